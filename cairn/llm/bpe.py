"""BPE encoding and decoding by a token automaton.

The automaton of tokens: its state is what the last token leaves open. At first there is one state, from which
every symbol leads back to it. Each merge adds a gadget: the state behind its left part is copied without the arc of its
right part, the left part leads to the copy, and the merged token gets an arc wherever the left part has one, to the
state behind the right part. All tokens of a name lead to one state, so that the automaton is deterministic, and each
string has exactly one path, the one that BPE takes.

Words are read byte by byte by the automaton that follows from it: a state holds the token in which the path of what has
been read ends, and of each place from which a longer token may still come the last token before it. Its table is filled
in as texts ask for it. A word is encoded by one walk over its bytes and the end, without backtracking; the tokens are
those that the states name, from the last back to the first. Decoding emits the labels of the arcs."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import arrow_batch, small_batches, table, tidy

#: Stretches of text whose tokens a worker keeps for the next time, twice (the ones before these, too): some 40 MB.
KEPT_CHUNKS = 100_000
#: Rows of the table that a worker keeps before it starts anew: some 90 MB.
KEPT_STATES = 140_000
END = "</w>"
WORD_END = 256  # the symbol after a word's bytes
#: Letters and numbers that are newer than the Unicode version (16) by which the file's pattern splits, and upper-case
#: letters newer than Python's tables with their lower case.
NEWER_LETTERS = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A
    11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
    1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF
    2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
NEWER_NUMBERS = """
    11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6
"""
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
#: Bytes of characters before the first of these, and characters that are white space to Python but not to the file's pattern.
BELOW, SEPARATORS = bytes(range(0xE1)), "\x1c\x1d\x1e\x1f"
NEWER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_labels() -> list[str]:
    """The visible character of each byte: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def without(group: str, newer: str) -> str:
    """A set of the pattern's group without the ranges of code points."""
    return rf"[\p{{{group}}}--[{''.join('-'.join(chr(int(c, 16)) for c in r.split('-')) for r in newer.split())}]]"


class State(dict):
    """A row of the table: symbol -> State. token: in which what has been read ends, and its length; opened: of each
    place from which a token may go on, the last token before it << 32 | the node of what has been read since."""

    __slots__ = ("automaton", "token", "length", "opened")

    def __init__(self, automaton: Automaton, token: int, length: int, opened: tuple[int, ...]):
        self.automaton, self.token, self.length, self.opened = automaton, token, length, opened

    def __missing__(self, symbol: int) -> State:
        self[symbol] = to = self.automaton.step(self, symbol)
        return to


class Automaton:
    """The deterministic automaton of a merge list.

    A state of the automaton of tokens is (token, time): what stands behind the token once the merges up to that time are
    compiled. It is kept as what the gadgets changed: the arc that each took (by left part and arc), when each token came
    and from which parts."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.labels = {i: t for t, i in vocabulary.items()}
        size = max(vocabulary.values(), default=0) + 1
        self.came, self.left, self.right = [-1] * (size + 1), [-1] * size, [-1] * size
        self.never = len(merges)
        self.taken: dict[int, int] = {}
        for time, (a, b) in enumerate(merges):
            self._gadget(vocabulary[a], vocabulary[b], vocabulary[a + b], time)
        #: A tree of the tokens' symbols: node << 9 | symbol -> node; the token that each node completes, or -1.
        self.nodes: dict[int, int] = {}
        self.completed, self.goes_on = [-1], [False]
        symbols = {label: b for b, label in enumerate(byte_labels())}
        for t, i in vocabulary.items():
            name = t.removesuffix(END)
            if len(name) != 1 and self.came[i] < 0 or not all(c in symbols for c in name):
                continue  # no merge makes it
            node = 0
            for s in [*map(symbols.__getitem__, name), *[WORD_END] * (name != t)]:
                if (to := self.nodes.get(node << 9 | s)) is None:
                    to = self.nodes[node << 9 | s] = len(self.completed)
                    self.completed.append(-1)
                    self.goes_on.append(False)
                    self.goes_on[node] = True
                node = to
            self.completed[node] = i
        self.known: dict[tuple, State] = {}
        self.start = State(self, -1, 0, (size << 32,))  # nothing was taken from the token before a word's start

    def _gadget(self, a: int, b: int, merged: int, time: int) -> None:
        if self.came[merged] >= 0 or a << 32 | b in self.taken:
            raise ValueError("a merge must make a token of its own")
        self.taken[a << 32 | b] = time
        self.came[merged], self.left[merged], self.right[merged] = time, a, b

    def arc(self, state: int, token: int) -> bool:
        """Whether the token has an arc from the state behind the token `state`."""
        came, taken, until, none = self.came, self.taken, self.never, self.never + 1
        while True:
            time = came[token]
            while True:  # back to the states that were there when the token came
                if taken.get(state << 32 | token, none) <= until:
                    return False
                if came[state] <= time:
                    break
                until = came[state] - 1
                state = self.right[state]
            if time < 0:
                return True
            until = min(until, time)  # there it has an arc where its left part has one
            token = self.left[token]

    def step(self, state: State, symbol: int) -> State:
        """The table's entry: where the symbol leads from the state. One token ends here, as every string has one path."""
        token, length, opened = -1, 0, []
        for place in state.opened:
            if (to := self.nodes.get((place & 0xFFFFFFFF) << 9 | symbol)) is not None:
                if self.goes_on[to]:
                    opened.append(place >> 32 << 32 | to)
                if token < 0 and (t := self.completed[to]) >= 0 and self.arc(place >> 32, t):
                    token, length = t, len(self.labels[t].removesuffix(END))
        if token < 0:
            raise ValueError("a symbol of this word isn't in the vocabulary")
        key = (token, length) if symbol == WORD_END else (token, length, *opened)
        if (to := self.known.get(key)) is None:
            if len(self.known) >= KEPT_STATES:
                self.known.clear()
                self.start.clear()  # a walk goes on over the rows that it holds
            to = self.known[key] = State(self, token, length, () if symbol == WORD_END else (*opened, token << 32))
        return to

    def word(self, symbols: bytes) -> list[int]:
        """The tokens of a pre-split word, not empty."""
        state, walk = self.start, []
        for s in symbols:
            state = state[s]
            walk.append(state)
        state = state[WORD_END]
        path, at = [state.token], len(walk) - state.length
        while at:
            state = walk[at - 1]
            path.append(state.token)
            at -= state.length
        return path[::-1]


class Tokenizer:
    """Normalisation, splitting and special tokens around the automaton, as the file gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = Automaton(dict(model["vocab"]), [tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\p{L}", without("L", NEWER_LETTERS)).replace(r"\p{N}", without("N", NEWER_NUMBERS)), regex.V1)
        self.newer_upper = re.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")
        self.space = regex.compile(r"\s+")
        self.names = {str(i): t for i, t in self.labels.items()}
        self.chunks: dict[str, str] = {}
        self.older: dict[str, str] = {}  # a generation before

    def _chunk(self, chunk: str) -> str:
        """The ids of the tokens of a stretch without white space, spaces between them; kept for the next time unless it is long."""
        if (entry := self.older.get(chunk)) is None:
            pieces = [chunk] if chunk.isalpha() else self.pieces.findall(chunk)
            if pieces == [chunk]:
                entry = " ".join(map(str, self.automaton.word(chunk.encode())))
            else:
                entry = " ".join([self.chunks.get(p) or self._chunk(p) for p in pieces])
        if len(chunk) < 100:
            if len(self.chunks) >= KEPT_CHUNKS:
                self.older = self.chunks.copy()
                self.chunks.clear()
            self.chunks[chunk] = entry
        return entry

    def entries(self, text: str) -> list[str]:
        """The ids of the tokens of each stretch of text between white space; empty for stretches of no token."""
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(str(self.special[part]))
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            part = part.replace("Σ", "σ").lower()  # each character by itself: no final sigma
            if not part.isascii() and part.encode().translate(None, BELOW) and self.newer_upper.search(part):
                part = part.translate(NEWER_LOWER)
            get, make = self.chunks.get, self._chunk
            chunks = part.split()
            if any(c in part for c in SEPARATORS):  # white space to Python alone
                chunks = [c for c in self.space.split(part) if c]
            out += [get(c) or make(c) for c in chunks]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.entries(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids; the file names no decoder, which joins them by spaces."""
        return " ".join(map(self.labels.__getitem__, ids))


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str | None = None) -> Tokenizer:
    """The compiled tokenizer of a file, once in each worker."""
    path = path or default_path()
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, ids; one row for each row. Null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield arrow_batch(ENCODED, doc_id=part["doc_id"], ids=[t.encode(x or "") for x in part["text"].to_pylist()])

    return small_batches(_narrow(docs)).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids, ...) -> doc_id, text: the labels of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield arrow_batch(DECODED, doc_id=part["doc_id"], text=[t.decode(x or []) for x in part["ids"].to_pylist()])

    return small_batches(encoded.selectExpr("cast(doc_id as bigint) doc_id", "cast(ids as array<int>) ids")).mapInArrow(run, "doc_id bigint, text string")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs -> doc_id, n_tokens, ids_sha256, decoded_sha256: encode(), then decode(), in one task; only their digests leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for x in batch["text"]:
                ids = " ".join(filter(None, t.entries(x.as_py() or "")))
                tokens = ids.split()
                rows[0].append(len(tokens))
                rows[1].append(hashlib.sha256(ids.encode()).hexdigest())
                rows[2].append(hashlib.sha256(" ".join(map(t.names.__getitem__, tokens)).encode()).hexdigest())
            yield arrow_batch(DIGESTS, doc_id=batch["doc_id"], n_tokens=rows[0], ids_sha256=rows[1], decoded_sha256=rows[2])

    return small_batches(_narrow(docs)).mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the tokens of all documents; see token_digests()."""
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe": op10_bpe}
SQL: dict[str, str] = {}
