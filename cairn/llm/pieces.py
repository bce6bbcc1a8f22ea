"""SentencePiece encoding and decoding for merge-type vocabularies by an agenda of adjacent symbol pairs.

A text is a row of symbols, at first its characters behind a space. The agenda holds the adjacent pairs whose joint string
is a piece, ordered by the piece's score and then by place; the best pair becomes one symbol, and its pairs with both
neighbours come onto the agenda, until it is empty. Symbols that are no pieces are spelled in bytes.

No merge crosses two characters that stand side by side in no piece. There texts are cut, and the tokens of frequent
stretches are kept. The agendas of a batch's short new stretches are worked off side by side, in arrays. Of every Arrow batch, the stretches that weren't kept are checked against the sentencepiece library."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import arrow_batch, small_batches, table

#: Stretches of text whose tokens a worker keeps for the next time, twice (the ones before these, too): some 250 MB.
KEPT = 400_000
#: Characters up to which a stretch isn't cut further.
SHORT = 40
#: An agenda's entry is the rank of a piece above 40 bits of place.
PLACE = (1 << 40) - 1
#: Rank of a pair that is no piece, and the symbol of a character that has become part of one before.
NEVER, GONE = 1 << 30, -2
#: The sign for a space; kinds of pieces and of models in the file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields; integers as they are, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at : at + size]
        at += size


class Pieces:
    """A vocabulary of a model file, which must be of the merge type, spell unknown characters in bytes and leave texts as they are
    but for a space in front."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer = dict(fields(next(v for k, v in model if k == 2)))
        normalizer = dict(fields(next(v for k, v in model if k == 3)))
        if trainer.get(3, 1) != MERGES or not trainer.get(35):
            raise ValueError("the model must be of the merge type and have pieces for bytes")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model must put a space in front and change nothing else")
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.labels: list[bytes] = []  # what each id stands for in a text
        scores = {}
        for i, piece in enumerate(v for k, v in model if k == 1):
            spec = dict(fields(piece))
            name, kind = spec[1].decode(), spec.get(3, NORMAL)
            self.labels.append(b"")
            if kind == NORMAL:
                name = name.replace(SPACE, " ")
                self.ids[name], scores[name] = i, struct.unpack("<f", spec.get(2, b"\0\0\0\0"))[0]
                self.labels[i] = name.encode()
            elif kind == BYTE:
                self.bytes[int(name[3:5], 16)] = i
                self.labels[i] = bytes([int(name[3:5], 16)])
            elif kind == UNKNOWN:
                self.labels[i] = " ⁇ ".encode()
            elif kind != CONTROL:
                raise ValueError("pieces that a user defines aren't known here")
        self.byte_ids, self.piece_ids = frozenset(self.bytes.values()), frozenset(self.ids.values())
        order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: The place of each piece in the order of scores; pieces of one score share it.
        self.rank = {p: order[s] << 40 for p, s in scores.items()}
        self.beside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.by_words = not any(b == " " != a for a, b in self.beside)
        self.names = list(map(str, range(len(self.labels))))
        self._tables()
        self.kept: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.made: list[tuple[str, str]] = []  # stretches and ids that the library hasn't seen yet

    def merged(self, text: str) -> list[str]:
        """The symbols that no pair of the agenda is left of."""
        n, rank = len(text), self.rank
        symbols, after, before = [*text, ""], [*range(1, n + 1)], [*range(-1, n)]
        agenda = [rank[p] + i for i, p in enumerate(map(add, text, text[1:])) if p in rank]
        heapify(agenda)
        while agenda:
            pair = heappop(agenda)
            at = pair & PLACE
            left, to = symbols[at], after[at]
            if not left or to == n or rank.get(joint := left + symbols[to]) != pair - at:
                continue  # one of the two has become part of another symbol
            symbols[at], symbols[to] = joint, ""
            after[at] = end = after[to]
            before[end] = at
            if end < n and (p := joint + symbols[end]) in rank:
                heappush(agenda, rank[p] + at)
            if at and (p := symbols[start := before[at]] + joint) in rank:
                heappush(agenda, rank[p] + start)
        return [s for s in symbols if s]

    def _tables(self) -> None:
        """Symbols as numbers (a piece's is its id; other characters of pieces come behind), and the pairs that make a piece in order of
        their numbers."""
        names = [*self.ids]
        number = dict(self.ids)
        size = len(self.labels)
        for c in sorted({c for p in names for c in p} - self.ids.keys()):
            number[c] = size
            size += 1
        made = [(number[p[:i]] * size + number[p[i:]], self.rank[p] >> 40, number[p]) for p in names for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        made.sort()
        self.size = size
        self.pairs, self.pair_rank, self.pair_symbol = (np.array(x, np.int64) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 3
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i

    def _met(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NEVER where there is none) and symbols of the pieces that pairs make."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NEVER), self.pair_symbol[at]

    def side_by_side(self, stretches: list[str]) -> tuple[list[int], list[int]]:
        """tokens() of stretches that aren't empty, and where each one's end: in each round every one takes the best pair off its agenda, the first of several."""
        lengths = np.array([len(s) for s in stretches], np.int64)
        code = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
        symbol = self.symbol_of[code].astype(np.int64)
        owner = np.repeat(np.arange(len(stretches)), lengths)
        place = np.arange(len(code))
        final = symbol.copy()  # of each character the symbol that starts there, or GONE
        rank, made = np.full(len(code), NEVER), np.zeros(len(code), np.int64)
        if len(self.pairs):
            rank[:-1], made[:-1] = self._met(symbol[:-1], symbol[1:])
        rank[np.cumsum(lengths) - 1] = NEVER
        while len(rank):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            on = best >> 32 < NEVER
            at = (best & 0xFFFFFFFF)[on]
            symbol[at] = made[at]
            final[place[at]], final[place[at + 1]] = made[at], GONE
            stays = np.repeat(on, np.diff(start, append=len(rank)))  # the others are done
            stays[at + 1] = False
            moved = np.cumsum(stays) - 1
            at = moved[at]
            symbol, owner, place, rank, made = symbol[stays], owner[stays], place[stays], rank[stays], made[stays]
            if not len(rank):
                break
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(owner)]
                inside = owner[i] == owner[i + 1]
                found, piece = self._met(symbol[i], symbol[i + 1])
                rank[i], made[i] = np.where(inside, found, NEVER), piece
            rank[-1] = NEVER
        known = final != GONE
        ids, spelt = final[known], np.flatnonzero(known)
        odd = (ids < 0) | (ids >= len(self.labels))
        ends = np.searchsorted(spelt, np.cumsum(lengths))
        if not odd.any():
            return ids.tolist(), ends.tolist()
        parts = [[self.bytes[b] for b in chr(code[p]).encode()] if o else [i] for i, o, p in zip(ids.tolist(), odd.tolist(), spelt.tolist(), strict=True)]
        return [i for x in parts for i in x], np.cumsum([0, *(len(x) for x in parts)])[ends].tolist()

    def prepare(self, texts: list[str]) -> None:
        """Keeps the tokens of the short stretches of these texts that aren't kept yet."""
        new: set[str] = set()
        for text in texts:
            if text:
                new.update(self.rests(text))
        new -= self.kept.keys()
        short = [r for r in new if len(r) < SHORT and r not in self.older]
        if not short:
            return
        ids, ends = self.side_by_side([" " + r for r in short])
        names, labels, kept, made, at = list(map(self.names.__getitem__, ids)), list(map(self.labels.__getitem__, ids)), self.kept, self.made, 0
        for rest, to in zip(short, ends, strict=True):
            entry = ",".join(names[at:to]), b"".join(labels[at:to]).decode()
            at = to
            made.append((rest, entry[0]))
            kept[rest] = entry
        if len(kept) >= KEPT:
            self.older, self.kept = kept, {}

    def tokens(self, text: str) -> list[int]:
        """The ids of a stretch in which spaces are spaces, without one put in front."""
        symbols, at = [], 0
        if len(text) > SHORT:
            for i in range(1, len(text)):
                if text[i - 1 : i + 1] not in self.beside:
                    symbols += self.merged(text[at:i])
                    at = i
        symbols += self.merged(text[at:])
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            return [i for s in symbols for i in ([self.ids[s]] if s in self.ids else [self.bytes[b] for b in s.encode()])]

    def _entry(self, rest: str) -> tuple[str, str]:
        """Of a space and what follows: the ids, commas between them, and the text of the ids; kept for the next time unless it is long."""
        if (entry := self.older.get(rest)) is None:
            ids = self.tokens(" " + rest)
            entry = ",".join(map(str, ids)), b"".join(map(self.labels.__getitem__, ids)).decode()
            self.made.append((rest, entry[0]))
        if len(rest) < SHORT:
            if len(self.kept) >= KEPT:
                self.older, self.kept = self.kept, {}
            self.kept[rest] = entry
        return entry

    def rests(self, text: str) -> list[str]:
        """The stretches of a text that isn't empty, each without the space at its start."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.by_words:
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [s[1:] for s in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ")

    def entries(self, text: str) -> list[tuple[str, str]]:
        """Ids and text of the stretches of a text, each of which starts with a space; none for the empty text."""
        get, make = self.kept.get, self._entry
        return [get(r) or make(r) for r in self.rests(text)] if text else []

    def agrees(self, library) -> bool:
        """Whether the library makes the same ids of the stretches made since the last call, one behind the other."""
        inner = [m for m in self.made if m[0][-1:].strip(" ")]
        last = [m for m in self.made if not m[0][-1:].strip(" ")]  # only the end of a text can end in spaces
        self.made = []
        texts = [" ".join([rest for rest, _ in inner]), *("." + " " + rest for rest, _ in last)]
        ours = [",".join([ids for _, ids in inner]), *(self._entry(".")[0] + "," + ids for _, ids in last)]
        return all(str(x)[1:-1].replace(" ", "") == y for x, y in zip(library.encode(texts, num_threads=1), ours, strict=True))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.entries(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids, without the space that was put in front. Bytes that are no UTF-8 become U+FFFD, each for itself; control
        pieces are silent."""
        out, run = [], b""
        first = True
        for i in ids:
            label = self.labels[i]
            if i in self.byte_ids:
                run += label
                continue
            if run:
                out.append(spelled(run))
                first, run = False, b""
            if first and label[:1] == b" " and i in self.piece_ids:
                label, first = label[1:], False
            elif label:
                first = False
            out.append(label.decode())
        return "".join(out) + spelled(run)


def spelled(run: bytes) -> str:
    """A run of bytes as text; each byte that isn't part of a character becomes U+FFFD."""
    out = ""
    while run:
        try:
            return out + run.decode()
        except UnicodeDecodeError as bad:
            out += run[: bad.start].decode() + "�"
            run = run[bad.start + 1 :]
    return out


_LOADED: dict[str, Pieces] = {}
_LIBRARY: dict = {}


def pieces(path: str | None = None) -> Pieces:
    """The vocabulary of a file, once in each worker."""
    path = path or default_path()
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def library(path: str | None = None):
    import sentencepiece

    path = path or default_path()
    if path not in _LIBRARY:
        _LIBRARY[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LIBRARY[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("agrees", pa.bool_())])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, ids; one row for each row. Null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield arrow_batch(ENCODED, doc_id=part["doc_id"], ids=[p.encode(x or "") for x in part["text"].to_pylist()])

    return small_batches(_narrow(docs)).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids, ...) -> doc_id, text. Null lists give empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield arrow_batch(DECODED, doc_id=part["doc_id"], text=[p.decode(x or []) for x in part["ids"].to_pylist()])

    return small_batches(encoded.selectExpr("cast(doc_id as bigint) doc_id", "cast(ids as array<int>) ids")).mapInArrow(run, "doc_id bigint, text string")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs -> doc_id, n_tokens, ids_sha256, decoded_sha256, agrees: encode(), then decode(), in one task; only their digests leave it.

    agrees: whether the library makes the same ids of the stretches that the row's Arrow batch met first. One row for each row;
    null and empty texts have no tokens, and rows that repeat stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, lib = pieces(path), library(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for at in range(0, len(batch), 1024):
                p.prepare([x.as_py() for x in batch["text"][at : at + 1024]])
            for x in batch["text"]:
                found = p.entries(x.as_py() or "")
                own = ",".join([e[0] for e in found])
                n.append(own.count(",") + 1 if own else 0)
                ids.append(hashlib.sha256(own.encode()).hexdigest())
                decoded.append(hashlib.sha256("".join([e[1] for e in found])[1:].encode()).hexdigest())
            yield arrow_batch(DIGESTS, doc_id=batch["doc_id"], n_tokens=n, ids_sha256=ids, decoded_sha256=decoded, agrees=[p.agrees(lib)] * len(n))

    return small_batches(_narrow(docs)).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, agrees boolean")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the tokens of all documents; see token_digests()."""
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op13_pieces": op13_pieces}
SQL: dict[str, str] = {}
