"""Tokens of two vocabularies aligned by the bytes they cover, with the documents that link each pair of tokens.

Where a token of A and a token of B both end, a text is cut into groups; all A tokens of a group are linked with all its B
tokens. A block of texts becomes a dictionary of its distinct groups, and of each text only counts of them stay. The
dictionaries of all blocks become one, each distinct group is expanded to its links once, and the number of documents that hold
the group counts for all of them; documents that hold a pair by several groups are taken off again. What comes out for a
group goes back to the blocks by the group's key, and to their texts by its number in the block."""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import pieces
from cairn.llm.bpe import byte_labels
from cairn.llm.common import arrow_batch, small_batches, staged, table

#: Words whose groups a worker keeps for the next time, twice (the ones before these, too): some 100 MB.
KEPT = 150_000
#: Characters of a text that are cut into words, and of new words that are encoded, at a time.
STRETCH = 1 << 20
#: Fixed value: how texts are split before bytes are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Both vocabularies start anew here: a space between characters that aren't white.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A text in which some spaces stand otherwise.
ODD = re.compile(r"\A\s|\s\Z| \s|\s ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words(text: str) -> list[str]:
    """A text cut at CUT, without the spaces there."""
    return CUT.split(text) if ODD.search(text) else text.split(" ")


def stretches(text: str) -> Iterator[str]:
    """Parts of a text of about STRETCH characters, cut at CUT."""
    at = 0
    while len(text) - at > STRETCH and (cut := CUT.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


class Word:
    """The groups of a word with a space in front, `a1,a2|b1;a3|b2`, and numbers of tokens and links; groups is None where the tokens' bytes
    aren't the word's."""

    __slots__ = ("a", "b", "groups", "links")

    def __init__(self, groups: str | None, a: int = 0, b: int = 0, links: int = 0):
        self.groups, self.a, self.b, self.links = groups, a, b, links


class Aligner:
    """Two vocabularies, loaded once in each worker."""

    def __init__(self, path_a: str, path_b: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b, self.library = pieces.Pieces(path_b), pieces.library(path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_labels())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (spec["model"]["vocab"] | special).items()}
        self.bytes_a = [names[i].encode() if names[i] in special else bytes(byte[c] for c in names[i]) for i in range(len(names))]
        self.bytes_b = self.b.labels
        self.ranks = self._ranked(spec)
        self.size_a, self.size_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        self.kept: dict[str, Word] = {}
        self.older: dict[str, Word] = {}
        self.linked: dict[str, tuple[int, ...]] = {}

    def _ranked(self, spec: dict):
        """The same vocabulary for a quicker library, if its merges stand in the order of their ids and texts are split as usual; else None."""
        vocabulary, split = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not spec.get("normalizer")
        if not usual or merged != sorted(set(merged)) or min(merged, default=1 << 30) <= max((vocabulary[c] for c in vocabulary if len(c) == 1), default=-1):
            return None
        import tiktoken

        own = set(vocabulary.values()) - {t["id"] for t in spec["added_tokens"]}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in own}, special_tokens={})

    def _tokens(self, text: str, some: list[str]) -> tuple[list[int], list[int]]:
        if len(some) > 1 and self.ranks:  # short words without odd spaces
            return self.ranks.encode_ordinary(" " + text), self.library.encode(text, num_threads=1)
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        self.b.made = []  # the library's check of these belongs to `pieces`
        return a, b

    def _exact(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = (" " + text).encode()
        return all(b"".join(map(own.__getitem__, ids)) == whole for own, ids in ((self.bytes_a, a), (self.bytes_b, b)))

    def aligned(self, some: list[str]) -> list[Word]:
        """The groups of words, that stand one behind the other in one text."""
        text = " ".join(some)
        a, b = self._tokens(text, some)
        if not self._exact(text, a, b):
            return [Word(None)] if len(some) == 1 else [w for s in some for w in self.aligned([s])]
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        bounds = np.cumsum([len(s.encode()) + 1 for s in some])
        last = np.searchsorted(ends, bounds)
        if not (ends[last] == bounds).all():
            raise ValueError("a vocabulary has tokens across words")
        links = np.cumsum(np.diff(to_a, prepend=0) * np.diff(to_b, prepend=0))
        sides = []
        for ids, to in ((a, to_a.tolist()), (b, to_b.tolist())):
            names = list(map(str, ids))
            sides.append([names[i] if j == i + 1 else ",".join(names[i:j]) for i, j in zip([0, *to], to, strict=False)])
        keys = [f"{x}|{y}" for x, y in zip(*sides, strict=True)]
        at = (last + 1).tolist()
        many = zip(*(np.diff(x[last], prepend=0).tolist() for x in (to_a, to_b, links)), strict=True)
        return [Word(";".join(keys[i:j]), *n) for i, j, n in zip([0, *at], at, many, strict=False)]

    def known(self, some: list[str]) -> list[Word]:
        """The groups of distinct words; those that are new are encoded together."""
        old, kept = self.older, self.kept
        found = [kept.get(w) or old.get(w) for w in some]
        regular, size, queues, new = [], 0, [], {}
        for w in (w for w, x in zip(some, found, strict=True) if x is None):
            if len(w) >= pieces.SHORT or not w or w[0].isspace() or w[-1].isspace() or pieces.SPACE in w:
                queues.append([w])
                continue
            regular.append(w)
            size += len(w)
            if size > STRETCH // 8:
                queues.append(regular)
                regular, size = [], 0
        for queue in [*queues, regular]:
            new.update(zip(queue, self.aligned(queue) if queue else [], strict=True))
        kept.update((w, x) for w, x in new.items() if len(w) < pieces.SHORT)
        kept.update((w, x) for w, x in zip(some, found, strict=True) if x is not None)
        if len(kept) >= KEPT:
            self.older, self.kept = kept, {}
        return [x or new[w] for w, x in zip(some, found, strict=True)]

    def pairs(self, key: str) -> tuple[int, ...]:
        """The distinct links of a group, A << 32 | B."""
        if (own := self.linked.get(key)) is None:
            a, _, b = key.partition("|")
            own = tuple({int(x) << 32 | int(y) for x in set(a.split(",")) for y in set(b.split(","))})
            if len(self.linked) >= KEPT:
                self.linked.clear()
            self.linked[key] = own
        return own


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str | None = None, path_b: str | None = None) -> Aligner:
    paths = path_a or default_path(), path_b or pieces.default_path()
    if paths not in _LOADED:
        _LOADED[paths] = Aligner(*paths)
    return _LOADED[paths]


def numbered() -> defaultdict:
    """Gives each new key the next number."""
    out: defaultdict = defaultdict()
    out.default_factory = out.__len__
    return out


#: Rows of a block: its texts, its distinct groups with the number of texts that hold each, and the pairs that texts hold by several
#: groups with how many they are too many.
TEXT, GROUP, AGAIN = 0, 1, 2
BLOCKS = pa.schema([
    ("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("numbers", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("number", pa.int32()), ("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()),
])
BLOCKS_SQL = "kind int, block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, numbers array<int>, times array<int>, number int, key string, a int, b int, docs bigint"


def _rows(n: int, kind: int, **columns) -> pa.RecordBatch:
    own = {"kind": np.full(n, kind, np.int32)} | columns
    return arrow_batch(BLOCKS, **{f.name: own.get(f.name, pa.nulls(n, f.type)) for f in BLOCKS})


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, pa.int32()))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1 of all i."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def block(own: Aligner, number: int, doc_ids: pa.Array, texts: Iterator[str | None]) -> Iterator[pa.RecordBatch]:
    """The rows of a block of texts."""
    index = numbered()
    used = [np.concatenate([np.fromiter(map(index.__getitem__, words(s)), np.int64) for s in stretches(t)]) if t else np.zeros(0, np.int64) for t in texts]
    found = own.known(list(index))
    bad = np.array([w.groups is None for w in found], bool)
    used = [u if not bad[u].any() else u[:0] for u in used]
    groups = numbered()
    split = [w.groups.split(";") if w.groups else () for w in found]
    of_word = np.array([groups[k] for keys in split for k in keys], np.int64)
    n_words = np.array(list(map(len, split)), np.int64)
    starts = np.cumsum(n_words) - n_words
    n_a, n_b, links = (np.array([getattr(w, name) for w in found], np.int64) for name in ("a", "b", "links"))
    digests, numbers, times = [], [], []
    for u in used:
        digest = hashlib.sha256()
        for at in range(0, len(u), STRETCH // 8):
            digest.update(((";" if at else "") + ";".join([found[i].groups for i in u[at : at + STRETCH // 8].tolist()])).encode())
        digests.append(digest.hexdigest() if len(u) else "")
        distinct, count = np.unique(u, return_counts=True)
        each = of_word[_spread(starts[distinct], n_words[distinct])]
        sums = np.bincount(each, np.repeat(count, n_words[distinct])) if len(each) else np.zeros(0)
        held = np.flatnonzero(sums)
        numbers.append(held.astype(np.int32))
        times.append(sums[held].astype(np.int32))
    sizes = np.array([len(x) for x in numbers], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *numbers])
    totals = {name: [int(own[u].sum()) for u in used] for name, own in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_words), ("n_links", links))}
    n = len(used)
    yield _rows(n, TEXT, block=np.full(n, number), doc_id=doc_ids, groups_sha256=digests, numbers=_lists(flat, np.cumsum(sizes)), times=_lists(np.concatenate([np.zeros(0, np.int32), *times]), np.cumsum(sizes)), **totals)
    if not len(flat):
        return
    holders = np.bincount(flat, minlength=len(groups))
    own_groups = np.flatnonzero(holders)  # some may be in texts without tokens only
    keys = list(groups)
    yield _rows(len(own_groups), GROUP, block=np.full(len(own_groups), number), number=own_groups, key=[keys[i] for i in own_groups.tolist()], docs=holders[own_groups])
    pairs = [own.pairs(k) for k in keys]
    n_pairs = np.array([len(p) for p in pairs], np.int64)
    distinct, of_group = np.unique(np.array([x for p in pairs for x in p], np.int64), return_inverse=True)
    texts_of = np.repeat(np.arange(n), sizes)
    held = texts_of.repeat(n_pairs[flat]) * len(distinct) + of_group[_spread((np.cumsum(n_pairs) - n_pairs)[flat], n_pairs[flat])]
    held.sort()
    again = np.bincount(held[1:][held[1:] == held[:-1]] % len(distinct), minlength=len(distinct))
    more = np.flatnonzero(again)
    yield _rows(len(more), AGAIN, a=distinct[more] >> 32, b=distinct[more] & 0xFFFFFFFF, docs=again[more])


RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _valued(texts: pa.Table, groups: pa.Table) -> pa.Table:
    """The texts of a block with the sums over their groups."""
    texts, groups = texts.combine_chunks(), groups.combine_chunks()
    number = groups["number"].to_numpy()
    size = int(number.max()) + 1 if len(number) else 1
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(texts["numbers"]).to_numpy())))
    flat, times = (np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in texts[name].chunks)]).astype(np.int64) for name in ("numbers", "times"))
    out = {}
    for name in ("n_best", "count_sum"):
        value = np.zeros(size, np.int64)
        value[number] = groups[name].to_numpy()
        total = np.concatenate(([0], np.cumsum(value[flat] * times)))
        out[name] = total[offsets[1:]] - total[offsets[:-1]]
    return pa.table([pa.array(out[f.name]) if f.name in out else texts[f.name] for f in RESULT], schema=RESULT)


def links(groups: DataFrame) -> DataFrame:
    """groups (key, docs) -> key, docs, a, b, times: each pair of a group once, with how often it is there."""
    sides = F.split("key", r"\|")
    both = groups.withColumn("as", F.split(sides[0], ",").cast("array<int>")).withColumn("bs", F.split(sides[1], ",").cast("array<int>"))
    each = both.withColumn("a", F.explode(F.array_distinct("as"))).withColumn("b", F.explode(F.array_distinct("bs")))
    times = F.size(F.filter("as", lambda x: x == F.col("a"))) * F.size(F.filter("bs", lambda x: x == F.col("b")))
    return each.select("key", "docs", "a", "b", times.cast("bigint").alias("times"))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, ...) -> the rows of all blocks, and the pairs: a, b, docs (how many documents hold it linked), best (whether
    no other pair of a has more). Both are staged; see alignment()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        base = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            if len(batch):
                yield from block(own, base + i, batch["doc_id"], (x.as_py() for x in batch["text"]))

    narrow = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    blocks = staged(small_batches(narrow).mapInArrow(run, BLOCKS_SQL), "blocks")  # block numbers hold once written
    groups = blocks.filter(F.col("kind") == GROUP).groupBy("key").agg(F.sum("docs").alias("docs"))
    again = blocks.filter(F.col("kind") == AGAIN).select("a", "b", (-F.col("docs")).alias("docs"))
    pairs = staged(links(groups).select("a", "b", "docs").union(again).groupBy("a", "b").agg(F.sum("docs").alias("docs")), "pairs")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return blocks, pairs.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row for each row.

    Texts that are null or empty, or that a vocabulary doesn't spell byte by byte, have no tokens: zeros and an empty
    digest. Every row is a document of its own, also where it repeats another or its id is null."""
    blocks, pairs = aligned(docs, path_a, path_b)
    groups = blocks.filter(F.col("kind") == GROUP).select("key").distinct().withColumn("docs", F.lit(0))
    counted = links(groups).join(pairs.withColumnRenamed("docs", "count"), ["a", "b"])
    values = counted.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    own = blocks.filter(F.col("kind") == GROUP).select("block", "number", "key").join(values, "key").select(F.col("block").alias("of_block"), "number", "n_best", "count_sum")
    texts = blocks.filter(F.col("kind") == TEXT).select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "numbers", "times")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return texts.groupBy("block").cogroup(own.groupBy("of_block")).applyInArrow(_valued, schema)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of the tokens of all documents; see alignment()."""
    return alignment(table(spark, sf_dir, "documents"))


QUERIES = {"op11_align": op11_align}
SQL: dict[str, str] = {}
