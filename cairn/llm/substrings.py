"""Removal of repeated byte strings by sharded suffix arrays.

Every 400-byte string is filed under its smallest 64-byte hash (its anchor), so equal strings are
filed alike. The starts of a document that follow each other under one anchor are a segment; only
segments whose anchor occurs again can hold repeats. Their distinct texts go to shards by anchor,
each shard sorts its suffixes (Larsson-Sadakane), takes common prefixes (Kasai) and finds the starts
that share 400 bytes with another. An anchor with more text than a shard is split, and what a piece
leaves open is looked up in its sibling pieces' suffix arrays by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import U64, arrow_batch, carried, carried_sql, mix, slices, small_batches, span_hashes, staged, table, tidy, uncarried, with_carried
from cairn.llm.suffix import bytes_at, common_prefixes, find, suffix_array

LENGTH, ANCHOR = 400, 64
#: Bytes of distinct segment text in a shard; a shard's arrays take about 80 times that.
SHARD_BYTES = 1 << 21
SEGMENTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("seg", pa.int64()), ("multi", pa.bool_())])
TEXTS = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("n", pa.int32()), ("copies", pa.int64()), ("bytes", pa.binary())])
RANGES = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("sub", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("open", pa.bool_())])
_RANGES = "anchor bigint, seg bigint, sub int, a int, b int, open boolean"


def window_minima(buf: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchor-long strings at each position, and for each start the least of them within `length` bytes."""
    h, size = bytes_at(np.concatenate((buf, np.zeros(8, np.uint8)))), 8
    while size < anchor:
        step = min(size, anchor - size)
        h = (h ^ (h >> U64(31)))[: len(h) - step] * U64(0x9FB21C651E98DF25) + h[step:] * U64(0xD6E8FEB86659FD93)
        size += step
    h = mix(h[: len(buf) - anchor + 1])
    width, m, have = length - anchor + 1, h, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return h, m


def segments(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """The runs of starts of each text that share an anchor: text number, first start in it, starts, anchor, hash of
    the bytes they cover, and whether the anchor occurs more than once in them."""
    empty = {c: np.zeros(0, np.int64) for c in ("doc", "start", "n", "anchor", "seg", "multi")}
    if len(buf) < length:
        return empty
    h, m = window_minima(buf, length, anchor)
    size = np.diff(off)
    long = np.flatnonzero(size >= length)
    mark = np.zeros(len(m) + 1, np.int8)
    mark[off[long]] += 1
    mark[off[long] + size[long] - length + 1] -= 1
    valid = np.cumsum(mark[:-1]).astype(bool)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (m[1:] != m[:-1])
    s = np.flatnonzero(new)
    if not len(s):
        return empty
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (m[1:] != m[:-1])
    e = np.flatnonzero(last)
    v = m[s]
    view = np.lib.stride_tricks.sliding_window_view(h, length - anchor + 1)
    multi = np.zeros(len(s), bool)
    for at in range(0, len(s), 1024):
        k = slice(at, at + 1024)
        one, two = view[s[k]] == v[k, None], view[e[k]] == v[k, None]
        multi[k] = (one.sum(axis=1) > 1) | (two.sum(axis=1) > 1) | (one.argmax(axis=1) + s[k] != two.argmax(axis=1) + e[k])
    doc = np.searchsorted(off, s, "right") - 1
    return {"doc": doc, "start": s - off[doc], "n": e - s + 1, "anchor": v.view(np.int64), "seg": span_hashes(buf, s, e + length).view(np.int64), "multi": multi}


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text", 1 << 19):
                s = segments(buf, off, length, min(ANCHOR, length))
                doc = pa.array(s["doc"])
                yield arrow_batch(SEGMENTS, key=part["key"].take(doc), doc_id=part["doc_id"].take(doc), **{c: s[c] for c in ("start", "n", "anchor", "seg")}, multi=s["multi"].astype(bool))

    return run


def _texts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                data = text.as_py() or b""
                for w in wanted.as_py():
                    piece = data[w["start"] : w["start"] + w["n"] + length - 1]
                    h = span_hashes(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)])).view(np.int64)[0]
                    if h == w["seg"]:  # another text with the same key has other bytes here
                        rows.append((w["anchor"], w["seg"], w["n"], w["copies"], piece))
                if len(rows) > 2000:
                    yield arrow_batch(TEXTS, **dict(zip(TEXTS.names, zip(*rows, strict=True), strict=True)))
                    rows = []
            if rows:
                yield arrow_batch(TEXTS, **dict(zip(TEXTS.names, zip(*rows, strict=True), strict=True)))

    return run


class Shard:
    """The sorted suffixes of a shard's distinct segments."""

    def __init__(self, rows: pa.Table, length: int):
        rows = rows.take(pa.array(np.unique(np.stack((rows["anchor"].to_numpy(), rows["seg"].to_numpy())), axis=1, return_index=True)[1]))
        self.rows, self.length = rows, length
        pieces = rows["bytes"].to_pylist()
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
        self.n = rows["n"].to_numpy().astype(np.int64)
        sa, _ = suffix_array(self.text.astype(np.int64), 8, len(self.text))  # Kasai's bound needs the full order
        mark = np.zeros(len(self.text) + 1, np.int8)
        mark[self.at[:-1]] += 1
        np.subtract.at(mark, self.at[:-1] + self.n, 1)
        self.valid = np.cumsum(mark[:-1]).astype(bool)
        self.sa = sa[self.valid[sa]]

    def repeated(self) -> np.ndarray:
        """Whether each position of the text is a start whose string occurs again in the shard, or in a copy of its segment."""
        before = np.full(len(self.text), -2, np.int64)
        before[self.sa[1:]], before[self.sa[:1]] = self.sa[:-1], -1
        lanes = [(int(a) + i, int(a) + min(i + 256, int(n))) for a, n in zip(self.at[:-1], self.n, strict=True) for i in range(0, int(n), 256)]
        prefix = common_prefixes(bytes_at(np.concatenate((self.text, np.zeros(self.length + 16, np.uint8)))), before, lanes, self.length)
        full = prefix[self.sa] >= self.length
        out = np.zeros(len(self.text), bool)
        out[self.sa[full]] = True
        out[self.sa[:-1][full[1:]]] = True
        copied = self.rows["copies"].to_numpy() > 1
        for i in np.flatnonzero(copied):
            out[self.at[i] : self.at[i] + self.n[i]] = True
        return out

    def holds(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Whether the strings of data from each start occur in this shard, by binary search."""
        text, sa = self.text.astype(np.int16), self.sa
        own = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8).astype(np.int16), self.length)
        found = np.zeros(len(starts), bool)
        for k in range(0, len(starts), 1024):
            lo, hi = find(text, sa, own[starts[k : k + 1024]], np.full(len(starts[k : k + 1024]), self.length))
            found[k : k + 1024] = hi > lo
        return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sort_shard(length: int):
    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, length)
        split = rows["pieces"][0].as_py() > 1
        sub = rows["sub"][0].as_py()
        out: list[tuple] = []
        repeated = shard.repeated()
        for i, (anchor, seg) in enumerate(zip(shard.rows["anchor"].to_pylist(), shard.rows["seg"].to_pylist(), strict=True)):
            own = repeated[shard.at[i] : shard.at[i] + shard.n[i]]
            out += [(anchor, seg, sub, a, b, False) for a, b in zip(*_runs(own), strict=True)]
            if split:
                out += [(anchor, seg, sub, a, b, True) for a, b in zip(*_runs(~own), strict=True)]
        return pa.Table.from_batches([arrow_batch(RANGES, **dict(zip(RANGES.names, zip(*out, strict=True), strict=True)))] if out else [], RANGES)

    return run


def _look_up(length: int):
    def run(rows: pa.Table) -> pa.Table:
        query = np.array(rows["query"].to_pylist(), bool)
        out: list[tuple] = []
        if query.any() and not query.all():
            shard = Shard(rows.filter(pa.array(~query)), length)
            for q in rows.filter(pa.array(query)).to_pylist():
                found = shard.holds(q["bytes"], np.arange(q["a"], q["b"]))
                out += [(q["anchor"], q["seg"], q["sub"], q["a"] + a, q["a"] + b, False) for a, b in zip(*_runs(found), strict=True)]
        return pa.Table.from_batches([arrow_batch(RANGES, **dict(zip(RANGES.names, zip(*out, strict=True), strict=True)))] if out else [], RANGES)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, text (binary), spans and the columns to carry. spans: the byte ranges (a, b) of `text`, possibly overlapping, whose
    strings of `length` bytes also start elsewhere. One row for each row; null text is empty; rows that repeat
    another row's text repeat all its strings."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *carried(carry))
    handed_on = [c for c in base.columns if c.startswith("carried_")]
    base = base.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text", *handed_on)
    found = staged(small_batches(base.filter(F.octet_length("text") >= length).select("key", "doc_id", "text")).mapInArrow(tidy(_segments(length)), "key bigint, doc_id bigint, start int, n int, anchor bigint, seg bigint, multi boolean"), "segments")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("times"), F.min("seg").alias("s0"), F.max("seg").alias("s1"), F.max("multi").alias("within"))
    anchors = anchors.filter("times > 1 or within").select("anchor", (F.col("within") | (F.col("s0") != F.col("s1"))).alias("sort"))
    candidates = staged(found.drop("multi").join(anchors, "anchor"), "candidates")
    # Segments whose anchor stands in other texts, too: one instance of each text, and how many it stands for.
    reps = candidates.filter("sort").groupBy("anchor", "seg").agg(F.first("key").alias("key"), F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n").alias("n"), F.count("*").alias("copies"))
    wanted = reps.groupBy("key", "doc_id").agg(F.collect_list(F.struct("anchor", "seg", "start", "n", "copies")).alias("wanted"))
    texts = base.join(wanted.hint("shuffle_hash"), ["key", "doc_id"]).select("text", "wanted").mapInArrow(tidy(_texts(length)), "anchor bigint, seg bigint, n int, copies bigint, bytes binary")
    texts = staged(texts, "texts")
    size = F.octet_length("bytes").cast("bigint")
    total = texts.agg(F.sum(size)).first()[0] or 0
    shards = int(total // shard_bytes + 1)
    per = texts.groupBy("anchor").agg(F.ceil(F.sum(size) / shard_bytes).cast("int").alias("pieces"))
    dealt = texts.join(per, "anchor").withColumn("sub", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("seg"), "pieces").cast("int")).otherwise(F.lit(0)))
    dealt = dealt.withColumn("shard", F.when(F.col("pieces") > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))))
    ranges = staged(dealt.groupBy("shard", "sub", (F.col("pieces") > 1).alias("own")).applyInArrow(_sort_shard(length), _RANGES), "ranges")
    if not (left := ranges.filter("open")).isEmpty():
        pieces = dealt.filter("pieces > 1").select("anchor", "seg", "n", "copies", "bytes", "sub", "pieces")
        asked = left.drop("open").join(pieces.drop("sub", "n", "copies"), ["anchor", "seg"])
        asked = asked.select("anchor", "seg", "bytes", "sub", "a", "b", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("place")).filter("place <> sub")
        asked = asked.select("anchor", "place", F.col("sub").alias("origin"), "seg", "sub", "a", "b", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("copies"), "bytes", F.lit(True).alias("query"))
        blocks = asked.select("anchor", "place", "origin").distinct()
        held = pieces.join(blocks.withColumnRenamed("place", "sub"), ["anchor", "sub"]).select("anchor", F.col("sub").alias("place"), "origin", "seg", "sub", F.lit(0).alias("a"), F.lit(0).alias("b"), "n", "copies", "bytes", F.lit(False).alias("query"))
        ranges = ranges.filter("not open").unionByName(asked.unionByName(held).groupBy("anchor", "place", "origin").applyInArrow(_look_up(length), _RANGES))
    ranges = ranges.filter("not open").select("anchor", "seg", "a", "b")
    whole = candidates.filter("not sort").select("key", "doc_id", F.col("start").alias("a"), (F.col("start") + F.col("n") + (length - 1)).alias("b"))
    parts = candidates.filter("sort").select("anchor", "seg", "key", "doc_id", "start").join(ranges, ["anchor", "seg"]).select("key", "doc_id", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + (length - 1)).alias("b"))
    # Rows that repeat doc_id and text bring the same spans; one list of distinct ones serves them all.
    spans = whole.unionByName(parts).groupBy("key", "doc_id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = staged(spans, "spans")
    out = base.join(spans.hint("shuffle_hash"), ["key", "doc_id"], "left")
    return out.select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), "text", "spans", *handed_on)


def removed_runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint maximal ranges of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"], batch["spans"], strict=True):
            data = text.as_py()
            runs = removed_runs(spans.as_py())
            rows.append((doc_id, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()))
        yield arrow_batch(DIGESTS, **dict(zip(DIGESTS.names, zip(*rows, strict=True), strict=True))) if rows else DIGESTS.empty_table().to_batches()[0]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            yield with_carried(arrow_batch(KEPT, doc_id=part["doc_id"], text=[kept_bytes(t.as_py(), removed_runs(s.as_py())).decode("utf-8", "ignore") for t, s in zip(part["text"], part["spans"], strict=True)]), part)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with its columns, text without the repeated strings; bytes of characters of which a part was removed go, too."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    spans = repeated_spans(docs, carry=carry)
    return uncarried(spans.mapInArrow(tidy(_kept), "doc_id bigint, text string" + carried_sql(spans)), carry).select(*docs.columns)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strings that start elsewhere, too, remove from all documents; see repeated_spans()."""
    return repeated_spans(table(spark, sf_dir, "documents")).mapInArrow(_digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


QUERIES = {"op4_suffix": op4_suffix}
SQL: dict[str, str] = {}
