"""Benchmark decontamination: suffix arrays over the training words, in which every window of
the benchmark is found by binary search; then documents with matches go.

A document shard is a slice of a task's batches. Words that no benchmark item has can't be part
of a match, so a shard's suffix array covers the runs between them. Nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import LOWER, NOT_ALNUM, carried, carried_sql, slices, small_batches, span_hashes, table, tidy, uncarried, word_spans
from cairn.llm.suffix import find, suffix_array

WINDOW = 10
#: Bytes of benchmark text that are broadcast at a time; a larger benchmark takes more passes over the documents' maps.
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20


class Windows:
    """The distinct windows of a block of items as rows of word numbers, and where they stand in the items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        texts = [(t or "").encode() for _, t in items]
        buf = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts, ends, item = word_spans(buf, off, NOT_ALNUM)
        h = span_hashes(buf, starts, ends) if len(buf) else np.zeros(0, np.uint64)
        self.vocabulary, number = np.unique(h, return_inverse=True)
        number = number.astype(np.int64) + 1
        count = np.bincount(item, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        first = np.concatenate(([0], np.cumsum(count)))
        rows, size, place, owner = [], [], [], []
        for i, n in enumerate(count):
            for at in range(max(1, n - window + 1) if n else 0):
                w = number[first[i] + at : first[i] + min(at + window, n)]
                rows.append(np.pad(w, (0, window - len(w))))
                size.append(len(w))
                place.append(first[i] + i + at)  # a gap after each item: matches don't run from one into the next
                owner.append(i)
        self.names = [x for x, _ in items]
        rows = np.array(rows, np.int64).reshape(-1, window)
        self.rows, inverse = np.unique(rows, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        self.size = (self.rows > 0).sum(axis=1)
        order = np.argsort(inverse, kind="stable")
        self.at = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(self.rows))))).astype(np.int64)
        self.place, self.owner = np.array(place, np.int64)[order], np.array(owner, np.int64)[order]
        self.bits = max(1, int(len(self.vocabulary)).bit_length())

    def matches(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Of each document of a shard: number of words; of all matches: (document, item, first word, words), longest runs."""
        buf = LOWER[buf]
        starts, ends, doc = word_spans(buf, off, NOT_ALNUM)
        n_words = np.bincount(doc, minlength=len(off) - 1)
        none = np.zeros(0, np.int64)
        if not len(self.rows) or not len(starts):
            return n_words, [none] * 4, none, none
        h = span_hashes(buf, starts, ends)
        near = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[near] == h
        # Runs of known words within a document that are as long as the shortest window at least.
        first_of_doc = np.concatenate(([0], np.cumsum(n_words)))
        begin = known & ~np.concatenate(([False], known[:-1]))
        begin[first_of_doc[:-1][n_words > 0]] |= known[first_of_doc[:-1][n_words > 0]]
        a = np.flatnonzero(begin)
        stop = np.flatnonzero(~known)
        b = np.minimum(np.concatenate((a[1:], [len(known)])), np.concatenate((stop, [len(known)]))[np.searchsorted(stop, a)]) if len(a) else a
        long = b - a >= self.size.min()
        a, b = a[long], b[long]
        if not len(a):
            return n_words, [none] * 4, none, none
        size = b - a + 1  # a zero after each run
        to = np.cumsum(size)
        source = np.arange(to[-1]) - np.repeat(to - size, size) + np.repeat(a, size)
        symbols = near[np.minimum(source, len(near) - 1)] + 1
        symbols[to - 1] = 0
        sa, _ = suffix_array(symbols, self.bits, self.rows.shape[1])
        lo, hi = find(symbols, sa, self.rows, self.size)
        hits = hi - lo
        w = np.repeat(np.arange(len(hits)), hits)
        word = source[sa[np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + lo[w]]]
        per = self.at[w + 1] - self.at[w]  # each window of each item that it stands in
        own = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.at[w], per)
        word, width, item, place = np.repeat(word, per), np.repeat(self.size[w], per), self.owner[own], self.place[own]
        # Windows one after the other in both texts are one longer verbatim match.
        order = np.lexsort((word, word - place, item, doc[word]))
        word, width, item, place = word[order], width[order], item[order], place[order]
        d = doc[word]
        new = np.ones(len(word), bool)
        new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (word[1:] - place[1:] != word[:-1] - place[:-1]) | (word[1:] != word[:-1] + 1)
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(word)) - 1 if len(s) else s
        length = word[e] - word[s] + width[e]
        return n_words, [d[s], item[s], word[s] - first_of_doc[d[s]], length], word[s], first_of_doc


MATCH = "array<struct<item_id:string,first_word:bigint,n_words:bigint>>"


def _marker(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for part, buf, off in slices(batch, "text", SHARD_BYTES):
                n_words, (d, item, first, length), _, _ = windows.matches(buf, off)
                names = pa.array(windows.names, pa.string()).take(pa.array(item, pa.int64())) if len(item) else pa.array([], pa.string())
                rows = pa.StructArray.from_arrays([names, pa.array(first, pa.int64()), pa.array(length, pa.int64())], ["item_id", "first_word", "n_words"])
                at = np.searchsorted(d, np.arange(len(off)))
                found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows)
                schema = pa.schema([*[f for f in part.schema if f.name not in ("n_words", "found")], ("n_words", pa.int64()), ("found", found.type)])
                yield pa.RecordBatch.from_arrays([*[part[f.name] for f in part.schema if f.name not in ("n_words", "found")], pa.array(n_words, pa.int64()), found], schema=schema)

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...) x benchmark (item_id, text) -> doc_id, text, n_words, matches and the columns to carry. matches: the
    longest verbatim matches of WINDOW words or more (or of a whole shorter item), as (item_id, first_word, n_words).

    One row for each input row. Null or empty texts have no words; null or empty items match nothing.
    A null item_id counts as the item named by the empty text; rows that repeat an item_id are one item."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *carried(carry))
    handed_on = carried_sql(out)
    found = []
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Windows([(r.item_id, r.text) for r in rows]))
        kept = ", ".join(f"{c} {MATCH}" for c in found)
        out = small_batches(out).mapInArrow(tidy(_marker(shared)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text binary{handed_on}, {kept + ', ' if kept else ''}n_words bigint, found {MATCH}").withColumnRenamed("found", f"found{k}")
        found.append(f"found{k}")
    own = out.select("doc_id", F.col("text").cast("string").alias("text"), "n_words", F.flatten(F.array(*found)).alias("matches"), *(c for c in out.columns if c.startswith("carried_")))
    return uncarried(own, carry)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """benchmark_matches() as doc_id, n_words, n_hit, n_items, longest_match, items_sha256, contaminated."""
    m = benchmark_matches(docs, benchmark).drop("text").withColumn("matches", F.array_sort("matches", lambda x, y: F.when(x.first_word < y.first_word, -1).when(x.first_word > y.first_word, 1).otherwise(0)))
    covered = F.aggregate(
        "matches",
        F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("to")),
        lambda s, x: F.struct((s.hit + F.greatest(F.lit(0).cast("bigint"), x.first_word + x.n_words - F.greatest(s.to, x.first_word))).alias("hit"), F.greatest(s.to, x.first_word + x.n_words).alias("to")),
        lambda s: s.hit,
    )
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    longest = F.coalesce(F.array_max(F.col("matches.n_words")), F.lit(0).cast("bigint"))
    out = m.select("doc_id", "n_words", covered.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), longest.alias("longest_match"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any match, with all their columns."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return benchmark_matches(docs, benchmark, carry).filter(F.size("matches") == 0).select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark windows in all documents; see contamination()."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
QUERIES = {"op8_decontamination": op8_decontamination}
SQL = {
    "op8_decontamination": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
m AS (SELECT doc_id, i, win.n, item FROM p JOIN sizes ON i + sizes.n - 1 <= len(ws) JOIN win ON win.n = sizes.n AND win.w = array_to_string(ws[i:i + sizes.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
