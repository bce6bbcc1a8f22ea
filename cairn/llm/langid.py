"""Language identification by error-correcting output codes.

Every learned language has a codeword; for each bit a binary naive-Bayes classifier over hashed byte
trigrams tells the languages with 1 from those with 0. A text gets the language whose codeword costs
the least logistic loss against the bits' margins, weighted by how well each bit separates."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import LOWER, SLICE_BYTES, arrow_batch, carried, carried_sql, id_bucket, slices, small_batches, table, tidy, uncarried, with_carried

BUCKETS = 1 << 16
#: Margins are mean log-odds a trigram; the loss sees them this many times larger.
SHARPNESS = 4.0
#: Texts whose two best codewords differ by less than this share of the bits' total weight are ambiguous.
AMBIGUOUS = 0.02
FOLDS, HELD_OUT = 4, 2
COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text between two spaces, ASCII lower-cased, and the offsets of the texts' runs.
    The two windows that reach over a text's end are in bucket 0, which weighs nothing."""
    n = len(off) - 1
    at = off + 2 * np.arange(n + 1)
    wide = np.full(len(buf) + 2 * n + 2, 32, np.uint32)
    wide[np.arange(len(buf)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))] = LOWER[buf]
    x = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
    x = (x * np.uint32(0x9E3779B1)) >> np.uint32(16)
    x[x == 0] = 1
    ends = at[1:]
    x[ends - 1] = 0
    x[ends - 2] = 0
    return x, at


def bucket_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often each bucket occurs in the texts; a text longer than a slice is taken piece by piece."""
    if len(buf) <= 2 * SLICE_BYTES:
        return np.bincount(trigrams(buf, off)[0], minlength=BUCKETS)
    total = np.zeros(BUCKETS, np.int64)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        for at in range(a, b, SLICE_BYTES):
            to = min(at + SLICE_BYTES, b)
            left, right = int(at > a), int(to < b)  # the neighbours' bytes take the place of the spaces around a text
            x, _ = trigrams(buf[at - left : to + right], np.array([0, to - at + left + right]))
            total += np.bincount(x[left : left + to - at], minlength=BUCKETS)
    return total


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of +1 and -1: all splits of up to six languages, else 15 random balanced bits a doubling of the languages."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng = np.random.default_rng(n)
    bits = 15 * int(np.ceil(np.log2(n)))
    base = np.where(np.arange(n) < n // 2, 1.0, -1.0)
    while True:
        code = np.stack([rng.permutation(base) for _ in range(bits)], axis=1)
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() >= bits // 5:
            return code


class Model:
    """Weights of the bit classifiers, (buckets, bits), from the trigram counts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        if not langs:
            return
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        w = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.reliability = np.ones(self.code.shape[1])
        if len(langs) > 1:
            for b in range(w.shape[1]):
                one, zero = p[self.code[:, b] > 0].mean(axis=0), p[self.code[:, b] < 0].mean(axis=0)
                w[:, b] = np.log(one) - np.log(zero)
                self.reliability[b] = 1 - np.minimum(one, zero).sum()  # total variation between the two sides
        w[0] = 0
        self.weights = w

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and ambiguity of each text."""
        n = len(off) - 1
        if n == 1 and len(buf) > 2 * SLICE_BYTES:
            margin = (bucket_counts(buf, off) @ self.weights.astype(np.float64) / len(buf))[None]
        else:
            x, at = trigrams(buf, off)
            margin = np.add.reduceat(self.weights[x[: at[-1]]], at[:-1], axis=0) / np.maximum(1, np.diff(off))[:, None] if n else np.zeros((0, 1))
        weight = self.reliability / self.reliability.sum()
        z = SHARPNESS * margin[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -z) * weight).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        if len(self.langs) == 1:
            return best, np.ones(n), np.zeros(n, bool)
        row = np.arange(n)
        gap = loss[row, order[:, 1]] - loss[row, best]
        return best, 1 / (1 + np.exp(-4 * gap)), gap < AMBIGUOUS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
    for batch in batches:
        langs = np.array(batch["lang"].to_pylist(), object)
        for lang in dict.fromkeys(langs):
            own = batch.filter(pa.array(langs == lang))
            for _, buf, off in slices(own, "text"):
                totals[lang] += bucket_counts(buf, off)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield arrow_batch(COUNTS, lang=[lang] * len(at), bucket=at, n=total[at])


def fit(labelled: DataFrame) -> Model:
    """Learns from all rows (text, lang) with a lang. What reaches the driver is a count for each language
    and bucket, of which there are 65,536 a language however many texts there are."""
    rows = labelled.filter("lang is not null and text is not null").selectExpr("cast(lang as string) lang", "cast(text as binary) text")
    counts = small_batches(rows).mapInArrow(tidy(_count), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    out = np.zeros((len(langs), BUCKETS))
    out[np.searchsorted(np.array(langs, object), counts["lang"].to_numpy()) if langs else [], counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return Model(langs, out)


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, lang_pred, score, ambiguous, the columns to carry and, if asked for, text (empty for null); one row for each row.

    Null texts and texts without a letter are `und` with score 0; so is everything if no language was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def own(found: pa.RecordBatch, part: pa.RecordBatch) -> pa.RecordBatch:
        return with_carried(found.append_column("text", part["text"]) if with_text else found, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.langs, pa.string())
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                if not m.langs:
                    yield own(arrow_batch(PREDICTED, doc_id=part["doc_id"], lang_pred=["und"] * len(part), score=np.zeros(len(part)), ambiguous=np.zeros(len(part), bool)), part)
                    continue
                best, score, unclear = m.predict(buf, off)
                letters = np.array(part["letters"].to_pylist(), bool)
                lang = np.where(letters, np.array(names.take(pa.array(best)).to_pylist(), object), "und")
                yield own(arrow_batch(PREDICTED, doc_id=part["doc_id"], lang_pred=lang.tolist(), score=np.where(letters, score, 0.0), ambiguous=unclear & letters), part)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), *carried(carry))
    out = small_batches(narrow).mapInArrow(tidy(run), "doc_id bigint, lang_pred string, score double, ambiguous boolean" + (", text binary" if with_text else "") + carried_sql(narrow))
    return uncarried(out.withColumn("text", F.col("text").cast("string")) if with_text else out, carry)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of all documents, learned from those that aren't held out; see fit() and predict()."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", FOLDS) == HELD_OUT
    return predict(docs, fit(docs.filter(~held_out).select("text", "lang"))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op5_langid": op5_langid}
SQL: dict[str, str] = {}
