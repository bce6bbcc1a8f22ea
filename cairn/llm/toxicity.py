"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are hashed words and their stems, of which the higher score counts. Their log-odds between toxic and other labelled texts carry a Dirichlet
prior from the counts of all texts; a token that doesn't stand out costs a little. A linear scan
(Ruzzo and Tompa) finds all maximal segments of a text, extreme-value statistics turn them into
normalised scores, and a logistic curve around the labelled texts' best cut makes that a probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import LOWER, NOT_ALNUM, arrow_batch, id_bucket, slices, span_hashes, table, word_spans

BUCKETS, STEM = 1 << 18, 4
#: The classifier learns from this many labelled rows at most, those with the smallest hashes of their ids.
MAX_LABELS = 200_000
#: The prior's weight as a share of the labelled tokens; least z and log-odds of a token that scores; cost of any other token.
PRIOR, LEAST_Z, LEAST_ODDS, COST = 0.02, 2.0, 2.0, 0.05
#: Learning folds: rows whose crc32(doc_id) mod 5 is 0 are held out.
FOLDS = 5
COUNTS = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("n", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("raw", pa.float64()), ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])))])


class Labels:
    """A bounded table of doc_id -> toxic."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.toxic = ids[order], toxic[order].astype(bool)

    def of(self, ids: pa.Array) -> np.ndarray:
        """1, 0 or -1 (no label) of each id."""
        x = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        if not len(self.ids):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1)
        return np.where((self.ids[at] == x) & np.asarray(ids.is_valid()), self.toxic[at].astype(int), -1)


def buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its bucket, the bucket of its stem (its first STEM bytes; the word's own if it has no more), its text."""
    buf = LOWER[buf]
    starts, ends, doc = word_spans(buf, off, NOT_ALNUM)
    word = (span_hashes(buf, starts, ends) >> np.uint64(46)).astype(np.int64)
    stem = (span_hashes(buf, starts, np.minimum(ends, starts + STEM)) >> np.uint64(45)).astype(np.int64) & (BUCKETS - 1)
    return word, np.where(ends - starts > STEM, stem, word), doc


def token_scores(toxic: np.ndarray, other: np.ndarray, everywhere: np.ndarray) -> np.ndarray:
    """Score of each bucket: log-odds with the prior where they stand out, -COST elsewhere."""
    prior = (PRIOR * (toxic.sum() + other.sum()) + 1) * (everywhere + 0.1) / (everywhere.sum() + 0.1 * len(everywhere))
    a, b = toxic + prior, other + prior
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    z = odds / np.sqrt(1 / a + 1 / b)
    return np.where((z >= LEAST_Z) & (odds > LEAST_ODDS), odds, -COST)


def decay(scores: np.ndarray, null: np.ndarray) -> float:
    """The extreme-value scale: lambda > 0 with sum of p * exp(lambda * score) = 1 over the counts of texts that aren't toxic."""
    p = null / max(1, null.sum())
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * scores, 500))).sum() < 1 else (lo, mid)
    return lo


def maximal_segments(at: np.ndarray, score: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of a sequence in which the tokens `at` have
    positive scores and any other token costs `cost`. Linear time: each segment is merged once at most."""
    held: list[list[float]] = []  # first, last, total before, total through
    before = 0.0
    last = -1
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        left = before - cost * (i - last - 1)
        now = [i, i, left, left + s]
        before, last = left + s, i
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= now[2]:
                j -= 1
            if j < 0 or held[j][3] >= now[3]:
                held.append(now)
                break
            now = [held[j][0], now[1], held[j][2], now[3]]
            del held[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in held]


class Model:
    def __init__(self, scores: np.ndarray, scale: float, middle: float = 0.0):
        self.scores, self.scale, self.middle = scores.astype(np.float32), scale, middle

    def texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Of each text: its normalised score (log of one over the expected number of such segments by chance, summed over
        its significant segments, at least the best one's) and its significant segments."""
        word, stem, doc = buckets(buf, off)
        s = np.maximum(self.scores[word], self.scores[stem])
        n = len(off) - 1
        count = np.bincount(doc, minlength=n)
        first = np.concatenate(([0], np.cumsum(count)))
        hot = np.flatnonzero(s > 0)
        edge = np.searchsorted(hot, first)
        out, spans = np.full(n, -20.0), [[] for _ in range(n)]
        for i in np.flatnonzero(np.diff(edge)):
            k = hot[edge[i] : edge[i + 1]]
            own = [(a, e, self.scale * x - np.log(count[i])) for a, e, x in maximal_segments(k - first[i], s[k], COST)]
            spans[i] = [(a, e - a + 1, float(x)) for a, e, x in own if x > 0]
            out[i] = max(max(x for _, _, x in own), sum(x for _, _, x in spans[i]))
        return out, spans


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, total = shared.value, np.zeros((3, BUCKETS), np.int64)
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                word, stem, doc = buckets(buf, off)
                label = labels.of(part["doc_id"])[doc]
                for b, known in ((word, label), (stem[stem != word], label[stem != word])):
                    total[2] += np.bincount(b, minlength=BUCKETS)
                    for kind in (0, 1):
                        total[kind] += np.bincount(b[known == kind], minlength=BUCKETS)
        for kind in range(3):
            at = np.flatnonzero(total[kind])
            yield arrow_batch(COUNTS, kind=np.full(len(at), kind), bucket=at, n=total[kind][at])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                raw, spans = model.texts(buf, off)
                yield arrow_batch(SCORED, doc_id=part["doc_id"], raw=raw, spans=[[dict(zip(("first_word", "n_words", "score"), x, strict=True)) for x in s] for s in spans])

    return run


SCORED_SQL = "doc_id bigint, raw double, spans array<struct<first_word:bigint,n_words:bigint,score:double>>"


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Learns from the texts of docs whose doc_id has a label; the background counts are of all texts.

    The driver gets max_labels labels and scores at most, and three counts for each of 2**18 buckets.
    Rows without id or label are ignored; of several labels of an id the largest counts."""
    sc = docs.sparkSession.sparkContext
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).toPandas()
    table_ = Labels(rows["doc_id"].to_numpy(np.int64), rows["toxic"].to_numpy() > 0)
    shared = sc.broadcast(table_)
    counts = _narrow(docs).mapInArrow(_count(shared), "kind tinyint, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((3, BUCKETS))
    total[counts["kind"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    scores = token_scores(total[1], total[0], total[2])
    model = Model(scores, decay(scores, total[0] + 1e-3 * total[2]))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.of(batch["doc_id"]) >= 0))

    own = _narrow(docs).mapInArrow(labelled, "doc_id bigint, text binary").mapInArrow(_score(sc.broadcast(model)), SCORED_SQL).select("doc_id", "raw").groupBy("doc_id").agg(F.max("raw").alias("raw")).toArrow()
    model.middle = calibration(own["raw"].to_numpy(), table_.of(own["doc_id"].combine_chunks()) > 0)
    return model


def calibration(x: np.ndarray, y: np.ndarray) -> float:
    """The normalised score at which the probability is a half: the cut with the fewest errors, halfway between its neighbours.
    Normalised scores are natural logarithms already, so the curve's slope is 1."""
    if not len(x) or not y.any() or y.all():
        return -20.0 if len(x) and y.any() else 20.0
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    errors = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum(~y[::-1])[::-1], [0]))
    able = np.concatenate(([True], x[1:] > x[:-1], [True]))  # cuts between different scores
    at = int(np.argmin(np.where(able, errors, len(x) + 1)))
    below, above = x[at - 1] if at else x[0] - 2, x[at] if at < len(x) else x[-1] + 2
    return float((below + above) / 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score, predicted, spans (significant passages in words); one row for each row.
    Null and empty texts have no tokens and get the lowest score."""
    scored = _narrow(docs).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), SCORED_SQL)
    p = 1 / (1 + F.exp(F.lit(model.middle) - F.col("raw")))
    return scored.select("doc_id", p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all documents, learned from the labels of those that aren't held out; see fit() and score()."""
    docs, held_out = table(spark, sf_dir, "documents"), id_bucket("doc_id", FOLDS) == 0
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("spans").alias("n_passages"))


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
