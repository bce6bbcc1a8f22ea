"""Quantization of clouds: logarithmic positions, codebooks of equal counts, Lloyd's clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.geometry import finite, sym_log
from cairn.sources.tables import staged, with_ordinal

ENTRIES = 256


def quantized_means(splats: DataFrame) -> DataFrame:
    """splats with the low and high byte of each axis' 16-bit place between the least and greatest symmetric logarithm."""
    logs = {c: sym_log(F.col(c)) for c in "xyz"}
    ends = splats.agg(*(f(logs[c]) for c in "xyz" for f in (F.min, F.max))).first()
    out = splats
    for i, c in enumerate("xyz"):
        low, high = ends[2 * i], ends[2 * i + 1]
        low = 0.0 if low is None else low
        high = low + 1.0 if high is None or high <= low else high
        q = F.round(F.least(F.greatest((logs[c] - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 65535.0).cast("int")
        out = out.withColumn(f"{c}_low", q.bitwiseAND(255)).withColumn(f"{c}_high", F.shiftright(q, 8))
    return out


def codebook(values: DataFrame, entries: int = ENTRIES) -> list[float]:
    """Means of `entries` runs of equal counts of the sorted finite values (column v), non-decreasing; few values repeat.

    One range sort numbers the values; a run's sum combines before it is shuffled."""
    ranked = with_ordinal(values.select(F.col("v").cast("double").alias("v")).filter(finite(F.col("v"))), ["v"], "i")
    n = ranked.count()
    if not n:
        return [0.0] * entries
    ends = [(b, b * n // entries, min(max((b + 1) * n // entries, b * n // entries + 1), n)) for b in range(entries)]
    if n >= entries:
        b = F.floor((F.col("i") * entries + entries - 1) / F.lit(n))  # the run of i: the last with b * n // entries <= i
        runs = ranked.withColumn("b", F.least(b, F.lit(entries - 1))).withColumn("b", F.when(F.expr(f"b * {n} div {entries}") > F.col("i"), F.col("b") - 1).otherwise(F.col("b")))
        means = dict(runs.groupBy("b").agg(F.avg("v")).collect())
    else:
        few = [r[0] for r in ranked.orderBy("i").select("v").collect()]  # fewer than the entries
        means = {b: sum(few[a:e]) / (e - a) for b, a, e in ends}
    out = [means[b] for b in range(entries)]
    return np.maximum.accumulate(out).tolist()


def nearest_entry(value: Column, book: list[float]) -> Column:
    """Place of the nearest codebook entry, the lower of two equally near; not finite counts as 0."""
    entries = np.asarray(book)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        x = np.nan_to_num(v.to_numpy(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
        at = np.searchsorted(entries, x, "left")
        low, high = np.maximum(at - 1, 0), np.minimum(at, len(entries) - 1)
        return pd.Series(np.where(np.abs(entries[high] - x) < np.abs(x - entries[low]), high, low).astype(np.int32))

    return place(value)


def nearest(centroids: np.ndarray, vectors: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """The nearest centroid of each vector, the first of equals, in blocks of `block` distances."""
    rows = max(block // max(len(centroids), 1), 1)
    out = np.zeros(len(vectors), np.int64)
    for at in range(0, len(vectors), rows):
        d = np.zeros((len(vectors[at : at + rows]), len(centroids)))
        for i in range(centroids.shape[1]):
            d += (vectors[at : at + rows, i : i + 1] - centroids[:, i]) ** 2
        out[at : at + rows] = d.argmin(axis=1)
    return out


def nearest_centroid(vector: Column, centroids: list[list[float]]) -> Column:
    """Place of the nearest centroid, the first of equals; the centroids go along as one matrix, batches of vectors are compared in arrays."""
    table = np.asarray(centroids, float)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(table, np.stack(v.to_numpy()).astype(float)).astype(np.int32) if len(v) else np.zeros(0, np.int32))

    return place(vector)


def kmeans(rows: DataFrame, key: str, clusters: int, iterations: int) -> tuple[list[list[float]], DataFrame]:
    """rows (key, v: an array) -> centroids and rows with label. Starts at every n / clusters-th row in key order; every round learns from all
    rows, a task's sums of each cluster combine before they are shuffled; empty clusters stay put."""
    ranked = staged(with_ordinal(rows, [key], "i"), "ranked")
    n = ranked.count()
    clusters = min(max(clusters, 1), max(n, 1))
    if not n:
        return [], rows.withColumn("label", F.lit(0))
    starts = [c * n // clusters for c in range(clusters)]
    centroids = [list(r["v"]) for r in ranked.filter(F.col("i").isin(starts)).orderBy("i").collect()]
    dims = len(centroids[0])
    for _ in range(max(iterations, 1)):
        means = ranked.groupBy(nearest_centroid(F.col("v"), centroids).alias("label")).agg(*(F.avg(F.get("v", F.lit(d))).alias(f"m{d}") for d in range(dims)))
        for r in means.collect():  # a row for each cluster
            centroids[r["label"]] = [r[f"m{d}"] for d in range(dims)]
    return centroids, ranked.withColumn("label", nearest_centroid(F.col("v"), centroids)).drop("i")
