"""Z-order chunks of a cloud and their levels of detail."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.geometry import morton
from cairn.sources.tables import new_folder, running_total, staged, with_ordinal

BITS = 21


def z_ordered(splats: DataFrame) -> DataFrame:
    """splats with code and place: their dense number in Z-order, ties by splat_id."""
    ends = splats.agg(*(f(c) for c in "xyz" for f in (F.min, F.max))).first()
    cells = []
    for i, c in enumerate("xyz"):
        low, high = ends[2 * i] or 0.0, ends[2 * i + 1] or 0.0
        extent = high - low if high > low else 1.0
        cells.append(F.floor(F.least(F.greatest((F.col(c) - low) / extent, F.lit(0.0)), F.lit(1.0)) * (2**BITS - 1)).cast("bigint"))
    return with_ordinal(splats.withColumn("code", morton(*cells)), ["code", "splat_id"], "place")


def chunked(ordered: DataFrame, target: int, extent: float = 0.0) -> DataFrame:
    """ordered with chunk. Without an extent a chunk is `target` rows. With one, a chunk also ends before the row with which its box would pass
    it, once it has max(target / 8, 8192) rows.

    Where a chunk ends depends on where it starts alone. So blocks of rows tell, each by itself, for every place at which a chunk may start that comes
    from the block before, where the first chunk of the next block starts; these maps are joined pair by pair, which gives each block its true start."""
    if extent <= 0:
        return ordered.withColumn("chunk", F.floor(F.col("place") / target))
    size, least = max(4 * target, BLOCK), max(target // 8, LEAST)
    rows = staged(ordered.withColumn("block", F.floor(F.col("place") / size)), "blocks")
    last, n = rows.agg(F.max("block"), F.count("*")).first()
    if not n:
        return rows.select(*ordered.columns, F.lit(0).cast("bigint").alias("chunk"))
    columns = ordered.columns
    # A block and the rows behind it that a chunk of it can reach.
    ahead = rows.filter((F.col("block") > 0) & (F.col("place") < F.col("block") * size + target)).withColumn("block", F.col("block") - 1)
    both = rows.union(ahead)

    def passes(part: pa.Table) -> pa.Table:
        k, _, place, after = _block(part, target, extent, least, n)
        end = (k + 1) * size
        out = np.append(after, n)  # of each row where the first chunk at or behind the block's end starts that follows from it
        inside = int(np.searchsorted(place, end))
        first = int(place[0])
        while len(short := np.flatnonzero((out < end) & (out < n))):  # a chunk further each time, of the few that a block holds
            out[short] = after[out[short] - first]
        many = 1 if k == 0 else min(target, inside)
        return pa.table([pa.array(np.full(many, k)), pa.array(place[:many]), pa.array(out[:many])], schema=PASSES)

    maps = [staged(both.select("block", "place", *"xyz").groupBy("block").applyInArrow(passes, "block bigint, start bigint, next bigint"), "passes")]
    lasts = [last]
    while lasts[-1] > 0:
        now = maps[-1]
        right = now.filter(F.col("block") % 2 == 1).select((F.col("block") - 1).alias("block"), F.col("start").alias("next"), F.col("next").alias("beyond"))
        pairs = now.filter(F.col("block") % 2 == 0).join(right, ["block", "next"], "left")
        maps.append(staged(pairs.select(F.floor(F.col("block") / 2).alias("block"), "start", F.coalesce("beyond", "next").alias("next")), "passes"))
        lasts.append(lasts[-1] // 2)
    starts = rows.sparkSession.createDataFrame([(0, 0)], "block bigint, start bigint")
    for level in range(len(maps) - 2, -1, -1):  # down again: a left half starts where both do, the right half where the left one leads
        left = starts.select((F.col("block") * 2).alias("block"), "start")
        right = left.join(maps[level], ["block", "start"], "left").select((F.col("block") + 1).alias("block"), F.coalesce("next", "start").alias("start"))
        starts = staged(left.union(right.filter(F.col("block") <= lasts[level])), "starts")

    def label(part: pa.Table, start: pa.Table) -> pa.Table:
        k, part, place, after = _block(part, target, extent, least, n)
        inside = int(np.searchsorted(place, (k + 1) * size))
        cut, at, first = np.zeros(inside, np.int64), start["start"][0].as_py(), int(place[0])
        while at - first < inside:
            cut[at - first] = 1
            at = int(after[at - first])
        return part.select([*columns, "block"]).slice(0, inside).append_column("local", pa.array(np.cumsum(cut)))

    schema = rows.withColumn("local", F.lit(0).cast("bigint")).select(*columns, "block", "local").schema
    own = staged(both.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(label, schema), "labels")
    before = running_total(own.groupBy("block").agg(F.max("local").alias("cuts")), [], ["block"], "cuts", "before")
    return own.join(before.select("block", "before"), "block").select(*columns, (F.col("before") + F.col("local") - 1).alias("chunk"))


#: Rows of a block at least, and of a chunk that ends before its target.
BLOCK, LEAST = 1 << 16, 8192
PASSES = pa.schema([("block", pa.int64()), ("start", pa.int64()), ("next", pa.int64())])


def _block(part: pa.Table, target: int, extent: float, least: int, n: int) -> tuple[int, pa.Table, np.ndarray, np.ndarray]:
    """A block with the rows behind it in order: its number, rows, places, and where the chunk after the one that starts at each row does."""
    part = part.sort_by("place")
    place = part["place"].to_numpy()
    far = np.minimum.reduce([_passed(part[c].to_numpy(), extent) for c in "xyz"])
    end = np.minimum(np.maximum(far, np.arange(len(place)) + least), np.arange(len(place)) + target)
    return part["block"][0].as_py(), part, place, np.minimum(place[0] + end, n)


def _passed(values: np.ndarray, extent: float) -> np.ndarray:
    """Of each place the first one behind it with which the values between span more than the extent; beyond the end if there is none.

    Least and greatest values of runs of 1, 2, 4... places are at hand; each place takes in the longest run that still fits, then shorter ones."""
    n = len(values)
    runs = [(values, values)]
    while 2 << (len(runs) - 1) <= n:
        half = 1 << (len(runs) - 1)
        low, high = runs[-1]
        runs.append((np.minimum(low[:-half], low[half:]), np.maximum(high[:-half], high[half:])))
    at, low, high = np.arange(n), np.full(n, np.inf), np.full(n, -np.inf)
    for k in range(len(runs) - 1, -1, -1):
        run = np.minimum(at, len(runs[k][0]) - 1)
        wide_low, wide_high = np.minimum(low, runs[k][0][run]), np.maximum(high, runs[k][1][run])
        fits = (at < len(runs[k][0])) & ~(wide_high - wide_low > extent)
        at, low, high = at + (fits << k), np.where(fits, wide_low, low), np.where(fits, wide_high, high)
    return np.where(at < n, at, 1 << 60)


def levels(chunks: DataFrame, count: int) -> DataFrame:
    """A row for each splat and level that has it: level l keeps every 2**l-th row of a chunk, so that level 0 is the chunk itself."""
    if count == 1:
        return chunks.withColumn("level", F.lit(0))
    first = chunks.groupBy("chunk").agg(F.min("place").alias("first"))
    rows = chunks.join(first, "chunk").withColumn("i", F.col("place") - F.col("first"))
    return rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).filter(F.expr("i % shiftleft(1, level)") == 0).drop("first", "i")


def leaves(chunks: DataFrame, count: int) -> DataFrame:
    """A row for each chunk: its box, rows, and a map of levels to rows."""
    box = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    own = chunks.groupBy("chunk").agg(F.count("*").alias("rows"), *box)
    lods = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(i.cast("string"), F.ceil(F.col("rows") / F.expr("1L") / F.pow(F.lit(2.0), i)).cast("bigint"))))
    return own.withColumn("lods", lods)


def lod_tree(leaf: DataFrame) -> DataFrame:
    """node_id, depth, chunks, first and box of the balanced binary tree over the chunks in order: each leaf walks up the halvings that hold
    it, and boxes meet in grouped minima. Node ids are heap numbers, 1 the root; first is the first chunk below."""
    n = leaf.count()

    def path(i: int) -> list[tuple[int, int]]:
        start, end, node, out = 0, n, 1, [(1, 0)]
        while end > start + 1:
            mid = start + (end - start) // 2
            start, end, node = (start, mid, 2 * node) if i < mid else (mid, end, 2 * node + 1)
            out.append((node, len(out)))
        return out

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(c, *step) for c in p["chunk"] for step in path(int(c))]
            yield pd.DataFrame(rows, columns=["chunk", "node_id", "depth"])

    up = leaf.select("chunk").mapInPandas(walk, "chunk bigint, node_id bigint, depth int")
    box = [f(f"{n}_{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    return up.join(leaf, "chunk").groupBy("node_id", "depth").agg(F.count("*").alias("chunks"), F.min("chunk").alias("first"), *box)


def write_bundle(chunks: DataFrame, count: int) -> str:
    """The levels as Parquet files under level=/chunk= in a new shared folder, so that readers of a level or chunk skip the rest."""
    where = new_folder(chunks.sparkSession, "bundle")
    levels(chunks, count).repartition("level", "chunk").write.partitionBy("level", "chunk").parquet(where)
    return where


def strided(rows: DataFrame, place: str, take: int) -> DataFrame:
    """The rows at places floor(i n / take): an even sample of fixed size, each row deciding for itself."""
    n = rows.count()
    if n <= take:
        return rows
    i = F.expr(f"({place} * {take} + {n} - 1) div {n}")  # the least i with i n / take >= place
    return rows.filter(F.expr("1=1") & (i < take) & (F.floor(i * n / take) == F.col(place)))
