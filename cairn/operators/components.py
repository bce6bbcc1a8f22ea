"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.tables import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points the larger (or the smaller and itself) neighbours of each node to its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if large:
        return near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one centre and no centre points on."""
    return edges.groupBy("a").count().filter("count > 1").isEmpty() and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) of an ordered type -> (node, component), component the smallest node; nodes without edges don't appear.

    Each round is two grouped minima with joins back, so no component is ever gathered in a task,
    and skewed joins on a hot centre are split by adaptive execution. Rounds grow with the logarithm
    of the longest path; each is written to the shared folder, in place of the one before."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        before, now = now, staged(_star(_star(now, True), False), "edges")
        discard(before)
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")


def neighbours(cells: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Pairs (a, b), b the next cell along one axis, of the cells that stand in both; a and b are structs of the axes."""
    offset = F.explode(F.array(*(F.struct(*(F.lit(int(i == j)).cast("bigint").alias(c) for j, c in enumerate(axes))) for i in range(len(axes))))).alias("o")
    moved = cells.select(*axes, offset).select(F.struct(*axes).alias("a"), *((F.col(c) + F.col(f"o.{c}")).alias(c) for c in axes))
    return moved.join(cells.select(*axes), list(axes)).select("a", F.struct(*axes).alias("b"))


#: Edge of the tiles whose cells are labelled in one task at a time, by the number of axes: 4096 cells.
TILE = {1: 4096, 2: 64, 3: 16}


def tile_labels(places: np.ndarray, edge: int, axes: int) -> np.ndarray:
    """Of cells at `places` (in row-major order of a tile) the smallest place of their component."""
    free = edge**axes
    label = np.full((edge,) * axes, free)
    flat = label.reshape(-1)
    flat[places] = places
    open_ = label < free
    while True:
        before = flat[places].copy()
        for i in range(axes):
            low, high = (tuple(slice(None) if k != i else s for k in range(axes)) for s in (slice(0, -1), slice(1, None)))
            both = open_[low] & open_[high]
            for to, of in ((low, high), (high, low)):
                np.minimum(label[to], label[of], out=label[to], where=both)
        flat[places] = flat[flat[places]]
        if (flat[places] == before).all():
            return before


def cell_components(cells: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """cells with the component of those that touch along an axis: the struct of its smallest cell.

    Tiles are labelled each by itself; only labels that touch across a tile's border take part in the rounds that all share."""
    edge, k = TILE[len(axes)], len(axes)
    own = [f"least_{i}" for i in range(k)]
    tile = [F.floor(F.col(c) / edge).alias(f"tile_{i}") for i, c in enumerate(axes)]
    columns = cells.columns
    schema = cells.withColumns({c: F.lit(0).cast("bigint") for c in own}).schema

    def label(rows: pa.Table) -> pa.Table:
        at = np.stack([rows[c].to_numpy().astype(np.int64) for c in axes])
        low = at[:, 0] // edge * edge
        shape = (edge,) * k
        least = np.unravel_index(tile_labels(np.ravel_multi_index(tuple(at - low[:, None]), shape), edge, k), shape)
        out = rows.select(columns)
        for c, v, base in zip(own, least, low, strict=True):
            out = out.append_column(c, pa.array(v.astype(np.int64) + base))
        return out

    dealt = cells.select("*", *tile).groupBy(*(f"tile_{i}" for i in range(k)))
    labelled = staged(dealt.applyInArrow(label, schema), "tiles")
    least = F.struct(*(F.col(c).alias(a) for c, a in zip(own, axes, strict=True)))

    def border(i: int, rest: int) -> Column:
        return F.pmod(F.col(axes[i]), F.lit(edge)) == rest

    edges = None
    for i in range(k):
        here = labelled.filter(border(i, edge - 1)).select(least.alias("a"), *((F.col(c) + int(c == axes[i])).alias(c) for c in axes))
        there = labelled.filter(border(i, 0)).select(least.alias("b"), *axes)
        met = here.join(there, list(axes)).select("a", "b").distinct()
        edges = met if edges is None else edges.union(met)
    found = connected_components(edges).withColumnRenamed("node", "own")
    return labelled.select(*columns, least.alias("own")).join(found, "own", "left").withColumn("component", F.coalesce("component", "own")).drop("own")
