"""Islands of triangle meshes: triangles that share a vertex's rounded position, what each island measures, and which to keep.

Triangles are dealt by blocks of space and joined within each stretch of a task's rows; only stretches that meet at a position
take part in the rounds that all share. A position with many triangles costs a row for each at most and no pairs of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import meshes as M
from cairn.operators.components import connected_components
from cairn.sources.tables import staged

#: Places of a vertex's position that must agree for triangles to touch.
PLACES = 3


@dataclass(frozen=True)
class IslandSettings:
    """merge: all islands of a level within reach, instead of the nearest one."""

    seed: tuple[float, float, float]
    reach: float = 6.0
    merge: bool = False
    band: float = 2.5
    least_share: float = 0.08


#: Edge of the blocks by which triangles are dealt, in metres, and the triangles that are joined at a time.
BLOCK, STRETCH = 16.0, 1 << 16


def _position(v: str) -> Column:
    return F.struct(*((F.round(F.col(f"{v}{c}"), PLACES) + F.lit(0.0)).alias(c) for c in "xyz"))


def linked(place: np.ndarray, corners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of shapes with so many corners each, from the places of these: the first shape that each can be reached from by shared places, corners in the order
    of places, and where a new place starts among them."""
    by = np.argsort(place, kind="stable")
    new = np.flatnonzero(np.diff(place[by], prepend=-1))
    size = np.diff(np.append(new, len(by)))
    of = by // corners
    label = np.arange(len(place) // corners)
    while len(label):
        before = label.copy()
        least = np.repeat(np.minimum.reduceat(label[of], new), size)
        np.minimum.at(label, label[of], least)  # whole components at once
        np.minimum.at(label, of, least)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    return label, by, new


def joined(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of triangles (ids, and at: n x 3 x 3 positions) the smallest that can be reached by shared positions, and bits for the corners that stand for
    their position: the first of those that share it. Positions that aren't finite stand for themselves and join nothing here."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    flat = np.ascontiguousarray(at[order].reshape(n * 3, 3))
    _, place = np.unique(flat.view(np.dtype((np.void, 24))).reshape(-1), return_inverse=True)
    odd = np.flatnonzero(~np.isfinite(flat).all(axis=1))
    place = place.reshape(-1)
    place[odd] = place.max(initial=0) + 1 + np.arange(len(odd))
    label, by, new = linked(place, 3)
    fresh = np.zeros(n, np.int64)
    first = by[new]
    np.bitwise_or.at(fresh, first // 3, 1 << first % 3)
    out, bits = np.empty(n, ids.dtype), np.empty(n, np.int64)
    out[order], bits[order] = ids[order][label], fresh
    return out, bits


def islands(triangles: DataFrame) -> DataFrame:
    """triangles (triangle, ax, ay, az, bx, ...) with island: the smallest triangle that can be reached by shared positions."""
    block = [F.floor(F.col(f"a{c}") / BLOCK) for c in "xyz"]
    dealt = triangles.repartition(*block).sortWithinPartitions(*block).select("*", *(_position(v).alias(f"_{v}") for v in "abc"))
    columns = triangles.columns
    schema = triangles.withColumns({"_label": F.lit(0).cast("bigint"), "_fresh": F.lit(0).cast("bigint")}).schema

    def run(batches):
        held, n = [], 0

        def label() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            at = np.stack([np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in rows[f"_{v}"].combine_chunks().flatten()], axis=1) for v in "abc"], axis=1)
            least, fresh = joined(rows["triangle"].to_numpy(), at)
            out = rows.select(columns).append_column("_label", pa.array(least)).append_column("_fresh", pa.array(fresh))
            return out.to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= STRETCH:
                yield from label()
                held, n = [], 0
        if n:
            yield from label()

    rows = staged(dealt.mapInArrow(run, schema), "stretches")
    own = F.array(*(F.when(F.col("_fresh").bitwiseAND(1 << i) > 0, _position(v)) for i, v in enumerate("abc")))
    keys = rows.select("_label", F.explode(F.array_compact(own)).alias("key"))
    met = keys.groupBy("key").agg(F.min("_label").alias("first"), F.max("_label").alias("last")).filter("first < last").select("key", "first")
    found = connected_components(keys.join(met, "key").select(F.col("_label").alias("a"), F.col("first").alias("b")).filter("a <> b").distinct())
    return rows.drop("_fresh").join(found.select(F.col("node").alias("_label"), F.col("component").alias("island")), "_label", "left").withColumn("island", F.coalesce("island", "_label")).drop("_label")


def _apart(at: list[Column], s: IslandSettings, flat: bool = False) -> Column:
    total = F.lit(0.0)
    for c, v, axis in zip(at, s.seed, "xyz", strict=True):
        if not (flat and axis == "y"):
            total = total + (c - v) * (c - v)
    return F.sqrt(total)


def measured(found: DataFrame, s: IslandSettings) -> DataFrame:
    """A row for each island: triangles, area, area-weighted centre, heights, distances to the seed, and kept.

    Islands of less than a share of the largest's area never stay. Of the others the nearest stays (the larger of two), or, if
    islands are merged, all within reach over the plan and near the seed's height; the nearest over the plan if there are none."""
    own = M.area()
    # Sums of corners are divided by 3 at last: of corners on a lattice they are exact, so that thresholds don't hang on the order of summing.
    rows = found.select("island", own.alias("area"), *((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")).alias(c) for c in "xyz"), F.least("ay", "by", "cy").alias("low"), F.greatest("ay", "by", "cy").alias("high"))
    sums = rows.groupBy("island").agg(F.count("*").alias("triangles"), F.sum("area").alias("area"), *(F.sum(F.col(c) * F.col("area")).alias(c) for c in "xyz"), F.min("low").alias("low"), F.max("high").alias("high"))
    mean = [F.when(F.col("area") > 0, F.col(c) / (F.col("area") * 3.0)).otherwise(0.0).alias(f"centre_{c}") for c in "xyz"]
    out = sums.select("island", "triangles", "area", *mean, "low", "high")
    at = [F.col(f"centre_{c}") for c in "xyz"]
    out = staged(out.withColumn("distance", _apart(at, s)).withColumn("flat_distance", _apart(at, s, flat=True)), "islands")
    top = out.agg(F.max("area")).first()[0]
    viable = F.col("area") >= F.lit(top or 0.0) * s.least_share
    near = (F.col("flat_distance") <= s.reach) & (F.abs(F.col("centre_y") - s.seed[1]) <= s.band)
    kept = viable & near
    if not s.merge or out.filter(kept).isEmpty():
        nearest = out.filter(viable).orderBy("flat_distance" if s.merge else "distance", F.desc("area"), "island").first()
        kept = F.col("island") == F.lit(nearest and nearest["island"])
    return out.withColumn("kept", F.coalesce(kept, F.lit(False)))


def near_seed(found: DataFrame, measures: DataFrame, s: IslandSettings) -> DataFrame:
    """The triangles of kept islands with their distance to the seed; nearest first is the order that a mesh of them has."""
    kept = staged(measures.filter("kept").select("island"), "kept")  # few of the islands, and known to be
    return found.join(kept, "island", "left_semi").withColumn("distance", _apart(M.centre(), s))


def selection(measures: DataFrame) -> DataFrame:
    """One row, or none without islands: what is kept all together, and the distance of the nearest of it."""
    kept = measures.filter("kept")
    mean = [F.when(F.sum("area") > 0, F.sum(F.col(f"centre_{c}") * F.col("area")) / F.sum("area")).otherwise(0.0).alias(f"centre_{c}") for c in "xyz"]
    row = kept.agg(F.count("*").alias("kept_islands"), F.sum("triangles").alias("triangles"), F.sum("area").alias("area"), *mean, F.min_by("distance", F.struct("flat_distance", -F.col("area"))).alias("distance"))
    return row.filter("kept_islands > 0")


def verdict(chosen: DataFrame, s: IslandSettings, floor: float | None = None) -> DataFrame:
    """chosen with the reason why it can't be walked, null if it can: tiny, far from the seed, or below the floor."""
    below = F.lit(False) if floor is None else F.col("centre_y") - floor < -0.7
    why = F.when((F.col("area") < 0.35) | (F.col("triangles") < 2), "tiny").when(F.col("distance") > s.reach, "too_far").when(below, "below_floor")
    return chosen.withColumn("rejected", why)


def companion(found: DataFrame, player: tuple[float, float, float]) -> DataFrame:
    """One row or none: the triangle centre furthest from the player over the plan, each metre of height counting against it twice; none
    nearer than 0.75 m counts."""
    x, y, z = M.centre()
    flat = F.sqrt((x - player[0]) * (x - player[0]) + (z - player[2]) * (z - player[2]))
    rows = found.select("triangle", x.alias("x"), y.alias("y"), z.alias("z"), flat.alias("flat")).filter("flat >= 0.75").withColumn("score", F.col("flat") - F.abs(F.col("y") - player[1]) * 2.0)
    best = rows.agg(F.max_by(F.struct("triangle", "x", "y", "z", "score"), F.struct("score", -F.col("triangle"))).alias("r"))
    return best.filter("r is not null").select("r.*")


def farthest_vertex(vertices: DataFrame, start: tuple[float, float, float]) -> DataFrame:
    """One row or none: the vertex furthest from the start over the plan, the first of several."""
    d2 = (F.col("x") - start[0]) * (F.col("x") - start[0]) + (F.col("z") - start[2]) * (F.col("z") - start[2])
    best = vertices.agg(F.max_by(F.struct("vertex", "x", "y", "z", F.sqrt(d2).alias("distance")), F.struct(d2, -F.col("vertex"))).alias("r"))
    return best.filter("r is not null").select("r.*")


def closest_centre(found: DataFrame, target: tuple[float, float, float]) -> DataFrame:
    """One row or none: the triangle whose centre is nearest to the target, the first of several."""
    own = found.select("triangle", *(c.alias(n) for c, n in zip(M.centre(), "xyz", strict=True)))
    d2 = sum(((F.col(c) - t) * (F.col(c) - t) for c, t in zip("xyz", target, strict=True)), F.lit(0.0))
    best = own.agg(F.min_by(F.struct("triangle", "x", "y", "z", F.sqrt(d2).alias("distance")), F.struct(d2, "triangle")).alias("r"))
    return best.filter("r is not null").select("r.*")
