"""Rays of any direction against a voxel volume, many at once.

The times at which a ray crosses the lattice planes of an axis are evenly spaced, so that the voxel behind each crossing follows
from counting the crossings of the other axes before it. A ray makes a row for each tile of voxels it enters, with its crossings there;
rows meet the bits of solid tiles by an equi-join, and the first hit is a grouped minimum; no ray walks step by step."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import voxels as V
from cairn.sources.tables import staged

#: Fixed values, in metres: how far above the feet a probe starts, and how far around the floor it looks.
PROBE_EYE, PROBE_RANGE = 1.3, 1.0
#: Edge of the tiles, 4096 voxels in 64 words of 64 bits, and the rays that a task takes at a time.
EDGE, AT_ONCE = 16, 4096
TILE = ("tx", "ty", "tz")


def _entered(ray: dict[str, np.ndarray], box: V.Box, reach: float) -> tuple[np.ndarray, ...]:
    """Of rays (s, step, first, every of each axis) a row for each voxel entered: the ray's number, t, rank, vx, vy, vz."""
    who, when, rank, count = [], [], [], []
    for r, (c, dim) in enumerate(zip("zyx", box.dims[::-1], strict=True)):
        most = np.where(ray[f"step{c}"] != 0, np.minimum(np.floor((reach - ray[f"first{c}"]) / ray[f"every{c}"]), dim + 2), -1)
        n = np.maximum(np.nan_to_num(most, nan=-1) + 1, 0).astype(np.int64)
        own = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        who.append(own)
        when.append(ray[f"first{c}"][own] + k * ray[f"every{c}"][own])
        rank.append(np.full(len(own), r))
        count.append(k)
    own, t, rank, k = (np.concatenate(v) for v in (who, when, rank, count))
    ok = (t > 1e-6) & (t <= reach)
    own, t, rank, k = own[ok], t[ok], rank[ok], k[ok]
    at = {}
    for r, c in enumerate("zyx"):
        # Crossings of this axis before the event: the nearest one is told by its own time, those on either side of it are clear.
        first, every, step = (ray[f"{n}{c}"][own] for n in ("first", "every", "step"))
        nearest = np.maximum(np.floor((t - first) / every + 0.5), -1)
        past = (nearest >= 0) & ((first + nearest * every < t) | ((first + nearest * every == t) & (r < rank)))
        other = np.where(step == 0, 0, np.maximum(nearest, 0) + past)
        at[c] = ray[f"s{c}"][own] + step * np.where(rank == r, k + 1, other).astype(np.int64)
    ok = np.logical_and.reduce([(at[c] >= 0) & (at[c] < d) for c, d in zip("xyz", box.dims, strict=True)])
    return own[ok], t[ok], rank[ok], *(at[c][ok] for c in "xyz")


def stretches(rays: DataFrame, box: V.Box, reach: float) -> DataFrame:
    """rays (ray_id, x, y, z, dx, dy, dz) -> a row for each tile entered up to `reach`: the ray, tx, ty, tz, and of each crossing there t and its
    code, the voxel's place in the tile times 3 and the rank.

    Of planes crossed at once the one of z is first, then y, then x: rank. A ray without direction, or with a place or direction that isn't
    finite, crosses nothing. A ray ends where it is more than a voxel outside the box."""
    rows = rays.select("ray_id", *"xyz", *(F.col(f"d{c}") for c in "xyz"))
    size = F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"), F.lit(0.0)))
    rows = rows.withColumn("size", size).filter((F.col("size") >= 1e-12) & (F.col("size") < math.inf) & ~F.isnan("size"))
    for c in "xyz":
        rows = rows.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    at = {c: F.floor((F.col(c) - low) / box.size) for c, low in zip("xyz", box.low, strict=True)}
    rows = rows.select("ray_id", *"xyz", *((F.col(f"d{c}") / F.nullif("size", F.lit(0.0))).alias(f"d{c}") for c in "xyz"), *(v.cast("bigint").alias(f"s{c}") for c, v in at.items()))
    for c, low in zip("xyz", box.low, strict=True):
        d = F.col(f"d{c}")
        edge = F.when(d > 0, F.col(f"s{c}") + 1).otherwise(F.col(f"s{c}")) * box.size
        rows = rows.withColumn(f"step{c}", F.signum(d).cast("bigint")).withColumn(f"first{c}", (edge - (F.col(c) - low)) / F.nullif(d, F.lit(0.0))).withColumn(f"every{c}", F.abs(F.lit(box.size) / F.nullif(d, F.lit(0.0))))
    rows = staged(rows, "rays")  # so that the columns below stay short
    # The first crossing of all decides whether the ray begins near the box.
    rows = rows.withColumn("start", F.array_min(F.array(*(F.when(F.col(f"step{c}") != 0, F.struct(F.col(f"first{c}").alias("t"), F.lit(r).alias("rank"))) for r, c in enumerate("zyx")))))
    near = []
    for r, (c, dim) in enumerate(zip("zyx", box.dims[::-1], strict=True)):
        near.append((F.col(f"s{c}") + F.when(F.col("start.rank") == r, F.col(f"step{c}")).otherwise(0)).between(-1, dim))
    rows = rows.filter(reduce(lambda a, b: a & b, near))
    kept = ["ray_id", *"xyz", *(f"d{c}" for c in "xyz")]
    numbers = [f"{n}{c}" for n in ("s", "step", "first", "every") for c in "xyz"]
    schema = rows.select(*kept, *(F.lit(0).cast("bigint").alias(c) for c in TILE), F.array().cast("array<int>").alias("codes"), F.array().cast("array<double>").alias("ts")).schema

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(start, AT_ONCE)
                with np.errstate(all="ignore"):
                    own, t, rank, *at = _entered({c: batch[c].to_numpy(zero_copy_only=False) for c in numbers}, box, reach)
                tile = [v // EDGE for v in at]
                code = ((at[1] % EDGE * EDGE + at[2] % EDGE) * EDGE + at[0] % EDGE) * 3 + rank
                order = np.lexsort((*tile, own))
                new = np.ones(len(order), bool)
                new[1:] = np.logical_or.reduce([np.diff(v[order]) != 0 for v in (own, *tile)])
                heads = np.flatnonzero(new)
                ends = pa.array(np.append(heads, len(order)).astype(np.int32))
                of = order[heads]
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (code[order].astype(np.int32), t[order])]
                yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(own[of])) for c in kept), *(pa.array(v[of]) for v in tile), *lists], names=[*kept, *TILE, "codes", "ts"])

    return rows.select(*kept, *numbers).mapInArrow(run, schema)


def tiles(solid: DataFrame) -> DataFrame:
    """solid voxels -> tx, ty, tz, words: of each tile its words (word, bits) with any bit set, 64 at most."""
    x, y, z = (F.pmod(F.col(v), F.lit(EDGE)) for v in V.AXES)
    place = ((y * EDGE + z) * EDGE + x).cast("int")
    at = solid.select(*(F.floor(F.col(v) / EDGE).alias(t) for v, t in zip(V.AXES, TILE, strict=True)), place.alias("place"))
    words = at.groupBy(*TILE, F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits"))
    return words.groupBy(*TILE).agg(F.collect_list(F.struct("word", "bits")).alias("words"))


def _first(met: DataFrame) -> DataFrame:
    """Rows of stretches() with the words of their tiles -> of each that meets a solid voxel the ray, and t and rank of the first."""
    kept = ["ray_id", *"xyz", *(f"d{c}" for c in "xyz")]
    schema = met.select(*kept, F.lit(0.0).alias("t"), F.lit(0).alias("rank")).schema

    def run(batches):
        for batch in batches:
            n, codes, words = batch.num_rows, batch["codes"], batch["words"]
            each = lambda lists: np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            bits = np.zeros((n, 64), np.int64)
            word = words.flatten()
            bits[each(words), word.field("word").to_numpy()] = word.field("bits").to_numpy()
            row, code, t = each(codes), codes.flatten().to_numpy(), batch["ts"].flatten().to_numpy()
            place = code // 3
            hit = np.flatnonzero((bits[row, place >> 6] >> (place & 63)) & 1)
            hit = hit[np.lexsort((code[hit] % 3, t[hit], row[hit]))]
            hit = hit[np.diff(row[hit], prepend=-1) != 0]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(row[hit])) for c in kept), pa.array(t[hit]), pa.array((code[hit] % 3).astype(np.int32))], names=[*kept, "t", "rank"])

    return met.mapInArrow(run, schema)


def first_hits(rays: DataFrame, solid: DataFrame, box: V.Box, reach: float) -> DataFrame:
    """rays (ray_id, x, y, z, dx, dy, dz) -> of each ray that meets a solid voxel within reach: ray_id, distance, normal (nx, ny, nz) and position
    (hx, hy, hz). The voxel in which a ray starts doesn't count."""
    met = _first(stretches(rays, box, reach).join(tiles(solid), list(TILE)))
    normal = [F.when(F.col("rank") == r, -F.signum(f"d{c}")).otherwise(0).cast("bigint").alias(f"n{c}") for r, c in enumerate("zyx")]
    at = [(F.col(c) + F.col(f"d{c}") * F.col("t")).alias(f"h{c}") for c in "xyz"]
    best = met.groupBy("ray_id").agg(F.min(F.struct("t", "rank", *normal[::-1], *at)).alias("r"))
    return best.select("ray_id", F.col("r.t").alias("distance"), *(f"r.n{c}" for c in "xyz"), *(f"r.h{c}" for c in "xyz"))


def probed(points: DataFrame, solid: DataFrame, box: V.Box, radius: float) -> DataFrame:
    """points (point_id, x, y, z), y the feet's height -> point_id, ground: the mean height, less a voxel, that five rays down around each point find
    near its floor (a voxel above the feet); null where they find none."""
    offsets = [(0.0, 0.0), (-radius, 0.0), (radius, 0.0), (0.0, radius), (0.0, -radius)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(offsets)))).alias("o")
    floor = F.col("y") + box.size
    rows = points.select("point_id", "x", floor.alias("floor"), "z", each)
    rays = rows.select(F.struct("point_id", "o.k").alias("ray_id"), (F.col("x") + F.col("o.i")).alias("x"), (F.col("floor") + PROBE_EYE).alias("y"), (F.col("z") + F.col("o.j")).alias("z"), *(F.lit(float(d)).alias(n) for n, d in zip(("dx", "dy", "dz"), (0, -1, 0), strict=True)))
    hits = first_hits(rays, solid, box, PROBE_EYE + PROBE_RANGE).select(F.col("ray_id.point_id").alias("point_id"), "hy")
    near = hits.join(points.select("point_id", floor.alias("floor")), "point_id").filter(F.abs(F.col("hy") - F.col("floor")) <= PROBE_RANGE + 1e-3)
    return points.select("point_id").join(near.groupBy("point_id").agg((F.avg("hy") - box.size).alias("ground")), "point_id", "left")
