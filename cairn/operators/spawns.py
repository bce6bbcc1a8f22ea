"""Places to stand near seeds, for many seeds at once: free voxels with floor, headroom and clearance, nearest first.

What a place is worth doesn't depend on a seed, so that places are judged once, by joins on columns of the volume; seeds then
meet the places of the columns around them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import voxels as V
from cairn.sources.tables import staged

#: Fixed values, in metres: how far around a seed places are looked for, and how far from the deck's height one counts as on it.
SEARCH, DECK_BAND = 5.0, 0.35


def _offsets(pairs: list[tuple[int, ...]], names: str) -> Column:
    return F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, p, strict=True))) for p in pairs))).alias("o")


def free(solid: DataFrame, nav: DataFrame) -> DataFrame:
    return nav.select(*V.AXES).join(solid.select(*V.AXES), list(V.AXES), "left_anti")


def places(solid: DataFrame, nav: DataFrame, box: V.Box, radius: float, height: float) -> DataFrame:
    """vx, vy, vz, floor of the free voxels in which a cylinder can stand: below each column that it covers the first solid voxel is floor, no
    voxel above hangs lower than the highest of these floors and the height, and the body on that floor is clear."""
    reach = math.ceil(radius / box.size)
    feet = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i * box.size) ** 2 + (j * box.size) ** 2 <= radius * radius]
    own = free(solid, nav).select(F.struct(*V.AXES).alias("at"), *V.AXES)
    under = own.select("at", "vy", _offsets(feet, "ij")).select("at", "vy", (F.col("at.vx") + F.col("o.i")).alias("vx"), (F.col("at.vz") + F.col("o.j")).alias("vz"))
    met = under.join(solid.select("vx", "vz", F.col("vy").alias("sy")), ["vx", "vz"])
    sides = met.groupBy("at", "vx", "vz").agg(F.max(F.when(F.col("sy") < F.col("vy"), F.col("sy"))).alias("low"), F.min(F.when(F.col("sy") > F.col("vy"), F.col("sy"))).alias("high")).filter("low is not null")
    floor = V.walkable(solid, nav).filter(F.col("vy") < box.dims[1] - 1).withColumnRenamed("vy", "low")
    each = sides.join(floor, ["vx", "low", "vz"]).groupBy("at").agg(F.count("*").alias("columns"), F.max("low").alias("low"), F.min("high").alias("high")).filter(F.col("columns") == len(feet))
    top = F.lit(box.low[1]) + (F.col("low") + 1) * box.size
    roomy = each.filter(F.col("high").isNull() | (top + height <= F.lit(box.low[1]) + F.col("high") * box.size))
    wide, tall = max(0, math.ceil(radius / box.size) - 1), max(1, math.ceil(height / box.size))
    body = [(i, k, j) for i in range(-wide, wide + 1) for j in range(-wide, wide + 1) if i * i + j * j <= wide * wide + 1 for k in range(1, tall + 1)]
    stand = roomy.select("at", "low", _offsets(body, "ikj"))
    hit = stand.select("at", (F.col("at.vx") + F.col("o.i")).alias("vx"), (F.col("low") + F.col("o.k")).alias("vy"), (F.col("at.vz") + F.col("o.j")).alias("vz")).join(solid.select(*V.AXES), list(V.AXES), "left_semi").select("at").distinct()
    return roomy.filter(F.col("low") + 1 < box.dims[1]).join(hit, "at", "left_anti").select("at.*", top.alias("floor"))


def deck_height(solid: DataFrame, nav: DataFrame, box: V.Box) -> float | None:
    """The floor height below most free voxels of an even grid through the box, the lowest of several."""
    stride = max(1, min(box.dims[0], box.dims[2]) // 32)
    grid = lambda *axes: " and ".join(f"{v} % {stride} = 0" for v in axes)
    both = solid.select(*V.AXES, F.col("vy").alias("sy")).filter(grid("vx", "vz")).union(nav.select(*V.AXES, F.lit(None).cast("bigint")).filter(grid(*V.AXES)))
    up_to = Window.partitionBy("vx", "vz").orderBy("vy").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("low", F.max("sy").over(up_to)).filter("sy is null and low < vy")  # a voxel that is solid itself has low = vy
    below = rows.groupBy("vx", "vz", F.col("vy").alias("own")).agg(F.max("low").alias("vy"))
    best = below.groupBy(F.floor((F.lit(box.low[1]) + (F.col("vy") + 1) * box.size) / box.size + 0.5).alias("b")).count().orderBy(F.desc("count"), "b").first()
    return None if best is None else best["b"] * box.size


def spawns(seeds: DataFrame, solid: DataFrame, nav: DataFrame, box: V.Box, radius: float, height: float, search: float = SEARCH) -> DataFrame:
    """seeds (seed_id, x, y, z) -> seed_id, x, y, z of the nearest place within `search` of each, y a voxel below its floor; null without one.

    Places on the deck go first, unless the seed is far above or below it. Of equally near places the one in the smallest cube around the
    seed counts, then the lowest, then by z and x."""
    deck = deck_height(solid, nav, box)
    reach = math.ceil(search / box.size)
    at = seeds.select("seed_id", "x", "y", "z", *(F.floor((F.col(c) - low) / box.size).cast("bigint").alias(f"s{c}") for c, low in zip("xyz", box.low, strict=True)))
    around = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i * i + j * j) * box.size * box.size <= search * search]
    # Only columns that a seed can choose are judged, from those that a cylinder in them covers.
    columns = at.select(F.col("sx").alias("vx"), F.col("sz").alias("vz")).distinct()
    moved = lambda df, pairs: df.select("*", _offsets(pairs, "ij")).select((F.col("vx") + F.col("o.i")).alias("vx"), (F.col("vz") + F.col("o.j")).alias("vz")).distinct()
    columns, feet = staged(moved(columns, around), "columns"), math.ceil(radius / box.size)
    beside = staged(moved(columns, [(i, j) for i in range(-feet, feet + 1) for j in range(-feet, feet + 1)]), "columns")
    solid, nav = (staged(v.select(*V.AXES).join(beside, ["vx", "vz"], "left_semi"), n) for v, n in ((solid, "solid"), (nav, "nav")))
    good = staged(places(solid, nav, box, radius, height).join(columns, ["vx", "vz"], "left_semi"), "places")
    near = at.select("*", _offsets(around, "ij")).select("*", (F.col("sx") + F.col("o.i")).alias("vx"), (F.col("sz") + F.col("o.j")).alias("vz")).join(good, ["vx", "vz"])
    i, j, k = F.col("o.i"), F.col("vy") - F.col("sy"), F.col("o.j")
    d2 = (i * i + j * j + k * k) * F.lit(box.size) * box.size
    off = F.lit(False) if deck is None else (F.abs(F.col("y") - deck) <= DECK_BAND * 3) & (F.abs(F.col("floor") - deck) > DECK_BAND)
    order = F.struct(off.alias("off"), d2.alias("d2"), F.greatest(F.abs(i), F.abs(j), F.abs(k)).alias("r"), j.alias("j"), k.alias("k"), i.alias("i"))
    spot = F.struct((F.col("x") + i * box.size).alias("x"), (F.col("floor") - box.size).alias("y"), (F.col("z") + k * box.size).alias("z"))
    best = near.filter(d2 <= search * search).groupBy("seed_id").agg(F.min_by(spot, order).alias("r"))
    return seeds.select("seed_id").join(best, "seed_id", "left").select("seed_id", "r.x", "r.y", "r.z")


def collision_seed(bounds: dict[str, float | None], floor: float | None, seed: tuple[float, float, float] | None = None) -> tuple[float, float, float]:
    """The given seed if it is finite, else the middle of the bounds a metre above the floor; bounds by min_x .. max_z, 0 if there are none."""
    if seed is not None and len(seed) == 3 and all(math.isfinite(v) for v in seed):
        return tuple(seed)
    side = lambda n: 0.0 if bounds.get(n) is None else bounds[n]
    return (side("min_x") + side("max_x")) * 0.5, (side("min_y") if floor is None else floor) + 1.0, (side("min_z") + side("max_z")) * 0.5


def extents(solid: DataFrame, nav: DataFrame, box: V.Box) -> DataFrame:
    """One row: the least and greatest height of the walking space's voxel centres, the highest floor, and the box's heights; null where there is nothing."""
    middle = F.lit(box.low[1]) + (F.col("vy") + 0.5) * box.size
    top = V.walkable(solid, nav).filter(F.col("vy") < box.dims[1] - 1).agg(F.max(F.lit(box.low[1]) + (F.col("vy") + 1) * box.size).alias("floor_max")).first()[0]
    return nav.agg(F.min(middle).alias("nav_min"), F.max(middle).alias("nav_max")).select(
        F.lit(top).cast("double").alias("floor_max"), "nav_min", "nav_max", F.lit(box.low[1]).alias("box_min"), F.lit(box.low[1] + box.dims[1] * box.size).alias("box_max"),
    )
