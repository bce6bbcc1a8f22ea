"""The walkable ground field: density profiles of columns, their layers, the common floor, and the state of each cell.

The grid is sparse: a row for each cell that splats reach. Geometry that all rows share is a handful of
numbers, taken once from a one-row aggregate."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.cloud import nearest_rank
from cairn.operators.components import cell_components
from cairn.sources.tables import staged


@dataclass(frozen=True)
class FieldSettings:
    cell: float = 0.5
    vertical: float = 0.08
    influence: float = 2.5
    projection: float = 0.16
    obstacle_height: float = 0.24
    density: float = 0.08
    layers: int = 2
    smoothing: int = 1
    confidence: float = 0.01
    evidence: float = 0.001
    obstacle: float = 0.35
    clearance: tuple[float, float] = (0.16, 1.7)
    hole_radius: int = 1
    agent_radius: float = 0.0

    @property
    def continuity(self) -> float:
        return max(self.obstacle_height, 0.2)


@dataclass(frozen=True)
class Grid:
    min_u: float
    min_v: float
    width: int
    height: int
    low: float
    bins: int
    floor: float


def grid_of(splats: DataFrame, s: FieldSettings) -> Grid | None:
    """The field's grid over the splats' bounds, None without extent."""
    x0, x1, z0, z1, y0, y1 = splats.agg(*(f(c) for c in "xzy" for f in (F.min, F.max))).first()
    if x0 is None or x1 <= x0 or z1 <= z0:
        return None
    pad = max(s.obstacle_height, s.projection) * 2.0
    bins = min(max(math.ceil((y1 + pad - (y0 - pad)) / s.vertical), 2), 256)
    cells = lambda a, b: max(math.ceil((b - a) / s.cell), 1)
    return Grid(x0, z0, cells(x0, x1), cells(z0, z1), y0 - pad, bins, nearest_rank(splats, "y", 0.02))


def profiles(splats: DataFrame, g: Grid, s: FieldSettings) -> DataFrame:
    """row, col, bin, density: each splat's Gaussian share in the cells and height bins within its reach.

    Splats generate the cells that they reach, so that no range join is needed; sums combine before the shuffle.
    Cells and bins are dealt in two steps, the falloff over the floor plan computed once for all bins."""
    size = F.greatest(F.col("scale"), F.lit(0.001))
    reach = F.least(F.greatest(size * s.influence, F.lit(s.cell * 0.5)), F.lit(s.cell * 4.0))
    up = F.least(F.abs("ny"), F.lit(1.0))
    sigma = F.greatest(size, F.lit(s.vertical * 0.5))
    rows = splats.select(
        "x", "y", "z", reach.alias("reach"), sigma.alias("sigma"), up.alias("up"),
        (F.greatest(F.col("opacity"), F.lit(0.0)) * (0.35 + 0.65 * up)).alias("base"),
        F.round((F.col("y") - g.low) / s.vertical).cast("int").alias("centre"),
        F.least(F.greatest(F.ceil(sigma * s.influence / s.vertical), F.lit(1)), F.lit(8)).cast("int").alias("around"),
    )
    span = lambda c, low, n: F.sequence(F.greatest(F.floor((F.col(c) - F.col("reach") - low) / s.cell), F.lit(0)), F.least(F.floor((F.col(c) + F.col("reach") - low) / s.cell), F.lit(n - 1)))
    rows = rows.withColumn("row", F.explode(span("z", g.min_v, g.height))).withColumn("col", F.explode(span("x", g.min_u, g.width)))
    dx, dz = g.min_u + (F.col("col") + 0.5) * s.cell - F.col("x"), g.min_v + (F.col("row") + 0.5) * s.cell - F.col("z")
    rows = rows.withColumn("d2", dx * dx + dz * dz).filter(F.col("d2") <= F.col("reach") * F.col("reach"))
    rows = rows.withColumn("share", F.col("base") * F.exp(-F.col("d2") / (2.0 * F.col("reach") * F.col("reach"))))
    bins = F.sequence(F.greatest(F.col("centre") - F.col("around"), F.lit(0)), F.least(F.col("centre") + F.col("around"), F.lit(g.bins - 1)))
    rows = rows.filter(F.col("centre") + F.col("around") >= 0).withColumn("bin", F.explode(bins))
    dy = g.low + (F.col("bin") + 0.5) * s.vertical - F.col("y")
    weight = F.col("share") * F.exp(-(dy * dy) / (2.0 * F.col("sigma") * F.col("sigma")))
    return rows.groupBy("row", "col", "bin").agg(F.sum(weight).alias("density"))


def layers(profile: DataFrame, g: Grid, s: FieldSettings) -> DataFrame:
    """row, col, first and last bin, weighted height and weight of each run of bins of enough density; a column has 256 bins at most."""
    column = Window.partitionBy("row", "col").orderBy("bin")
    runs = profile.filter(F.col("density") >= s.density).withColumn("run", F.col("bin") - F.row_number().over(column))
    height = g.low + (F.col("bin") + 0.5) * s.vertical
    return runs.groupBy("row", "col", "run").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), (F.sum(height * F.col("density")) / F.sum("density")).alias("height"), F.sum("density").alias("weight")).drop("run")


def floor_height(layer: DataFrame, g: Grid, s: FieldSettings) -> float | None:
    """The lowest significant peak of the layers' smoothed height histogram (256 bins at most, on the driver)."""
    at = F.least(F.greatest(F.floor((F.col("height") - g.low) / s.vertical), F.lit(0)), F.lit(g.bins - 1)).cast("int")
    weights = dict(layer.groupBy(at.alias("bin")).agg(F.sum("weight")).collect())
    return lowest_peak([weights.get(b, 0.0) for b in range(g.bins)], g, s)


def lowest_peak(histogram: list[float], g: Grid, s: FieldSettings) -> float | None:
    n, around = len(histogram), min(max(math.floor(0.15 / s.vertical + 0.5), 1), 6)
    smooth = [sum(histogram[max(0, b - around) : b + around + 1]) for b in range(n)]
    top = max(smooth, default=0.0)
    if top <= 0:
        return None
    height = lambda b: g.low + (b + 0.5) * s.vertical
    good = [b for b in range(n) if smooth[b] >= 0.25 * top and height(b) >= g.floor - max(s.vertical * 4.0, 0.5)]
    peak = [b for b in good if (b == 0 or smooth[b] >= smooth[b - 1]) and (b + 1 >= n or smooth[b] >= smooth[b + 1])]
    return height((peak or good or [max(range(n), key=lambda b: (smooth[b], b))])[0])


def surfaces(profile: DataFrame, layer: DataFrame, floor: float | None, s: FieldSettings) -> DataFrame:
    """A row for each cell with density: its floor layer (the nearest to the common floor, the lower of two), and what stands in the way above it."""
    column = Window.partitionBy("row", "col")
    far = F.abs(F.col("height") - F.lit(floor)) if floor is not None else F.col("first")
    marked = layer.withColumn("main", F.min_by(F.struct("height", "weight", "first", "last"), F.struct(far.alias("d"), F.col("first").alias("f"))).over(column))
    marked = marked.withColumn("place", F.row_number().over(column.orderBy("first"))).withColumn("delta", F.col("height") - F.col("main.height"))
    blocks = F.col("delta").between(*s.clearance)
    used = F.when(F.col("place") <= max(s.layers, 1), F.col("weight"))
    found = marked.groupBy("row", "col").agg(
        F.first("main.height").alias("height"), F.count("*").alias("layer_count"), F.first("main.weight").alias("confidence"),
        F.coalesce(F.sum(F.when(blocks, F.col("weight"))), F.lit(0.0)).alias("obstacle"),
        (F.sum(used * F.col("delta") * F.col("delta")) / F.sum(used)).alias("variance"),
        F.first(F.col("main.last") - F.col("main.first") + 1).alias("floor_bins"),
        F.coalesce(F.sum(F.when(blocks, F.col("last") - F.col("first") + 1)), F.lit(0)).alias("obstacle_bins"),
    )
    peak = profile.groupBy("row", "col").agg(F.max("density").alias("peak"))
    return peak.join(found, ["row", "col"], "left")


def around(cells: DataFrame, reach: int, corners: bool = True, itself: bool = True) -> DataFrame:
    """Pairs of cells with those in reach: row, col of the one, and n (a struct of all columns) of the other."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (itself or (i, j) != (0, 0)) and (corners or i == 0 or j == 0)]
    offset = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))).alias("o")
    moved = cells.select(F.struct(*cells.columns).alias("n"), offset).select((F.col("n.row") + F.col("o.i")).alias("row"), (F.col("n.col") + F.col("o.j")).alias("col"), "n", "o")
    return moved


def smoothed(cells: DataFrame, g: Grid, s: FieldSettings) -> DataFrame:
    """height as the mean of the cells around, for cells of one layer or near the floor, from three such cells on."""
    if s.smoothing <= 0:
        return cells
    fit = F.col("height").isNotNull() & ((F.col("layer_count") <= 1) | (F.abs(F.col("height") - g.floor) <= s.continuity))
    able = cells.filter(fit).select("row", "col", "height")
    means = around(able, s.smoothing).groupBy("row", "col").agg(F.avg("n.height").alias("mean"), F.count("*").alias("many"))
    change = means.join(able.select("row", "col"), ["row", "col"], "left_semi").filter("many >= 3").drop("many")
    return cells.join(change, ["row", "col"], "left").withColumn("height", F.coalesce("mean", "height")).drop("mean")


def classified(cells: DataFrame, s: FieldSettings) -> DataFrame:
    """state of each cell. Heights that depart a little from the (upper) median around them take it, all at once from
    the heights before; larger steps are ledges. The original snaps in scan order, each seeing earlier snaps."""
    near = around(cells.filter("height is not null").select("row", "col", "height"), 1, itself=False).groupBy("row", "col").agg(F.sort_array(F.collect_list("n.height")).alias("hs"))  # eight at most
    median = F.when(F.size("hs") >= 3, F.get("hs", F.floor(F.size("hs") / 2).cast("int")))
    rows = cells.join(near, ["row", "col"], "left").withColumn("median", median).drop("hs")
    step = F.abs(F.col("height") - F.col("median"))
    ledge = F.coalesce(step >= max(s.continuity * 2.5, 0.6), F.lit(False))
    rows = rows.withColumn("ledge", ledge).withColumn("height", F.when((step > s.continuity) & ~ledge, F.col("median")).otherwise(F.col("height"))).drop("median")
    total = F.coalesce(F.col("confidence"), F.lit(0.0)) + F.coalesce(F.col("obstacle"), F.lit(0.0))
    score = F.when(total > 0, F.col("obstacle") / total).otherwise(0.0)
    state = F.when(F.col("layer_count").isNull(), "void").when((F.col("obstacle") >= s.evidence) & (score >= s.obstacle), "obstacle").when(total < s.evidence, "void")
    state = state.when(F.col("confidence") < s.confidence, "low_confidence").when(F.col("ledge"), "height_variance").otherwise("walkable")
    return rows.withColumn("obstacle_score", score).withColumn("state", state).drop("ledge")


def gradients(cells: DataFrame, s: FieldSettings) -> DataFrame:
    """Central differences of the heights along columns and rows; a missing neighbour counts as the cell itself."""
    height = cells.select("row", "col", "height")
    side = around(height, 1, corners=False, itself=False).withColumn("axis", F.when(F.col("o.j") != 0, F.when(F.col("o.j") < 0, "right").otherwise("left")).when(F.col("o.i") < 0, "down").otherwise("up"))
    parts = side.groupBy("row", "col").agg(*(F.max(F.when(F.col("axis") == a, F.col("n.height"))).alias(a) for a in ("left", "right", "up", "down")))
    own = F.col("height")
    slope = lambda a, b: F.coalesce((F.coalesce(F.col(b), own) - F.coalesce(F.col(a), own)) / (2.0 * s.cell), F.lit(0.0))
    return cells.join(parts, ["row", "col"], "left").withColumn("gradient_x", slope("left", "right")).withColumn("gradient_z", slope("up", "down")).drop("left", "right", "up", "down")


def filled(cells: DataFrame, g: Grid, s: FieldSettings) -> DataFrame:
    """Holes of low confidence or none, closed in by accepted cells and small enough, take the mean height around them.

    Cells of the grid that no splat reaches are void as well; those further from reached cells than any cell of
    a small hole can be only mark their hole as too large."""
    if s.hole_radius <= 0:
        return cells
    most, reach = (2 * s.hole_radius + 1) ** 2, 1
    while 2 * reach * (reach - 1) + 1 <= most:  # a cell so far inside a hole needs a hole of so many cells
        reach += 1
    inside = F.col("row").between(0, g.height - 1) & F.col("col").between(0, g.width - 1)
    far = F.abs(F.col("o.i")) + F.abs(F.col("o.j"))
    rim = around(cells.select("row", "col"), reach).filter(inside & (far <= reach)).groupBy("row", "col").agg(F.min(far).alias("far"))
    every = staged(rim.join(cells, ["row", "col"], "left").withColumn("state", F.coalesce("state", F.lit("void"))), "cells")
    hole = staged(cell_components(every.filter(F.col("state").isin("low_confidence", "void")).select("row", "col", "far"), ("row", "col")), "holes")
    size = hole.groupBy("component").agg(F.count("*").alias("cells"), F.max((F.col("far") == reach) | (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == g.height - 1) | (F.col("col") == g.width - 1)).alias("open"))
    touch = around(every.select("row", "col", "state", "height"), 1, corners=False, itself=False).join(hole.drop("far"), ["row", "col"]).filter(~F.col("n.state").isin("low_confidence", "void"))
    accepted = F.col("n.state") == "walkable"
    rimmed = touch.groupBy("component").agg(F.min(accepted).alias("closed"), F.avg(F.when(accepted, F.col("n.height"))).alias("mean"))
    good = size.join(rimmed, "component").filter(F.col("closed") & ~F.col("open") & (F.col("cells") <= most) & F.col("mean").isNotNull()).select("component", "mean")
    change = hole.join(good, "component").select("row", "col", "mean")
    out = cells.join(change, ["row", "col"], "full")
    return out.withColumn("height", F.coalesce("mean", "height")).withColumn("state", F.when(F.col("mean").isNotNull(), "filled").otherwise(F.col("state"))).drop("mean")


BLOCKING = ("obstacle", "height_variance", "void", "low_confidence")


def eroded(cells: DataFrame, s: FieldSettings) -> DataFrame:
    """Accepted cells nearer to a blocking one than the agent's radius, by steps of 1 and sqrt(2), become eroded."""
    if s.agent_radius <= 0:
        return cells
    reach = math.ceil(s.agent_radius / s.cell)
    blocked = cells.filter(F.col("state").isin(*BLOCKING)).select("row", "col")
    i, j = F.abs(F.col("o.i")), F.abs(F.col("o.j"))
    steps = F.greatest(i, j) + F.least(i, j) * (math.sqrt(2) - 1)
    near = around(blocked, reach).filter(steps * s.cell < s.agent_radius).select("row", "col").distinct().withColumn("near", F.lit(True))
    return cells.join(near, ["row", "col"], "left").withColumn("state", F.when(F.col("near") & F.col("state").isin("walkable", "filled"), "eroded").otherwise(F.col("state"))).drop("near")


def with_components(cells: DataFrame) -> DataFrame:
    """component: the smallest cell (row, col) of an accepted cell's component, null for others."""
    found = cell_components(cells.filter(F.col("state").isin("walkable", "filled")).select("row", "col"), ("row", "col"))
    return cells.join(found, ["row", "col"], "left")


@dataclass(frozen=True)
class Field:
    grid: Grid
    floor: float | None
    cells: DataFrame


def build(splats: DataFrame, s: FieldSettings = FieldSettings()) -> Field | None:
    """The whole field of filtered splats; None without extent."""
    g = grid_of(splats, s)
    if g is None:
        return None
    profile = staged(profiles(splats, g, s), "profile")
    layer = staged(layers(profile, g, s), "layers")
    floor = floor_height(layer, g, s)
    cells = smoothed(staged(surfaces(profile, layer, floor, s), "surfaces"), g, s)
    cells = staged(gradients(classified(cells, s), s), "classified")
    return Field(g, floor, staged(with_components(eroded(filled(cells, g, s), s)), "field"))


def density() -> Column:
    return F.greatest(F.coalesce(F.col("peak"), F.lit(0.0)), F.coalesce(F.col("confidence"), F.lit(0.0)))


def dense_floor(field: Field, s: FieldSettings, bin_size: float = 0.25, share: float = 0.6) -> DataFrame:
    """One row or none: the modal height of the denser cells, and the density-weighted centre of those near it."""
    g = field.grid
    rows = field.cells.filter("height is not null").withColumn("density", density()).filter("density > 0")
    n = rows.count()
    if n < 8:
        return rows.limit(0).select(F.lit(0.0).alias("modal_height"), *(F.lit(0.0).alias(f"centre_{c}") for c in "xyz"), F.lit(0).cast("bigint").alias("cells"))
    least = nearest_rank(rows, "density", min(n - 1, math.floor(n * share)) / (n - 1))
    dense = rows.filter(F.col("density") >= least)
    modal = dense.groupBy(F.floor(F.col("height") / bin_size + 0.5).alias("b")).agg(F.sum("density").alias("w")).agg(F.max_by("b", F.struct("w", -F.col("b"))).alias("b")).first()[0] * bin_size
    core = dense.filter(F.abs(F.col("height") - modal) <= bin_size)
    x, z = g.min_u + (F.col("col") + 0.5) * s.cell, g.min_v + (F.col("row") + 0.5) * s.cell
    centre = [(F.sum(v * F.col("density")) / F.sum("density")).alias(f"centre_{c}") for c, v in (("x", x), ("y", F.col("height")), ("z", z))]
    return core.agg(F.lit(modal).alias("modal_height"), *centre, F.count("*").alias("cells"))


def dense_region(field: Field, s: FieldSettings, below: float = 0.6, above: float = 3.0) -> DataFrame:
    """One row or none: the box over all cells from a little below the denser cells' modal height to headroom above it, two cells wider on each side."""
    core = dense_floor(field, s).first()
    g, margin = field.grid, 2.0 * s.cell
    height = F.lit(None) if core is None or core["modal_height"] is None else F.lit(core["modal_height"])
    near = field.cells.filter(F.col("height").between(height - below, height + above))
    x, z = g.min_u + (F.col("col") + 0.5) * s.cell, g.min_v + (F.col("row") + 0.5) * s.cell
    out = near.agg((F.min(x) - margin).alias("min_x"), (height - below).cast("double").alias("min_y"), (F.min(z) - margin).alias("min_z"), (F.max(x) + margin).alias("max_x"), (height + above).cast("double").alias("max_y"), (F.max(z) + margin).alias("max_z"))
    return out.filter("min_x is not null")
