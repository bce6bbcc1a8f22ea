"""Sparse voxel volumes: occupancy by summed opacity, dilation, fill, carving by reachability, and what can be walked.

A volume is the set of its voxels as rows (vx, vy, vz). Free space is only formed inside a box whose number of
voxels the settings limit, as the fill and the carving need it."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cairn.functions.geometry import voxel
from cairn.operators.components import cell_components
from cairn.sources.tables import staged

AXES = ("vx", "vy", "vz")


@dataclass(frozen=True)
class VoxelSettings:
    size: float = 0.5
    fill: float = 1.6
    scene: str = "indoor"
    threshold: float = 0.1
    most: int = 1_500_000
    carve_height: float = 1.6
    carve_radius: float = 0.2


@dataclass(frozen=True)
class Box:
    low: tuple[float, float, float]
    dims: tuple[int, int, int]
    size: float

    def cell(self, x: float, y: float, z: float) -> tuple[int, ...] | None:
        at = tuple(math.floor((v - a) / self.size) for v, a in zip((x, y, z), self.low, strict=True))
        return at if all(0 <= v < d for v, d in zip(at, self.dims, strict=True)) else None

    def columns(self) -> list[Column]:
        return [voxel(F.col(c), a, self.size).alias(v) for c, a, v in zip("xyz", self.low, AXES, strict=True)]

    def holds(self) -> Column:
        ok = F.lit(True)
        for v, d in zip(AXES, self.dims, strict=True):
            ok = ok & F.col(v).between(0, d - 1)
        return ok


def padding(s: VoxelSettings) -> float:
    return max(math.ceil(s.fill / s.size), 1) * s.size + s.size if s.scene in ("indoor", "outdoor") else max(s.fill, 0.3)


def box_of(low: tuple[float, float, float], high: tuple[float, float, float], s: VoxelSettings) -> Box | None:
    """The padded grid over the bounds; voxels grow by a quarter until it has no more than `most`, None if half a metre isn't enough."""
    size, pad = min(max(s.size, 0.025), 0.5), padding(replace(s, size=min(max(s.size, 0.025), 0.5)))
    while True:
        dims = tuple(int(max(math.ceil((b + pad - (a - pad)) / size), 1)) + 1 for a, b in zip(low, high, strict=True))
        if math.prod(dims) <= min(s.most, 2_500_000):
            return Box(tuple(a - pad for a in low), dims, size)
        if size >= 0.5:
            return None
        size *= 1.25


def densities(splats: DataFrame, box: Box) -> DataFrame:
    """vx, vy, vz, density: each splat's opacity falls off over the voxels within its reach, which it generates itself."""
    size = F.greatest(F.col("scale"), F.lit(box.size * 0.5))
    reach = F.least(F.greatest(size * 2.5, F.lit(box.size)), F.lit(box.size * 6.0))
    rows = splats.select("x", "y", "z", F.greatest(F.col("opacity"), F.lit(0.0)).alias("opacity"), reach.alias("reach"), *box.columns()).filter(box.holds())
    rows = rows.withColumn("r", F.ceil(F.col("reach") / box.size))
    d2 = F.lit(0.0)
    for c, v, low, d in zip("xyz", AXES, box.low, box.dims, strict=True):
        rows = rows.withColumn(v, F.explode(F.sequence(F.greatest(F.col(v) - F.col("r"), F.lit(0)), F.least(F.col(v) + F.col("r"), F.lit(d - 1)))))
        d2 = d2 + (low + (F.col(v) + 0.5) * box.size - F.col(c)) * (low + (F.col(v) + 0.5) * box.size - F.col(c))
    rows = rows.withColumn("d2", d2).filter(F.col("d2") <= F.col("reach") * F.col("reach"))
    return rows.groupBy(*AXES).agg(F.sum(F.col("opacity") * F.exp(-F.col("d2") / (2.0 * F.col("reach") * F.col("reach")))).alias("density"))


def solids(splats: DataFrame, box: Box, threshold: float) -> DataFrame:
    return densities(splats, box).filter(F.col("density") >= max(threshold, 0.001)).select(*AXES)


def space(spark, box: Box) -> DataFrame:
    """Every voxel of the box, from one range: no cross join."""
    dx, dy, dz = box.dims
    return spark.range(dx * dy * dz).select((F.col("id") % dx).alias("vx"), F.floor(F.col("id") / (dx * dz)).alias("vy"), (F.floor(F.col("id") / dx) % dz).alias("vz"))


def dilated(volume: DataFrame, box: Box, reach: tuple[int, int, int]) -> DataFrame:
    """All voxels of the box within reach along each axis, one axis at a time."""
    out = volume.select(*AXES)
    for v, r, d in zip(AXES, reach, box.dims, strict=True):
        if r > 0:
            out = out.withColumn(v, F.explode(F.sequence(F.greatest(F.col(v) - r, F.lit(0)), F.least(F.col(v) + r, F.lit(d - 1))))).distinct()
    return out


def nearest(volume: DataFrame, at: tuple[int, ...], most: int) -> Row | None:
    """The voxel of the volume in the smallest cube around `at`, then the least y, z, x; None beyond `most`."""
    far = F.greatest(*(F.abs(F.col(v) - i) for v, i in zip(AXES, at, strict=True)))
    return volume.withColumn("far", far).filter(F.col("far") <= most).orderBy("far", "vy", "vz", "vx").first()


def reachable(volume: DataFrame, start: Row) -> DataFrame:
    """The voxels joined to the start by faces: its component."""
    parts = staged(cell_components(volume.select(*AXES), AXES), "reach")
    own = parts.filter(F.struct(*AXES) == F.struct(*(F.lit(start[v]).cast("bigint").alias(v) for v in AXES))).select("component")
    return parts.join(F.broadcast(own), "component", "left_semi").select(*AXES)  # own has a row at most


def filled_outside(solid: DataFrame, box: Box, s: VoxelSettings, seed: tuple[float, float, float], pinned: bool = False) -> tuple[DataFrame, bool]:
    """The dilated solid with all space joined to the box's faces; unchanged, and True, if the seed stands there."""
    r = max(math.ceil(s.fill / box.size), 1)
    wide = staged(dilated(solid, box, (r, r, r)), "dilated")
    empty = space(solid.sparkSession, box).join(wide, list(AXES), "left_anti")
    parts = staged(cell_components(empty, AXES), "empty")
    face = F.lit(False)
    for v, d in zip(AXES, box.dims, strict=True):
        face = face | (F.col(v) == 0) | (F.col(v) == d - 1)
    outer = parts.filter(face).select("component").distinct()
    exterior = staged(parts.join(outer, "component", "left_semi").select(*AXES), "exterior")
    at = box.cell(*seed)
    if not pinned and at and not exterior.filter(F.struct(*AXES) == F.struct(*(F.lit(i).cast("bigint").alias(v) for v, i in zip(AXES, at, strict=True)))).isEmpty():
        return solid, True
    return staged(wide.union(exterior).distinct(), "solid"), False


def supported(solid: DataFrame, box: Box, reach: int) -> DataFrame:
    """vx, vz of the columns with solid in at least 35 % of the columns in reach (clipped at the border)."""
    columns = solid.select("vx", "vz").distinct()
    near = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    counts = columns.withColumn("i", near).withColumn("j", near).select((F.col("vx") + F.col("i")).alias("vx"), (F.col("vz") + F.col("j")).alias("vz")).groupBy("vx", "vz").count()
    span = lambda v, d: F.least(F.col(v) + reach, F.lit(d - 1)) - F.greatest(F.col(v) - reach, F.lit(0)) + 1
    inside = F.col("vx").between(0, box.dims[0] - 1) & F.col("vz").between(0, box.dims[2] - 1)
    return counts.filter(inside & (F.col("count") / (span("vx", box.dims[0]) * span("vz", box.dims[2])) >= 0.35)).select("vx", "vz")


def floor_filled(solid: DataFrame, box: Box, s: VoxelSettings) -> DataFrame:
    """The solid with all voxels under the lowest one of each supported column."""
    low = solid.groupBy("vx", "vz").agg(F.min("vy").alias("top")).filter("top > 0").join(supported(solid, box, max(math.ceil(s.fill / box.size), 1)), ["vx", "vz"], "left_semi")
    below = low.select("vx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top") - 1)).alias("vy"), "vz")
    return solid.select(*AXES).union(below)


def carved(solid: DataFrame, box: Box, s: VoxelSettings, seed: tuple[float, float, float]) -> DataFrame:
    """The space that a capsule starting near the seed can reach."""
    flat, up = max(math.ceil(s.carve_radius / box.size), 0), max(math.ceil(s.carve_height / (2.0 * box.size)), 1)
    reach, at = (flat, up, flat), box.cell(*seed)
    free = staged(space(solid.sparkSession, box).join(dilated(solid, box, reach), list(AXES), "left_anti"), "free")
    start = at and nearest(free, at, max(flat, up) * 2)
    return dilated(reachable(free, start), box, reach) if start else free.limit(0)


def coarse_cluster(splats: DataFrame, seed: tuple[float, float, float], threshold: float = 0.1, edge: float = 1.0) -> DataFrame:
    """The opaque splats in 1 m voxels joined by faces to the occupied voxel nearest to the seed; all splats if the seed is outside."""
    opaque = splats.filter(F.col("opacity") >= threshold)
    box = opaque.agg(*(f(c) for c in "xyz" for f in (F.min, F.max))).first()
    if box[0] is None:
        return opaque
    low = tuple(box[::2])
    dims = tuple(max(math.ceil((b - a) / edge), 1) + 1 for a, b in zip(low, box[1::2], strict=True))
    grid = Box(low, dims, edge)
    at = grid.cell(*seed)
    if math.prod(dims) > 2_000_000 or not at:
        return splats
    placed = opaque.select("*", *grid.columns())
    occupied = staged(placed.select(*AXES).distinct(), "occupied")
    start = nearest(occupied, at, min(max(dims), 512))
    return placed.join(reachable(occupied, start), list(AXES), "left_semi").drop(*AXES) if start else splats


def walkable(solid: DataFrame, nav: DataFrame) -> DataFrame:
    """Solid voxels with a voxel of the walking space on top."""
    return solid.select(*AXES).join(nav.select("vx", (F.col("vy") - 1).alias("vy"), "vz"), list(AXES), "left_semi")


#: The directions of faces: an axis and a sign.
FACES = tuple(tuple(sign if i == axis else 0 for i in range(3)) for axis in range(3) for sign in (1, -1))


def corners(direction: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """The corners of a voxel's face, counter-clockwise from outside: around the axis in the sense of the next two, or against it."""
    axis = next(i for i, d in enumerate(direction) if d)
    out = []
    for u, v in ((0, 0), (1, 0), (1, 1), (0, 1)):
        at = [int(direction[axis] > 0)] * 3
        at[(axis + 1) % 3], at[(axis + 2) % 3] = u, v
        out.append(tuple(at))
    return out if direction[axis] > 0 else out[::-1]


def faces(volume: DataFrame, directions=FACES) -> DataFrame:
    """volume with each of its faces' direction (nx, ny, nz) and the voxel beyond (ox, oy, oz)."""
    d = F.explode(F.array(*(F.struct(*(F.lit(i).cast("bigint").alias(n) for n, i in zip(("nx", "ny", "nz"), f, strict=True))) for f in directions))).alias("d")
    return volume.select(*AXES, d).select(*AXES, "d.*", *((F.col(v) + F.col(f"d.n{c}")).alias(f"o{c}") for v, c in zip(AXES, "xyz", strict=True)))


def beyond(volume: DataFrame) -> DataFrame:
    return volume.select(*(F.col(v).alias(f"o{c}") for v, c in zip(AXES, "xyz", strict=True)))


def exterior_faces(solid: DataFrame) -> DataFrame:
    return faces(solid).join(beyond(solid), ["ox", "oy", "oz"], "left_anti")


def shell_faces(solid: DataFrame, nav: DataFrame) -> DataFrame:
    """Faces of the solid towards the walking space."""
    return faces(solid).join(beyond(nav.join(solid, list(AXES), "left_anti")), ["ox", "oy", "oz"], "left_semi")


def ramps(tread: DataFrame, step: int = 1) -> DataFrame:
    """Pairs of treads side by side along x or z whose heights differ by 1 to `step` voxels."""
    side = F.explode(F.array(F.struct(F.lit(1).alias("i"), F.lit(0).alias("j")), F.struct(F.lit(0).alias("i"), F.lit(1).alias("j")))).alias("o")
    near = tread.select("vx", "vy", "vz", side, F.explode(F.array(*(F.lit(d) for d in range(-step, step + 1) if d))).alias("d"))
    moved = near.select(*AXES, (F.col("vx") + F.col("o.i")).alias("ox"), (F.col("vy") + F.col("d")).alias("oy"), (F.col("vz") + F.col("o.j")).alias("oz"))
    return moved.join(beyond(tread), ["ox", "oy", "oz"], "left_semi")


def packed(volume: DataFrame, box: Box) -> DataFrame:
    """byte_index, byte: the volume as a bit mask, lowest bit first, in the order y, z, x; zero bytes are left out."""
    dx, _, dz = box.dims
    index = (F.col("vy") * dz + F.col("vz")) * dx + F.col("vx")
    return volume.select(index.alias("i")).groupBy(F.floor(F.col("i") / 8).alias("byte_index")).agg(F.sum(F.expr("shiftleft(1, cast(i % 8 as int))")).cast("int").alias("byte"))


def unpacked(mask: DataFrame, box: Box) -> DataFrame:
    """The volume of packed()."""
    dx, _, dz = box.dims
    bit = mask.select("byte_index", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b")).filter(F.expr("shiftright(byte, b) & 1") == 1)
    i = F.col("byte_index") * 8 + F.col("b")
    return bit.select(i.alias("i")).select((F.col("i") % dx).alias("vx"), F.floor(F.col("i") / (dx * dz)).alias("vy"), (F.floor(F.col("i") / dx) % dz).alias("vz"))


def ground_below(points: DataFrame, solid: DataFrame, box: Box, reach: float) -> DataFrame:
    """points (point_id, x, y, z) with ground: the top of the first solid voxel under each, null beyond reach.

    Columns meet by an equi-join; the highest voxel below is a grouped maximum, never a list of a column."""
    at = points.select("point_id", "x", "y", "z", *box.columns())
    met = at.withColumnRenamed("vy", "own").join(solid.select(*AXES), ["vx", "vz"]).filter((F.col("vy") <= F.col("own")) & (F.col("y") - (box.low[1] + (F.col("vy") + 1) * box.size) <= reach))
    top = met.groupBy("point_id").agg((box.low[1] + (F.max("vy") + 1) * box.size).alias("ground"))
    return points.join(top, "point_id", "left")


def capsule_fits(points: DataFrame, solid: DataFrame, box: Box, s: VoxelSettings) -> DataFrame:
    """points (point_id, x, y, z) with state: outside_grid, inside_solid, capsule_blocked or capsule_fits."""
    flat, up = max(math.ceil(s.carve_radius / box.size), 0), max(math.ceil(s.carve_height / box.size), 1)
    r2 = (s.carve_radius + box.size * 0.5) ** 2
    disc = [(i, j) for i in range(-flat, flat + 1) for j in range(-flat, flat + 1) if (i * box.size) ** 2 + (j * box.size) ** 2 <= r2]
    at = points.select("point_id", *box.columns()).withColumn("inside", box.holds())
    offset = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(j).alias("j")) for i, j in disc for k in range(up + 1)))).alias("o")
    body = at.filter("inside").select("point_id", offset, *AXES).select("point_id", "o", *((F.col(v) + F.col(f"o.{c}")).alias(v) for v, c in zip(AXES, "ikj", strict=True)))
    hit = body.join(solid.select(*AXES), list(AXES)).groupBy("point_id").agg(F.max((F.col("o.i") == 0) & (F.col("o.k") == 0) & (F.col("o.j") == 0)).alias("own"))
    state = F.when(~F.col("inside"), "outside_grid").when(F.col("own"), "inside_solid").when(F.col("own").isNotNull(), "capsule_blocked").otherwise("capsule_fits")
    return at.join(hit, "point_id", "left").select("point_id", state.alias("state"))
