"""Meshes of voxel volumes: faces as quads of lattice corners, welded vertices with dense numbers, triangles with a stated winding.

A corner is its place on the lattice, so that quads which touch share it without any tolerance. Vertices are numbered by one
range sort of the distinct corners in the order y, z, x; triangles get their numbers by joins on corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import voxels as V
from cairn.sources.tables import staged, with_ordinal

#: Height that a tread may step up to its neighbour, in metres.
STEP_UP = 0.75
CORNER = ("cy", "cz", "cx")


def _corner(dx: Column | int, dy: Column | int, dz: Column | int) -> Column:
    at = {"cx": F.col("vx") + dx, "cy": F.col("vy") + dy, "cz": F.col("vz") + dz}
    return F.struct(*(at[c].cast("bigint").alias(c) for c in CORNER))


def _code(n: tuple[int, int, int]) -> int:
    return n[0] + 3 * n[1] + 9 * n[2]


def quads(faces: DataFrame, *more: str) -> DataFrame:
    """faces (vx, vy, vz, nx, ny, nz and more columns) with corners: four of the lattice, counter-clockwise from outside."""
    own = F.coalesce(*(F.when(F.col("nx") + 3 * F.col("ny") + 9 * F.col("nz") == _code(n), F.array(*(_corner(*c) for c in V.corners(n)))) for n in V.FACES))
    return faces.select(*more, *V.AXES, "nx", "ny", "nz", own.alias("corners"))


def treads(floor: DataFrame, *more: str) -> DataFrame:
    """The tops of floor voxels as quads, seen from above."""
    return quads(floor.select(*more, *V.AXES, *(F.lit(i).cast("bigint").alias(n) for n, i in zip(("nx", "ny", "nz"), (0, 1, 0), strict=True))), *more)


def steps(step_up: float, box: V.Box) -> int:
    """The voxels that a step spans at most."""
    return max(i for i in range(int(step_up / box.size) + 2) if i * box.size <= step_up + 1e-6)


def ramp_quads(floor: DataFrame, box: V.Box, step_up: float = STEP_UP) -> DataFrame:
    """A quad along the edge of two treads side by side whose tops differ by step_up at most, from the own top to the other's."""
    step = steps(step_up, box)
    if not step:
        return treads(floor.limit(0))
    near = V.ramps(floor, step)
    along_x = F.col("ox") > F.col("vx")
    rise = F.col("oy") - F.col("vy")
    x_edge = F.array(_corner(1, 1, 0), _corner(1, 1, 1), _corner(1, rise + 1, 1), _corner(1, rise + 1, 0))
    z_edge = F.array(_corner(0, 1, 1), _corner(1, 1, 1), _corner(1, rise + 1, 1), _corner(0, rise + 1, 1))
    return near.select(*V.AXES, (F.col("ox") - F.col("vx")).alias("nx"), rise.alias("ny"), (F.col("oz") - F.col("vz")).alias("nz"), F.when(along_x, x_edge).otherwise(z_edge).alias("corners"))


def floor_voxels(solid: DataFrame, nav: DataFrame, box: V.Box) -> tuple[DataFrame, bool]:
    """Solid voxels below the walking space; where there are none, all with no solid above, and True."""
    inner = V.walkable(solid, nav).filter(F.col("vy") < box.dims[1] - 1)
    if not inner.isEmpty():
        return inner, False
    return solid.select(*V.AXES).join(solid.select("vx", (F.col("vy") - 1).alias("vy"), "vz"), list(V.AXES), "left_anti"), True


def connected_walkable(solid: DataFrame, nav: DataFrame, box: V.Box, step_up: float = STEP_UP) -> DataFrame:
    """Treads and the ramps between them as quads; ramps stand between treads below the walking space only."""
    floor, bare = floor_voxels(solid, nav, box)
    floor = staged(floor, "floor")
    return treads(floor) if bare else treads(floor).unionByName(ramp_quads(floor, box, step_up))


def welded(faces: DataFrame, box: V.Box, bias: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """quads -> vertices (vertex, x, y, z), their y moved by bias, and triangles (triangle, a, b, c): two for each quad, the first
    three corners and the first, third and fourth; in the order y, z, x of voxels, then of directions."""
    faces = staged(faces, "quads")
    corner = faces.select(F.explode("corners").alias("c")).select("c.*").distinct()
    vertices = staged(with_ordinal(corner, list(CORNER), "vertex"), "vertices")
    keys = ["vy", "vz", "vx", "nx", "ny", "nz"]
    each = faces.select(*keys, F.posexplode("corners").alias("slot", "c")).select(*keys, "slot", "c.*")
    placed = each.join(vertices, list(CORNER)).groupBy(*keys).agg(*(F.max(F.when(F.col("slot") == i, F.col("vertex"))).alias(f"v{i}") for i in range(4)))
    three = lambda half, *slots: F.struct(F.lit(half).alias("half"), *(F.col(f"v{i}").alias(n) for i, n in zip(slots, "abc", strict=True)))
    triangles = placed.select(*keys, F.explode(F.array(three(0, 0, 1, 2), three(1, 0, 2, 3))).alias("t")).select(*keys, "t.*")
    numbered = with_ordinal(triangles, [*keys, "half"], "triangle").select("triangle", "a", "b", "c")
    at = [(low + F.col(c) * box.size + (bias if axis == "y" else 0.0)).alias(axis) for c, axis, low in zip(("cx", "cy", "cz"), "xyz", box.low, strict=True)]
    return vertices.select("vertex", *at), numbered


def cropped(volume: DataFrame, box: V.Box) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The voxels around a volume that a mesh is made of, from and to (excluded): a margin of 10, 6 or 4 voxels, the fewer the larger it is."""
    found = volume.agg(*(f(v) for v in V.AXES for f in (F.min, F.max))).first()
    if found[0] is None:
        return None
    low, high = found[::2], found[1::2]
    span = max(b - a for a, b in zip(low, high, strict=True))
    margin = 10 if span <= 48 else 6 if span <= 96 else 4
    return tuple(max(a - margin, 0) for a in low), tuple(min(b + margin + 1, d) for b, d in zip(high, box.dims, strict=True))


def corners_of(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """triangles (triangle, a, b, c) with the positions of their corners: ax, ay, az, bx, ..."""
    out = triangles
    for v in "abc":
        out = out.join(vertices.select(F.col("vertex").alias(v), *(F.col(c).alias(f"{v}{c}") for c in "xyz")), v)
    return out


def _cross() -> list[Column]:
    u, w = ([F.col(f"{v}{c}") - F.col(f"a{c}") for c in "xyz"] for v in "bc")
    return [u[(i + 1) % 3] * w[(i + 2) % 3] - u[(i + 2) % 3] * w[(i + 1) % 3] for i in range(3)]


def area() -> Column:
    """Of a row of corners_of()."""
    n = _cross()
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) * 0.5


def normal() -> list[Column]:
    """The unit normal of a row of corners_of(), null without area."""
    n = _cross()
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return [F.when(size > 0, x / size) for x in n]


def centre() -> list[Column]:
    return [(F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3.0 for c in "xyz"]


#: Triangles whose normals tell how a mesh lies, and the mean upward part below which it lies upside down.
SEEN, DOWN = 50, -0.5


def preflight(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row on a mesh (vertices, finite ones, their bounds and mean, triangles, up: the mean upward part of the first normals, flipped), and
    its triangles, turned round if they face down. Vertices that aren't finite count as such only; triangles without area count as level with 0."""
    good = F.lit(True)
    for c in "xyz":
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    only = lambda c: F.when(good, F.col(c))
    box = [f(only(c)).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c in "xyz"]
    few = triangles.orderBy("triangle").limit(SEEN).collect()
    own = vertices.filter(F.col("vertex").isin({r[v] for r in few for v in "abc"})).collect()
    first = corners_of(*(triangles.sparkSession.createDataFrame(rows, df.schema) for rows, df in ((few, triangles), (own, vertices))))
    up = first.agg(F.avg(F.coalesce(normal()[1], F.lit(0.0)))).first()[0] or 0.0
    row = vertices.agg(F.count("*").alias("vertices"), F.count(F.when(good, 1)).alias("finite"), *box)
    row = row.withColumns({"triangles": F.lit(triangles.count()).cast("bigint"), "up": F.lit(float(up)), "flipped": F.lit(up < DOWN)})
    return row, triangles.select("triangle", "a", F.col("c").alias("b"), F.col("b").alias("c")) if up < DOWN else triangles
