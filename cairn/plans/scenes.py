"""Queries of places to stand, navigation packs, packed clouds, and settings of volumes and fields that other queries leave alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import bits as N
from cairn.operators import cloud as C
from cairn.operators import field as D
from cairn.operators import packs as K
from cairn.operators import spawns as W
from cairn.operators import voxels as V
from cairn.plans import bundles as U
from cairn.plans import floors as O
from cairn.plans import meshes as T
from cairn.plans import volumes as P
from cairn.plans.scalars import r6, sql6
from cairn.sources import splats as A
from cairn.sources.tables import CLOUD_SQL, TERRAIN_DEPTH, TERRAIN_LEVELS, TERRAIN_SQL, cloud, staged, table, terrain_columns

RADIUS, HEIGHT = 0.3, 0.6
#: Voxels along x of a scene of the packs.
TILE = 64


def spawn_search(spark: SparkSession, sf: str) -> DataFrame:
    solid, nav, box = T._terrain(spark, sf)
    k = F.col("s_suppkey")
    seeds = table(spark, sf, "supplier").select(k.alias("seed_id"), (k % 97 / 8.0 + 1.0).alias("x"), (k % 13 * 0.25).alias("y"), (k % 41 / 4.0).alias("z"))
    return W.spawns(seeds, solid, nav, box, RADIUS, HEIGHT, 2.0).select("seed_id", *r6("x", "y", "z"))


def nav_extents(spark: SparkSession, sf: str) -> DataFrame:
    solid, nav, box = P._carved(spark, sf)
    return W.extents(solid, nav, box).select(*r6("floor_max", "nav_min", "nav_max", "box_min", "box_max"))


def collision_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The seed that the bounds give, and whether points made of orders are within a metre of the bounds."""
    splats = cloud(spark, sf)
    b = C.bounds(splats).first().asDict()
    seed = W.collision_seed(b, b["floor_y"])
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % 53 / 4.0 - 2.0).alias("x"), (F.col("o_orderkey") % 17 / 4.0 - 1.5).alias("y"), (F.col("o_custkey") % 43 / 4.0).alias("z"))
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.col(c).between(b[f"min_{c}"] - 1.0, b[f"max_{c}"] + 1.0)
    return at.select("point_id", inside.alias("inside"), *(F.lit(v).alias(f"seed_{c}") for c, v in zip("xyz", seed, strict=True))).select("point_id", "inside", *r6("seed_x", "seed_y", "seed_z"))


def nav_packs(spark: SparkSession, sf: str) -> DataFrame:
    """A pack for each stretch of the terrain, zipped, read again, and counted."""
    columns, _ = terrain_columns(spark, sf)
    box = V.Box((0.0, 0.0, 0.0), (TILE, TERRAIN_LEVELS + 4, TERRAIN_DEPTH), T.SIZE)
    top = F.col("top")
    rows = staged(N.of_columns(columns, solid=(F.lit(0), top), nav=(top + 1, top + 3)), "rows")  # a row of bits is as long as a stretch
    named = lambda bits: rows.filter(F.col(bits) != 0).select(F.concat(F.lit("tile-"), F.col("bx")).alias("name"), F.lit(0).cast("bigint").alias("vx"), "vy", "vz", F.col(bits).alias("bits"))
    solid, nav = named("solid"), named("nav")
    scenes = solid.select("name").distinct().select("name", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("seed"), F.lit(None).cast("array<double>").alias("spawn"))
    back = staged(K.contents(K.scene_packs(K.sessions(scenes, box), solid, nav, box, -T.SIZE), box), "contents")
    own = lambda path, c: F.max(F.when(F.col("path") == path, F.col(c)))
    weighed = lambda path: own(path, "sum_vy") * 7 + own(path, "sum_vx") * 3 + own(path, "sum_vz")
    counts = back.groupBy("name").agg(
        *(c.alias(n) for path, n in ((K.SOLID, "solid"), (K.NAV, "nav")) for c, n in ((own(path, "voxels"), n), (weighed(path), f"{n}_sum"))),
        *(own(path, c).alias(f"{n}_{c}") for n, path in (("collision", K.COLLISION), ("floors", K.FLOORS)) for c in ("vertices", "triangles")),
    ).filter("solid > 0 AND nav > 0")
    found = K.judged(back).select("name", "files", "version", "mode", F.array_join("dims", "x").alias("dims"), "voxel_size", "has_volume", "has_navmesh", "active_mode", "error")
    return found.join(counts, "name")


def packed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Splats written as packed clouds and read again."""
    rows = U._full(U._chunks(spark, sf), 1).drop("level", "chunk", "place", "splat_id")
    rows = rows.withColumn("f_rest", F.array(*(F.get("f_dc", F.lit(i % 3)) - 0.5 for i in range(9))))
    back = A.decoded(A.encoded(rows, "spz"), full=True)
    return back.groupBy(F.round(F.col("opacity").cast("double"), 4).alias("opacity"), F.get("scale", F.lit(0)).cast("double").alias("scale")).agg(
        F.count("*").alias("splats"), *(f(F.col(c).cast("double")).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"),
        F.round(F.sum(F.get("f_dc", F.lit(1)).cast("double")), 2).alias("colour"), F.round(F.sum(F.get("f_rest", F.lit(4)).cast("double")), 2).alias("rest"), F.round(F.sum(F.get("rot", F.lit(2)).cast("double")), 2).alias("turn"),
    )


def eroded_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells, _ = O.field(spark, sf)
    return D.eroded(cells, D.FieldSettings(cell=O.CELL, agent_radius=0.8)).select("row", "col", "state")


def leaking_fills(spark: SparkSession, sf: str) -> DataFrame:
    """The exterior fill for a seed above the cloud, to which the outside leaks, and for one within it."""
    solid, box = P._volume(spark, sf)
    out = None
    for name, seed in (("above", P.SEED), ("within", (5.0, 0.3, 5.0))):
        filled, leaked = V.filled_outside(solid, box, V.VoxelSettings(fill=0.5), seed)
        row = filled.agg(F.lit(name).alias("seed"), F.count("*").alias("voxels"), F.lit(leaked).alias("leaked"))
        out = row if out is None else out.union(row)
    return out


COARSE = V.VoxelSettings(size=0.1, scene="object", most=12_000)


def coarsened(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels that grew until the box holds no more than 12,000."""
    splats = cloud(spark, sf)
    box = P._box(splats, COARSE)
    own = V.densities(splats, box).agg(F.count("*").alias("voxels"), F.round(F.sum("density"), 2).alias("density"))
    return own.select(*(F.lit(d).cast("bigint").alias(f"d{c}") for c, d in zip("xyz", box.dims, strict=True)), F.round(F.lit(box.size), 6).alias("size"), "voxels", "density")


_FEET = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j)"
SPAWNS = f"""WITH {TERRAIN_SQL}, free AS MATERIALIZED (SELECT vx, vy, vz FROM nav WHERE (vx, vy, vz) NOT IN (SELECT (vx, vy, vz) FROM solid)), floor AS MATERIALIZED (SELECT vx, vy, vz FROM solid WHERE (vx, vy + 1, vz) IN (SELECT (vx, vy, vz) FROM nav) AND vy < {TERRAIN_LEVELS + 3}),
side AS (SELECT f.vx, f.vy, f.vz, i, j, max(s.vy) FILTER (s.vy < f.vy) AS low, min(s.vy) FILTER (s.vy > f.vy) AS high FROM free f CROSS JOIN {_FEET} JOIN solid s ON s.vx = f.vx + i AND s.vz = f.vz + j GROUP BY ALL),
each_ AS (SELECT side.vx, side.vy, side.vz, count(*) AS n, max(low) AS low, min(high) AS high FROM side JOIN floor l ON l.vx = side.vx + i AND l.vz = side.vz + j AND l.vy = low GROUP BY side.vx, side.vy, side.vz),
roomy AS (SELECT * FROM each_ WHERE n = 5 AND (high IS NULL OR (low + 1) * 0.25e0 + 0.6e0 <= high * 0.25e0) AND low + 1 < {TERRAIN_LEVELS + 4}),
hit AS (SELECT DISTINCT r.vx, r.vy, r.vz FROM roomy r JOIN solid s ON abs(s.vx - r.vx) <= 1 AND abs(s.vz - r.vz) <= 1 AND s.vy BETWEEN r.low + 1 AND r.low + 3),
spot AS MATERIALIZED (SELECT vx, vy, vz, (low + 1) * 0.25e0 AS floor FROM roomy WHERE (vx, vy, vz) NOT IN (SELECT (vx, vy, vz) FROM hit)),
stride AS (SELECT greatest(1, least(max(vx) + 1, {TERRAIN_DEPTH}) // 32) AS s FROM column_),
down AS (SELECT f.vx, f.vz, f.vy, max(s.vy) AS low FROM free f, stride JOIN solid s ON s.vx = f.vx AND s.vz = f.vz AND s.vy < f.vy WHERE f.vx % stride.s = 0 AND f.vy % stride.s = 0 AND f.vz % stride.s = 0 GROUP BY ALL),
deck AS (SELECT b * 0.25e0 AS deck FROM (SELECT floor((low + 1) * 0.25e0 / 0.25e0 + 0.5) AS b, count(*) AS n FROM down GROUP BY b ORDER BY n DESC, b LIMIT 1)),
seed AS (SELECT s_suppkey AS seed_id, s_suppkey % 97 / 8e0 + 1 AS x, s_suppkey % 13 * 0.25e0 AS y, s_suppkey % 41 / 4e0 AS z FROM supplier),
cell AS (SELECT *, CAST(floor(x / 0.25) AS BIGINT) AS sx, CAST(floor(y / 0.25) AS BIGINT) AS sy, CAST(floor(z / 0.25) AS BIGINT) AS sz FROM seed),
near AS (SELECT seed_id, x, y, z, floor, deck, vx - sx AS i, vy - sy AS j, vz - sz AS k FROM cell CROSS JOIN deck JOIN spot ON abs(vx - sx) <= 8 AND abs(vz - sz) <= 8 AND (pow(vx - sx, 2) + pow(vy - sy, 2) + pow(vz - sz, 2)) * 0.0625 <= 4),
best AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY abs(y - deck) <= 1.05 AND abs(floor - deck) > 0.35, i * i + j * j + k * k, greatest(abs(i), abs(j), abs(k)), j, k, i) AS n FROM near),
found AS (SELECT seed_id, x + i * 0.25e0 AS ax, floor - 0.25e0 AS ay, z + k * 0.25e0 AS az FROM best WHERE n = 1) SELECT seed_id, {", ".join(f"round(a{c}, 6) + 0.0 AS {c}" for c in "xyz")} FROM seed LEFT JOIN found USING (seed_id)"""
_TILED = f"""{TERRAIN_SQL}, ts AS MATERIALIZED (SELECT vx // {TILE} AS t, vx % {TILE} AS vx, vy, vz FROM solid), tn AS MATERIALIZED (SELECT vx // {TILE} AS t, vx % {TILE} AS vx, vy, vz FROM nav), {T._CORNERS}"""
PACKS = f"""WITH {_TILED}, face AS (SELECT t, vx, vy, vz, i AS nx, j AS ny, k AS nz FROM ts, {P._STEPS} WHERE (t, vx + i, vy + j, vz + k) NOT IN (SELECT (t, vx, vy, vz) FROM ts)), top AS (SELECT t, vx, vy, vz, 0 AS nx, 1 AS ny, 0 AS nz FROM ts WHERE (t, vx, vy + 1, vz) IN (SELECT (t, vx, vy, vz) FROM tn)),
mesh AS (SELECT t, count(DISTINCT (vx + dx, vy + dy, vz + dz)) AS collision_vertices, count(*) // 2 AS collision_triangles FROM face JOIN corner_ USING (nx, ny, nz) GROUP BY t), flat AS (SELECT t, count(DISTINCT (vx + dx, vy + dy, vz + dz)) AS floors_vertices, count(*) // 2 AS floors_triangles FROM top JOIN corner_ USING (nx, ny, nz) GROUP BY t),
s AS (SELECT t, count(*) AS solid, CAST(sum(vy * 7 + vx * 3 + vz) AS BIGINT) AS solid_sum FROM ts GROUP BY t), n AS (SELECT t, count(*) AS nav, CAST(sum(vy * 7 + vx * 3 + vz) AS BIGINT) AS nav_sum FROM tn GROUP BY t)
SELECT 'tile-' || t AS name, 6 AS files, 1 AS version, 'voxel_walk' AS mode, '{TILE}x{TERRAIN_LEVELS + 4}x{TERRAIN_DEPTH}' AS dims, 0.25::DOUBLE AS voxel_size, true AS has_volume, false AS has_navmesh, 'voxel_mesh' AS active_mode, NULL AS error,
solid, solid_sum, nav, nav_sum, collision_vertices, collision_triangles, floors_vertices, floors_triangles FROM mesh JOIN flat USING (t) JOIN s USING (t) JOIN n USING (t)"""
_SH = repr(A.SH_C0)
_TONE = "sqrt(x + 1.0)"
PACKED = f"""WITH s AS ({CLOUD_SQL}), q AS (SELECT {", ".join(f"floor({c} * 4096 + 0.5) / 4096 AS {c}" for c in "xyz")}, floor(255 / (1 + exp(-(opacity * 8.0 - 2.0))) + 0.5) / 255 AS a, least(greatest(floor((ln(scale) + 10) * 16 + 0.5), 0), 255) / 16 - 10 AS scale,
  (least(greatest(floor(({_TONE} * {_SH}::DOUBLE + 0.5) * 255 + 0.5), 0), 255) / 255 - 0.5) / {_SH}::DOUBLE AS colour, (least(greatest(floor(({_TONE} - 0.5) * 128 + 128.5), 0), 255) - 128) / 128 AS rest,
  sqrt(pow(ny - 0.5, 2) + pow(x - 5.0, 2) + pow(z - 5.0, 2) + pow(y - 1.0, 2)) AS len, ny - 0.5 AS w, z - 5.0 AS qy FROM s),
u AS (SELECT *, least(greatest(floor((CASE WHEN w < 0 THEN -qy ELSE qy END) / len * 127.5 + 128), 0), 255) / 127.5 - 1 AS turn, ln(least(greatest(a, 1e-6), 1 - 1e-6) / (1 - least(greatest(a, 1e-6), 1 - 1e-6))) AS logit FROM q)
SELECT round(CAST(CAST(logit AS FLOAT) AS DOUBLE), 4) AS opacity, scale, count(*) AS splats, {", ".join(f"{n}({c}) AS {n}_{c}" for n in ("min", "max") for c in "xyz")}, round(sum(CAST(colour AS FLOAT)::DOUBLE), 2) AS colour, round(sum(rest), 2) AS rest, round(sum(CAST(turn AS FLOAT)::DOUBLE), 2) AS turn FROM u GROUP BY 1, 2"""
_PROD = " * ".join(f"(greatest(ceil((h{c} + 1.6 - (l{c} - 1.6)) / size), 1) + 1)" for c in "xyz")
COARSENED = f"""WITH RECURSIVE s AS ({CLOUD_SQL}), b AS (SELECT {", ".join(f"min({c}) AS l{c}, max({c}) AS h{c}" for c in "xyz")} FROM s), step(size) AS (SELECT 0.1::DOUBLE UNION ALL SELECT size * 1.25::DOUBLE FROM step, b WHERE {_PROD} > 12000 AND size < 0.5),
g AS (SELECT max(size) AS size FROM step), d AS (SELECT size, {", ".join(f"l{c} - 1.6 AS {c}0, CAST(greatest(ceil((h{c} + 1.6 - (l{c} - 1.6)) / size), 1) + 1 AS BIGINT) AS d{c}" for c in "xyz")} FROM b, g),
p AS (SELECT s.*, d.*, {", ".join(f"CAST(floor(({c} - {c}0) / size) AS BIGINT) AS p{c}" for c in "xyz")}, least(greatest(greatest(scale, size * 0.5) * 2.5, size), size * 6) AS reach FROM s, d),
o AS (SELECT *, px + i AS vx, py + j AS vy, pz + k AS vz FROM p, range(-2, 3) a(i), range(-2, 3) b(j), range(-2, 3) c(k)), f AS (SELECT *, {" + ".join(f"pow({c}0 + (v{c} + 0.5) * size - {c}, 2)" for c in "xyz")} AS d2 FROM o WHERE vx BETWEEN 0 AND dx - 1 AND vy BETWEEN 0 AND dy - 1 AND vz BETWEEN 0 AND dz - 1),
r AS (SELECT vx, vy, vz, sum(opacity * exp(-d2 / (2 * reach * reach))) AS density FROM f WHERE d2 <= reach * reach GROUP BY ALL) SELECT any_value(dx) AS dx, any_value(dy) AS dy, any_value(dz) AS dz, round(any_value(size), 6) AS size, count(*) AS voxels, round(sum(density), 2) AS density FROM r, d"""
_OUTER = f"""{P._grown("wide", "solid", 1, 1, 1)}, {P._space("free", "wide")}, outer_(vx, vy, vz) AS (SELECT vx, vy, vz FROM free WHERE face UNION SELECT f.vx, f.vy, f.vz FROM outer_ w, {P._STEPS} JOIN free f ON f.vx = w.vx + i AND f.vy = w.vy + j AND f.vz = w.vz + k)"""

QUERIES = {
    "spawn_search": spawn_search, "nav_extents": nav_extents, "collision_seeds": collision_seeds, "nav_packs": nav_packs, "packed_round_trip": packed_round_trip, "eroded_cells": eroded_cells, "leaking_fills": leaking_fills, "coarsened_voxels": coarsened,
}
SQL = {
    "spawn_search": SPAWNS,
    "nav_extents": f"{P.BOX}, {P._NAV}, {P._TREAD}, e AS (SELECT (SELECT max(y0 + (vy + 1) * 0.5) FROM tread, g WHERE vy < dy - 1) AS floor_max, min(y0 + (vy + 0.5) * 0.5) AS nav_min, max(y0 + (vy + 0.5) * 0.5) AS nav_max, any_value(y0) AS box_min, any_value(y0 + dy * 0.5) AS box_max FROM nav, g) SELECT {sql6('floor_max', 'nav_min', 'nav_max', 'box_min', 'box_max')} FROM e",
    "collision_seeds": f"""WITH s AS ({CLOUD_SQL}), b AS (SELECT {", ".join(f"min({c}) AS l{c}, max({c}) AS h{c}" for c in "xyz")}, (list_sort(list(y)))[CAST(floor((count(*) - 1) * 0.02 + 0.5) AS BIGINT) + 1] AS f FROM s), k AS (SELECT *, (lx + hx) * 0.5 AS seed_x, f + 1.0 AS seed_y, (lz + hz) * 0.5 AS seed_z FROM b),
p AS (SELECT o_orderkey AS point_id, o_orderkey % 53 / 4.0 - 2.0 AS x, o_orderkey % 17 / 4.0 - 1.5 AS y, o_custkey % 43 / 4.0 AS z FROM orders) SELECT point_id, {" AND ".join(f"{c} BETWEEN l{c} - 1 AND h{c} + 1" for c in "xyz")} AS inside, {sql6("seed_x", "seed_y", "seed_z")} FROM p, k""",
    "nav_packs": PACKS,
    "packed_round_trip": PACKED,
    "eroded_cells": f"""{O.FIELD}, bad AS (SELECT DISTINCT row + i AS row, col + j AS col FROM cell, range(-2, 3) a(i), range(-2, 3) b(j) WHERE state NOT IN ('walkable', 'filled') AND (greatest(abs(i), abs(j)) + least(abs(i), abs(j)) * (sqrt(2.0) - 1)) * 0.5 < 0.8)
SELECT row, col, CASE WHEN state IN ('walkable', 'filled') AND (row, col) IN (SELECT (row, col) FROM bad) THEN 'eroded' ELSE state END AS state FROM cell""",
    "leaking_fills": f"""{P.BOX}, {_OUTER}, seed AS (SELECT * FROM (VALUES ('above', 5.0, 3.9, 5.0), ('within', 5.0, 0.3, 5.0)) r(seed, x, y, z)), l AS (SELECT seed, (CAST(floor((x - x0) / 0.5) AS BIGINT), CAST(floor((y - y0) / 0.5) AS BIGINT), CAST(floor((z - z0) / 0.5) AS BIGINT)) IN (SELECT (vx, vy, vz) FROM outer_) AS leaked FROM seed, g)
SELECT seed, CASE WHEN leaked THEN (SELECT count(*) FROM solid) ELSE (SELECT count(*) FROM (SELECT vx, vy, vz FROM wide UNION SELECT vx, vy, vz FROM outer_)) END AS voxels, leaked FROM l""",
    "coarsened_voxels": COARSENED,
}
