"""Queries of planes fitted to clouds and of rays against volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.operators import cloud as C
from cairn.operators import planes as N
from cairn.operators import rays as R
from cairn.plans import meshes as M
from cairn.plans.scalars import r6, sql6
from cairn.sources.tables import NUMBERED_SQL, POINTS_SQL, TERRAIN_DEPTH, TERRAIN_LEVELS, TERRAIN_SQL, cloud, points, staged, table

NEAR, REACH, RADIUS = 0.0531, 9.0, 0.2


def _row(spark: SparkSession, plane: N.Plane | None, inliers: int) -> list[tuple]:
    return [] if plane is None else [(*plane.normal, plane.d, inliers)]


_PLANE = "nx double, ny double, nz double, d double, inliers bigint"


def floor_plane(spark: SparkSession, sf: str) -> DataFrame:
    """The floor, the same refitted, and turned so that z is up."""
    rows = staged(cloud(spark, sf, numbered=True).select("splat_id", "x", "y", "z"), "points")
    plane, inliers = N.floor_plane(rows, C.nearest_rank(rows, "y", 0.02), NEAR)
    made = [] if plane is None else [("drawn", plane), ("refitted", N.refitted(rows, plane, NEAR)), ("z_up", N.turned(plane, G.output_space("z")[0]))]
    return spark.createDataFrame([(name, *p.normal, p.d, inliers) for name, p in made], f"kind string, {_PLANE}").select("kind", *r6("nx", "ny", "nz", "d"), "inliers")


def best_plane(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(_row(spark, *N.best_plane(points(spark, sf))), _PLANE).select(*r6("nx", "ny", "nz", "d"), "inliers")


def plane_points(spark: SparkSession, sf: str) -> DataFrame:
    """All points with their distance from the best plane."""
    rows = points(spark, sf)
    plane, _ = N.best_plane(rows)
    distance = F.lit(None).cast("double") if plane is None else plane.distance()
    return rows.select("splat_id", distance.alias("distance"), (distance < 0.2).alias("near")).select("splat_id", *r6("distance"), "near")


def plane_quad(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(N.quad(rows, N.best_plane(rows)[0]))], "corner int, x double, y double, z double").select("corner", *r6("x", "y", "z"))


def ray_hits(spark: SparkSession, sf: str) -> DataFrame:
    """From places on and off the lattice, in directions along and across it."""
    solid, _, box = M._terrain(spark, sf)
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rays = table(spark, sf, "orders").select(o.alias("ray_id"), (o % 1999 / 16.0).alias("x"), (3.0 + c % 5 / 8.0).alias("y"), (c % 160 / 16.0).alias("z"), (o % 5 - 2.0).alias("dx"), (c % 3 - 2.0).alias("dy"), (c % 7 - 3.0).alias("dz"))
    return R.first_hits(rays, solid, box, REACH).select("ray_id", "nx", "ny", "nz", *r6("distance", "hx", "hy", "hz"))


def ground_probes(spark: SparkSession, sf: str) -> DataFrame:
    solid, _, box = M._terrain(spark, sf)
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    at = table(spark, sf, "orders").select(o.alias("point_id"), (o % 1999 / 16.0).alias("x"), (c % 11 * 0.25).alias("y"), (c % 160 / 16.0).alias("z"))
    return R.probed(at, solid, box, RADIUS).select("point_id", *r6("ground"))


def _drawn(cloud_sql: str, pool: str, draws: int) -> str:
    """Planes (k, nx, ny, nz, d) through triples of the points with the least hashes."""
    at = {"a": "3 * k % m", "b": "(3 * k + 1 + 7 * (3 * k // m)) % m", "c": "(3 * k + 2 + 11 * (3 * k // m)) % m"}
    cross = {c: f"((b.{u} - a.{u}) * (c.{w} - a.{w}) - (b.{w} - a.{w}) * (c.{u} - a.{u}))" for c, u, w in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}
    return f"""p AS MATERIALIZED (SELECT splat_id, x, y, z FROM ({cloud_sql})), pool AS MATERIALIZED (SELECT x, y, z, row_number() OVER (ORDER BY (splat_id % 2147483648) * 2654435761 % 4294967296, splat_id) - 1 AS i FROM {pool} QUALIFY i < {3 * draws}), m AS (SELECT count(*) AS m FROM pool),
t AS (SELECT k, {", ".join(f"{v} AS i{n}" for n, v in at.items())} FROM range({draws}) r(k), m),
u AS (SELECT k, a.x AS ax, a.y AS ay, a.z AS az, {", ".join(f"{v} AS c{c}" for c, v in cross.items())} FROM t JOIN pool a ON a.i = ia JOIN pool b ON b.i = ib JOIN pool c ON c.i = ic WHERE ia <> ib AND ia <> ic AND ib <> ic),
n AS (SELECT k, ax, ay, az, {", ".join(f"c{c} / sqrt(cx * cx + cy * cy + cz * cz) AS n{c}" for c in "xyz")} FROM u WHERE sqrt(cx * cx + cy * cy + cz * cz) >= 1e-6), plane AS MATERIALIZED (SELECT k, nx, ny, nz, -(nx * ax + ny * ay + nz * az) AS d FROM n)"""


_FAR = "abs(nx * x + ny * y + nz * z + d)"
BEST = f"""WITH {_drawn(POINTS_SQL, "p", N.MESH_DRAWS)}, best AS MATERIALIZED (SELECT k, nx, ny, nz, d, count(*) AS inliers FROM plane JOIN p ON {_FAR} < 0.2 GROUP BY ALL ORDER BY inliers DESC, k LIMIT 1)"""
_LOW = "(SELECT p.* FROM p, f WHERE y <= floor + 0.45)"
FLOOR = f"""WITH {_drawn(NUMBERED_SQL, _LOW, N.FLOOR_DRAWS).replace("pool AS", "f AS (SELECT (list_sort(list(y)))[CAST(floor((count(*) - 1) * 0.02 + 0.5) AS BIGINT) + 1] AS floor FROM p), pool AS", 1)},
up AS (SELECT k, CASE WHEN ny < 0 THEN -nx ELSE nx END AS nx, abs(ny) AS ny, CASE WHEN ny < 0 THEN -nz ELSE nz END AS nz, CASE WHEN ny < 0 THEN -d ELSE d END AS d FROM plane WHERE abs(ny) >= 0.82),
score AS (SELECT k, nx, ny, nz, d, count(*) AS inliers, count(*) FILTER (y <= floor + 0.45) AS low, sum(abs(y - floor)) FILTER (y <= floor + 0.45) AS error FROM up CROSS JOIN f JOIN p ON {_FAR} < {NEAR} GROUP BY ALL),
best AS MATERIALIZED (SELECT * FROM score WHERE low > 0 ORDER BY inliers + 3.0 * low - error / low / 0.45 DESC, k LIMIT 1),
fit AS (SELECT any_value(inliers) AS inliers, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(z, z) AS zz, covar_pop(z, x) AS zx, covar_pop(x, x) AS xx, covar_pop(z, y) AS zy, covar_pop(x, y) AS xy FROM best JOIN p ON {_FAR} < {NEAR}),
slope AS (SELECT *, (zy * xx - xy * zx) / (zz * xx - zx * zx) AS sz, (xy * zz - zy * zx) / (zz * xx - zx * zx) AS sx FROM fit),
unit AS (SELECT *, -sx / sqrt(1 + sz * sz + sx * sx) AS ux, 1 / sqrt(1 + sz * sz + sx * sx) AS uy, -sz / sqrt(1 + sz * sz + sx * sx) AS uz FROM slope),
made AS (SELECT 'drawn' AS kind, nx, ny, nz, d, inliers FROM best UNION ALL SELECT 'refitted', ux, uy, uz, -(ux * mx + uy * my + uz * mz), inliers FROM unit UNION ALL SELECT 'z_up', nx, -nz, ny, d, inliers FROM best)"""

_T = {c: f"CASE WHEN s{c} <> 0 THEN f{c} + k{c} * e{c} ELSE 'inf'::DOUBLE END" for c in "xyz"}
RAYS = f"""WITH RECURSIVE {TERRAIN_SQL}, width AS (SELECT max(vx) + 1 AS w FROM column_),
o AS (SELECT o_orderkey AS ray_id, o_orderkey % 1999 / 16e0 AS x, 3e0 + o_custkey % 5 / 8e0 AS y, o_custkey % 160 / 16e0 AS z, o_orderkey % 5 - 2.0 AS dx, o_custkey % 3 - 2.0 AS dy, o_custkey % 7 - 3.0 AS dz FROM orders),
a AS (SELECT ray_id, x, y, z, {", ".join(f"CAST(d{c} AS DOUBLE) / sqrt(CAST(dx * dx + dy * dy + dz * dz AS DOUBLE)) AS d{c}, CAST(sign(d{c}) AS BIGINT) AS s{c}, CAST(floor({c} / 0.25) AS BIGINT) AS v{c}" for c in "xyz")} FROM o WHERE dx * dx + dy * dy + dz * dz > 0),
b AS MATERIALIZED (SELECT *, {", ".join(f"CASE WHEN s{c} <> 0 THEN ((CASE WHEN s{c} > 0 THEN v{c} + 1 ELSE v{c} END) * 0.25 - {c}) / d{c} END AS f{c}, CASE WHEN s{c} <> 0 THEN abs(0.25 / d{c}) END AS e{c}" for c in "xyz")} FROM a),
walk(ray_id, kx, ky, kz, t, axis) AS (SELECT ray_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 'n' FROM b
  UNION ALL SELECT ray_id, {", ".join(f"k{c} + (CASE axis WHEN '{c}' THEN 1 ELSE 0 END)" for c in "xyz")}, CASE axis WHEN 'x' THEN tx WHEN 'y' THEN ty ELSE tz END, axis
  FROM (SELECT *, CASE WHEN tx < ty THEN (CASE WHEN tx < tz THEN 'x' ELSE 'z' END) WHEN ty < tz THEN 'y' ELSE 'z' END AS axis FROM (SELECT w.ray_id, kx, ky, kz, {", ".join(f"s{c}, v{c}, {v} AS t{c}" for c, v in _T.items())} FROM walk w JOIN b USING (ray_id))), width
  WHERE least(tx, ty, tz) <= {REACH} AND vx + sx * (kx + (CASE axis WHEN 'x' THEN 1 ELSE 0 END)) BETWEEN -1 AND w AND vy + sy * (ky + (CASE axis WHEN 'y' THEN 1 ELSE 0 END)) BETWEEN -1 AND {TERRAIN_LEVELS + 4} AND vz + sz * (kz + (CASE axis WHEN 'z' THEN 1 ELSE 0 END)) BETWEEN -1 AND {TERRAIN_DEPTH}),
hit AS (SELECT ray_id, arg_min({{'t': t, 'axis': axis}}, kx + ky + kz) AS h FROM walk JOIN b USING (ray_id) JOIN solid ON solid.vx = b.vx + sx * kx AND solid.vy = b.vy + sy * ky AND solid.vz = b.vz + sz * kz WHERE t > 1e-6 GROUP BY ray_id),
r AS (SELECT ray_id, {", ".join(f"CASE h.axis WHEN '{c}' THEN -s{c} ELSE 0 END AS n{c}" for c in "xyz")}, h.t AS distance, {", ".join(f"{c} + d{c} * h.t AS h{c}" for c in "xyz")} FROM hit JOIN b USING (ray_id))
SELECT ray_id, nx, ny, nz, {sql6("distance", "hx", "hy", "hz")} FROM r"""
PROBES = f"""WITH {TERRAIN_SQL}, o AS (SELECT o_orderkey AS point_id, o_orderkey % 1999 / 16e0 AS x, o_custkey % 11 * 0.25e0 + 0.25e0 AS floor, o_custkey % 160 / 16e0 AS z FROM orders),
q AS (SELECT point_id, i, j, floor, CAST(floor((x + i) / 0.25) AS BIGINT) AS px, CAST(floor((z + j) / 0.25) AS BIGINT) AS pz, floor + 1.3e0 AS y FROM o, (VALUES (0.0, 0.0), (-0.2, 0.0), (0.2, 0.0), (0.0, 0.2), (0.0, -0.2)) r(i, j)),
h AS (SELECT point_id, i, j, any_value(floor) AS floor, max((vy + 1) * 0.25e0) AS hy FROM q JOIN solid ON vx = px AND vz = pz AND vy < floor(y / 0.25) AND y - (vy + 1) * 0.25e0 <= 2.3e0 GROUP BY point_id, i, j),
m AS (SELECT point_id, avg(hy) - 0.25 AS ground FROM h WHERE abs(hy - floor) <= 1.001 GROUP BY point_id) SELECT point_id, round(ground, 6) + 0.0 AS ground FROM o LEFT JOIN m USING (point_id)"""

QUERIES = {"floor_plane": floor_plane, "best_plane": best_plane, "plane_points": plane_points, "plane_quad": plane_quad, "ray_hits": ray_hits, "ground_probes": ground_probes}
SQL = {
    "floor_plane": f"{FLOOR} SELECT kind, {sql6('nx', 'ny', 'nz', 'd')}, inliers FROM made",
    "best_plane": f"{BEST} SELECT {sql6('nx', 'ny', 'nz', 'd')}, inliers FROM best",
    "plane_points": f"{BEST}, far AS (SELECT splat_id, {_FAR} AS distance FROM p, best) SELECT splat_id, {sql6('distance')}, distance < 0.2 AS near FROM far",
    "plane_quad": f"""{BEST}, i AS (SELECT CASE WHEN abs(nx) < 0.9 THEN [1.0 - nx * nx, -ny * nx, -nz * nx] ELSE [-nx * ny, 1.0 - ny * ny, -nz * ny] END AS w, * FROM best),
a AS (SELECT nx, ny, nz, d, {", ".join(f"w[{n}] / sqrt(w[1] * w[1] + w[2] * w[2] + w[3] * w[3]) AS t{c}" for n, c in enumerate("xyz", 1))} FROM i), b AS (SELECT *, ny * tz - nz * ty AS wx, nz * tx - nx * tz AS wy, nx * ty - ny * tx AS wz FROM a),
e AS (SELECT any_value(b) AS b, min(tx * x + ty * y + tz * z) AS u0, max(tx * x + ty * y + tz * z) AS u1, min(wx * x + wy * y + wz * z) AS v0, max(wx * x + wy * y + wz * z) AS v1 FROM b JOIN p ON {_FAR} < 0.2),
c AS (SELECT corner, {", ".join(f"(CASE WHEN corner IN (0, 3) THEN u0 ELSE u1 END) * b.t{c} + (CASE WHEN corner < 2 THEN v0 ELSE v1 END) * b.w{c} - b.d * b.n{c} AS {c}" for c in "xyz")} FROM e, (VALUES (0), (1), (2), (3)) r(corner)) SELECT corner, {sql6("x", "y", "z")} FROM c""",
    "ray_hits": RAYS,
    "ground_probes": PROBES,
}
