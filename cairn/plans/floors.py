"""Queries of the floor mesh, each step one, over a stand-in field with walls, steps, holes and doubtful cells made of lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import floors as O
from cairn.operators.field import Grid
from cairn.plans.scalars import r6, sql6
from cairn.sources.tables import staged, table

WIDTH, WALL, CELL = 12, 25, 0.5
S = O.FloorSettings(seed=(3.0, 0.75, 18.0), gap=2.0, room=6.0)
PLANE = 0.75


def field(spark: SparkSession, sf: str) -> tuple[DataFrame, Grid]:
    """Cells of rooms that walls divide, each on one of three levels; a cell's quantities give its state and height."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("row"), (F.col("l_orderkey") % WIDTH).alias("col")).agg(F.sum("l_quantity").cast("bigint").alias("s"))
    kind = F.col("s") % 16
    state = F.when((F.col("row") % WALL == 0) | (kind == 0), "obstacle").when(kind == 1, "height_variance").when(kind == 2, "low_confidence").when(kind == 3, "void").when(kind == 4, "filled").otherwise("walkable")
    height = F.when(kind != 3, F.floor(F.col("row") / WALL) % 3 * 0.6 + F.col("s") % 7 * 0.05)
    cells = staged(rows.select("row", "col", state.alias("state"), height.alias("height"), (F.col("s") % 4 * 0.02).alias("confidence"), (F.col("s") % 5 * 0.03).alias("variance"), (F.col("s") % 9 * 0.1).alias("obstacle_score")), "cells")
    high = (cells.agg(F.max("row")).first()[0] or 0) + 1
    return cells, Grid(0.0, 0.0, WIDTH, high, 0.0, 2, 0.0)


def masks(spark: SparkSession, sf: str) -> DataFrame:
    cells, _ = field(spark, sf)
    return cells.select("row", "col", O.accepted().alias("strict"), O.accepted(True).alias("relaxed"))


def bridged(spark: SparkSession, sf: str) -> DataFrame:
    cells, g = field(spark, sf)
    return O.gaps(cells.filter(O.accepted()), cells, g)


def closed(spark: SparkSession, sf: str) -> DataFrame:
    cells, g = field(spark, sf)
    return O.closed_mask(cells, g, S, CELL).filter("source = 'closed'").select("row", "col", *r6("height"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    cells, g = field(spark, sf)
    found = O.parts(O.with_parts(O.closed_mask(cells, g, S, CELL)), g, S, CELL)
    return found.select(F.col("component.row").alias("row"), F.col("component.col").alias("col"), "cells", "viable", *r6("area", "centre_x", "centre_y", "centre_z", "distance"))


def _floor(spark: SparkSession, sf: str) -> tuple[O.Floor, Grid]:
    cells, g = field(spark, sf)
    return O.extracted(cells, g, PLANE, S, CELL), g


def levels(spark: SparkSession, sf: str) -> DataFrame:
    return _floor(spark, sf)[0].cells.select("row", "col", "source", *r6("height", "level"))


def corners(spark: SparkSession, sf: str) -> DataFrame:
    floor, _ = _floor(spark, sf)
    return O.corners(floor.cells, floor.plane, S.flatten).select("row", "col", *r6("height"))


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    floor, g = _floor(spark, sf)
    return O.mesh(floor, g, S, CELL)[0].select("vertex", *r6("x", "y", "z"))


def triangles(spark: SparkSession, sf: str) -> DataFrame:
    floor, g = _floor(spark, sf)
    return O.mesh(floor, g, S, CELL)[1]


def trimmed(spark: SparkSession, sf: str) -> DataFrame:
    """Of the cells of the first rooms of each level, so that the levels around the middle one's median are strays."""
    cells, _ = field(spark, sf)
    own = cells.filter(O.accepted()).withColumn("height", F.when(F.col("row") % 10 == 0, F.col("height")).otherwise(F.pmod("height", F.lit(0.6))))
    return O.trimmed(own.select("row", "col", "height"), tolerance=0.4, most_stray=0.9).select("row", "col", *r6("height"))


def modes(spark: SparkSession, sf: str) -> DataFrame:
    cells, g = field(spark, sf)
    floor = staged(O.with_parts(cells.filter(O.accepted()).select("row", "col")), "parts")
    out = None
    for mode in O.MODES:
        own = O.selected(floor, g, mode, (3.0, 18.0), CELL).filter("kept").select(F.lit(mode).alias("mode"), "row", "col")
        out = own if out is None else out.union(own)
    return out


def _room(spark: SparkSession, sf: str) -> tuple[O.Room, Grid]:
    cells, g = field(spark, sf)
    return O.room(cells, g, PLANE, S, CELL), g


def room_vertices(spark: SparkSession, sf: str) -> DataFrame:
    found, g = _room(spark, sf)
    return O.steps(found.cells, g, CELL)[0].select("vertex", *r6("x", "y", "z"))


def room_triangles(spark: SparkSession, sf: str) -> DataFrame:
    found, g = _room(spark, sf)
    return O.steps(found.cells, g, CELL)[1]


FIELD = f"""WITH RECURSIVE base AS (SELECT l_partkey AS row, l_orderkey % {WIDTH} AS col, CAST(sum(l_quantity) AS BIGINT) AS s FROM lineitem GROUP BY ALL), g AS (SELECT max(row) + 1 AS h, {WIDTH} AS w FROM base),
cell AS MATERIALIZED (SELECT row, col, CASE WHEN row % {WALL} = 0 OR s % 16 = 0 THEN 'obstacle' WHEN s % 16 = 1 THEN 'height_variance' WHEN s % 16 = 2 THEN 'low_confidence' WHEN s % 16 = 3 THEN 'void' WHEN s % 16 = 4 THEN 'filled' ELSE 'walkable' END AS state,
  CASE WHEN s % 16 <> 3 THEN row // {WALL} % 3 * 0.6e0 + s % 7 * 0.05e0 END AS height, s % 4 * 0.02e0 AS confidence, s % 5 * 0.03e0 AS variance, s % 9 * 0.1e0 AS score FROM base),
strict AS MATERIALIZED (SELECT row, col, height FROM cell WHERE state IN ('walkable', 'filled'))"""


def _closure(name: str, of: str) -> str:
    """The least cell (as row * 100 + col) of the component of each cell."""
    return f"""{name}_n AS MATERIALIZED (SELECT row, col, row * 100 + col AS id FROM {of}),
{name}_e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM {name}_n a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(i, j) JOIN {name}_n b ON b.row = a.row + i AND b.col = a.col + j),
{name}_j(id, other) AS (SELECT id, id FROM {name}_n UNION SELECT j.id, b FROM {name}_j j JOIN {name}_e ON a = j.other),
{name} AS MATERIALIZED (SELECT id // 100 AS row, id % 100 AS col, min(other) AS comp FROM {name}_j GROUP BY id)"""


BRIDGED = f"""{FIELD}, grid AS MATERIALIZED (SELECT r.row, q.col, coalesce(state, 'void') AS state, (r.row, q.col) IN (SELECT (row, col) FROM strict) AS floor, r.row IN (0, h - 1) OR q.col IN (0, w - 1) AS edge
  FROM g, LATERAL (SELECT unnest(range(h)) AS row) r, LATERAL (SELECT unnest(range(w)) AS col) q LEFT JOIN cell ON cell.row = r.row AND cell.col = q.col),
open_ AS (SELECT * FROM grid WHERE NOT floor AND state IN ('void', 'low_confidence')), {_closure("hole", "open_")},
wall AS (SELECT DISTINCT comp FROM hole, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(i, j) JOIN grid ON grid.row = hole.row + i AND grid.col = hole.col + j WHERE NOT floor AND state NOT IN ('void', 'low_confidence')),
small AS (SELECT comp FROM hole JOIN grid USING (row, col) GROUP BY comp HAVING count(*) <= 12 AND NOT bool_or(edge)), bridge AS MATERIALIZED (SELECT row, col FROM hole WHERE comp IN (FROM small) AND comp NOT IN (FROM wall))"""
CLOSED = f"""{BRIDGED}, mask AS MATERIALIZED (SELECT row, col, height, 'mask' AS source FROM strict UNION ALL SELECT row, col, height, 'bridged' FROM bridge LEFT JOIN cell USING (row, col)),
side AS (SELECT c.row, c.col, d, arg_min({{'h': m.height}}, n).h AS h FROM (FROM grid ANTI JOIN mask USING (row, col)) c, (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) o(d, i, j), range(1, 5) r(n) JOIN mask m ON m.row = c.row + i * n AND m.col = c.col + j * n
  WHERE c.state NOT IN ('obstacle', 'height_variance') GROUP BY c.row, c.col, d),
seam AS MATERIALIZED (SELECT row, col, (min(h) + max(h)) / 2 AS middle FROM side GROUP BY row, col HAVING count(h) >= 2 AND max(h) - min(h) <= 0.35),
floor AS MATERIALIZED (FROM mask UNION ALL SELECT row, col, coalesce(height, middle) AS height, 'closed' AS source FROM seam LEFT JOIN cell USING (row, col))"""
PARTS = f"""{CLOSED}, {_closure("comp_", "floor")}, part AS MATERIALIZED (SELECT comp, count(*) AS cells, count(*) * 0.25e0 AS area, avg((col + 0.5) * 0.5) AS centre_x, avg(coalesce(height, 0)) AS centre_y, avg((row + 0.5) * 0.5) AS centre_z FROM comp_ JOIN floor USING (row, col) GROUP BY comp),
placed AS MATERIALIZED (SELECT *, sqrt(pow(centre_x - 3, 2) + pow(centre_y - 0.75, 2) + pow(centre_z - 18, 2)) AS distance, cells >= 20 AND area >= 1.2 AS viable FROM part)"""
LEVEL = f"""{PARTS}, best AS (SELECT comp FROM placed WHERE viable ORDER BY distance > 3.25, CASE WHEN distance > 3.25 THEN 0 ELSE distance - 0.45 * sqrt(area) END, cells DESC, comp LIMIT 1),
median AS (SELECT comp, (list_sort(list(height)))[count(height) // 2 + 1] AS m FROM comp_ JOIN floor USING (row, col) WHERE height IS NOT NULL GROUP BY comp), ref AS (SELECT m AS r FROM median JOIN best USING (comp)),
own AS MATERIALIZED (SELECT floor.* FROM floor JOIN comp_ USING (row, col) JOIN median USING (comp) JOIN placed USING (comp), ref WHERE viable AND m BETWEEN r - 0.25 AND r + 0.3 AND (height IS NULL OR height BETWEEN r - 0.5 AND r + 0.45)),
levels AS (SELECT a.row, a.col, (list_sort(list(b.height)))[count(*) // 2 + 1] AS level FROM own a JOIN own b ON b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 WHERE b.height IS NOT NULL GROUP BY a.row, a.col),
flat AS MATERIALIZED (SELECT own.*, level FROM own LEFT JOIN levels USING (row, col)), plane AS (SELECT CASE WHEN {PLANE} BETWEEN r - 0.5 AND r + 0.45 THEN {PLANE}::DOUBLE ELSE r END AS p FROM ref)"""
CORNERS = f"""{LEVEL}, mean AS (SELECT row + i AS row, col + j AS col, coalesce(avg(level), any_value(p)) AS m FROM flat, plane, range(2) a(i), range(2) b(j) GROUP BY 1, 2),
corner_ AS MATERIALIZED (SELECT row, col, CASE WHEN abs(m - p) <= 0.12 THEN p ELSE m END AS height, row_number() OVER (ORDER BY row, col) - 1 AS vertex FROM mean, plane)"""
ROOM = f"""{FIELD}, {_closure("comp_", "strict")}, part AS (SELECT comp, count(*) AS cells, count(*) * 0.25e0 AS area, avg((col + 0.5) * 0.5) AS centre_x, avg(coalesce(height, 0)) AS centre_y, avg((row + 0.5) * 0.5) AS centre_z FROM comp_ JOIN strict USING (row, col) GROUP BY comp),
placed AS (SELECT *, sqrt(pow(centre_x - 3, 2) + pow(centre_y - {PLANE}, 2) + pow(centre_z - 18, 2)) AS distance FROM part WHERE cells >= 20 AND area >= 1.2),
best AS (SELECT comp FROM placed ORDER BY distance > 3.25, CASE WHEN distance > 3.25 THEN 0 ELSE distance - 0.45 * sqrt(area) END, cells DESC, comp LIMIT 1),
own AS MATERIALIZED (SELECT row, col, height FROM strict JOIN comp_ USING (row, col) JOIN best USING (comp)), mid AS (SELECT (list_sort(list(height)))[count(*) // 2 + 1] AS m FROM own), band AS MATERIALIZED (SELECT own.* FROM own, mid WHERE abs(height - m) <= 0.5), {_closure("piece", "band")},
top AS (SELECT comp FROM piece GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1), ok AS (SELECT count(*) > 16 AND (SELECT count(*) FROM band) >= greatest(0.7 * count(*), 16) AND (SELECT count(*) FROM piece JOIN top USING (comp)) >= greatest(0.7 * count(*), 16) AS good FROM own),
room AS MATERIALIZED (SELECT row, col, height, row_number() OVER (ORDER BY row, col) - 1 AS k FROM own, ok WHERE NOT good OR (row, col) IN (SELECT (row, col) FROM piece JOIN top USING (comp)))"""

QUERIES = {
    "room_floor_vertices": room_vertices, "room_floor_triangles": room_triangles, "floor_masks": masks, "bridged_gaps": bridged, "closed_seams": closed, "floor_parts": parts, "floor_levels": levels, "floor_corners": corners, "fast_floor_vertices": vertices, "fast_floor_triangles": triangles,
    "trimmed_floor": trimmed, "component_modes": modes,
}
SQL = {
    "room_floor_vertices": f"{ROOM} SELECT k * 4 + n AS vertex, round((col + i) * 0.5e0, 6) + 0.0 AS x, round(height, 6) + 0.0 AS y, round((row + j) * 0.5e0, 6) + 0.0 AS z FROM room, (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) r(n, i, j)",
    "room_floor_triangles": f"{ROOM} SELECT k * 2 + h AS triangle, k * 4 AS a, k * 4 + 1 + h AS b, k * 4 + 2 + h AS c FROM room, (VALUES (0), (1)) r(h)",
    "floor_masks": f"""{FIELD} SELECT row, col, state IN ('walkable', 'filled') AS strict, state IN ('walkable', 'filled') OR (height IS NOT NULL AND ((state = 'low_confidence' AND variance <= 0.18 AND score <= 0.42)
  OR (state = 'height_variance' AND confidence >= 0.01 AND variance <= 0.08 AND score <= 0.35) OR (state = 'obstacle' AND confidence >= 0.02 AND variance <= 0.05 AND score <= 0.52))) AS relaxed FROM cell""",
    "bridged_gaps": f"{BRIDGED} FROM bridge",
    "closed_seams": f"{CLOSED} SELECT row, col, round(height, 6) + 0.0 AS height FROM floor WHERE source = 'closed'",
    "floor_parts": f"{PARTS} SELECT comp // 100 AS row, comp % 100 AS col, cells, viable, {sql6('area', 'centre_x', 'centre_y', 'centre_z', 'distance')} FROM placed",
    "floor_levels": f"{LEVEL} SELECT row, col, source, {sql6('height', 'level')} FROM flat",
    "floor_corners": f"{CORNERS} SELECT row, col, {sql6('height')} FROM corner_",
    "fast_floor_vertices": f"{CORNERS} SELECT vertex, round(col * 0.5e0, 6) + 0.0 AS x, round(height, 6) + 0.0 AS y, round(row * 0.5e0, 6) + 0.0 AS z FROM corner_",
    "fast_floor_triangles": f"""{CORNERS} SELECT row_number() OVER (ORDER BY f.row, f.col, half) - 1 AS triangle, a.vertex AS a, CASE half WHEN 0 THEN b.vertex ELSE c.vertex END AS b, CASE half WHEN 0 THEN c.vertex ELSE d.vertex END AS c FROM flat f, range(2) r(half)
JOIN corner_ a ON a.row = f.row AND a.col = f.col JOIN corner_ b ON b.row = f.row + 1 AND b.col = f.col JOIN corner_ c ON c.row = f.row + 1 AND c.col = f.col + 1 JOIN corner_ d ON d.row = f.row AND d.col = f.col + 1""",
    "trimmed_floor": f"""{FIELD}, own AS MATERIALIZED (SELECT row, col, CASE WHEN row % 10 = 0 THEN height ELSE height - floor(height / 0.6e0) * 0.6e0 END AS height FROM strict), mid AS (SELECT (list_sort(list(height)))[count(*) // 2 + 1] AS m FROM own),
band AS MATERIALIZED (SELECT own.* FROM own, mid WHERE abs(height - m) <= 0.4), {_closure("piece", "band")}, top AS (SELECT comp FROM piece GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1),
ok AS (SELECT (SELECT count(*) FROM band) >= 0.1 * count(*) AND (SELECT count(*) FROM piece JOIN top USING (comp)) >= greatest(16, 0.1 * count(*)) AS good FROM own)
SELECT row, col, round(height, 6) + 0.0 AS height FROM own, ok WHERE NOT good OR (row, col) IN (SELECT (row, col) FROM piece JOIN top USING (comp))""",
    "component_modes": f"""{FIELD}, {_closure("piece", "strict")}, m AS MATERIALIZED (SELECT comp, count(*) AS cells, avg(row) AS r, avg(col) AS c FROM piece GROUP BY comp),
k AS (SELECT 'largest' AS mode, comp FROM (SELECT comp FROM m ORDER BY cells DESC, comp DESC LIMIT 1) UNION ALL SELECT 'nearest_centre', comp FROM (SELECT comp FROM m, g ORDER BY pow(r - (h - 1) / 2, 2) + pow(c - (w - 1) / 2, 2), cells DESC, comp LIMIT 1)
  UNION ALL SELECT 'seed', comp FROM (SELECT comp FROM m ORDER BY sqrt(pow(r - 35.5, 2) + pow(c - 5.5, 2)) * 0.5 - sqrt(cells * 0.25) * 0.45, cells DESC, comp LIMIT 1)) SELECT mode, row, col FROM k JOIN piece USING (comp)""",
}
