"""Queries of clouds and of the walkable ground field, each stage one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import cloud as C
from cairn.operators import field as D
from cairn.plans.scalars import r6, sql6
from cairn.sources.tables import CLOUD_SQL, POINTS_SQL, cloud, points, staged

NONE, S = C.CloudSettings(), D.FieldSettings()


def _splats(spark: SparkSession, sf: str) -> DataFrame:
    return C.kept(C.oriented(cloud(spark, sf), NONE), NONE)


def bounds(spark: SparkSession, sf: str) -> DataFrame:
    out = C.bounds(cloud(spark, sf))
    return out.select("point_count", *r6(*out.columns[1:]))


def suggested_region(spark: SparkSession, sf: str) -> DataFrame:
    out = C.suggested_region(_splats(spark, sf))
    return out.select(*r6(*out.columns[:7]), "sample_count", "clamped_height")


_SIDES = [f"{n}_{c}" for n in ("min", "max") for c in "xyz"]
_RANK = "(SELECT y FROM (SELECT y, row_number() OVER (ORDER BY y) AS i FROM s) WHERE i = floor(((SELECT count(*) FROM s) - 1) * 0.02 + 0.5) + 1)"
_BOUNDS = "SELECT count(*) AS point_count, " + ", ".join(f"{s[:3]}({s[-1]}) AS {s}" for s in _SIDES) + f", {_RANK} AS floor_y FROM s"
KEPT = f"SELECT * FROM ({CLOUD_SQL}) WHERE opacity > 0.05 AND scale < 5"
BOUNDS = f"WITH s AS ({CLOUD_SQL}), b AS ({_BOUNDS}) SELECT point_count, {sql6(*_SIDES, 'floor_y')} FROM b"
REGION = f"""WITH s AS ({KEPT}), b AS ({_BOUNDS}), t AS (SELECT min_x AS region_min_x, least(min_y, floor_y) AS region_min_y, min_z AS region_min_z, max_x AS region_max_x,
  least(min_y, floor_y) + least(2.0, greatest(max_y - min_y, 0)) AS region_max_y, max_z AS region_max_z, floor_y, point_count AS sample_count, greatest(max_y - min_y, 0) < 2.0 AS clamped_height FROM b)
SELECT {sql6("region_min_x", "region_min_y", "region_min_z", "region_max_x", "region_max_y", "region_max_z", "floor_y")}, sample_count, clamped_height FROM t"""


def neighbour_distances(spark: SparkSession, sf: str) -> DataFrame:
    return C.neighbour_distances(points(spark, sf)).select("splat_id", *r6("mean_distance"))


def pruned(spark: SparkSession, sf: str) -> DataFrame:
    return C.pruned(points(spark, sf)).select("splat_id")


_NEAR = f"""WITH p AS ({POINTS_SQL}), b AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, greatest(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) / pow(count(*), 1.0 / 3), 1e-6) AS c FROM p),
q AS (SELECT p.*, floor((x - x0) / c) AS cx, floor((y - y0) / c) AS cy, floor((z - z0) / c) AS cz FROM p, b),
d AS (SELECT a.splat_id, o.splat_id AS other, sqrt(pow(o.x - a.x, 2) + pow(o.y - a.y, 2) + pow(o.z - a.z, 2)) AS d, greatest(abs(a.cx - o.cx), abs(a.cy - o.cy), abs(a.cz - o.cz), 1) AS ring FROM q a JOIN q o ON a.splat_id <> o.splat_id),
r AS (SELECT splat_id, coalesce((list_sort(list(ring)))[16], 8) AS ring FROM d GROUP BY splat_id),
k AS (SELECT d.*, row_number() OVER (PARTITION BY d.splat_id ORDER BY d, other) AS i FROM d JOIN r ON d.splat_id = r.splat_id AND d.ring <= least(r.ring, 8)),
m AS (SELECT splat_id, avg(d) AS mean_distance FROM k WHERE i <= 16 GROUP BY splat_id),
n AS (SELECT p.splat_id, coalesce(mean_distance, 'inf'::DOUBLE) AS mean_distance FROM p LEFT JOIN m USING (splat_id))"""
NEIGHBOURS = f"{_NEAR} SELECT splat_id, {sql6('mean_distance')} FROM n"
PRUNED = f"""{_NEAR}, g AS (SELECT avg(mean_distance) + 2 * stddev_pop(mean_distance) AS t FROM n WHERE isfinite(mean_distance)), ok AS (SELECT splat_id FROM n, g WHERE mean_distance <= t)
SELECT splat_id FROM n WHERE splat_id IN (FROM ok) OR (SELECT count(*) FROM n) - (SELECT count(*) FROM ok) > 0.4 * (SELECT count(*) FROM n)"""


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    s = _splats(spark, sf)
    return D.profiles(s, D.grid_of(s, S), S).select("row", "col", "bin", *r6("density"))


def layers(spark: SparkSession, sf: str) -> DataFrame:
    s = _splats(spark, sf)
    g = D.grid_of(s, S)
    return D.layers(D.profiles(s, g, S), g, S).select("row", "col", "first", "last", *r6("height", "weight"))


def _surfaces(spark: SparkSession, sf: str):
    s = _splats(spark, sf)
    g = D.grid_of(s, S)
    profile = staged(D.profiles(s, g, S), "profile")
    layer = staged(D.layers(profile, g, S), "layers")
    return g, D.surfaces(profile, layer, D.floor_height(layer, g, S), S)


def surfaces(spark: SparkSession, sf: str) -> DataFrame:
    return _surfaces(spark, sf)[1].select("row", "col", "layer_count", "floor_bins", "obstacle_bins", *r6("height", "confidence", "obstacle", "variance", "peak"))


def smoothed(spark: SparkSession, sf: str) -> DataFrame:
    g, cells = _surfaces(spark, sf)
    return D.smoothed(cells, g, S).select("row", "col", *r6("height"))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    g, cells = _surfaces(spark, sf)
    return D.gradients(D.classified(D.smoothed(cells, g, S), S), S).select("row", "col", "state", *r6("height", "obstacle_score", "gradient_x", "gradient_z"))


def ground_field(spark: SparkSession, sf: str) -> DataFrame:
    cells = D.build(_splats(spark, sf), S).cells
    return cells.select("row", "col", "state", *r6("height"), F.col("component.row").alias("component_row"), F.col("component.col").alias("component_col"))


def state_counts(spark: SparkSession, sf: str) -> DataFrame:
    cells = D.build(_splats(spark, sf), S).cells
    return cells.groupBy("state").agg(F.count("*").alias("cells"), F.countDistinct("component").alias("components"))


def dense_floor(spark: SparkSession, sf: str) -> DataFrame:
    return D.dense_floor(D.build(_splats(spark, sf), S), S).select("cells", *r6("modal_height", "centre_x", "centre_y", "centre_z"))


def dense_region(spark: SparkSession, sf: str) -> DataFrame:
    return D.dense_region(D.build(_splats(spark, sf), S), S).select(*r6(*_SIDES))


#: One chain of common table expressions for the stages; each query selects from one.
FIELD = f"""WITH RECURSIVE s AS ({KEPT}), g AS (SELECT min(x) AS u, min(z) AS v, greatest(ceil((max(x) - min(x)) / 0.5), 1) AS w, greatest(ceil((max(z) - min(z)) / 0.5), 1) AS h, min(y) - 0.48 AS low, greatest(least(ceil((max(y) + 0.48 - (min(y) - 0.48)) / 0.08), 256), 2) AS bins, {_RANK} AS floor FROM s),
a AS (SELECT x, y, z, least(greatest(greatest(scale, 0.001) * 2.5, 0.25), 2.0) AS reach, greatest(scale, 0.04) AS sigma, opacity * (0.35 + 0.65 * least(abs(ny), 1)) AS base, least(greatest(ceil(greatest(scale, 0.04) * 2.5 / 0.08), 1), 8) AS around FROM s),
c AS (SELECT a.*, CAST(round((y - low) / 0.08) AS INTEGER) AS centre, unnest(generate_series(CAST(greatest(floor((z - reach - v) / 0.5), 0) AS BIGINT), CAST(least(floor((z + reach - v) / 0.5), h - 1) AS BIGINT))) AS row FROM a, g),
e AS (SELECT c.*, unnest(generate_series(CAST(greatest(floor((x - reach - u) / 0.5), 0) AS BIGINT), CAST(least(floor((x + reach - u) / 0.5), w - 1) AS BIGINT))) AS col FROM c, g),
f AS (SELECT e.*, pow(u + (col + 0.5) * 0.5 - x, 2) + pow(v + (row + 0.5) * 0.5 - z, 2) AS d2 FROM e, g),
i AS (SELECT f.*, base * exp(-d2 / (2 * reach * reach)) AS share, unnest(generate_series(CAST(greatest(centre - around, 0) AS INTEGER), CAST(least(centre + around, bins - 1) AS INTEGER))) AS bin FROM f, g WHERE d2 <= reach * reach AND centre + around >= 0),
profile AS (SELECT row, col, bin, sum(share * exp(-pow(low + (bin + 0.5) * 0.08 - y, 2) / (2 * sigma * sigma))) AS density FROM i, g GROUP BY row, col, bin),
runs AS (SELECT *, bin - row_number() OVER (PARTITION BY row, col ORDER BY bin) AS run FROM profile WHERE density >= 0.08),
layer AS (SELECT row, col, min(bin) AS first, max(bin) AS last, sum((low + (bin + 0.5) * 0.08) * density) / sum(density) AS height, sum(density) AS weight FROM runs, g GROUP BY row, col, run),
hist AS (SELECT b.bin, coalesce(sum(weight), 0) AS w FROM (SELECT unnest(generate_series(0, CAST(bins - 1 AS INTEGER))) AS bin FROM g) b LEFT JOIN (SELECT CAST(least(greatest(floor((height - low) / 0.08), 0), bins - 1) AS INTEGER) AS bin, weight FROM layer, g) l USING (bin) GROUP BY b.bin),
smooth AS (SELECT bin, sum(w) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM hist),
peak AS (SELECT bin, w, max(w) OVER () AS top, coalesce(lag(w) OVER (ORDER BY bin), -1) AS p, coalesce(lead(w) OVER (ORDER BY bin), -1) AS n FROM smooth),
plane AS (SELECT low + (min(bin) + 0.5) * 0.08 AS y FROM peak, g WHERE peak.w >= 0.25 * top AND peak.w >= p AND peak.w >= n AND low + (bin + 0.5) * 0.08 >= floor - 0.5 GROUP BY low),
main AS (SELECT row, col, arg_min({{'h': height, 'w': weight, 'f': first, 'l': last}}, [abs(height - y), first]) AS m FROM layer, plane GROUP BY row, col),
placed AS (SELECT layer.*, m, row_number() OVER (PARTITION BY layer.row, layer.col ORDER BY first) AS place, height - m.h AS delta FROM layer JOIN main USING (row, col)),
found AS (SELECT row, col, any_value(m.h) AS height, count(*) AS layer_count, any_value(m.w) AS confidence, coalesce(sum(weight) FILTER (delta BETWEEN 0.16 AND 1.7), 0) AS obstacle, sum(weight * delta * delta) FILTER (place <= 2) / sum(weight) FILTER (place <= 2) AS variance,
  any_value(m.l - m.f + 1) AS floor_bins, coalesce(sum(last - first + 1) FILTER (delta BETWEEN 0.16 AND 1.7), 0) AS obstacle_bins FROM placed GROUP BY row, col),
surface AS (SELECT * FROM (SELECT row, col, max(density) AS peak FROM profile GROUP BY row, col) LEFT JOIN found USING (row, col)),
able AS (SELECT row, col, height FROM surface, g WHERE height IS NOT NULL AND (layer_count <= 1 OR abs(height - floor) <= 0.24)),
mean AS (SELECT x.row, x.col, avg(n.height) AS mean FROM able x JOIN able n ON n.row BETWEEN x.row - 1 AND x.row + 1 AND n.col BETWEEN x.col - 1 AND x.col + 1 GROUP BY x.row, x.col HAVING count(*) >= 3),
level AS (SELECT surface.* REPLACE (coalesce(mean, height) AS height) FROM surface LEFT JOIN mean USING (row, col)),
near AS (SELECT x.row, x.col, list_sort(list(n.height)) AS hs FROM level x JOIN level n ON n.row BETWEEN x.row - 1 AND x.row + 1 AND n.col BETWEEN x.col - 1 AND x.col + 1 AND (n.row, n.col) <> (x.row, x.col) WHERE n.height IS NOT NULL GROUP BY x.row, x.col),
step AS (SELECT level.*, CASE WHEN len(hs) >= 3 THEN hs[len(hs) // 2 + 1] END AS median FROM level LEFT JOIN near USING (row, col)),
snap AS (SELECT * REPLACE (CASE WHEN abs(height - median) > 0.24 AND abs(height - median) < 0.6 THEN median ELSE height END AS height), coalesce(abs(height - median) >= 0.6, false) AS ledge, coalesce(obstacle / (confidence + obstacle), 0) AS obstacle_score FROM step),
state AS (SELECT *, CASE WHEN layer_count IS NULL THEN 'void' WHEN obstacle >= 0.001 AND obstacle_score >= 0.35 THEN 'obstacle' WHEN confidence + obstacle < 0.001 THEN 'void' WHEN confidence < 0.01 THEN 'low_confidence' WHEN ledge THEN 'height_variance' ELSE 'walkable' END AS state FROM snap),
slope AS (SELECT c.*, coalesce((coalesce(r.height, c.height) - coalesce(l.height, c.height)) / 1.0, 0) AS gradient_x, coalesce((coalesce(d.height, c.height) - coalesce(t.height, c.height)) / 1.0, 0) AS gradient_z FROM state c
  LEFT JOIN state l ON l.row = c.row AND l.col = c.col - 1 LEFT JOIN state r ON r.row = c.row AND r.col = c.col + 1 LEFT JOIN state t ON t.col = c.col AND t.row = c.row - 1 LEFT JOIN state d ON d.col = c.col AND d.row = c.row + 1),
grid AS (SELECT r.row, q.col, coalesce(state, 'void') AS state, height, peak, confidence, state IS NOT NULL AS seen FROM (SELECT unnest(generate_series(0, CAST(h - 1 AS BIGINT))) AS row FROM g) r CROSS JOIN (SELECT unnest(generate_series(0, CAST(w - 1 AS BIGINT))) AS col FROM g) q LEFT JOIN state ON state.row = r.row AND state.col = q.col),
hole AS (SELECT row, col, row * 100000 + col AS id FROM grid WHERE state IN ('void', 'low_confidence')),
hjoin(id, other) AS (SELECT id, id FROM hole UNION SELECT j.id, n.id FROM hjoin j JOIN hole m ON m.id = j.other JOIN hole n ON abs(n.row - m.row) + abs(n.col - m.col) = 1),
hcomp AS (SELECT id, min(other) AS comp, count(*) AS n FROM hjoin GROUP BY id),
rim AS (SELECT comp, any_value(n) AS n, bool_and(coalesce(x.state = 'walkable', false)) AS closed, avg(x.height) FILTER (x.state = 'walkable') AS mean FROM hcomp JOIN hole USING (id) CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(i, j) LEFT JOIN grid x ON x.row = hole.row + i AND x.col = hole.col + j WHERE x.state IS NULL OR x.state NOT IN ('void', 'low_confidence') GROUP BY comp),
fill AS (SELECT row, col, mean FROM rim JOIN hcomp USING (comp) JOIN hole USING (id) WHERE closed AND rim.n <= 9 AND mean IS NOT NULL),
cell AS (SELECT grid.row, grid.col, CASE WHEN mean IS NOT NULL THEN 'filled' ELSE state END AS state, coalesce(mean, height) AS height, peak, confidence FROM grid LEFT JOIN fill USING (row, col) WHERE seen OR mean IS NOT NULL),
good AS (SELECT row, col, row * 100000 + col AS id FROM cell WHERE state IN ('walkable', 'filled')),
cjoin(id, other) AS (SELECT id, id FROM good UNION SELECT j.id, n.id FROM cjoin j JOIN good m ON m.id = j.other JOIN good n ON abs(n.row - m.row) + abs(n.col - m.col) = 1),
comp AS (SELECT id, min(other) AS comp FROM cjoin GROUP BY id),
done AS (SELECT cell.*, comp // 100000 AS component_row, comp % 100000 AS component_col FROM cell LEFT JOIN comp ON comp.id = row * 100000 + col AND state IN ('walkable', 'filled'))
"""
_DENSE = """, dens AS (SELECT *, greatest(coalesce(peak, 0), coalesce(confidence, 0)) AS d FROM done WHERE height IS NOT NULL AND greatest(coalesce(peak, 0), coalesce(confidence, 0)) > 0),
cut AS (SELECT (list_sort(list(d)))[least(count(*) - 1, CAST(floor(count(*) * 0.6) AS BIGINT)) + 1] AS t FROM dens), thick AS (SELECT dens.* FROM dens, cut WHERE d >= t),
modal AS (SELECT arg_min(b, [-w, b]) * 0.25 AS m FROM (SELECT floor(height / 0.25 + 0.5) AS b, sum(d) AS w FROM thick GROUP BY 1)),
core AS (SELECT any_value(m) AS modal_height, sum((u + (col + 0.5) * 0.5) * d) / sum(d) AS centre_x, sum(height * d) / sum(d) AS centre_y, sum((v + (row + 0.5) * 0.5) * d) / sum(d) AS centre_z, count(*) AS cells FROM thick, modal, g WHERE abs(height - m) <= 0.25)
"""
QUERIES = {
    "cloud_bounds": bounds, "suggested_region": suggested_region, "neighbour_distances": neighbour_distances, "pruned_points": pruned, "field_profiles": profiles, "field_layers": layers,
    "field_surfaces": surfaces, "field_smoothed": smoothed, "field_classified": classified, "ground_field": ground_field, "field_states": state_counts, "dense_floor": dense_floor, "dense_region": dense_region,
}
SQL = {
    "cloud_bounds": BOUNDS, "suggested_region": REGION, "neighbour_distances": NEIGHBOURS, "pruned_points": PRUNED,
    "field_profiles": f"{FIELD} SELECT row, col, bin, {sql6('density')} FROM profile",
    "field_layers": f"{FIELD} SELECT row, col, first, last, {sql6('height', 'weight')} FROM layer",
    "field_surfaces": f"{FIELD} SELECT row, col, layer_count, floor_bins, CAST(obstacle_bins AS BIGINT) AS obstacle_bins, {sql6('height', 'confidence', 'obstacle', 'variance', 'peak')} FROM surface",
    "field_smoothed": f"{FIELD} SELECT row, col, {sql6('height')} FROM level",
    "field_classified": f"{FIELD} SELECT row, col, state, {sql6('height', 'obstacle_score', 'gradient_x', 'gradient_z')} FROM slope",
    "ground_field": f"{FIELD} SELECT row, col, state, {sql6('height')}, component_row, component_col FROM done",
    "field_states": f"{FIELD} SELECT state, count(*) AS cells, count(DISTINCT (component_row, component_col)) FILTER (component_row IS NOT NULL) AS components FROM done GROUP BY state",
    "dense_region": f"""{FIELD}{_DENSE}, box AS (SELECT min(u + (col + 0.5) * 0.5) - 1 AS min_x, any_value(m) - 0.6 AS min_y, min(v + (row + 0.5) * 0.5) - 1 AS min_z, max(u + (col + 0.5) * 0.5) + 1 AS max_x, any_value(m) + 3.0 AS max_y, max(v + (row + 0.5) * 0.5) + 1 AS max_z FROM done, modal, g WHERE height BETWEEN m - 0.6 AND m + 3)
SELECT {", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in _SIDES)} FROM box""",
    "dense_floor": f"{FIELD}{_DENSE} SELECT cells, {sql6('modal_height', 'centre_x', 'centre_y', 'centre_z')} FROM core",
}
