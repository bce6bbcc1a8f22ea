"""Queries of voxel volumes, meshes, codes and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import cloud as C
from cairn.operators import codec as Q
from cairn.operators import slicing as L
from cairn.operators import voxels as V
from cairn.plans.scalars import r6, sql6
from cairn.sources import splats as A
from cairn.sources.tables import CLOUD_SQL, NUMBERED_SQL, POINTS_SQL, TERRAIN_SQL, cloud, points, staged, table, terrain

S = V.VoxelSettings(scene="object", threshold=3.0)
SEED = (5.0, 3.9, 5.0)


def _box(splats: DataFrame, s: V.VoxelSettings = S) -> V.Box:
    b = C.bounds(splats).first()
    return V.box_of(tuple(b[f"min_{c}"] for c in "xyz"), tuple(b[f"max_{c}"] for c in "xyz"), s)


def _volume(spark: SparkSession, sf: str) -> tuple[DataFrame, V.Box]:
    splats = cloud(spark, sf)
    box = _box(splats)
    # Sums scale with the rows; so does the threshold of this stand-in, so that some space stays free.
    return staged(V.solids(splats, box, splats.count() / 2000), "solid"), box


def densities(spark: SparkSession, sf: str) -> DataFrame:
    splats = cloud(spark, sf)
    return V.densities(splats, _box(splats)).select(*V.AXES, *r6("density"))


def solid_bounds(spark: SparkSession, sf: str) -> DataFrame:
    solid, _ = _volume(spark, sf)
    return solid.agg(F.count("*").alias("voxels"), *(f(v).alias(f"{n}_{v}") for n, f in (("min", F.min), ("max", F.max)) for v in V.AXES))


def dilated(spark: SparkSession, sf: str) -> DataFrame:
    solid, box = _volume(spark, sf)
    return V.dilated(solid, box, (1, 2, 1))


def floor_filled(spark: SparkSession, sf: str) -> DataFrame:
    solid, box = _volume(spark, sf)
    return V.floor_filled(solid, box, S)


def exterior_fill(spark: SparkSession, sf: str) -> DataFrame:
    solid, box = _volume(spark, sf)
    out, leaked = V.filled_outside(solid, box, V.VoxelSettings(fill=0.5), SEED, pinned=True)
    return out.withColumn("leaked", F.lit(leaked))


def _carved(spark, sf):
    solid, box = _volume(spark, sf)
    return solid, staged(V.carved(solid, box, S, SEED), "nav"), box


def carved(spark: SparkSession, sf: str) -> DataFrame:
    return _carved(spark, sf)[1]


def walkable(spark: SparkSession, sf: str) -> DataFrame:
    solid, nav, box = _carved(spark, sf)
    return V.walkable(solid, nav).withColumn("top_y", F.round(box.low[1] + (F.col("vy") + 1) * box.size, 6))


def shell(spark: SparkSession, sf: str) -> DataFrame:
    solid, nav, _ = _carved(spark, sf)
    return V.shell_faces(solid, nav)


def exterior(spark: SparkSession, sf: str) -> DataFrame:
    return V.exterior_faces(_volume(spark, sf)[0])


def ramps(spark: SparkSession, sf: str) -> DataFrame:
    """Over the carved volume, and over the stepped terrain, so that there are ramps at every scale."""
    solid, nav, _ = _carved(spark, sf)
    ground, free, _ = terrain(spark, sf)
    ramp = lambda name, tread, step: V.ramps(staged(tread, "treads"), step).withColumn("over", F.lit(name))
    return ramp("volume", V.walkable(solid, nav), 1).union(ramp("terrain", V.walkable(ground, free), 2))


def mask(spark: SparkSession, sf: str) -> DataFrame:
    solid, box = _volume(spark, sf)
    return V.packed(solid, box)


def unmasked(spark: SparkSession, sf: str) -> DataFrame:
    solid, box = _volume(spark, sf)
    return V.unpacked(V.packed(solid, box), box)


def ground(spark: SparkSession, sf: str) -> DataFrame:
    solid, box = _volume(spark, sf)
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % 41 / 4.0).alias("x"), F.lit(3.5).alias("y"), (F.col("o_custkey") % 43 / 4.0).alias("z"))
    return V.ground_below(at, solid, box, 4.0).select("point_id", *r6("ground"))


def capsules(spark: SparkSession, sf: str) -> DataFrame:
    solid, box = _volume(spark, sf)
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % 53 / 4.0 - 1.0).alias("x"), (F.col("o_orderkey") % 17 / 4.0).alias("y"), (F.col("o_custkey") % 43 / 4.0).alias("z"))
    return V.capsule_fits(at, solid, box, S)


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = cloud(spark, sf).withColumn("x", F.when(F.col("x") > 5, F.col("x") + 4.0).otherwise(F.col("x")))  # two parts, metres from each other
    return V.coarse_cluster(rows, (1.0, 0.5, 1.0), 0.1).groupBy(F.floor("x").alias("x")).agg(F.count("*").alias("splats"))


#: The object scene's padding is its fill size; voxels of half a metre.
BOX = f"""WITH RECURSIVE s AS ({CLOUD_SQL}), g AS (SELECT min(x) - 1.6 AS x0, min(y) - 1.6 AS y0, min(z) - 1.6 AS z0,
  CAST(greatest(ceil((max(x) + 1.6 - (min(x) - 1.6)) / 0.5), 1) + 1 AS BIGINT) AS dx, CAST(greatest(ceil((max(y) + 1.6 - (min(y) - 1.6)) / 0.5), 1) + 1 AS BIGINT) AS dy, CAST(greatest(ceil((max(z) + 1.6 - (min(z) - 1.6)) / 0.5), 1) + 1 AS BIGINT) AS dz, count(*) AS n FROM s),
p AS (SELECT s.*, CAST(floor((x - x0) / 0.5) AS BIGINT) AS px, CAST(floor((y - y0) / 0.5) AS BIGINT) AS py, CAST(floor((z - z0) / 0.5) AS BIGINT) AS pz, least(greatest(greatest(scale, 0.25) * 2.5, 0.5), 3.0) AS reach FROM s, g),
o AS (SELECT p.*, px + i AS vx, py + j AS vy, pz + k AS vz FROM p, range(-2, 3) a(i), range(-2, 3) b(j), range(-2, 3) c(k)),
d AS (SELECT o.*, pow(x0 + (vx + 0.5) * 0.5 - x, 2) + pow(y0 + (vy + 0.5) * 0.5 - y, 2) + pow(z0 + (vz + 0.5) * 0.5 - z, 2) AS d2 FROM o, g WHERE vx BETWEEN 0 AND dx - 1 AND vy BETWEEN 0 AND dy - 1 AND vz BETWEEN 0 AND dz - 1),
dens AS (SELECT vx, vy, vz, sum(opacity * exp(-d2 / (2 * reach * reach))) AS density FROM d WHERE d2 <= reach * reach GROUP BY ALL),
solid AS MATERIALIZED (SELECT vx, vy, vz FROM dens, g WHERE density >= n / 2000)"""


def _space(name: str, blocked: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT vx, vy, vz, (vy * dz + vz) * dx + vx AS id, vx IN (0, dx - 1) OR vy IN (0, dy - 1) OR vz IN (0, dz - 1) AS face FROM g, LATERAL (SELECT unnest(range(dx)) AS vx), LATERAL (SELECT unnest(range(dy)) AS vy), LATERAL (SELECT unnest(range(dz)) AS vz) WHERE (vx, vy, vz) NOT IN (FROM {blocked}))"""


def _grown(name: str, source: str, x: int, y: int, z: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT vx + i AS vx, vy + j AS vy, vz + k AS vz FROM {source}, g, range({-x}, {x + 1}) a(i), range({-y}, {y + 1}) b(j), range({-z}, {z + 1}) c(k) WHERE vx + i BETWEEN 0 AND dx - 1 AND vy + j BETWEEN 0 AND dy - 1 AND vz + k BETWEEN 0 AND dz - 1)"""


_STEPS = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(i, j, k)"
_NAV = f"""{_grown("blocked", "solid", 1, 2, 1)}, {_space("free", "blocked")}, seed AS (SELECT CAST(floor((5.0 - x0) / 0.5) AS BIGINT) AS sx, CAST(floor((3.9 - y0) / 0.5) AS BIGINT) AS sy, CAST(floor((5.0 - z0) / 0.5) AS BIGINT) AS sz FROM g),
start AS (SELECT vx, vy, vz FROM free, seed WHERE greatest(abs(vx - sx), abs(vy - sy), abs(vz - sz)) <= 4 ORDER BY greatest(abs(vx - sx), abs(vy - sy), abs(vz - sz)), vy, vz, vx LIMIT 1),
walk(vx, vy, vz) AS (FROM start UNION SELECT f.vx, f.vy, f.vz FROM walk w, {_STEPS} JOIN free f ON f.vx = w.vx + i AND f.vy = w.vy + j AND f.vz = w.vz + k), {_grown("nav", "walk", 1, 2, 1)}"""
_FACES = f"(SELECT vx, vy, vz, i AS nx, j AS ny, k AS nz, vx + i AS ox, vy + j AS oy, vz + k AS oz FROM solid, {_STEPS})"
_TREAD = "tread AS (SELECT * FROM solid WHERE (vx, vy + 1, vz) IN (SELECT vx, vy, vz FROM nav))"


def order_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return L.chunked(L.z_ordered(cloud(spark, sf, numbered=True)), 500).select("splat_id", "code", "place", "chunk")


_T = {c: f"CAST(floor(least(greatest(({c} - m{c}) / (CASE WHEN x{c} > m{c} THEN x{c} - m{c} ELSE 1 END), 0), 1) * 2097151) AS BIGINT)" for c in "xyz"}
_CODE = " + ".join(f"((q{c} // {1 << i}) % 2) * {1 << (3 * i + k)}" for k, c in enumerate("xyz") for i in range(21))
ORDERED = f"""WITH s AS ({NUMBERED_SQL}), e AS (SELECT {", ".join(f"min({c}) AS m{c}, max({c}) AS x{c}" for c in "xyz")} FROM s), q AS (SELECT s.*, {", ".join(f"{v} AS q{c}" for c, v in _T.items())} FROM s, e),
k AS (SELECT *, CAST({_CODE} AS BIGINT) AS code FROM q), o AS (SELECT *, row_number() OVER (ORDER BY code, splat_id) - 1 AS place FROM k), c AS (SELECT *, CAST(place // 500 AS BIGINT) AS chunk FROM o)"""


def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    chunks = L.chunked(L.z_ordered(cloud(spark, sf, numbered=True)), 500)
    return L.levels(chunks, 3).groupBy("level", "chunk").agg(F.count("*").alias("rows"), F.sum("splat_id").alias("ids"))


def chunk_leaves(spark: SparkSession, sf: str) -> DataFrame:
    own = L.leaves(L.chunked(L.z_ordered(cloud(spark, sf, numbered=True)), 500), 3)
    return own.select("chunk", "rows", *r6(*(f"{n}_{c}" for n in ("min", "max") for c in "xyz")), *(F.col("lods")[str(i)].alias(f"level_{i}") for i in range(3)))


def lod_tree(spark: SparkSession, sf: str) -> DataFrame:
    own = L.leaves(L.chunked(L.z_ordered(cloud(spark, sf, numbered=True)), 500), 1)
    return L.lod_tree(own).select("node_id", "depth", "chunks", *r6(*(f"{n}_{c}" for n in ("min", "max") for c in "xyz")))


_BOXES = ", ".join(f"{n}({c}) AS {n}_{c}" for n in ("min", "max") for c in "xyz")
_BOX_NAMES = [f"{n}_{c}" for n in ("min", "max") for c in "xyz"]
TREE = ORDERED.replace("WITH s", "WITH RECURSIVE s", 1) + f""", l AS (SELECT chunk, {_BOXES} FROM c GROUP BY chunk),
n(node_id, depth, a, b) AS (SELECT CAST(1 AS BIGINT), 0, CAST(0 AS BIGINT), (SELECT count(*) FROM l) UNION ALL SELECT 2 * node_id + h, depth + 1, CASE h WHEN 0 THEN a ELSE a + (b - a) // 2 END, CASE h WHEN 0 THEN a + (b - a) // 2 ELSE b END FROM n, range(2) r(h) WHERE b > a + 1)
SELECT node_id, depth, count(*) AS chunks, {", ".join(f"round({n}({n}_{c}), 6) + 0.0 AS {n}_{c}" for n in ("min", "max") for c in "xyz")} FROM n JOIN l ON chunk >= a AND chunk < b GROUP BY node_id, depth"""


def extent_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of up to 20,000 rows that end where their box passes six metres."""
    chunks = L.chunked(L.z_ordered(cloud(spark, sf, numbered=True)), 20_000, 6.0)
    return chunks.groupBy("chunk").agg(F.count("*").alias("rows"), F.min("place").alias("start"), F.sum("splat_id").alias("ids"))


def strided(spark: SparkSession, sf: str) -> DataFrame:
    return L.strided(L.z_ordered(cloud(spark, sf, numbered=True)), "place", 700).select("splat_id", "place")


_SPANS = ", ".join(f"max({c}) OVER w - min({c}) OVER w" for c in "xyz")
#: The step from a chunk's start to the next, from the spans of all rows behind it.
EXTENTS = ORDERED.replace("WITH s", "WITH RECURSIVE s", 1).replace("o AS (", "o AS MATERIALIZED (", 1) + f""", n AS (SELECT count(*) AS n FROM o), st(p) AS (SELECT CAST(0 AS BIGINT)
  UNION ALL SELECT coalesce(min(place) FILTER (span > 6.0 AND place >= p + 8192), least(any_value(p) + 20000, any_value(n))) FROM (SELECT p, n, place, greatest({_SPANS}) AS span FROM st, n, o WHERE place >= p AND place < p + 20000 AND p + 1 <= n WINDOW w AS (ORDER BY place)) GROUP BY p),
t AS (SELECT p AS start, row_number() OVER (ORDER BY p) - 1 AS chunk, coalesce(lead(p) OVER (ORDER BY p), (SELECT n FROM n)) AS stop FROM st WHERE p < (SELECT n FROM n))
SELECT chunk, count(*) AS rows, start, CAST(sum(splat_id) AS BIGINT) AS ids FROM t JOIN o ON place >= start AND place < stop GROUP BY chunk, start"""


def quantized_means(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quantized_means(points(spark, sf)).select("splat_id", *(f"{c}_{h}" for c in "xyz" for h in ("low", "high")))


_L = {c: f"(sign({c}) * ln(1 + abs({c})))" for c in "xyz"}
MEANS = f"""WITH p AS ({POINTS_SQL}), e AS (SELECT {", ".join(f"min({v}) AS m{c}, max({v}) AS x{c}" for c, v in _L.items())} FROM p),
q AS (SELECT splat_id, {", ".join(f"CAST(round(least(greatest(({v} - m{c}) / (x{c} - m{c}), 0), 1) * 65535.0) AS INTEGER) AS {c}" for c, v in _L.items())} FROM p, e)
SELECT splat_id, {", ".join(f"{c} % 256 AS {c}_low, {c} // 256 AS {c}_high" for c in "xyz")} FROM q"""


def codebook(spark: SparkSession, sf: str) -> DataFrame:
    values = points(spark, sf).select(F.explode(F.array("x", "y", "z")).alias("v"))
    book = Q.codebook(values)
    return spark.createDataFrame(list(enumerate(book)), "entry int, value double").select("entry", *r6("value"))


_BOOK = f"""WITH p AS ({POINTS_SQL}), v AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT unnest([x, y, z]) AS v FROM p)), n AS (SELECT count(*) AS n FROM v),
m AS (SELECT e, avg(v) AS value FROM range(256) r(e), n, v WHERE i >= e * n // 256 AND i < least(greatest((e + 1) * n // 256, e * n // 256 + 1), n) GROUP BY e), b AS (SELECT CAST(e AS INTEGER) AS entry, max(value) OVER (ORDER BY e) AS value FROM m)"""


def codebook_places(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf)
    book = Q.codebook(rows.select(F.explode(F.array("x", "y", "z")).alias("v")))
    return rows.select("splat_id", *(Q.nearest_entry(F.col(c), book).alias(f"{c}_entry") for c in "xyz"))


_PLACE = "(SELECT arg_min(entry, [abs(value - {c}), entry]) FROM b)"


def palette(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = Q.kmeans(points(spark, sf).select("splat_id", F.array("x", "y", "z").alias("v")), "splat_id", 8, 4)
    return rows.select("splat_id", "label")


def _lloyd(rounds: int, k: int) -> str:
    near = "SELECT p.splat_id, x, y, z, arg_min(c, [pow(cx - x, 2) + pow(cy - y, 2) + pow(cz - z, 2), c]) AS c FROM p, c{r} GROUP BY ALL"
    out = f"WITH p AS ({POINTS_SQL}), i AS (SELECT *, row_number() OVER (ORDER BY splat_id) - 1 AS i, count(*) OVER () AS n FROM p), c0 AS (SELECT c, x AS cx, y AS cy, z AS cz FROM range({k}) r(c) JOIN i ON i = c * n // {k})"
    for r in range(rounds):
        own = near.format(r=r).replace(" GROUP BY ALL", " GROUP BY p.splat_id, x, y, z")
        out += f", a{r} AS ({own}), c{r + 1} AS (SELECT c{r}.c, coalesce(avg(x), any_value(cx)) AS cx, coalesce(avg(y), any_value(cy)) AS cy, coalesce(avg(z), any_value(cz)) AS cz FROM c{r} LEFT JOIN a{r} ON a{r}.c = c{r}.c GROUP BY c{r}.c)"
    own = near.format(r=rounds).replace(" GROUP BY ALL", " GROUP BY p.splat_id, x, y, z")
    return f"{out}, a{rounds} AS ({own}) SELECT splat_id, CAST(c AS INTEGER) AS label FROM a{rounds}"


def ply_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Splats written as PLY files, read back as navigation points."""
    rows = cloud(spark, sf)
    same = lambda v, n: F.array(*([v] * n))
    f = lambda c: F.col(c).cast("float").alias(c)
    full = rows.select(f("x"), f("y"), f("z"), same(F.col("scale").cast("float"), 3).alias("scale"), F.array(*(F.lit(v).cast("float") for v in (1.0, 0.0, 0.0, 0.0))).alias("rot"), f("opacity"), same(F.lit(0.0).cast("float"), 3).alias("f_dc"), F.array().cast("array<float>").alias("f_rest"))
    back = A.read_splats(spark, A.write_ply(full))
    return back.groupBy(*r6("opacity", "sx")).agg(F.count("*").alias("splats"), F.round(F.min("y"), 5).alias("min_y"), F.round(F.max("z"), 5).alias("max_z"), F.round(F.sum("nz"), 6).alias("normals"))


PLY = f"""WITH s AS (SELECT CAST(x AS FLOAT) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z, CAST(CAST(opacity AS FLOAT) AS DOUBLE) AS opacity, CAST(CAST(scale AS FLOAT) AS DOUBLE) AS sx FROM ({CLOUD_SQL})), r AS (SELECT y, z, {sql6("opacity", "sx")} FROM s)
SELECT opacity, sx, count(*) AS splats, round(min(y), 5) AS min_y, round(max(z), 5) AS max_z, CAST(count(*) AS DOUBLE) AS normals FROM r GROUP BY opacity, sx"""

QUERIES = {
    "voxel_densities": densities, "solid_bounds": solid_bounds, "dilated_solid": dilated, "floor_filled": floor_filled, "exterior_fill": exterior_fill, "carved_space": carved, "walkable_floors": walkable,
    "shell_faces": shell, "exterior_faces": exterior, "floor_ramps": ramps, "solid_mask": mask, "unpacked_mask": unmasked, "ground_below": ground, "capsule_states": capsules, "coarse_clusters": clusters,
    "z_order_chunks": order_chunks, "chunk_levels": level_counts, "chunk_leaves": chunk_leaves, "lod_tree": lod_tree, "extent_chunks": extent_chunks, "strided_sample": strided,
    "quantized_means": quantized_means, "codebook": codebook, "codebook_places": codebook_places, "palette_labels": palette, "ply_round_trip": ply_round_trip,
}
SQL = {
    "voxel_densities": f"{BOX} SELECT vx, vy, vz, {sql6('density')} FROM dens",
    "solid_bounds": f"{BOX} SELECT count(*) AS voxels, " + ", ".join(f"{n}({v}) AS {n}_{v}" for n in ("min", "max") for v in V.AXES) + " FROM solid",
    "dilated_solid": f"{BOX}, {_grown('wide', 'solid', 1, 2, 1)} FROM wide",
    "floor_filled": f"""{BOX}, cols AS (SELECT DISTINCT vx, vz FROM solid), near AS (SELECT vx + i AS vx, vz + k AS vz, count(*) AS n FROM cols, range(-4, 5) a(i), range(-4, 5) b(k) GROUP BY ALL),
ok AS (SELECT vx, vz FROM near, g WHERE vx BETWEEN 0 AND dx - 1 AND vz BETWEEN 0 AND dz - 1 AND near.n / ((least(vx + 4, dx - 1) - greatest(vx - 4, 0) + 1) * (least(vz + 4, dz - 1) - greatest(vz - 4, 0) + 1)) >= 0.35),
low AS (SELECT vx, vz, min(vy) AS top FROM solid GROUP BY vx, vz) SELECT vx, vy, vz FROM solid UNION ALL SELECT vx, unnest(range(top)) AS vy, vz FROM low JOIN ok USING (vx, vz)""",
    "exterior_fill": f"""{BOX}, {_grown("wide", "solid", 1, 1, 1)}, {_space("free", "wide")}, outer_(vx, vy, vz) AS (SELECT vx, vy, vz FROM free WHERE face UNION SELECT f.vx, f.vy, f.vz FROM outer_ w, {_STEPS} JOIN free f ON f.vx = w.vx + i AND f.vy = w.vy + j AND f.vz = w.vz + k)
SELECT vx, vy, vz, false AS leaked FROM (FROM wide UNION FROM outer_)""",
    "carved_space": f"{BOX}, {_NAV} FROM nav",
    "walkable_floors": f"{BOX}, {_NAV}, {_TREAD} SELECT vx, vy, vz, round(y0 + (vy + 1) * 0.5, 6) AS top_y FROM tread, g",
    "shell_faces": f"{BOX}, {_NAV} SELECT * FROM {_FACES} WHERE (ox, oy, oz) IN (FROM nav) AND (ox, oy, oz) NOT IN (FROM solid)",
    "exterior_faces": f"{BOX} SELECT * FROM {_FACES} WHERE (ox, oy, oz) NOT IN (FROM solid)",
    "floor_ramps": f"""{BOX}, {_NAV}, {_TREAD}, {TERRAIN_SQL.replace("solid AS", "ground AS").replace("nav AS", "above AS")}, step AS (SELECT * FROM ground WHERE (vx, vy + 1, vz) IN (SELECT vx, vy, vz FROM above))
SELECT t.vx, t.vy, t.vz, o.vx AS ox, o.vy AS oy, o.vz AS oz, 'volume' AS "over" FROM tread t JOIN tread o ON abs(t.vy - o.vy) = 1 AND ((o.vx = t.vx + 1 AND o.vz = t.vz) OR (o.vx = t.vx AND o.vz = t.vz + 1))
UNION ALL SELECT t.vx, t.vy, t.vz, o.vx AS ox, o.vy AS oy, o.vz AS oz, 'terrain' FROM step t CROSS JOIN (VALUES (1, 0), (0, 1)) r(i, k) JOIN step o ON o.vx = t.vx + i AND o.vz = t.vz + k AND abs(t.vy - o.vy) BETWEEN 1 AND 2""",
    "solid_mask": f"{BOX} SELECT ((vy * dz + vz) * dx + vx) // 8 AS byte_index, CAST(sum(pow(2, ((vy * dz + vz) * dx + vx) % 8)) AS INTEGER) AS byte FROM solid, g GROUP BY 1",
    "unpacked_mask": f"{BOX} FROM solid",
    "ground_below": f"""{BOX}, q AS (SELECT o_orderkey AS point_id, (o_orderkey % 41) / 4.0 AS x, (o_custkey % 43) / 4.0 AS z FROM orders),
r AS (SELECT point_id, max(y0 + (vy + 1) * 0.5) AS ground FROM q, g JOIN solid ON vx = floor((x - x0) / 0.5) AND vz = floor((z - z0) / 0.5) AND vy <= floor((3.5 - y0) / 0.5) AND 3.5 - (y0 + (vy + 1) * 0.5) <= 4 GROUP BY point_id) SELECT point_id, {sql6('ground')} FROM q LEFT JOIN r USING (point_id)""",
    "capsule_states": f"""{BOX}, q AS (SELECT o_orderkey AS point_id, CAST(floor(((o_orderkey % 53) / 4.0 - 1.0 - x0) / 0.5) AS BIGINT) AS px, CAST(floor(((o_orderkey % 17) / 4.0 - y0) / 0.5) AS BIGINT) AS py, CAST(floor(((o_custkey % 43) / 4.0 - z0) / 0.5) AS BIGINT) AS pz FROM orders, g),
h AS (SELECT point_id, bool_or(vx = px AND vy = py AND vz = pz) AS own FROM q JOIN solid ON abs(vx - px) <= 1 AND abs(vz - pz) <= 1 AND vy BETWEEN py AND py + 4 AND 0.25 * (pow(vx - px, 2) + pow(vz - pz, 2)) <= pow(0.45, 2) GROUP BY point_id)
SELECT point_id, CASE WHEN NOT (px BETWEEN 0 AND dx - 1 AND py BETWEEN 0 AND dy - 1 AND pz BETWEEN 0 AND dz - 1) THEN 'outside_grid' WHEN own THEN 'inside_solid' WHEN own IS NOT NULL THEN 'capsule_blocked' ELSE 'capsule_fits' END AS state FROM q CROSS JOIN g LEFT JOIN h USING (point_id)""",
    "coarse_clusters": f"""WITH RECURSIVE s AS (SELECT * REPLACE (CASE WHEN x > 5 THEN x + 4.0 ELSE x END AS x) FROM ({CLOUD_SQL}) WHERE opacity >= 0.1), g AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM s), p AS (SELECT x, CAST(floor(x - x0) AS BIGINT) AS vx, CAST(floor(y - y0) AS BIGINT) AS vy, CAST(floor(z - z0) AS BIGINT) AS vz FROM s, g),
o AS (SELECT DISTINCT vx, vy, vz FROM p), t AS (SELECT vx, vy, vz FROM o, g ORDER BY greatest(abs(vx - floor(1 - x0)), abs(vy - floor(0.5 - y0)), abs(vz - floor(1 - z0))), vy, vz, vx LIMIT 1),
w(vx, vy, vz) AS (FROM t UNION SELECT f.vx, f.vy, f.vz FROM w, {_STEPS} JOIN o f ON f.vx = w.vx + i AND f.vy = w.vy + j AND f.vz = w.vz + k) SELECT CAST(floor(x) AS BIGINT) AS x, count(*) AS splats FROM p WHERE (vx, vy, vz) IN (FROM w) GROUP BY 1""",
    "z_order_chunks": f"{ORDERED} SELECT splat_id, code, place, chunk FROM c",
    "chunk_levels": f"{ORDERED} SELECT CAST(l AS INTEGER) AS level, chunk, count(*) AS rows, CAST(sum(splat_id) AS BIGINT) AS ids FROM c, range(3) r(l) WHERE (place - chunk * 500) % CAST(pow(2, l) AS BIGINT) = 0 GROUP BY l, chunk",
    "chunk_leaves": f"{ORDERED}, l AS (SELECT chunk, count(*) AS rows, {_BOXES} FROM c GROUP BY chunk) SELECT chunk, rows, {sql6(*_BOX_NAMES)}, rows AS level_0, CAST(ceil(rows / 2) AS BIGINT) AS level_1, CAST(ceil(rows / 4) AS BIGINT) AS level_2 FROM l",
    "lod_tree": TREE,
    "extent_chunks": EXTENTS,
    "strided_sample": f"{ORDERED} SELECT splat_id, place FROM c WHERE place IN (SELECT i * (SELECT count(*) FROM c) // 700 FROM range(700) r(i))",
    "quantized_means": MEANS,
    "codebook": f"{_BOOK} SELECT entry, {sql6('value')} FROM b",
    "codebook_places": f"{_BOOK} SELECT splat_id, " + ", ".join(f"{_PLACE.format(c=c)} AS {c}_entry" for c in "xyz") + " FROM p",
    "palette_labels": _lloyd(4, 8),
    "ply_round_trip": PLY,
}
