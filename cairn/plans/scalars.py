"""Queries of single rows: orientation, output spaces, codes, boxes, budgets, paths."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import paths as P
from cairn.operators import cloud as C
from cairn.sources.tables import CLOUD_SQL, POINTS_SQL, cloud, points, table

TURN = (0.1, -0.2, 0.3)
REGION = C.CloudSettings(rotation=TURN, environment_scale=1.5, min_alpha=0.1, max_scale=0.09, region_min=(0.0, -2.0, 0.0), region_max=(12.0, 4.0, 12.0))


def r6(*columns: str):
    """Rounded to six places; adding zero makes a negative zero positive."""
    return [(F.round(c, 6) + 0.0).alias(c) for c in columns]


def sql6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def matrix_sql(m, names=("x", "y", "z")) -> list[str]:
    return [" + ".join(f"({v!r}) * {n}" for v, n in zip(row, names, strict=True) if v) or "0.0" for row in m]


def oriented(spark: SparkSession, sf: str) -> DataFrame:
    return C.kept(C.oriented(cloud(spark, sf), REGION), REGION).select(*r6("x", "y", "z", "scale", "opacity"))


_R = matrix_sql(G.rotation(*TURN))
ORIENTED = f"""WITH s AS ({CLOUD_SQL}), o AS (SELECT ({_R[0]}) * 1.5 AS x, ({_R[1]}) * 1.5 AS y, ({_R[2]}) * 1.5 AS z, scale * 1.5 AS scale, opacity FROM s)
SELECT {sql6("x", "y", "z", "scale", "opacity")} FROM o WHERE x BETWEEN 0 AND 12 AND y BETWEEN -2 AND 4 AND z BETWEEN 0 AND 12 AND opacity > 0.1 AND scale < 0.09 * 1.5"""

SPACES = [(u, h, w) for u in ("y", "z") for h in ("right", "left") for w in ("auto", "cw", "ccw")]


def output_spaces(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf)
    made = []
    for u, h, w in SPACES:
        m, flip = G.output_space(u, h, w)
        made.append(F.struct(F.lit(f"{u}/{h}/{w}").alias("space"), *(c.alias(n) for c, n in zip(G.transformed(m, *(F.col(c) for c in "xyz")), "xyz", strict=True)), F.lit(flip).alias("flip")))
    return rows.select("splat_id", F.explode(F.array(*made)).alias("s")).select("splat_id", "s.*").select("splat_id", "space", "flip", *r6("x", "y", "z"))


OUTPUT_SPACES = f"""WITH p AS ({POINTS_SQL}), k AS (SELECT u, h, w, CASE w WHEN 'cw' THEN true WHEN 'ccw' THEN false ELSE h = 'left' END AS flip
  FROM (VALUES ('y'), ('z')) a(u), (VALUES ('right'), ('left')) b(h), (VALUES ('auto'), ('cw'), ('ccw')) c(w)),
t AS (SELECT splat_id, u || '/' || h || '/' || w AS space, flip, x, CASE u WHEN 'z' THEN -z ELSE y END AS y, (CASE u WHEN 'z' THEN y ELSE z END) * CASE h WHEN 'left' THEN -1 ELSE 1 END AS z FROM p, k)
SELECT splat_id, space, flip, {sql6("x", "y", "z")} FROM t"""


def codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 2**20).alias("a"), (F.col("l_partkey") % 2**20).alias("b"), (F.col("l_suppkey") % 2**20).alias("c"))
    return rows.select("a", "b", "c", G.morton(*(F.col(c) for c in "abc"), 20).alias("code")).distinct()


_BITS = " + ".join(f"((({c} // {1 << i}) % 2) * {1 << (3 * i + k)})" for k, c in enumerate("abc") for i in range(20))
CODES = f"SELECT DISTINCT a, b, c, CAST({_BITS} AS BIGINT) AS code FROM (SELECT l_orderkey % 1048576 AS a, l_partkey % 1048576 AS b, l_suppkey % 1048576 AS c FROM lineitem)"


def quaternions(spark: SparkSession, sf: str) -> DataFrame:
    axis = lambda i: F.get("embedding", F.lit(i)).cast("double")
    kept, mode = G.packed_quaternion(axis(0), axis(1), axis(2), axis(3))
    return table(spark, sf, "embeddings").select("vec_id", kept.alias("k"), mode.alias("mode")).select("vec_id", F.get("k", F.lit(0)).alias("b0"), F.get("k", F.lit(1)).alias("b1"), F.get("k", F.lit(2)).alias("b2"), "mode")


_K = ", ".join(f"CAST(least(greatest(round((k[{i + 1}] * g * {math.sqrt(2)!r} / 2.0 + 0.5) * 255.0), 0), 255) AS INTEGER) AS b{i}" for i in range(3))
QUATERNIONS = f"""WITH e AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN [2, 3, 4, 1]] AS v FROM embeddings),
n AS (SELECT vec_id, [x / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + v[4] * v[4]) FOR x IN v] AS q FROM e),
m AS (SELECT *, list_position([abs(x) FOR x IN q], list_max([abs(x) FOR x IN q])) AS j FROM n),
s AS (SELECT vec_id, j, CASE WHEN q[j] < 0 THEN -1.0 ELSE 1.0 END AS g, [q[i] FOR i IN [1, 2, 3, 4] IF i <> j] AS k FROM m)
SELECT vec_id, {_K}, CAST(251 + j AS INTEGER) AS mode FROM s"""


def codec_scalars(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("v"), (F.col("c_custkey") % 60).alias("n"))
    logit = F.log((F.col("n") + 1) / (61.0 - (F.col("n") + 1) + 1.0))
    return rows.select("c_custkey", G.sym_log(F.col("v")).alias("sym_log"), G.sigmoid(F.col("v")).alias("sigmoid"), logit.alias("logit"), G.sh_coefficients(F.col("n") % 5).alias("coefficients"), G.sh_degree(F.col("n")).alias("degree")).select("c_custkey", *r6("sym_log", "sigmoid", "logit"), "coefficients", "degree")


CODEC_SCALARS = f"""WITH r AS (SELECT c_custkey, c_acctbal / 1000.0 AS v, c_custkey % 60 AS n FROM customer),
t AS (SELECT c_custkey, sign(v) * ln(1 + abs(v)) AS sym_log, 1 / (1 + exp(-v)) AS sigmoid, ln((n + 1) / (61.0 - n)) AS logit, CASE n % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 8 ELSE 15 END AS coefficients,
  CASE n // 3 WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 8 THEN 2 ELSE 3 END AS degree FROM r) SELECT c_custkey, {sql6("sym_log", "sigmoid", "logit")}, coefficients, degree FROM t"""


def voxel_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = cloud(spark, sf).select(*(G.voxel(F.col(c), 0.0, 0.25).alias(f"v{c}") for c in "xyz"))
    index = (F.col("vy") * 64 + F.col("vz")) * 64 + F.col("vx")  # the stand-in is less than 16 m wide
    return rows.groupBy("vx", "vy", "vz").agg(F.count("*").alias("splats")).select("vx", "vy", "vz", "splats", index.alias("index"), ((F.col("vx") + 0.5) * 0.25).alias("centre_x"), ((F.col("vy") + 1) * 0.25).alias("top_y"), (F.floor(index / 4096) == F.col("vy")).alias("back"))


VOXEL_NUMBERS = f"""WITH s AS ({CLOUD_SQL}), v AS (SELECT CAST(floor(x / 0.25) AS BIGINT) AS vx, CAST(floor(y / 0.25) AS BIGINT) AS vy, CAST(floor(z / 0.25) AS BIGINT) AS vz FROM s)
SELECT vx, vy, vz, count(*) AS splats, (vy * 64 + vz) * 64 + vx AS index, CAST((vx + 0.5) * 0.25 AS DOUBLE) AS centre_x, CAST((vy + 1) * 0.25 AS DOUBLE) AS top_y, true AS back FROM v GROUP BY vx, vy, vz"""


def _orders(spark, sf):
    """Boxes made of orders: a corner and three spans."""
    return table(spark, sf, "orders").select("o_orderkey", *((F.pmod(F.col("o_custkey") * k, F.lit(97)) / 4.0).alias(f"low_{c}") for c, k in zip("xyz", (3, 5, 7), strict=True)), *((F.pmod(F.col("o_orderkey") * k, F.lit(n)) / 4.0).alias(f"span_{c}") for c, k, n in zip("xyz", (11, 13, 17), (241, 23, 353), strict=True)))


ORDER_BOXES = "SELECT o_orderkey, " + ", ".join(f"(o_custkey * {k} % 97) / 4.0 AS low_{c}" for c, k in zip("xyz", (3, 5, 7), strict=True)) + ", " + ", ".join(f"(o_orderkey * {k} % {n}) / 4.0 AS span_{c}" for c, k, n in zip("xyz", (11, 13, 17), (241, 23, 353), strict=True)) + " FROM orders"


def grid_budgets(spark: SparkSession, sf: str) -> DataFrame:
    low = {c: F.col(f"low_{c}") for c in "xyz"}
    high = {c: F.col(f"low_{c}") + F.col(f"span_{c}") for c in "xyz"}
    voxels = lambda a, b: P.grid_voxels([a[c] for c in "xyz"], [b[c] for c in "xyz"], F.lit(0.5))
    cut = {c: P.clamped(low[c], high[c], 40.0) if c != "y" else (low[c], high[c]) for c in "xyz"}
    narrow = {c: P.clamped(*cut[c], 25.0) if c != "y" else cut[c] for c in "xyz"}
    rows = _orders(spark, sf).select("o_orderkey", voxels(low, high).alias("voxels"), voxels(*({c: cut[c][i] for c in "xyz"} for i in (0, 1))).alias("cut_voxels"), *(cut[c][i].alias(f"cut_{n}_{c}") for c in "xz" for i, n in enumerate(("min", "max"))), *(narrow[c][i].alias(f"narrow_{n}_{c}") for c in "xz" for i, n in enumerate(("min", "max"))))
    fits = F.col("cut_voxels") <= 200_000
    sides = [F.when(fits, F.col(f"cut_{n}_{c}")).otherwise(F.col(f"narrow_{n}_{c}")).alias(f"{n}_{c}") for c in "xz" for n in ("min", "max")]
    return rows.select("o_orderkey", "voxels", (F.col("voxels") <= 200_000).alias("fits"), fits.alias("fits_cut"), *sides).select("o_orderkey", "voxels", "fits", "fits_cut", *r6("min_x", "max_x", "min_z", "max_z"))


def _voxels_sql(spans: list[str]) -> str:
    return " * ".join(f"(greatest(ceil(({s} + 2 * 2.5) / 0.5), 1) + 1)" for s in spans)


GRID_BUDGETS = f"""WITH b AS ({ORDER_BOXES}), v AS (SELECT *, CAST({_voxels_sql(["span_x", "span_y", "span_z"])} AS BIGINT) AS voxels, CAST({_voxels_sql(["least(span_x, 40.0)", "span_y", "least(span_z, 40.0)"])} AS BIGINT) AS cut_voxels FROM b),
w AS (SELECT *, cut_voxels <= 200000 AS fits_cut, CASE WHEN cut_voxels <= 200000 THEN 40.0 ELSE 25.0 END AS most FROM v),
t AS (SELECT o_orderkey, voxels, voxels <= 200000 AS fits, fits_cut, """ + ", ".join(f"CASE WHEN span_{c} > most THEN low_{c} + span_{c} * 0.5 {s} most * 0.5 ELSE low_{c} {e} END AS {n}_{c}" for c in "xz" for n, s, e in (("min", "-", ""), ("max", "+", f"+ span_{c}"))) + f""" FROM w)
SELECT o_orderkey, voxels, fits, fits_cut, {sql6("min_x", "max_x", "min_z", "max_z")} FROM t"""


def regions(spark: SparkSession, sf: str) -> DataFrame:
    box = P.volume({c: F.col(f"low_{c}") for c in "xyz"}, {c: F.col(f"low_{c}") + F.col(f"span_{c}") for c in "xyz"})
    tall = P.stairs(box)
    yaw = F.col("o_orderkey") % 7
    seen = P.camera_box(F.col("low_x"), F.col("low_y"), F.col("low_z"), yaw, 2.0, 3.0, 1.0, 6.0, 2.0, 2.5)
    rows = _orders(spark, sf).select("o_orderkey", *(tall[f"{n}_{c}"].alias(f"{n}_{c}") for n in ("min", "max") for c in "xyz"), *(seen[f"{n}_{c}"].alias(f"camera_{n}_{c}") for n in ("min", "max") for c in "xyz"), F.greatest("span_x", "span_z").alias("footprint"))
    return rows.select("o_orderkey", *r6(*rows.columns[1:]))


_NAMES = [f"{n}_{c}" for n in ("min", "max") for c in "xyz"]
_CX = [f"low_x + cos(w) * ({a}) + sin(w) * ({b})" for a in (-2, 3) for b in (-1, 6)]
_CZ = [f"low_z - sin(w) * ({a}) + cos(w) * ({b})" for a in (-2, 3) for b in (-1, 6)]
REGIONS = f"""WITH b AS (SELECT *, CAST(o_orderkey % 7 AS DOUBLE) AS w FROM ({ORDER_BOXES})), t AS (SELECT o_orderkey,
  low_x + span_x * 0.5 - greatest(span_x, 0.5) * 0.5 AS min_x, low_y - 1.0 AS min_y, low_z + span_z * 0.5 - greatest(span_z, 0.5) * 0.5 AS min_z,
  low_x + span_x * 0.5 + greatest(span_x, 0.5) * 0.5 AS max_x, greatest(low_y + greatest(span_y, 2.0), low_y + 5.6) AS max_y, low_z + span_z * 0.5 + greatest(span_z, 0.5) * 0.5 AS max_z,
  least({", ".join(_CX)}) AS camera_min_x, low_y - 2.0 AS camera_min_y, least({", ".join(_CZ)}) AS camera_min_z, greatest({", ".join(_CX)}) AS camera_max_x, low_y + 2.5 AS camera_max_y, greatest({", ".join(_CZ)}) AS camera_max_z, greatest(span_x, span_z) AS footprint FROM b)
SELECT o_orderkey, {sql6(*_NAMES, *(f"camera_{n}" for n in _NAMES), "footprint")} FROM t"""


def turned_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of the eight corners of boxes, turned: corners as rows, sides as grouped extremes."""
    corner = F.explode(F.array(*(F.struct(*(F.lit(float(i >> k & 1)).alias(c) for k, c in enumerate("xyz"))) for i in range(8)))).alias("k")
    at = [F.col(f"low_{c}") + F.col(f"span_{c}") * F.col(f"k.{c}") for c in "xyz"]
    rows = _orders(spark, sf).select("*", corner).select("o_orderkey", *(v.alias(c) for v, c in zip(G.transformed(G.rotation(*TURN), *at), "xyz", strict=True)))
    return rows.groupBy("o_orderkey").agg(*(F.round(f(c), 6).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"))


TURNED_BOXES = f"""WITH b AS ({ORDER_BOXES}), k AS (SELECT o_orderkey, low_x + span_x * (i % 2) AS x, low_y + span_y * (i // 2 % 2) AS y, low_z + span_z * (i // 4) AS z FROM b, range(8) r(i)),
t AS (SELECT o_orderkey, {_R[0]} AS x, {_R[1]} AS y, {_R[2]} AS z FROM k)
SELECT o_orderkey, {", ".join(f"round({n}({c}), 6) AS {n}_{c}" for n in ("min", "max") for c in "xyz")} FROM t GROUP BY o_orderkey"""


def chunk_paths(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("", F.when(F.col("p_partkey") % 3 == 0, "./").when(F.col("p_partkey") % 3 == 1, "x/../").otherwise(""), (F.col("p_partkey") % 5).cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 11 == 0, "a").otherwise(""), F.lit("/meta.json"))
    wanted = F.element_at(F.array(*(F.lit(v) for v in ("coarsest", "finest", "nav", "2", "9"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    url = F.concat(F.lit("https://host/scenes/"), F.col("p_name"), F.lit("/lod-meta.json?v="), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", P.normalized(name).alias("path"), P.lod_index(name).alias("level"), P.resolved_lod(wanted, F.col("p_size") % 6).alias("resolved"), P.directory_url(url).alias("directory"))


CHUNK_PATHS = """WITH n AS (SELECT p_partkey, p_name, p_size, (p_partkey % 5) || '_' || p_size || CASE WHEN p_partkey % 11 = 0 THEN 'a' ELSE '' END || '/meta.json' AS path, greatest(p_size % 6 - 1, 0) AS last FROM part)
SELECT p_partkey, path, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 5 AS INTEGER) END AS level,
  CAST(CASE p_partkey % 5 WHEN 0 THEN last WHEN 1 THEN 0 WHEN 2 THEN last // 2 WHEN 3 THEN CASE WHEN 2 <= last THEN 2 END END AS INTEGER) AS resolved, 'https://host/scenes/' || p_name || '/' AS directory FROM n"""


def agents(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_suppkey")
    area = (n % 50) * 400.0
    return table(spark, sf, "supplier").select("s_suppkey", *P.recast_cells(0.5 + (n % 20) * 0.13, (n % 9) * 0.11, (n % 13) * 0.07), P.cell_size(area, F.lit(1e4), 0.5).alias("cell"), P.cache_budget(F.pow(F.lit(2.0), n % 8) * 2**28).alias("cache")).select("s_suppkey", "walkable_height", "walkable_climb", "walkable_radius", *r6("padding", "cell"), "cache")


AGENTS = """WITH s AS (SELECT s_suppkey, CAST(0.5 AS DOUBLE) + (s_suppkey % 20) * CAST(0.13 AS DOUBLE) AS h, (s_suppkey % 9) * CAST(0.11 AS DOUBLE) AS r, (s_suppkey % 13) * CAST(0.07 AS DOUBLE) AS c, (s_suppkey % 50) * CAST(400 AS DOUBLE) AS area FROM supplier)
SELECT s_suppkey, CAST(greatest(ceil(h / CAST(0.1 AS DOUBLE)), 1) AS BIGINT) AS walkable_height, CAST(greatest(floor(c / CAST(0.1 AS DOUBLE)), 0) AS BIGINT) AS walkable_climb, CAST(greatest(ceil(r / CAST(0.12 AS DOUBLE)), 0) AS BIGINT) AS walkable_radius,
  round(h + 0.5, 6) AS padding, round(least(greatest(CASE WHEN area > 0 THEN sqrt(area / 1e4) ELSE 0.5::DOUBLE / 3 END, 0.5::DOUBLE / 3), 0.25), 6) AS cell,
  CAST(least(greatest(round(pow(2.0, s_suppkey % 8) * 268435456 / 8), 52428800), 524288000) AS BIGINT) AS cache FROM s"""

QUERIES = {"oriented_filter": oriented, "output_spaces": output_spaces, "z_order_codes": codes, "packed_quaternions": quaternions, "codec_scalars": codec_scalars, "voxel_numbers": voxel_numbers, "grid_budgets": grid_budgets, "region_boxes": regions, "turned_boxes": turned_boxes, "chunk_paths": chunk_paths, "agent_cells": agents}
SQL = {"oriented_filter": ORIENTED, "output_spaces": OUTPUT_SPACES, "z_order_codes": CODES, "packed_quaternions": QUATERNIONS, "codec_scalars": CODEC_SCALARS, "voxel_numbers": VOXEL_NUMBERS, "grid_budgets": GRID_BUDGETS, "region_boxes": REGIONS, "turned_boxes": TURNED_BOXES, "chunk_paths": CHUNK_PATHS, "agent_cells": AGENTS}
