"""Queries of chunk files and of what is read of a bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import bundles as B
from cairn.operators import manifests as N
from cairn.operators import slicing as L
from cairn.plans.scalars import r6, sql6
from cairn.plans.volumes import _BOXES, ORDERED
from cairn.sources import sog
from cairn.sources.tables import cloud, staged, table

TARGET, LEVELS = 500, 3


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return staged(L.chunked(L.z_ordered(cloud(spark, sf, numbered=True)), TARGET), "chunks")


def _full(chunks: DataFrame, count: int) -> DataFrame:
    """Rows of levels with the properties of full splats, made of those that the stand-in has."""
    log = F.log("scale")
    own = {
        "scale": F.array(log, log - F.col("opacity"), log * 0.5), "rot": F.array(F.col("ny") - 0.5, F.col("x") - 5.0, F.col("z") - 5.0, F.col("y") - 1.0), "opacity": F.col("opacity") * 8.0 - 2.0,
        "f_dc": F.array(F.sqrt(F.col("z") + 1.0), F.sqrt(F.col("x") + 1.0), F.log(F.col("y") + 2.0)), "f_rest": F.array().cast("array<double>"),
    }
    return L.levels(chunks, count).select("level", "chunk", "place", "splat_id", *"xyz", *(c.alias(n) for n, c in own.items()))


def sog_files(spark: SparkSession, sf: str) -> DataFrame:
    files = staged(sog.encoded(_full(_chunks(spark, sf), LEVELS)), "files")
    planes = files.filter(~F.col("path").endswith(".json")).groupBy("level", "chunk").agg(F.count("*").alias("planes"), F.sum(F.octet_length("bytes")).cast("bigint").alias("plane_bytes"))
    return sog.index(files).join(planes, ["level", "chunk"])


def sog_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All levels written as planes and read back."""
    rows = _full(_chunks(spark, sf), 2)
    back = sog.decoded(sog.encoded(rows))
    each = {f"{n}_{i}": F.get(n, F.lit(i)) for n, k in (("scale", 3), ("rot", 4), ("f_dc", 3)) for i in range(k)}
    return back.select("level", "chunk", "ordinal", *"xyz", "opacity", *(c.alias(n) for n, c in each.items())).select("level", "chunk", "ordinal", *r6(*"xyz", "opacity", *each))


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    low = {"x": k % 11 * 0.9, "y": k % 5 * 0.6, "z": k % 13 * 0.8}
    size = {"x": k % 3 * 1.0, "y": k % 4 * 0.3, "z": k % 7 * 0.5}
    return table(spark, sf, "customer").select(k.alias("region_id"), *(v.alias(f"min_{c}") for c, v in low.items()), *((low[c] + v).alias(f"max_{c}") for c, v in size.items()))


def region_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return B.chunks_of_regions(_regions(spark, sf), staged(L.lod_tree(L.leaves(_chunks(spark, sf), 1)), "tree"))


def _counts(chunks: DataFrame) -> DataFrame:
    return L.levels(chunks, LEVELS).groupBy("level", "chunk").agg(F.count("*").alias("rows"))


def chunk_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """For all levels, a budget of two thirds of the finest's rows."""
    chunks = _chunks(spark, sf)
    return B.budgets(_counts(chunks), chunks.count() * 2 // 3)


def nav_source(spark: SparkSession, sf: str) -> DataFrame:
    """The rows to read from the coarsest level on that has a third of the rows, spread over half of them."""
    chunks = _chunks(spark, sf)
    n = chunks.count()
    return B.taken(chunks, LEVELS, B.refined(_counts(chunks), "coarsest", n // 3, n // 2)).select("level", "chunk", "ordinal", "splat_id")


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf)
    files = staged(sog.index(sog.encoded(_full(chunks, LEVELS))), "index")
    return staged(N.written(L.leaves(chunks, 1), files).select(F.lit("all").alias("name"), "text"), "manifest")


def manifest_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """The leaves of the manifest of all chunk files, as its text gives them."""
    return N.leaves(_manifest(spark, sf)).select("leaf", "level", "path", "rows", *r6(*B.SIDES))


def manifest_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Of the manifest of all chunk files, and of every page taken for one."""
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id")).alias("name"), F.col("html").alias("text"))
    return N.summaries(_manifest(spark, sf).union(pages)).select("name", "refused", "levels", "files", F.array_join("sample", " ").alias("sample"), "leaves", "rows")


def manifest_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of pages, some with the manifest's name, some that are none."""
    k = F.col("page_id")
    url = F.when(k % 5 == 0, F.concat("url", F.lit("/Lod-Meta.JSON?v=1"))).when(k % 5 == 1, F.concat(F.lit("  "), F.upper("url"), F.lit("/ "))).when(k % 5 == 2, F.concat(F.lit("ftp"), F.col("url"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", N.resolved_url(url).alias("resolved"), N.is_manifest_url(url).alias("named"))


CHUNKS = f"{ORDERED}, v AS MATERIALIZED (SELECT CAST(l AS INTEGER) AS level, chunk, (place - chunk * 500) // CAST(pow(2, l) AS BIGINT) AS ordinal, splat_id, x, y, z, ny, scale, opacity FROM c, range({{levels}}) r(l) WHERE (place - chunk * 500) % CAST(pow(2, l) AS BIGINT) = 0)"
THREE = CHUNKS.format(levels=LEVELS)
_COUNTS = "n AS MATERIALIZED (SELECT level, chunk, count(*) AS rows FROM v GROUP BY level, chunk), total AS (SELECT count(*) AS total FROM s)"
_FOLD = """, f(level, chunk, rows, take, rest) AS (SELECT level, chunk, rows, least(rows, (most + k - 1) // k, most), most - least(rows, (most + k - 1) // k, most) FROM n JOIN (SELECT level, count(*) AS k FROM n GROUP BY level) USING (level), budget WHERE chunk = 0
  UNION ALL SELECT n.level, n.chunk, n.rows, least(n.rows, greatest((rest + k - n.chunk - 1) // (k - n.chunk), 1), rest), rest - least(n.rows, greatest((rest + k - n.chunk - 1) // (k - n.chunk), 1), rest)
  FROM f JOIN n ON n.level = f.level AND n.chunk = f.chunk + 1 JOIN (SELECT level, count(*) AS k FROM n GROUP BY level) q ON q.level = n.level WHERE rest > 0)"""


def _book(name: str, values: str) -> str:
    """Per level and chunk: the codebook of the values, and its nearest entry for each distinct value."""
    return f"""{name}_v AS MATERIALIZED (SELECT level, chunk, unnest([{values}]) AS v FROM w), {name}_s AS (SELECT *, row_number() OVER (PARTITION BY level, chunk ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY level, chunk) AS n FROM {name}_v),
{name}_n AS (SELECT DISTINCT level, chunk, n FROM {name}_s), {name}_m AS (SELECT level, chunk, e, avg(v) AS value FROM {name}_n CROSS JOIN range(256) r(e) JOIN {name}_s USING (level, chunk) WHERE i >= e * {name}_n.n // 256 AND i < least(greatest((e + 1) * {name}_n.n // 256, e * {name}_n.n // 256 + 1), {name}_n.n) GROUP BY level, chunk, e),
{name}_b AS MATERIALIZED (SELECT level, chunk, e, max(value) OVER (PARTITION BY level, chunk ORDER BY e) AS value FROM {name}_m),
{name}_d AS (SELECT DISTINCT level, chunk, v FROM {name}_v), {name}_lo AS (SELECT d.level, d.chunk, v, value AS lo FROM {name}_d d ASOF LEFT JOIN {name}_b b ON b.level = d.level AND b.chunk = d.chunk AND b.value < d.v),
{name}_hi AS (SELECT d.level, d.chunk, v, value AS hi FROM {name}_d d ASOF LEFT JOIN {name}_b b ON b.level = d.level AND b.chunk = d.chunk AND b.value >= d.v),
{name} AS MATERIALIZED (SELECT level, chunk, v, CASE WHEN hi IS NULL THEN lo WHEN lo IS NULL OR abs(hi - v) < abs(v - lo) THEN hi ELSE lo END AS value FROM {name}_lo JOIN {name}_hi USING (level, chunk, v))"""


_ROT = ["x - 5.0", "z - 5.0", "y - 1.0", "ny - 0.5"]  # x, y, z, w
_FULL = f"""w AS MATERIALIZED (SELECT level, chunk, ordinal, x, y, z, ln(scale) AS s0, ln(scale) - opacity AS s1, ln(scale) * 0.5 AS s2, sqrt(z + 1.0) AS d0, sqrt(x + 1.0) AS d1, ln(y + 2.0) AS d2, opacity * 8.0 - 2.0 AS o, {", ".join(f"{v} AS q{i}" for i, v in enumerate(_ROT))} FROM v)"""
_LOG = {c: f"(sign({c}) * ln(1 + abs({c})))" for c in "xyz"}
_BACK = "l{c} + round(least(greatest(({v} - l{c}) / (h{c} - l{c}), 0), 1) * 65535.0) / 65535.0 * (h{c} - l{c})"
_UNIT = "sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3)"
_BYTE = "(round((u{i} * sqrt(2.0) / 2 + 0.5) * 255) / 255.0 - 0.5) * 2 / sqrt(2.0)"
ROUND = f"""{CHUNKS.format(levels=2)}, {_FULL}, {_book("sizes", "s0, s1, s2")}, {_book("tones", "d0, d1, d2")},
ends AS (SELECT level, chunk, {", ".join(f"min({v}) AS l{c}, CASE WHEN max({v}) > min({v}) THEN max({v}) ELSE min({v}) + 1 END AS h{c}" for c, v in _LOG.items())} FROM w GROUP BY level, chunk),
unit AS (SELECT *, {", ".join(f"q{i} / {_UNIT} AS p{i}" for i in range(4))} FROM w),
mode AS (SELECT *, CASE WHEN abs(p0) >= abs(p1) AND abs(p0) >= abs(p2) AND abs(p0) >= abs(p3) THEN 0 WHEN abs(p1) >= abs(p2) AND abs(p1) >= abs(p3) THEN 1 WHEN abs(p2) >= abs(p3) THEN 2 ELSE 3 END AS m FROM unit),
turn AS (SELECT *, {", ".join(f"CASE WHEN (CASE m WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) < 0 THEN -p{i} ELSE p{i} END AS u{i}" for i in range(4))} FROM mode),
bytes_ AS (SELECT *, {", ".join(f"CASE WHEN m = {i} THEN 0 ELSE {_BYTE.format(i=i)} END AS t{i}" for i in range(4))} FROM turn),
whole AS (SELECT *, sqrt(greatest(1 - t0 * t0 - t1 * t1 - t2 * t2 - t3 * t3, 0)) AS big FROM bytes_),
logs AS (SELECT level, chunk, ordinal, {", ".join(f"{_BACK.format(c=c, v=v)} AS g{c}" for c, v in _LOG.items())} FROM w JOIN ends USING (level, chunk)),
alpha AS (SELECT level, chunk, ordinal, least(greatest(round(255.0 / (1.0 + exp(-o))) / 255.0, 1 / 510.0), 1 - 1 / 510.0) AS a FROM w),
out_ AS (SELECT level, chunk, ordinal, {", ".join(f"sign(g{c}) * (exp(abs(g{c})) - 1) AS {c}" for c in "xyz")}, ln(a / (1 - a)) AS opacity, {", ".join(f"k{i}.value AS scale_{i}, e{i}.value AS f_dc_{i}" for i in range(3))},
  CASE WHEN m = 3 THEN big ELSE t3 END AS rot_0, {", ".join(f"CASE WHEN m = {i} THEN big ELSE t{i} END AS rot_{i + 1}" for i in range(3))}
  FROM whole JOIN logs USING (level, chunk, ordinal) JOIN alpha USING (level, chunk, ordinal) {" ".join(f"JOIN sizes k{i} ON k{i}.level = whole.level AND k{i}.chunk = whole.chunk AND k{i}.v = s{i} JOIN tones e{i} ON e{i}.level = whole.level AND e{i}.chunk = whole.chunk AND e{i}.v = d{i}" for i in range(3))})"""
_ALL = ["x", "y", "z", "opacity", *(f"{n}_{i}" for n, k in (("scale", 3), ("rot", 4), ("f_dc", 3)) for i in range(k))]
_REGION = """r AS (SELECT c_custkey AS region_id, c_custkey % 11 * 0.9e0 AS ax, c_custkey % 5 * 0.6e0 AS ay, c_custkey % 13 * 0.8e0 AS az, c_custkey % 3 * 1e0 AS dx, c_custkey % 4 * 0.3e0 AS dy, c_custkey % 7 * 0.5e0 AS dz FROM customer)"""

QUERIES = {"sog_files": sog_files, "sog_round_trip": sog_round_trip, "region_chunks": region_chunks, "chunk_budgets": chunk_budgets, "nav_source": nav_source, "manifest_leaves": manifest_leaves, "manifest_summaries": manifest_summaries, "manifest_urls": manifest_urls}
_URL = "CASE page_id % 5 WHEN 0 THEN url || '/Lod-Meta.JSON?v=1' WHEN 1 THEN '  ' || upper(url) || '/ ' WHEN 2 THEN 'ftp' || url ELSE url END"
_PARTS = {i: f"regexp_extract(u, '^([hH][tT][tT][pP][sS]?)://([^/?#\\s]+)([^?#]*)(\\?[^#]*)?(#.*)?$', {i})" for i in range(1, 6)}
SQL = {
    "manifest_leaves": f"{THREE}, {_COUNTS}, l AS (SELECT chunk, {_BOXES} FROM c GROUP BY chunk) SELECT n.chunk AS leaf, level, level || '_' || n.chunk || '/meta.json' AS path, n.rows, {sql6(*B.SIDES)} FROM n JOIN l USING (chunk)",
    "manifest_summaries": f"""{THREE}, {_COUNTS} SELECT 'all' AS name, NULL AS refused, 3 AS levels, count(*) AS files, (SELECT string_agg(level || '_' || chunk || '/meta.json', ' ' ORDER BY level, chunk) FROM (SELECT * FROM n ORDER BY level, chunk LIMIT 8)) AS sample, count(DISTINCT chunk) AS leaves, any_value(total) AS rows FROM n, total
UNION ALL SELECT 'page-' || page_id, 'no JSON', NULL, NULL, NULL, NULL, NULL FROM pages""",
    "manifest_urls": f"""WITH u AS (SELECT page_id, trim({_URL}) AS u FROM pages), p AS (SELECT page_id, {", ".join(f"{v} AS p{i}" for i, v in _PARTS.items())} FROM u)
SELECT page_id, CASE WHEN p1 <> '' THEN lower(p1) || '://' || lower(p2) || (CASE WHEN lower(p3) LIKE '%lod-meta.json' THEN p3 ELSE regexp_replace(p3, '/$', '') || '/lod-meta.json' END) || p4 || p5 END AS resolved, p1 <> '' AND lower(p3) LIKE '%lod-meta.json' AS named FROM p""",
    "sog_files": f"{THREE}, {_COUNTS} SELECT row_number() OVER (ORDER BY level, chunk) - 1 AS file, level || '_' || chunk || '/meta.json' AS path, level, chunk, rows, 5 AS planes, rows * 20 AS plane_bytes FROM n",
    "sog_round_trip": f"{ROUND} SELECT level, chunk, ordinal, {sql6(*_ALL)} FROM out_",
    "region_chunks": f"{ORDERED}, l AS (SELECT chunk, {_BOXES} FROM c GROUP BY chunk), {_REGION} SELECT region_id, chunk FROM r JOIN l ON {' AND '.join(f'a{c} <= max_{c} AND a{c} + d{c} >= min_{c}' for c in 'xyz')}",
    "chunk_budgets": f"{THREE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_COUNTS}, budget AS (SELECT total * 2 // 3 AS most FROM total){_FOLD} SELECT level, chunk, rows, take FROM f",
    "nav_source": f"""{THREE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_COUNTS}, budget AS (SELECT total // 2 AS most FROM total){_FOLD}, sums AS (SELECT level, sum(take) AS rows FROM f GROUP BY level),
pick AS (SELECT coalesce((SELECT max(level) FROM sums, total WHERE rows >= total // 3), 0) AS level), places AS (SELECT level, chunk, unnest(range(take)) * rows // take AS ordinal FROM f JOIN pick USING (level)) SELECT level, chunk, ordinal, splat_id FROM places JOIN v USING (level, chunk, ordinal)""",
}
