"""Queries of camera streams, resident budgets and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import PRESETS
from cairn.sources.tables import table
from cairn.streaming import lod


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in camera samples: a session for each user, positions and directions from the events."""
    e = table(spark, sf, "events")
    turn = F.col("event_id") % 16 * 0.01
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("tick"), F.col("ts").cast("timestamp").alias("ts"), (F.floor(F.col("value") / 5.0) * 0.05).alias("x"), F.lit(1.6).alias("y"), (F.col("user_id") % 3 * 0.5).alias("z"), F.sin(turn).alias("fx"), F.lit(0.0).alias("fy"), F.cos(turn).alias("fz"))


def motion(spark: SparkSession, sf: str) -> DataFrame:
    return lod.moving(samples(spark, sf)).select("session", "tick", "moving")


def pauses(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of motion; the stand-in's samples are minutes apart, so that its gap is hours."""
    out = lod.pauses(lod.moving(samples(spark, sf)), "6 hours")
    us = lambda c: F.unix_micros(c).alias(c)
    return out.select("session", us("start"), us("end"), "samples")


MOTION = """WITH s AS (SELECT user_id AS session, event_id AS tick, ts, floor(value / 5.0) * CAST(0.05 AS DOUBLE) AS x, (event_id % 16) * CAST(0.01 AS DOUBLE) AS a FROM events),
l AS (SELECT *, lag(x) OVER w AS px, lag(a) OVER w AS pa FROM s WINDOW w AS (PARTITION BY session ORDER BY ts, tick)),
m AS (SELECT session, tick, ts, coalesce(pow(x - px, 2) > 0.08::DOUBLE * 0.08::DOUBLE OR sin(a) * sin(pa) + cos(a) * cos(pa) < 0.999, false) AS moving FROM l)"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in leaves: the parts, seen by ten views; three files each, finer ones larger."""
    p = F.col("p_partkey")
    size = F.col("p_size").cast("bigint") * 40
    return table(spark, sf, "part").select((p % 10).alias("view"), p.alias("node"), (F.col("p_retailprice") / 100.0).alias("distance"), F.lit(0).alias("level"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("levels"), F.array(size * 4, size * 2, size).alias("counts"))


def budgeted(spark: SparkSession, sf: str) -> DataFrame:
    total = nodes(spark, sf).agg(F.sum(F.get("counts", F.lit(0)))).first()[0]
    return lod.budgeted(nodes(spark, sf), total * 4 // 100)


BUDGETED = """WITH n AS (SELECT p_partkey % 10 AS view, p_partkey AS node, p_retailprice / 100.0 AS distance, CAST(p_size AS BIGINT) * 40 AS c FROM part), b AS (SELECT CAST(sum(c * 4) AS BIGINT) * 4 // 100 AS budget FROM n), t AS (SELECT view, sum(c * 4) AS total FROM n GROUP BY view),
s AS (SELECT view, node, distance, CAST(r AS INTEGER) AS r, c * CASE r WHEN 1 THEN 2 ELSE 1 END AS freed FROM n, range(1, 3) k(r)), w AS (SELECT *, coalesce(sum(freed) OVER (PARTITION BY view ORDER BY r, distance DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT n.view, n.node, coalesce((SELECT max(r) FROM w, t, b WHERE w.view = n.view AND w.node = n.node AND t.view = n.view AND total - before > budget), 0) AS level FROM n"""


def unique_splats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("view"), (F.col("l_partkey") % 300).alias("file"), (F.col("l_partkey") % 300 * 17 + 5).alias("count"))
    return lod.unique_splats(rows)


UNIQUE = "SELECT view, CAST(sum(c) AS BIGINT) AS splats FROM (SELECT DISTINCT l_orderkey % 50 AS view, l_partkey % 300 AS file, l_partkey % 300 * 17 + 5 AS c FROM lineitem) GROUP BY view"


def evicted(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("owner"), F.col("o_orderkey").alias("key"), F.floor("o_totalprice").alias("bytes"), F.col("o_orderdate").alias("last_access"))
    return lod.evicted(rows, 2_000_000).select("owner", "key", "bytes")


EVICTED = """WITH e AS (SELECT o_custkey % 20 AS owner, o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderdate AS d FROM orders)
SELECT owner, key, bytes FROM (SELECT *, sum(bytes) OVER (PARTITION BY owner) - coalesce(sum(bytes) OVER (PARTITION BY owner ORDER BY d, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM e) WHERE rest > 2000000"""


def coarser(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    have = F.filter(F.array(*(F.lit(i).cast("bigint") for i in range(8))), lambda v: (p + v) % 3 != 0)
    return table(spark, sf, "part").select("p_partkey", lod.coarser(p % 9, have).alias("level"))


COARSER = "SELECT p_partkey, list_min([v FOR v IN range(8) IF (p_partkey + v) % 3 <> 0 AND v > p_partkey % 9]) AS level FROM part"


def presets(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(k, *v) for k, v in PRESETS.items()], "preset string, splats bigint, megabytes bigint")
    wanted = table(spark, sf, "customer").select("c_custkey", F.element_at(F.array(*(F.lit(k) for k in (*PRESETS, "other"))), (F.col("c_custkey") % 5 + 1).cast("int")).alias("preset"))
    low = PRESETS["low"]
    return wanted.join(F.broadcast(rows), "preset", "left").select("c_custkey", "preset", F.coalesce("splats", F.lit(low[0])).cast("bigint").alias("splats"), F.coalesce("megabytes", F.lit(low[1])).cast("bigint").alias("megabytes"))  # four presets


PRESET = """SELECT c_custkey, ['low', 'medium', 'high', 'ultra', 'other'][c_custkey % 5 + 1] AS preset, CAST([2000000, 4000000, 8000000, 16000000, 2000000][c_custkey % 5 + 1] AS BIGINT) AS splats, CAST([192, 384, 768, 1536, 192][c_custkey % 5 + 1] AS BIGINT) AS megabytes FROM customer"""

QUERIES = {"camera_motion": motion, "motion_pauses": pauses, "budgeted_levels": budgeted, "unique_splats": unique_splats, "evicted_entries": evicted, "coarser_levels": coarser, "quality_presets": presets}
SQL = {
    "camera_motion": f"{MOTION} SELECT session, tick, moving FROM m",
    "motion_pauses": f"""{MOTION}, v AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM m WHERE moving WINDOW w AS (PARTITION BY session ORDER BY ts, tick)),
i AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, tick) AS k FROM v) SELECT session, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS "end", count(*) AS samples FROM i GROUP BY session, k""",
    "budgeted_levels": BUDGETED, "unique_splats": UNIQUE, "evicted_entries": EVICTED, "coarser_levels": COARSER, "quality_presets": PRESET,
}
