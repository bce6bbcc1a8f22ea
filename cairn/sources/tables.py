"""Driver tables, the stand-in clouds made of them, and staging in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set on a single machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Rows from which a staged table meets others by sorting: sorted numbers shrink so much in its files that Spark would take it for small and
#: gather it on the driver to broadcast it.
MANY = 100_000


def staged(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df written as Parquet (with Spark's options) to the shared folder and read again: cuts lineage, survives lost executors. See discard()."""
    where, seen = new_folder(df.sparkSession, what), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**options).parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    if seen.get.get("rows", MANY) >= MANY:
        out = out.hint("merge")
    out.staged_at = where
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes what staged() wrote for these; no later job may read them."""
    for df in dfs:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_ordinal(df: DataFrame, keys: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """A dense 0-based number in the order of the keys, without a window over all rows: one range sort, then the
    row counts of its partitions (a row each) give every partition its offset."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = staged(placed, "ordinal")
    part = F.shiftright("_place", 33)
    at, offsets = 0, []
    for p, rows in sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, at))
        at += rows
    if not offsets:
        return placed.select(*df.columns, F.lit(0).cast("bigint").alias(name))
    start = F.broadcast(spark.createDataFrame(offsets, "_p bigint, _start bigint"))  # a row for each partition
    return placed.withColumn("_p", part).join(start, "_p").select(*df.columns, (F.col("_start") + F.col("_place") - F.shiftleft(F.col("_p"), 33)).alias(name))


def running_total(df: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """The sum of `value` over the rows of the same keys that stand before in an order without ties, 0 for the first.

    Rows are dealt by ranges of keys and order, so that a key with many rows takes many tasks; a task adds up its own, and the
    sums of a key's ranges, of which there are no more than tasks, say what stands before each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id())
    placed = staged(placed, "ranges")
    before = lambda by, *first: Window.partitionBy(*by).orderBy(*first).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    parts = parts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(before(keys, "_part")), F.lit(0)).alias("_start"))
    rows = placed.withColumn("_here", F.coalesce(F.sum(value).over(before([*keys, "_part"], *order)), F.lit(0)))
    on = rows["_part"] == parts["_of"]
    for k in keys:
        on = on & rows[k].eqNullSafe(parts[f"_{k}"])
    return rows.join(parts, on).select(*df.columns, (F.col("_start") + F.col("_here")).alias(name))


#: The same stand-in cloud for DuckDB: a floor, stripes of obstacles and a ceiling.
CLOUD_SQL = """SELECT l_quantity * 0.2 AS x,
  CASE WHEN l_linenumber <= 4 THEN 0.0 WHEN CAST(l_quantity AS INTEGER) % 10 < 3 THEN 1.2 ELSE 2.6 END + l_discount * 0.8 AS y,
  l_extendedprice / 10000.0 AS z, 1.0 - l_discount * 2.0 AS ny, 0.05 + l_discount * 4.0 AS opacity, 0.02 + l_tax AS scale FROM lineitem"""
ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
NUMBERED_SQL = CLOUD_SQL.replace("SELECT ", f"SELECT row_number() OVER (ORDER BY {ORDER}) - 1 AS splat_id, ", 1)
POINTS_SQL = "SELECT vec_id AS splat_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"


def cloud(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Stand-in splat cloud from lineitem: x, y, z, ny (the normal's upward part), opacity, scale; numbered: splat_id, too."""
    rows = table(spark, sf_dir, "lineitem")
    keys = ORDER.split(", ")
    if numbered:
        rows = with_ordinal(rows.select(keys), keys, "splat_id")
    q = F.col("l_quantity")
    level = F.when(F.col("l_linenumber") <= 4, 0.0).when(q.cast("int") % 10 < 3, 1.2).otherwise(2.6)
    return rows.select(
        *(["splat_id"] if numbered else []), (q * 0.2).alias("x"), (level + F.col("l_discount") * 0.8).alias("y"), (F.col("l_extendedprice") / 10000.0).alias("z"),
        (1.0 - F.col("l_discount") * 2.0).alias("ny"), (0.05 + F.col("l_discount") * 4.0).alias("opacity"), (0.02 + F.col("l_tax")).alias("scale"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small stand-in cloud of three components of the embeddings: splat_id, x, y, z."""
    axis = lambda i, c: F.get("embedding", F.lit(i)).cast("double").alias(c)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("splat_id"), axis(0, "x"), axis(1, "y"), axis(2, "z"))


#: A stepped terrain for meshes: a column of solid voxels for each (part, order modulo 40), of a height that the quantities give, and free
#: space of three voxels on it.
TERRAIN_DEPTH, TERRAIN_LEVELS = 40, 12
TERRAIN_SQL = f"""column_ AS (SELECT l_partkey AS vx, l_orderkey % {TERRAIN_DEPTH} AS vz, CAST(sum(l_quantity) AS BIGINT) % {TERRAIN_LEVELS} AS top FROM lineitem GROUP BY ALL),
solid AS MATERIALIZED (SELECT vx, unnest(range(top + 1)) AS vy, vz FROM column_), nav AS MATERIALIZED (SELECT vx, unnest(range(top + 1, top + 4)) AS vy, vz FROM column_)"""


def terrain_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Columns (vx, vz, top: the height of the highest solid voxel) of the terrain, and the number of voxels along x."""
    near = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("vx"), (F.col("l_orderkey") % TERRAIN_DEPTH).alias("vz"), "l_quantity", F.shiftright("l_partkey", 6).alias("block"))
    rows = near.repartition("block").groupBy("block", "vx", "vz").agg((F.sum("l_quantity").cast("bigint") % TERRAIN_LEVELS).alias("top"))  # columns side by side stay in one file
    rows = staged(rows.sortWithinPartitions("block", "vz").drop("block"), "terrain")
    return rows, (rows.agg(F.max("vx")).first()[0] or 0) + 1


def terrain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Solid and free voxels (vx, vy, vz), and the number of voxels along x."""
    rows, width = terrain_columns(spark, sf_dir)
    solid = rows.select("vx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("vy"), "vz")
    free = rows.select("vx", F.explode(F.sequence(F.col("top") + 1, F.col("top") + 3)).alias("vy"), "vz")
    return solid, free, width
