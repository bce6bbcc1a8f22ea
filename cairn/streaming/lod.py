"""Camera motion, decode pauses and resident budgets, on batches and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.tables import running_total

#: Metres moved, cosine turned, milliseconds idle.
MOVED, TURNED, IDLE_MS = 0.08, 0.999, 400


def moving(samples: DataFrame, keys: tuple[str, ...] = ("session",), order: tuple[str, ...] = ("ts", "tick")) -> DataFrame:
    """samples (x, y, z, fx, fy, fz) with moving: whether the camera moved or turned since the session's sample before."""
    before = Window.partitionBy(*keys).orderBy(*order)
    was = {c: F.lag(c).over(before) for c in ("x", "y", "z", "fx", "fy", "fz")}
    d2 = sum(((F.col(c) - was[c]) * (F.col(c) - was[c]) for c in ("y", "z")), (F.col("x") - was["x"]) * (F.col("x") - was["x"]))
    dot = F.col("fx") * was["fx"] + F.col("fy") * was["fy"] + F.col("fz") * was["fz"]
    return samples.withColumn("moving", F.coalesce((d2 > MOVED * MOVED) | (dot < TURNED), F.lit(False)))


def pauses(samples: DataFrame, gap: str = f"{IDLE_MS} milliseconds", late: str = "10 seconds") -> DataFrame:
    """session, start, end, samples of each stretch of motion; decoding rests until no motion came for `gap`. Works on
    batches and, with late samples up to `late` behind, on streams."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    window = F.session_window("ts", gap)
    return rows.filter("moving").groupBy("session", window).agg(F.count("*").alias("samples")).select("session", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "samples")


def coarser(current: Column, available: Column) -> Column:
    """The next coarser of the available levels, null at the coarsest."""
    return F.array_min(F.filter(available, lambda v: v > current))


def distance2(x: Column, y: Column, z: Column) -> Column:
    """Squared distance of a node's box centre from a point."""
    axis = lambda c, v: ((F.col(f"min_{c}") + F.col(f"max_{c}")) * 0.5 - v) * ((F.col(f"min_{c}") + F.col(f"max_{c}")) * 0.5 - v)
    return axis("x", x) + axis("y", y) + axis("z", z)


def unique_splats(nodes: DataFrame) -> DataFrame:
    """view, splats: each file of a view's nodes (view, file, count) counted once."""
    return nodes.groupBy("view", "file").agg(F.max("count").alias("count")).groupBy("view").agg(F.sum("count").alias("splats"))



def budgeted(nodes: DataFrame, budget: int) -> DataFrame:
    """view, node, level: target levels within the budget. nodes: view, node, distance, level, and levels, counts (parallel arrays of the
    node's own files, from fine to coarse).

    The farthest nodes take a step to the next coarser level in turn, round after round, until a view's total fits. Steps
    have a fixed order (round, distance, node) and each frees a known count, so that a running sum replaces the loop: a step is
    taken if the total before it is over the budget."""
    steps = nodes.select("view", "node", "distance", "level", F.explode(F.filter(F.arrays_zip("levels", "counts"), lambda s: s["levels"] >= F.col("level"))).alias("s"))
    own = Window.partitionBy("view", "node").orderBy("s.levels")
    steps = steps.withColumn("round", F.row_number().over(own) - 1).withColumn("freed", F.coalesce(F.lag("s.counts").over(own) - F.col("s.counts"), F.lit(0)))
    totals = steps.filter("round = 0").groupBy("view").agg(F.sum("s.counts").alias("total"))
    turns = running_total(steps.filter("round > 0").select("view", "node", "distance", "round", F.col("s.levels").alias("reached"), "freed"), ["view"], ["round", F.desc("distance"), "node"], "freed", "before")
    taken = turns.join(totals, "view").filter(F.col("total") - F.col("before") > budget)
    last = taken.groupBy("view", "node").agg(F.max("reached").alias("reached"))
    return nodes.select("view", "node", "level").join(last, ["view", "node"], "left").select("view", "node", F.coalesce("reached", "level").alias("level"))


def evicted(entries: DataFrame, budget: int) -> DataFrame:
    """entries (owner, key, bytes, last_access) that go, oldest first, until an owner's rest fits the budget."""
    totals = entries.groupBy(F.col("owner").alias("of")).agg(F.sum("bytes").alias("total"))
    rows = running_total(entries, ["owner"], ["last_access", "key"], "bytes", "gone")
    return rows.join(totals, F.col("owner").eqNullSafe(F.col("of"))).filter(F.col("total") - F.col("gone") > budget).select(*entries.columns)
