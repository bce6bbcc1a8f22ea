"""What to read of a bundle of chunks: by region, down the tree of boxes, or by a budget, spread over the chunks of a level."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.slicing import levels
from cairn.sources.tables import discard, staged, with_ordinal

SIDES = tuple(f"{n}_{c}" for n in ("min", "max") for c in "xyz")
#: Rows from which on a level is fine enough, and rows read at most.
LEAST, MOST = 50_000, 250_000


def overlaps(one: str, other: str) -> Column:
    """Whether two boxes, by the prefixes of their columns, share a point; sides that touch do."""
    parts = [(F.col(f"{one}min_{c}") <= F.col(f"{other}max_{c}")) & (F.col(f"{one}max_{c}") >= F.col(f"{other}min_{c}")) for c in "xyz"]
    return reduce(lambda a, b: a & b, parts)


def start_level(count: int, wanted: str | int = "nav") -> int:
    """The level that is read first: the coarsest, the finest, the one in the middle, or a number."""
    top = max(count - 1, 0)
    if wanted in ("coarsest", "finest", "nav"):
        return {"coarsest": top, "finest": 0, "nav": top // 2}[wanted]
    if not isinstance(wanted, int) or not 0 <= wanted <= top:
        raise ValueError(f"the level must be between 0 and {top}")
    return wanted


#: Chunks below a node from which on boxes go down in one task, and boxes that do so together.
BELOW, BOXES = 1024, 1 << 14
PAIRS = pa.schema([("box", pa.int64()), ("chunk", pa.int64())])


def descended(boxes: np.ndarray, tree: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of boxes (rows of SIDES) and the nodes below one of them: which box meets which chunk."""
    tree = tree.sort_by("node_id")
    node, chunks, first = (tree[c].to_numpy() for c in ("node_id", "chunks", "first"))
    side = np.stack([tree[c].to_numpy() for c in SIDES], axis=1)
    child = np.searchsorted(node, node * 2)  # those of a node stand side by side
    found = [(np.zeros(0, np.int64),) * 2]
    for start in range(0, len(boxes), 4096):
        who = np.arange(start, min(start + 4096, len(boxes)))
        at = np.zeros(len(who), np.int64)
        while len(who):
            hit = np.flatnonzero((boxes[who, :3] <= side[at, 3:]).all(axis=1) & (boxes[who, 3:] >= side[at, :3]).all(axis=1))
            who, at = who[hit], at[hit]
            leaf = chunks[at] == 1
            found.append((who[leaf], first[at[leaf]]))
            who, at = who[~leaf], child[at[~leaf]]
            who, at = np.concatenate((who, who)), np.concatenate((at, at + 1))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def chunks_of_regions(regions: DataFrame, tree: DataFrame) -> DataFrame:
    """regions (region_id, min_x .. max_z) and lod_tree() -> region_id, chunk of the chunks whose boxes overlap.

    Regions of the same box go down the tree as one: by a join on node numbers for each depth while a node has many chunks below it, then with the
    nodes below one in a task, so that the pairs of boxes and chunks, most of all that meet, are never staged. Only the result has a row for each region's."""
    node = tree.select("node_id", "depth", "chunks", "first", *SIDES)
    boxes = with_ordinal(regions.select(*SIDES).distinct(), list(SIDES), "box")
    n = node.agg(F.max("chunks")).first()[0] or 0
    at, here = boxes.withColumn("node_id", F.lit(1).cast("bigint")), None
    for depth in range(64):
        last = -(-n // (1 << depth)) <= BELOW and (depth > 0 or n < 2)  # nodes of a depth differ by one chunk at most
        # A depth's own nodes only: the whole tree would be gathered for each.
        own = node.filter(F.col("depth") == depth).select("node_id", *(F.col(c).alias(f"of_{c}") for c in SIDES))
        before, here = here, staged(at.join(own, "node_id").filter(overlaps("", "of_")).select("box", "node_id", *SIDES), "descent")
        if before is not None:
            discard(before)
        if last:
            break
        at = here.select("box", *SIDES, F.explode(F.array(F.col("node_id") * 2, F.col("node_id") * 2 + 1)).alias("node_id"))

    many = here.groupBy(F.col("node_id").alias("root")).agg(F.ceil(F.count("*") / BOXES).alias("parts"))
    asked = here.withColumnRenamed("node_id", "root").join(many, "root").select("root", F.pmod(F.xxhash64("box"), F.col("parts")).alias("part"), "box", *SIDES)
    below = node.filter(F.col("depth") >= depth).select(F.expr(f"shiftright(node_id, depth - {depth})").alias("root"), "node_id", "chunks", "first", *SIDES)
    below = below.join(many, "root").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))

    def meet(own: pa.Table, tree: pa.Table) -> pa.Table:
        if not len(own) or not len(tree):
            return PAIRS.empty_table()
        which, chunk = descended(np.stack([own[c].to_numpy() for c in SIDES], axis=1), tree)
        return pa.table([pa.array(own["box"].to_numpy()[which]), pa.array(chunk)], schema=PAIRS)

    found = asked.groupBy("root", "part").cogroup(below.groupBy("root", "part")).applyInArrow(meet, "box bigint, chunk bigint")
    return regions.select("region_id", *SIDES).join(boxes, list(SIDES)).select("region_id", "box").join(found, "box").select("region_id", "chunk")


def budgets(counts: DataFrame, most: int = MOST) -> DataFrame:
    """counts (level, chunk, rows) with take: in the order of chunks each gets its even share of what is left of `most`, rounded up.

    What a chunk leaves over goes to those behind it, so that the chunks of a level are gone through in order: a row for each
    chunk, of thousands of splats, and nothing of the splats."""

    def share(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        left, takes, n = most, [], len(rows)
        for i, many in enumerate(rows["rows"].to_pylist()):
            take = min(many, max(1, -(-left // (n - i))), left) if left > 0 else 0
            takes.append(take)
            left -= take
        return rows.append_column("take", pa.array(takes, pa.int64()))

    own = counts.select(F.col("level").cast("int").alias("level"), F.col("chunk").cast("bigint").alias("chunk"), F.col("rows").cast("bigint").alias("rows"))
    return own.groupBy("level").applyInArrow(share, "level int, chunk bigint, rows bigint, take bigint").filter("take > 0")


def refined(counts: DataFrame, wanted: str | int = "nav", least: int | None = None, most: int = MOST) -> DataFrame:
    """The chunks, rows and takes of the level to read: from the wanted one towards the finest the first with `least` rows, the finest there is
    if none has; a level that is asked for by number, or the finest, is taken as it is."""
    own = staged(budgets(counts, most), "budgets")
    top = counts.agg(F.max("level")).first()[0]
    if top is None:
        return own
    start = start_level(top + 1, wanted)
    if wanted not in ("nav", "coarsest"):
        return own.filter(F.col("level") == start)
    sums = {r["level"]: r["rows"] for r in own.filter(F.col("level") <= start).groupBy("level").agg(F.sum("take").alias("rows")).collect()}  # a row for each of eight levels
    enough = [level for level, rows in sums.items() if rows >= (LEAST if least is None else least)]
    return own.filter(F.col("level") == (max(enough) if enough else min(sums, default=0)))


def taken(chunks: DataFrame, count: int, chosen: DataFrame) -> DataFrame:
    """The rows of chosen chunks (level, chunk, rows, take) at the places floor(i * rows / take) of the chunk's level, i from 0: an even sample, not a prefix."""
    first = chunks.groupBy("chunk").agg(F.min("place").alias("first"))
    rows = levels(chunks, count).join(first, "chunk").withColumn("ordinal", F.expr("(place - first) div shiftleft(1L, level)")).drop("first")
    own = rows.join(chosen.select(F.col("level").cast("int").alias("level"), "chunk", "rows", "take"), ["level", "chunk"])
    i = F.expr("(ordinal * take + rows - 1) div rows")  # the least i with i * rows / take >= ordinal
    return own.filter((i < F.col("take")) & (F.expr("((ordinal * take + rows - 1) div rows) * rows div take") == F.col("ordinal"))).drop("rows", "take")
