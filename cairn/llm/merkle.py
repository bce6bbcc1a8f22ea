"""A Merkle manifest of documents: leaves, a root for each source, a root of all, and a proof for each document.

The place of a leaf in its source comes from histograms of the digits of doc_id: the buckets of the last digit are counted,
their counts added up digit by digit, and the smaller siblings of a bucket on each level say how many leaves stand before it.
The places in base FANOUT are the keys of a trie's nodes: a node's parent is its key without the last digit. The nodes of the
longest keys become their parents first, DEPTH digits with one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import discard, id_bucket, staged, table
from cairn.sources.tables import with_ordinal

FANOUT = 3
#: Digits that one shuffle takes off the keys; a task holds FANOUT ** DEPTH nodes of a parent at a time.
DEPTH = 4
BLOCK = FANOUT**DEPTH
#: Bits of doc_id below which a bucket's rows are numbered, and of each digit above.
DIGIT = 10
#: Copies of a row that one row stands for when copies are dealt out again.
RUN = 4096


def field(value: Column) -> Column:
    """`-` for null, else the bytes' number, `:` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.octet_length(text).cast("string").cast("binary"), F.lit(":").cast("binary"), text.cast("binary")))


def leaf(text: Column) -> Column:
    """The digest of a document's fields; long texts are read once, as they are."""
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """docs -> source, doc_id, leaf, tampered, copies: equal rows are one, with their number."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(source as string) source", "cast(lang as string) lang", "cast(n_chars as bigint) n_chars", "cast(text as string) text")
    even = id_bucket("doc_id", 2) == 0
    tampered = F.when(even & F.contains("text", F.lit("\n")), leaf(F.replace("text", F.lit("\n"), F.lit(""))))
    rows = docs.select("source", "doc_id", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    return rows.groupBy("source", "doc_id", "leaf").agg(F.first("tampered").alias("tampered"), F.count("*").alias("copies"))


def running(df: DataFrame, keys: list[str], order: list[str], count: str, name: str) -> DataFrame:
    """The sum of `count` over the rows of the same keys that stand before."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(count).over(before), F.lit(0)))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (tree, doc_id, leaf, copies, ...) with first: how many leaves of the tree stand before; null ids come first, and of one
    id the smaller digest. No task orders more at a time than a bucket's ids, or of one id the leaves whose digests start alike."""
    rows = rows.withColumn("known", F.col("doc_id").isNotNull().cast("int")).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    rows = rows.withColumn("high", F.shiftright("id", DIGIT)).withColumn("head", F.substring("leaf", 1, 2))
    ids, heads = ["tree", "high", "known", "id"], ["tree", "high", "known", "id", "head"]
    by_head = rows.groupBy(*heads).agg(F.sum("copies").alias("n"))
    by_id = by_head.groupBy(*ids).agg(F.sum("n").alias("n"))
    levels = [by_id.groupBy("tree", "high").agg(F.sum("n").alias("n"))]
    for _ in range(DIGIT, 64 - DIGIT, DIGIT):
        levels.append(levels[-1].withColumn("high", F.shiftright("high", DIGIT)).groupBy("tree", "high").agg(F.sum("n").alias("n")))
    top = running(levels[-1], ["tree"], ["high"], "n", "before")
    for level in levels[-2::-1]:
        inner = running(level.withColumn("upper", F.shiftright("high", DIGIT)), ["tree", "upper"], ["high"], "n", "inner")
        above = top.select("tree", F.col("high").alias("upper"), F.col("before").alias("outer"))
        top = inner.join(above, ["tree", "upper"]).select("tree", "high", (F.col("inner") + F.col("outer")).alias("before"))
    by_id = running(by_id, ["tree", "high"], ["known", "id"], "n", "of_ids").drop("n")
    by_head = running(by_head, ids, ["head"], "n", "of_heads").drop("n")
    rows = running(rows, heads, ["leaf"], "copies", "of_leaves")
    rows = rows.join(by_head, heads).join(by_id, ids).join(top, ["tree", "high"])
    return rows.withColumn("first", F.col("before") + F.col("of_ids") + F.col("of_heads") + F.col("of_leaves"))


def dealt(rows: DataFrame) -> DataFrame:
    """A row for each copy, with its place: in runs first, so that many copies are not one task's."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / RUN).cast("bigint"))))
    each = runs.withColumn("i", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1)))
    return each.select(*(c for c in rows.columns if c not in ("copies", "first")), (F.col("first") + F.col("i")).alias("pos"))


def parents(level: Column) -> Column:
    """The digests of the runs of FANOUT nodes."""
    starts = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
    return F.transform(starts, lambda i: F.sha2(F.concat_ws("", F.slice(level, i * FANOUT + 1, FANOUT)).cast("binary"), 256))


def _blocks(nodes: DataFrame, more: list[str]) -> DataFrame:
    """nodes (tree, pos, n, digest, ...) -> a row for each BLOCK of them: tree, block, n, rows, and the digests of each level.

    A level has the digits that are still to be taken off; where a tree has one node left, the next level is the same."""
    row = F.struct("pos", "digest", *more)
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(row)).alias("rows"))
    rows = rows.withColumn("level_0", F.col("rows.digest"))
    for k in range(DEPTH):
        level = F.col(f"level_{k}")
        rows = rows.withColumn(f"level_{k + 1}", F.when(F.col("n") > FANOUT**k, parents(level)).otherwise(level))
    return rows


def _path() -> Column:
    """Of a block's node j: on each level of the block its siblings to the left and to the right, joined."""

    def sides(j: Column, k: int) -> Column:
        at = F.floor(j / FANOUT**k).cast("int")
        start = at - at % FANOUT
        level = F.col(f"level_{k}")
        left, right = F.slice(level, start + 1, at - start), F.slice(level, at + 2, F.greatest(F.lit(0), start + FANOUT - 1 - at))
        return F.struct(F.concat_ws("", left).alias("l"), F.concat_ws("", right).alias("r"))

    def path(row: Column, j: Column) -> Column:
        levels = F.filter(F.array(*(F.when(F.col("n") > FANOUT**k, sides(j, k)) for k in range(DEPTH))), lambda x: x.isNotNull())
        return F.struct(*(row[c].alias(c) for c in ("pos",)), row.alias("row"), levels.alias("path"))

    return F.transform("rows", path)


def _above(nodes: DataFrame, scratch: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, pos, n, digest) -> the roots (tree, digest), and of each node the path to the root (tree, pos, path)."""
    nodes = staged(nodes, "nodes")
    scratch.append(nodes)
    if nodes.filter("n > 1").isEmpty():
        return nodes.select("tree", "digest"), nodes.select("tree", "pos", F.expr("cast(array() as array<struct<l: string, r: string>>)").alias("path"))
    blocks = _blocks(nodes, [])
    roots, above = _above(_next(blocks), scratch)
    own = blocks.select("tree", "block", F.explode(_path()).alias("x")).select("tree", "block", "x.row.pos", "x.path")
    upper = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("upper"))
    return roots, own.join(upper, ["tree", "block"]).select("tree", "pos", F.concat("path", "upper").alias("path"))


def _next(blocks: DataFrame) -> DataFrame:
    return blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.get(f"level_{DEPTH}", F.lit(0)).alias("digest"))


def manifest(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text, ...) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row
    for each row.

    Null sources are a source of their own, the first. Null ids come before all others and count as the empty text where
    tampering is decided. Rows that share an id are ordered by their digests; equal rows have places, and so proofs, of their own.
    A table without rows gives none."""
    scratch: list[DataFrame] = []
    found = staged(leaves(docs), "leaves")
    sources = staged(with_ordinal(found.groupBy("source").agg(F.sum("copies").alias("n")), ["source"], "tree"), "sources")
    in_trees = found.join(sources.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")))
    placed = staged(dealt(ranked(in_trees.select("tree", "n", "doc_id", "leaf", "tampered", "copies"))).select("tree", "n", "pos", "doc_id", "leaf", "tampered"), "places")
    subroots, paths = _above(_next(_blocks(placed.select("tree", "pos", "n", F.col("leaf").alias("digest")), [])), scratch)
    upper = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("pos"), F.lit(sources.count()).cast("bigint").alias("n"), "digest")
    roots, ends = _above(upper, scratch)
    root = roots.first()
    tops = subroots.withColumnRenamed("digest", "subroot").join(ends.select(F.col("pos").alias("tree"), F.col("path").alias("end")), "tree")
    above = staged(paths.join(tops, "tree").select("tree", F.col("pos").alias("block"), F.concat("path", "end").alias("upper"), "subroot"), "paths")
    discard(found, sources, *scratch)
    own = _blocks(placed.select("tree", "pos", "n", F.col("leaf").alias("digest"), "doc_id", "tampered"), ["doc_id", "tampered"])
    own = own.select("tree", "block", F.explode(_path()).alias("x")).select("tree", "block", "x.row.doc_id", F.col("x.row.digest").alias("leaf"), "x.row.tampered", "x.path")
    rows = own.join(above.hint("merge"), ["tree", "block"]).withColumn("path", F.concat("path", "upper")).withColumn("root", F.lit(root and root["digest"]).cast("string"))
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["l"], s["r"]))).cast("binary"), 256)
    folded = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda a, s: F.sha2(F.concat(s["l"], a, s["r"]).cast("binary"), 256))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; see manifest()."""
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op12_merkle": op12_merkle}
_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
SQL = {
    "op12_merkle": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NOT NULL AS named, {_LEAF.format("text")} AS leaf, {_LEAF.format("replace(text, chr(10), '')")} AS stripped,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END) % 2 = 1 AS even FROM documents),
p AS (SELECT doc_id, leaf, CASE WHEN even THEN stripped ELSE leaf END AS shown, dense_rank() OVER (ORDER BY named, source) - 1 AS tree,
  row_number() OVER (PARTITION BY named, source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY named, source) AS n FROM d),
l AS (SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM p
  UNION ALL SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM l WHERE n > 1 GROUP BY tree, lvl, n, pos // 3),
s AS (SELECT tree, h AS subroot FROM l WHERE n = 1),
t AS (SELECT 0 AS lvl, tree AS pos, (SELECT count(*) FROM s) AS n, subroot AS h FROM s
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, n, pos // 3),
f AS (SELECT tree, pos, 0 AS lvl, pos AS at, shown AS h FROM p
  UNION ALL SELECT f.tree, f.pos, f.lvl + 1, f.at // 3, sha256(string_agg(CASE WHEN l.pos = f.at THEN f.h ELSE l.h END, '' ORDER BY l.pos))
  FROM f JOIN l ON l.tree = f.tree AND l.lvl = f.lvl AND l.pos // 3 = f.at // 3 AND l.n > 1 GROUP BY f.tree, f.pos, f.lvl, f.at),
g AS (SELECT tree, pos, 0 AS lvl, tree AS at, arg_max(h, lvl) AS h FROM f GROUP BY tree, pos
  UNION ALL SELECT g.tree, g.pos, g.lvl + 1, g.at // 3, sha256(string_agg(CASE WHEN t.pos = g.at THEN g.h ELSE t.h END, '' ORDER BY t.pos))
  FROM g JOIN t ON t.lvl = g.lvl AND t.pos // 3 = g.at // 3 AND t.n > 1 GROUP BY g.tree, g.pos, g.lvl, g.at),
w AS (SELECT tree, pos, arg_max(h, lvl) AS folded_root FROM g GROUP BY tree, pos),
q AS (SELECT f.tree, f.pos, 0 AS part, f.lvl, l.pos AS place, l.h FROM f JOIN l ON l.tree = f.tree AND l.lvl = f.lvl AND l.pos // 3 = f.at // 3 AND l.pos <> f.at AND l.n > 1
  UNION ALL SELECT g.tree, g.pos, 1, g.lvl, t.pos, t.h FROM g JOIN t ON t.lvl = g.lvl AND t.pos // 3 = g.at // 3 AND t.pos <> g.at AND t.n > 1),
v AS (SELECT tree, pos, sha256(string_agg(h, '' ORDER BY part, lvl, place)) AS proof_sha256 FROM q GROUP BY tree, pos)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, coalesce(v.proof_sha256, sha256('')) AS proof_sha256, w.folded_root, w.folded_root = r.h AS verified
FROM p JOIN s USING (tree) JOIN w ON w.tree = p.tree AND w.pos = p.pos LEFT JOIN v ON v.tree = p.tree AND v.pos = p.pos CROSS JOIN (SELECT h FROM t WHERE n = 1) r"""
}
