"""Nearest vectors by inner product with a vantage-point tree in each shard.

Vectors are extended by one component to equal norms, so that the largest inner product is the
smallest Euclidean distance, for which the triangle inequality holds. A block of queries walks a
shard's tree together; a subtree is entered by the queries whose best distances, times the factor,
reach its ring around the vantage point. Factor 1 is exact; smaller ones prune more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import arrow_batch, table

K, EVERY = 20, 20
#: Rows of a shard and queries of a block; each pair of them is a task's group.
SHARD_ROWS, BLOCK_ROWS = 16_384, 4_096
LEAF = 512
#: Inner products within this much of a bound are kept until they are computed alike.
SLACK = 1e-9
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components: equal vectors get equal values."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Tree:
    """A vantage-point tree over rows; node: (vantage row, inner child, outer child, their rings) or an array of rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        square = (x * x).sum(axis=1)
        self.x, self.leaf = x, leaf
        self.wide = np.column_stack((x, np.sqrt(np.maximum(0, square.max(initial=0) - square))))
        self.norm = square.max(initial=0)
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        at = self.wide[rows[0]]
        d = np.sqrt(((self.wide[rows] - at) ** 2).sum(axis=1))
        inside = d <= np.median(d)
        if inside.all():  # mostly copies of one vector: no ring parts them
            return rows
        return (rows[0], *(y for part in (inside, ~inside) for y in (self._build(rows[part]), d[part].min(), d[part].max())))

    def search(self, q: np.ndarray, k: int, factor: float = 1.0, ids: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs among which are the k largest inner products of each query, and all ties of the k-th.
        ids of the rows and own ids of the queries: rows of a query's own id, however many, take no part for it."""
        square, asked = (q * q).sum(axis=1), own
        top = np.full((len(q), k), -np.inf)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                s = q[who] @ self.x[node].T
                if ids is not None:
                    s[ids[node] == asked[who, None]] = -np.inf
                i, j = np.nonzero((s >= top[who, :1] - SLACK) & (s > -np.inf))
                pairs.append((who[i], node[j], s[i, j]))
                both = np.concatenate((top[who], s), axis=1)
                kept = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kept.sort(axis=1)
                top[who] = kept
                return
            vantage, near, a0, a1, far, b0, b1 = node
            d = np.sqrt(np.maximum(0, square[who] + self.norm - 2 * (q[who] @ self.x[vantage])))
            first = d <= (a1 + b0) / 2
            for nearer in (True, False):
                own, dist = who[first == nearer], d[first == nearer]
                for child, lo, hi in ((near, a0, a1), (far, b0, b1))[:: 1 if nearer else -1]:
                    reach = np.sqrt(np.maximum(0, square[own] + self.norm - 2 * top[own, 0])) * factor + SLACK
                    reach[np.isinf(top[own, 0])] = np.inf
                    visit(child, own[(dist - reach <= hi) & (dist + reach >= lo)])

        visit(self.root, np.arange(len(q)))
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j, s = (np.concatenate(x) for x in zip(*pairs, strict=True))
        good = s >= top[i, 0] - SLACK
        return i[good], j[good]


def _search(k: int, factor: float):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return FOUND.empty_table()
        x, q = matrix(rows["v"]), matrix(queries["v"])
        ids, who = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        i, j = Tree(x).search(q, k, factor, ids, who)
        s = inner(q[i], x[j])
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        start = np.searchsorted(i, i, "left")
        best = np.arange(len(i)) - start < k
        return pa.Table.from_batches([arrow_batch(FOUND, query_id=who[i[best]], vec_id=ids[j[best]], score=s[best])])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = 1.0) -> DataFrame:
    """vectors, queries (vec_id, embedding, ...) -> query_id, rank, vec_id, score: the k vectors of largest inner product.

    Vectors that are null, empty or zero, hold null or non-finite components or have no id take no part, and a query
    meets vectors of its own length only, except those with its own id. Of a query id that is repeated all rows ask, and
    the k best of all their pairs are its result. Each block of queries meets each shard of rows."""
    usable = "vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    narrow = lambda df: df.selectExpr("cast(vec_id as bigint) vec_id", "cast(embedding as array<double>) v").filter(usable).withColumn("dim", F.size("v"))
    rows, asked = narrow(vectors), narrow(queries)
    shards, blocks = rows.count() // SHARD_ROWS + 1, asked.count() // BLOCK_ROWS + 1
    every = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)]) if n < 50 else F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    key = ["dim", "shard", "block"]
    found = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search(k, factor), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth; rows that can't be compared take no part."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


QUERIES = {"op6_nearest": op6_nearest}
SQL = {
    "op6_nearest": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM v WHERE v IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
}
