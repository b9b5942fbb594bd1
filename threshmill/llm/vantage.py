"""Approximate nearest neighbours: a vantage-point tree for each shard.

Vectors are scaled to length one; on those, the Euclidean distance is a metric
that orders like the cosine. Each shard of a bounded number of vectors gets a
tree: a vantage point, the median distance from it, and the nearer and the
farther half, down to leaves. A half is skipped if, by the triangle inequality,
it can't hold anything nearer than factor times the k-th distance so far; a
factor below one skips more and is approximate, factor one is exact search.

Queries travel in blocks: a group is one shard and one block of queries, both
of a bounded number of rows, whatever the table's size and whichever ids repeat. Scores are computed in double precision
from the original vectors, by the same sum whatever the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threshmill.llm.common import lean_group

LEAF = 128
SHARD = 8192
BLOCK = 8192
SLACK = 1e-9


@dataclass
class Node:
    """A leaf (rows) or a split around a vantage point."""

    rows: np.ndarray
    point: int = -1
    radius: float = 0.0
    near: Node | None = None
    far: Node | None = None


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.ids = ids
        self.vectors = vectors.astype(np.float64)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.unit = self.vectors / self.norms[:, None]
        self.leaf = leaf
        self.root = self._split(np.arange(len(ids)))

    def _split(self, rows: np.ndarray) -> Node:
        if len(rows) <= self.leaf:
            return Node(rows)
        # the row farthest from the middle sees the others at the most varied distances
        middle = self.unit[rows].mean(axis=0)
        point = int(rows[(self.unit[rows] @ middle).argmin()])
        d = np.sqrt(np.maximum(2 - 2 * (self.unit[rows] @ self.unit[point]), 0.0))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        return Node(rows[:0], point, float(d[order[half]]), self._split(rows[order[:half]]), self._split(rows[order[half:]]))

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float = 1.0) -> list[list[tuple[float, int]]]:
        """For each query its k best (cosine, row of the tree), nearest first, ties to the smaller id, then to the first row; a vector of the query's own id isn't a candidate."""
        q = vectors.astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1))
        unit = q / norms[:, None]
        score = np.full((len(q), k), -np.inf)
        found = np.full((len(q), k), -1)

        def leaf(rows: np.ndarray, ask: np.ndarray) -> None:
            rough = unit[ask] @ self.unit[rows].T
            x, y = np.nonzero((rough >= score[ask, -1][:, None] - SLACK) & (ids[ask][:, None] != self.ids[rows][None, :]))
            if not len(x):
                return
            exact = (q[ask[x]] * self.vectors[rows[y]]).sum(axis=1) / (norms[ask[x]] * self.norms[rows[y]])
            for i in np.unique(x):
                here, one = x == i, ask[i]
                s = np.concatenate((score[one], exact[here]))
                n = np.concatenate((found[one], rows[y[here]]))
                best = np.lexsort((n, self.ids[n], -s))[:k]
                score[one], found[one] = s[best], n[best]

        def visit(node: Node, ask: np.ndarray) -> None:
            if node.near is None:
                leaf(node.rows, ask)
                return
            d = np.sqrt(np.maximum(2 - 2 * (unit[ask] @ self.unit[node.point]), 0.0))
            inside = d < node.radius
            for first, second, some in ((node.near, node.far, inside), (node.far, node.near, ~inside)):
                if some.any():
                    visit(first, ask[some])
                    reach = np.sqrt(np.maximum(2 - 2 * score[ask[some], -1], 0.0))
                    gap = np.abs(d[some] - node.radius)
                    again = gap <= factor * reach + 1e-7
                    if again.any():
                        visit(second, ask[some][again])

        if len(self.ids) and len(q):
            visit(self.root, np.arange(len(q)))
        return [[(float(s), int(n)) for s, n in zip(a, b, strict=True) if s > -np.inf] for a, b in zip(score, found, strict=True)]


def usable(vector: F.Column) -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(wide, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, factor: float = 1.0, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each query (rows whose id is divisible by `every`), by cosine.

    Vectors that are null, zero or hold null or non-finite components, and rows
    without an id, take no part. Vectors of another length than a query's are
    no candidates of it. Every row is a candidate, so equal rows may take
    several ranks; rows of the query's own id are none. Rows of one id are one
    query: a candidate's score is its largest over them. Fewer than k candidates
    give fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    use = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    # equal rows are searched once; their number comes back with the answers
    use = use.groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("id", "v"))
    asks = F.col("id") % every == 0
    per_dim = use.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(asks, 1)).alias("q")).collect()  # one row for each vector length
    if not per_dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = F.broadcast(spark.createDataFrame([(r.dim, -(-r.n // shard_rows), max(1, -(-r.q // BLOCK))) for r in per_dim], "dim int, shards int, blocks int"))
    use = use.join(plan, "dim")
    # rows are dealt by all they hold, so one id's rows don't meet in one shard or block
    shards = use.select("dim", F.pmod(F.xxhash64("h", F.lit(1)), F.col("shards")).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "h", "copies", "v", F.lit(False).alias("asks"))
    asked = use.where(asks).select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("h", F.lit(2)), F.col("blocks")).cast("int").alias("block"), "id", "h", "copies", "v", F.lit(True).alias("asks"))

    def search(part: pa.Table) -> pa.Table:
        ids, marks, copies = (part.column(x).to_numpy() for x in ("id", "h", "copies"))
        asks = part.column("asks").to_numpy(zero_copy_only=False)
        dim = part.column("dim")[0].as_py()
        flat = part.column("v").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        v = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        own_ids, own_marks, own_copies = ids[~asks], marks[~asks], copies[~asks]
        tree = Tree(own_ids, v[~asks])
        found = zip(ids[asks].tolist(), tree.search(ids[asks], v[asks], k, factor), strict=True)
        out = [(one, row, s) for one, best in found for s, row in best]
        q, row, s = zip(*out, strict=True) if out else ((), (), ())
        at = np.array(row, np.int64)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(own_ids[at], pa.int64()), "h": pa.array(own_marks[at], pa.int64()), "copies": pa.array(own_copies[at], pa.int64()), "score": pa.array(s, pa.float64())})

    found = shards.unionByName(asked).groupBy("dim", "shard", "block").applyInArrow(lean_group(search), "query_id long, vec_id long, h long, copies long, score double")
    merged = found.groupBy("query_id", "vec_id", "h").agg(F.max("score").alias("score"), F.first("copies").alias("copies"))
    each = merged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
