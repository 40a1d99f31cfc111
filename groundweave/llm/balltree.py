"""Exact top-k inner-product search by ball trees and branch and bound.

Vectors become integers floor(scale * x). Rows are dealt into shards by hash; a shard's
vectors are put into a ball tree, and a query visits nodes in the order of their upper bound
q.c + |q| r until the bound is below its current kth score. The first round searches each
query in one shard; its kth score there goes along to all other shards, where it prunes from
the start. Query blocks meet shards as (block, shard) tasks of bounded size, and each task
returns at most k rows a query.

Scores are exact: products are summed in double precision while they stay under 2**53 and
as Python integers beyond. Only vectors of one length are compared. Null vectors, vectors
with null or non-finite components and null ids take no part; repeated rows (same id and
vector) count once; candidates with the query's own id are left out. Ties go to the
smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from groundweave.llm.registry import query, table
from groundweave.session import cut

SHARD, BLOCK, LEAF = 8_192, 2_048, 64  # vectors of a shard, queries of a block, vectors of a leaf
LOWEST = -(2**63)


class BallTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        # integers beyond 2**53 in a sum of products need Python's integers
        largest = max(1, int(np.abs(vectors).max(initial=0)))
        self.exact = largest * largest * vectors.shape[1] < 1 << 53
        self.vectors, self.ids, self.largest = vectors.astype(np.float64) if self.exact else vectors.astype(object), ids, largest
        self.nodes: list[tuple] = []  # centre, radius, children or rows
        self.root = self._build(vectors.astype(np.float64), np.arange(len(ids)))

    def _build(self, points: np.ndarray, rows: np.ndarray) -> int:
        own = points[rows]
        centre = own.mean(axis=0)
        away = ((own - centre) ** 2).sum(axis=1)
        radius, inside = float(np.sqrt(away.max())), rows
        if len(rows) > LEAF and radius > 0:
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            side = own @ (other - far)
            middle = np.argsort(side, kind="stable")
            half = len(rows) // 2
            inside = (self._build(points, rows[middle[:half]]), self._build(points, rows[middle[half:]]))
        self.nodes.append((centre, radius, inside))
        return len(self.nodes) - 1

    def search(self, vector: np.ndarray, own: int, k: int, least: int) -> list[tuple[int, int]]:
        """The k best (score, -id) of rows other than ``own``; scores under ``least`` may be left out."""
        q = vector.astype(np.float64)
        length = float(np.sqrt(q @ q))
        exact = self.exact and int(np.abs(vector).max(initial=0)) * self.largest * len(vector) < 1 << 53
        seeker = q if exact else vector.astype(object)
        rows = self.vectors if exact else self.vectors.astype(object) if self.exact else self.vectors

        def bound(node: int) -> float:
            centre, radius, _ = self.nodes[node]
            top = float(q @ centre) + length * radius
            return top + 1e-9 * (abs(top) + length * radius) + 1e-6  # never under the true bound

        best: list[tuple[int, int]] = []  # a heap of at most k
        waiting = [(-bound(self.root), self.root)]
        while waiting:
            top, node = heapq.heappop(waiting)
            if -top < (max(least, best[0][0]) if len(best) == k else least):
                break
            inside = self.nodes[node][2]
            if isinstance(inside, tuple):
                for child in inside:
                    heapq.heappush(waiting, (-bound(child), child))
                continue
            scores = rows[inside] @ seeker
            floor = best[0][0] if len(best) == k else least
            for at in np.flatnonzero(scores >= floor).tolist():
                found = (int(scores[at]), -int(self.ids[inside[at]]))
                if -found[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return sorted(best, reverse=True)


def _usable(df: DataFrame, column: str) -> DataFrame:
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(column).isNotNull() & finite)


def _search(tasks: DataFrame, k: int) -> DataFrame:
    """tasks: block, shard, id, vector, is_query, least; the k best of each query in the shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        asking = pdf["is_query"].to_numpy()
        sizes = pdf["vector"].map(len)
        for size in sizes[asking].unique():
            rows, queries = pdf[~asking & (sizes == size)], pdf[asking & (sizes == size)]
            if len(rows):
                tree = BallTree(np.array(rows["vector"].tolist(), dtype=np.int64).reshape(len(rows), size), rows["id"].to_numpy())
                for own, vector, least in zip(queries["id"].tolist(), queries["vector"], queries["least"].tolist()):
                    out += [(own, -i, s) for s, i in tree.search(np.asarray(vector, dtype=np.int64), own, k, least)]
        return pd.DataFrame(out, columns=["query_id", "id", "score"], dtype="int64")

    return tasks.groupBy("block", "shard").applyInPandas(run, "query_id long, id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k best candidates of each query."""
    kept = _usable(vectors.select(F.col(id).cast("long").alias("id"), F.col(column).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id IS NOT NULL"), "vector")
    whole = kept.select("id", "asks", F.transform("vector", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vector")).distinct()
    whole = cut(whole, "vectors")
    counts = whole.agg(F.count("*").alias("rows"), F.sum(F.col("asks").cast("long")).alias("queries")).first()
    shards, blocks = -(-max(1, counts["rows"]) // SHARD), -(-max(1, counts["queries"] or 0) // BLOCK)
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = whole.select(each(blocks).alias("block"), deal(shards, 1).alias("shard"), "id", "vector", F.lit(False).alias("is_query"), F.lit(LOWEST).cast("long").alias("least"))
    asked = whole.where("asks").select(deal(blocks, 2).alias("block"), deal(shards, 3).alias("first"), "id", "vector")

    first = asked.select("block", F.col("first").alias("shard"), "id", "vector", F.lit(True).alias("is_query"), F.lit(LOWEST).cast("long").alias("least"))
    found = cut(_search(rows.union(first), k), "first-shard")
    if shards > 1:
        least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(LOWEST)).alias("least"))
        rest = asked.join(least, asked["id"] == least["query_id"], "left").select(
            "block", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), F.array("first"))).alias("shard"), "id", "vector", F.lit(True).alias("is_query"), F.coalesce("least", F.lit(LOWEST)).alias("least"))
        found = found.union(_search(rows.union(rest), k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


ORACLE = """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


@query("op9_top_k", ORACLE)
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
