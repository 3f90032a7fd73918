"""Exact top-k by inner product with block-at-a-time pruning (operator 7).

Vectors are scaled to whole numbers. Candidates lie in ranges of their id; a range is cut into blocks of BLOCK vectors,
each with a matrix of its vectors (its forward index) and the largest and least value per dimension. A query's bound for
a block is the sum over dimensions of its weight times the block's extreme of the same sign. Every query visits the
blocks in falling order of its bounds, and stops at the first bound below its kth score. A bound that equals it is still
visited, as a smaller id wins a tie.

Queries, too, are dealt out in groups, and a task gets one range and one group of queries, so its memory is bounded.
First every query searches its own range alone; its kth score there is a floor for all ranges, which skip the blocks
whose bounds are below it. Then the best of all ranges are merged. Only vectors of one length are compared. Vectors that
are null, empty, or hold a null or non-finite component, and rows without an id, take no part. Of rows with one id the
smallest vector is the query; a query is not compared with rows of its own id. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import range_of, written

K = 10
SCALE = 1024
#: Vectors of a block; rows of a range; queries of a group.
BLOCK, RANGE, GROUP = 128, 4096, 8192


def scaled(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, array<long>, of the vectors that take part."""
    fine = embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return fine.where(~odd & (F.size("v") > 0)).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Doubles where sums of products are exact in them, else 64-bit integers."""
    m = np.array(vectors.tolist(), np.int64)
    return m.astype(np.float64) if m.size and np.abs(m).max() < 2**53 / m.shape[1] / 2**26 else m


class Blocks:
    """Vectors by rising id, with bounds for each block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = [ids[order[i : i + BLOCK]] for i in range(0, len(ids), BLOCK)]
        self.vectors = [vectors[order[i : i + BLOCK]] for i in range(0, len(ids), BLOCK)]
        self.most = np.array([v.max(axis=0) for v in self.vectors])
        self.least = np.array([v.min(axis=0) for v in self.vectors])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of each query's best k (score: the least value where there are fewer), and the blocks scored.

        A score below a query's floor may be left out.
        """
        none = np.iinfo(np.int64).min if queries.dtype == np.int64 else -np.inf
        best = np.full((len(queries), k), none, queries.dtype)
        found = np.zeros((len(queries), k), np.int64)
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        going, scored = np.arange(len(queries)), 0
        for turn in range(len(self.ids)):
            block = order[going, turn]
            on = bounds[going, block] >= (best[going, -1] if floors is None else np.maximum(best[going, -1], floors[going]))
            going, block = going[on], block[on]
            if not len(going):
                break
            for b in np.unique(block):
                q = going[block == b]
                scored += len(q)
                score = queries[q] @ self.vectors[b].T
                score[query_ids[q][:, None] == self.ids[b][None, :]] = none
                better = score.max(axis=1) >= best[q, -1]
                q, score = q[better], score[better]
                everything = np.hstack([best[q], score])
                names = np.hstack([found[q], np.broadcast_to(self.ids[b], score.shape)])
                top = np.lexsort((names, -everything), axis=1)[:, :k]
                best[q], found[q] = np.take_along_axis(everything, top, 1), np.take_along_axis(names, top, 1)
        return found, best, scored


def _search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        own, asked = _matrix(candidates["v"]), _matrix(queries["w"])
        if own.dtype != asked.dtype:
            own, asked = own.astype(np.int64), asked.astype(np.int64)
        floors = queries["floor"].to_numpy().astype(own.dtype)
        found, best, _ = Blocks(candidates["vec_id"].to_numpy(), own).search(queries["query_id"].to_numpy(), asked, k, floors)
        is_there = best > (np.iinfo(np.int64).min if best.dtype == np.int64 else -np.inf)
        who = np.broadcast_to(queries["query_id"].to_numpy()[:, None], found.shape)
        return pd.DataFrame({"query_id": who[is_there], "vec_id": found[is_there], "score": best[is_there].astype(np.int64)})

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: both inputs have vec_id and v."""
    rows, asked = candidates.count(), queries.count()
    groups = max(1, -(-asked // GROUP))
    bucket, ranges = range_of(candidates, "vec_id", max(1, -(-rows // RANGE)), F.xxhash64("v"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys, order = ["length", "bucket", "part"], Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    left = candidates.select("vec_id", "v", F.size("v").alias("length"), bucket.alias("bucket"), every(groups).alias("part"))
    each = lambda right: left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w"), bucket.alias("own"))
    length, part = F.size("w").alias("length"), F.pmod(F.hash("query_id"), F.lit(groups)).alias("part")
    floor = F.lit(-(2**62)).cast("long")
    first = each(own.select("query_id", "w", length, F.col("own").alias("bucket"), part, floor.alias("floor")))
    kth = written(first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")), "top-floors")
    right = own.join(kth, "query_id", "left").select("query_id", "w", length, every(ranges).alias("bucket"), part, F.coalesce("floor", floor).alias("floor"))
    return each(right).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    vectors = scaled(embeddings)
    asked = vectors.where(F.col("vec_id") % 100 == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return search(asked, vectors)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.w) = len(c.w)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
