"""Retrieval for a batch of queries: lookup, vectors, full text, fusion, expansion, re-ranking and context building."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import rules as R
from lexspark.functions import text as T
from lexspark.sources.shared import written

#: Bytes of query vectors, and of their best scores, that a task holds: the queries of a block.
BLOCK_BYTES = 64 << 20
#: Queries, and chunks, whose scores a task holds at a time.
TILE = 1024


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1))[:, None]
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _best_of_task(names: np.ndarray, queries: np.ndarray, classes: list[str], least: np.ndarray, k: int):
    """Over batches of (chunk_id, doc_class, v), the k best chunks of each query and class. Scores are made in squares of TILE queries and chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = queries.shape[1]
        best = np.full((len(classes), len(names), k), -np.inf)
        found = np.zeros(best.shape, np.int64)

        def merge(c: int, at: int, score: np.ndarray, ids: np.ndarray) -> None:
            """Takes in what is as good as the kth best of a query so far."""
            mine, held = best[c, at : at + TILE], found[c, at : at + TILE]
            q, j = np.nonzero(score >= np.maximum(mine[:, -1], least[c])[:, None])
            if not len(q):
                return
            some = np.unique(q)
            row = np.concatenate([np.repeat(some, k), q])
            every, id_of = np.concatenate([mine[some].ravel(), score[q, j]]), np.concatenate([held[some].ravel(), ids[j]])
            order = np.lexsort((id_of, -every, row))
            row = row[order]
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            top = order[begin[:, None] + np.arange(k)]
            mine[some], held[some] = every[top], id_of[top]

        for batch in batches:
            ids, kinds = batch.column(0).to_numpy(), np.array([classes.index(c) for c in batch.column(1).to_pylist()], int)
            vectors = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            for c in np.unique(kinds):
                own = np.flatnonzero(kinds == c)
                for part in (own[i : i + TILE] for i in range(0, len(own), TILE)):
                    for at in range(0, len(names), TILE):
                        merge(c, at, np.round(queries[at : at + TILE] @ vectors[part].T, 6), ids[part])
        for c, name in enumerate(classes):
            for at in range(0, len(names), TILE):
                q, _ = some = np.nonzero(best[c, at : at + TILE] > -np.inf)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(names[at : at + TILE][q]), "chunk_id": pa.array(found[c, at : at + TILE][some]), "doc_class": pa.array([name] * len(q), pa.string()), "score": pa.array(best[c, at : at + TILE][some])})

    return run


def vector_search(queries: DataFrame, chunks: DataFrame, thresholds: dict[str, float], k: int = R.TOP_PER_CLASS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, chunk_id, doc_class, score, rank: the k most similar chunks per query and class at or above its threshold.

    Inputs: query_id, q; chunk_id, doc_class, v. Query vectors go in blocks of about block_bytes, with their best scores,
    to tasks that hold each Arrow batch of chunks as a matrix, and a tile of scores; a task hands on k rows per query and
    class at most, so chunks are not shuffled. Queries of one vector are answered once. Vectors of the queries' most frequent length are compared; null vectors and classes without
    a threshold take no part.
    """
    classes, schema = sorted(thresholds), "query_id long, chunk_id long, doc_class string, score double"
    every = queries.where("q is not null").select(F.col("query_id").cast("long").alias("query_id"), F.transform("q", lambda x: x.cast("double")).alias("q"))
    asked = every.groupBy("q").agg(F.min("query_id").alias("query_id")).select("query_id", "q")
    sizes = every.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not sizes or not sizes["d"]:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    d = sizes["d"]
    asked = written(asked.where(F.size("q") == d), "query-vectors")
    blocks = -(-asked.count() * (d + 2 * k * len(classes)) * 8 // block_bytes)
    vectors = chunks.where(F.col("doc_class").isin(classes) & (F.size("v") == d)).select(F.col("chunk_id").cast("long"), "doc_class", F.transform("v", lambda x: x.cast("double")).alias("v"))
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()  # about block_bytes
        if rows:
            run = _best_of_task(np.array([r[0] for r in rows]), _unit(np.array([r[1] for r in rows])), classes, np.array([thresholds[c] for c in classes]), k)
            scored = vectors.mapInArrow(run, schema)
            out = scored if out is None else out.unionByName(scored)
    order = Window.partitionBy("query_id", "doc_class").orderBy(F.desc("score"), "chunk_id")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    same = every.join(asked.withColumnRenamed("query_id", "first"), "q").select("query_id", "first")
    return best.withColumnRenamed("query_id", "first").join(same, "first").select("query_id", "chunk_id", "doc_class", "score", "rank")


def direct_lookup(queries: DataFrame, chunks: DataFrame, k: int = 6) -> DataFrame:
    """Chunks whose reference is or starts with the query's (1.0); where there are none, those with its number (0.9).

    Queries of one reference are answered once, and of the chunks of one reference only the k first can be among the k first
    of a query: what is joined are distinct references.
    """
    first = Window.partitionBy("norm_reference").orderBy("hierarchy_level", "chunk_id")
    few = chunks.where("norm_reference is not null").select("chunk_id", "hierarchy_level", "norm_reference").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r")
    keyed = few.withColumn("number", F.regexp_extract("norm_reference", r"(\d+)", 1))
    asked = queries.select("reference").distinct().withColumn("number", F.regexp_extract("reference", r"(\d+)", 1))
    same = keyed.join(asked, "number").withColumn("exact", F.ilike("norm_reference", F.concat("reference", F.lit("%"))))
    rows = same.withColumn("any_exact", F.max("exact").over(Window.partitionBy("reference"))).where("exact or not any_exact").withColumn("score", F.when(F.col("exact"), 1.0).otherwise(0.9))
    order = Window.partitionBy("reference").orderBy(F.desc("score"), "hierarchy_level", "chunk_id")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("reference", "chunk_id", "score", "rank")
    return queries.select("query_id", "reference").join(best, "reference").select("query_id", "chunk_id", "score", "rank")


def fuse(*ranked: DataFrame, k: int = R.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists with query_id, chunk_id, rank."""
    every = ranked[0].select("query_id", "chunk_id", "rank")
    for more in ranked[1:]:
        every = every.unionByName(more.select("query_id", "chunk_id", "rank"))
    return every.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.count("*").alias("lists"))


def first_seen(rows: DataFrame, ordinal: str) -> DataFrame:
    """Of the rows of a query and chunk the one with the least ordinal."""
    order = Window.partitionBy("query_id", "chunk_id").orderBy(ordinal)
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def with_parents(found: DataFrame, chunks: DataFrame, tokens: int = 450) -> DataFrame:
    """Adds parents not yet found, score 0: always of class A, of class B for long chunks and for tables."""
    tree = chunks.select("chunk_id", "parent_id", "doc_class", "token_count", "chunk_type")
    kept = (F.col("doc_class") == "A") | ((F.col("doc_class") == "B") & ((F.col("token_count") > tokens) | (F.col("chunk_type") == "tabelle")))
    wanted = found.join(tree, "chunk_id").where("parent_id is not null").where(kept)
    parents = wanted.select("query_id", F.col("parent_id").alias("chunk_id")).distinct().join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    new = parents.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return found.select("query_id", "chunk_id", "score").unionByName(new.select("query_id", "chunk_id", F.lit(0.0).alias("score")))


def with_cross_references(found: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """Adds chunks that found ones refer to, up to a depth, score 0, none twice. links: chunk_id, target."""
    reached, front = found.select("query_id", "chunk_id", "score"), found.select("query_id", "chunk_id")
    for _ in range(depth):
        front = front.join(links, "chunk_id").select("query_id", F.col("target").alias("chunk_id")).distinct().join(reached.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        reached = reached.unionByName(front.withColumn("score", F.lit(0.0)))
    return reached


def retrieved(lookup: DataFrame, lists: list[DataFrame], chunks: DataFrame, links: DataFrame | None = None, k: int = R.RRF_K) -> DataFrame:
    """query_id, chunk_id, score, direct: the whole search for all queries and classes in one plan.

    lookup: query_id, chunk_id, score of direct hits. lists: vector and full-text hits, with query_id, chunk_id, doc_class,
    rank. Per query and class the lists are fused and weighted by class. Direct hits come before class A, then B, then C,
    and a chunk counts where it is first seen. Then come parents, and with `links` the chunks that ones of class A refer to.
    What the searches have found is written once, a bounded number of rows per query, and expanded from there.
    """
    every = lists[0].select("query_id", "chunk_id", "doc_class", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", "chunk_id", "doc_class", "rank"))
    weight = T.lookup(F.col("doc_class"), {c: str(w) for c, w in R.CLASS_WEIGHTS.items()}, "1.0").cast("double")
    fused = every.groupBy("query_id", "chunk_id", "doc_class").agg(F.sum(1.0 / (k + F.col("rank"))).alias("sum"))
    fused = fused.select("query_id", "chunk_id", F.round(F.col("sum") * weight, 9).alias("score"), F.col("doc_class").alias("turn"))
    seen = written(first_seen(lookup.select("query_id", "chunk_id", "score", F.lit("").alias("turn")).unionByName(fused), "turn"), "search-hits")
    found = with_parents(seen, chunks)
    if links is not None:
        found = written(found.join(chunks.select("chunk_id", "doc_class"), "chunk_id", "left"), "search-parents")
        reached = with_cross_references(found.where("doc_class = 'A'"), links)
        found = found.drop("doc_class").unionByName(reached.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"))
    direct = seen.where("turn = ''").select("query_id", "chunk_id", F.lit(True).alias("direct"))
    return found.join(direct, ["query_id", "chunk_id"], "left").withColumn("direct", F.coalesce("direct", F.lit(False)))


def rerank(found: DataFrame, chunks: DataFrame, pre: int = R.TOP_PRE, final: int = R.TOP_FINAL, boost: float = 2.0) -> DataFrame:
    """Equal contents once (the best score, the first chunk), the best `pre`, class weights, then the best `final`.

    Where `found` says what was found directly (`direct`), the weighted scores of those chunks are multiplied by `boost`.
    """
    found = found if "direct" in found.columns else found.withColumn("direct", F.lit(False))
    rows = found.join(chunks.select("chunk_id", "doc_class", "confidence_weight", F.md5("content").alias("hash"), "token_count"), "chunk_id")
    same = Window.partitionBy("query_id", "hash")
    once = rows.withColumn("best", F.max("score").over(same)).withColumn("r", F.row_number().over(same.orderBy("chunk_id"))).where("r = 1")
    order = lambda c: Window.partitionBy("query_id").orderBy(F.desc(c), "chunk_id")
    first = once.withColumn("r", F.row_number().over(order("best"))).where(F.col("r") <= pre)
    weighted = first.withColumn("final", F.round(F.col("best") * F.col("confidence_weight") * F.when(F.col("direct"), boost).otherwise(1.0), 9))
    return weighted.withColumn("rank", F.row_number().over(order("final"))).where(F.col("rank") <= final).select("query_id", "chunk_id", F.col("final").alias("score"), "rank", "token_count")


def within_budget(ranked: DataFrame, budget: int = R.CONTEXT_BUDGET) -> DataFrame:
    """Chunks in rank order until the first that would overflow the token budget."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum("token_count").over(order)).where(F.col("used") <= budget)


def context(kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """One context per query: blocks with a preamble, in rank order."""
    rows = kept.join(chunks.select("chunk_id", "doc_class", "norm_reference", "chunk_type", "content"), "chunk_id")
    low = F.when(F.col("doc_class") == "C", "Konfidenz: niedrig")
    preamble = F.concat(F.lit("["), F.concat_ws(" | ", F.concat(F.lit("Q"), F.col("rank").cast("string")), "norm_reference", F.upper("chunk_type"), low), F.lit("]"))
    block = F.concat_ws("\n", preamble, "content")
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"), F.max("used").alias("used"), F.count("*").alias("chunks"))
