"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 13).

A vector's residual from its centroid, made a unit vector, is padded with zeros to BITS dimensions and rotated; the signs
of the result are its code. With o the rotated unit residual and s the code as a unit vector of signs, the product of o
with a rotated query r is estimated by <s, r> / <s, o>: the index holds the packed bits and the scalars of that formula
(norm of the residual, <s, o>, and <s, rotated centroid>, by which one rotation of the query does for all centroids). The
estimate errs by a multiple of sqrt((1 - <s, o>^2) / <s, o>^2 / (BITS - 1)), and EPSILON of it bounds the distance from
both sides in all but a few cases in a hundred. Short vectors get BITS bits all the same, and so tighter bounds.

Centroids come from a few rounds of k-means on the SAMPLE vectors of least hashes; every vector is encoded. Queries go in
turns of about TURN. In each turn the codes, read without the vectors, are met twice: tasks give the k least upper bounds of
each query, of which the kth least over all tasks is the query's limit; then every code whose lower bound is within it is a
candidate. Only candidates' vectors are fetched, for exact distances, and the k nearest stay. A task holds a batch of codes
and the turn's queries; the driver sees the sample, and the queries and limits of a turn.

Only vectors of one length are compared. Vectors that are null, empty, zero, or hold a null or non-finite component, and
rows without an id, take no part. Of rows with one id the smallest vector is the query; a query is not compared with rows
of its own id. Repeated rows are candidates each. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import shared_dir, written

K = 10
BITS, EPSILON = 256, 1.9
SAMPLE, CENTROIDS, ROUNDS, SEED = 4096, 16, 8, 7
#: Queries of a turn, about; codes met at once.
TURN, BATCH = 2048, 2048
ANSWER = "query_id long, rank int, vec_id long, score double"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, array<double>, of the vectors that take part."""
    fine = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    fine = fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return fine.where(~odd & F.exists("v", lambda x: x != 0))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


@dataclass
class Codes:
    """Centroids, and the rotation of d dimensions into as many as a code has bits."""

    centroids: np.ndarray
    rotation: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int = BITS, centroids: int = CENTROIDS) -> Codes:
        rng, d = np.random.default_rng(SEED), sample.shape[1]
        centres = sample[rng.choice(len(sample), min(centroids, max(1, len(sample) // 64)), replace=False)]
        for _ in range(ROUNDS):
            near = _squared(sample, centres).argmin(axis=1)
            centres = np.array([sample[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        rotation = np.linalg.qr(rng.normal(size=(max(bits, -(-d // 8) * 8), d)))[0]  # the first d columns of a rotation
        return cls(centres, rotation.T)

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """centroid, packed code, norm, <s, o>, <s, rotated centroid>."""
        near = _squared(v, self.centroids).argmin(axis=1)
        rest = v - self.centroids[near]
        norm = np.sqrt((rest * rest).sum(axis=1))
        o = (rest / np.where(norm > 0, norm, 1)[:, None]) @ self.rotation
        bits = o > 0
        signs = np.where(bits, 1.0, -1.0) / np.sqrt(self.bits)
        own = np.where(norm > 0, (signs * o).sum(axis=1), 1.0)
        return near, np.packbits(bits, axis=1), norm, own, np.einsum("nb,nb->n", signs, (self.centroids @ self.rotation)[near])

    def bounds(self, near: np.ndarray, codes: np.ndarray, norm: np.ndarray, own: np.ndarray, of_centre: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances, codes by queries."""
        rotated = queries @ self.rotation
        ones = np.unpackbits(codes, axis=1, count=self.bits).astype(np.float64)
        product = ((2 * (ones @ rotated.T) - rotated.sum(axis=1)) / np.sqrt(self.bits) - of_centre[:, None]) / own[:, None]
        apart = _squared(self.centroids, queries)[near]
        middle = (norm * norm)[:, None] + apart - 2 * norm[:, None] * product
        error = 2 * EPSILON * (norm * np.sqrt(np.maximum(1 - own * own, 0) / (own * own) / (self.bits - 1)))[:, None] * np.sqrt(apart)
        return middle - error, middle + error


def _batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns key, vec_id, centroid, code, norm, own, of_centre of BATCH rows or so."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            yield _columns(held, bits)
            held, rows = [], 0
    if rows:
        yield _columns(held, bits)


def _columns(held: list[pa.RecordBatch], bits: int) -> tuple[np.ndarray, ...]:
    table = pa.Table.from_batches(held)
    key, vec_id, near, codes, *scalars = (table.column(i).combine_chunks() for i in range(7))
    packed = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, bits // 8)
    return key.to_numpy(), vec_id.to_numpy(), near.to_numpy(), packed, *(s.to_numpy() for s in scalars)


CODES = ["key", "vec_id", "centroid", "code", "norm", "own", "of_centre"]


def index(vectors: DataFrame, model: Codes) -> DataFrame:
    """A table of codes beside the vectors, column by column, with a key for each row."""
    d = model.rotation.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, codes, *scalars = model.encode(_rows(batch.column(1), d))
            columns = [pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, scalars)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["vec_id", "v", *CODES[2:]])

    coded = vectors.where(F.size("v") == d).mapInArrow(run, "vec_id long, v array<double>, centroid int, code binary, norm double, own double, of_centre double")
    return written(coded.withColumn("key", F.monotonically_increasing_id()), "bit-codes")  # fixed by being written


def limits(codes: DataFrame, model: Codes, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The kth least upper bound of each query; infinite where there are fewer codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full((len(ids), k), np.inf)
        for _, vec_id, *code in _batches(batches, model.bits):
            upper = np.where(vec_id[:, None] == ids, np.inf, model.bounds(*code, queries)[1]).T
            least = np.partition(np.hstack([least, np.nan_to_num(upper, nan=np.inf)]), k - 1, axis=1)[:, :k]
        who, some = np.repeat(np.arange(len(ids)), k), np.isfinite(least).ravel()
        yield pa.RecordBatch.from_pydict({"query": pa.array(who[some], pa.int32()), "upper": pa.array(least.ravel()[some])})

    order = Window.partitionBy("query").orderBy("upper")
    kth = codes.select(CODES).mapInArrow(run, "query int, upper double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    found = np.full(len(ids), np.inf)
    for row in kth.collect():
        found[row["query"]] = row["upper"]
    return found


def candidates(codes: DataFrame, model: Codes, ids: np.ndarray, queries: np.ndarray, limit: np.ndarray) -> DataFrame:
    """query_id and key of every code, not of the query's own id, that may be within the query's limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, vec_id, *code in _batches(batches, model.bits):
            row, query = np.nonzero(~(model.bounds(*code, queries)[0] > limit) & (vec_id[:, None] != ids))
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[query]), "key": pa.array(key[row])})

    return codes.select(CODES).mapInArrow(run, "query_id long, key long")


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x))


def _turn(coded: DataFrame, asked: DataFrame, model: Codes, k: int) -> DataFrame | None:
    rows = asked.select("vec_id", "v").collect()  # about TURN
    if not rows:
        return None
    ids, queries = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    met = candidates(coded, model, ids, queries, limits(coded, model, ids, queries, k))
    pairs = met.join(coded.select("key", "vec_id", "v"), "key").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w")), "query_id")
    scored = pairs.select("query_id", "vec_id", _distance(F.col("v"), F.col("w")).alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """ANSWER: both inputs have vec_id and v, the queries each id once. The lengths that occur, usually one, are searched in turn."""
    spark = vectors.sparkSession
    place = f"{shared_dir(spark)}/neighbours-{uuid.uuid4().hex}"
    asked = written(queries.select("vec_id", "v"), "neighbour-queries")
    for d, many in sorted(map(tuple, asked.groupBy(F.size("v")).count().collect())):
        own = vectors.where(F.size("v") == d)
        sample = own.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).collect()
        if not sample:
            continue
        model = Codes.fit(np.array([r["v"] for r in sample]))
        coded, turns = index(own, model), -(-many // TURN)
        for turn in range(turns):
            found = _turn(coded, asked.where((F.size("v") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(turns)) == turn)), model, k)
            if found is not None:
                found.write.mode("append").parquet(place)
    spark.createDataFrame([], ANSWER).write.mode("append").parquet(place)
    return spark.read.schema(ANSWER).parquet(place)


def query(embeddings: DataFrame) -> DataFrame:
    vectors = usable(embeddings)
    return search(vectors.where(F.col("vec_id") % 100 == 0).groupBy("vec_id").agg(F.min("v").alias("v")), vectors)
