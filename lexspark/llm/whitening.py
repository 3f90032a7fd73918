"""Embedding whitening by TSQR: principal axes from triangular factors, without forming a covariance (operator 11).

Entries become whole numbers x, so that sums are exact. The fit list is every distinct vector of whole numbers once. Its
per-dimension sums S are exact, and a row is centred as the whole number n*x - S before it is divided by n. Each
partition of the fit list reduces its centred rows to one triangular factor R, block by block; factors are stacked and
reduced again, FAN at a time, in a tree of grouped steps; the singular values and right vectors of the last R give the
eigenvalues and eigenvectors of the covariance to double precision. A task holds a block of rows and FAN factors.

Vectors that are null, empty, or hold a null or non-finite entry take no part. Vectors of each length are whitened among
themselves. Repeated rows and null ids get their rows; repeated vectors count once in the fit. A component of no
variance has explained 0 and a null whitened value. Extra columns are ignored. An entry whose whole number needs more
than 64 bits is an error; deviations are exact up to 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Factors merged in one group of the tree; rows of a block are at least this many times the dimensions.
FAN, TALL = 8, 8
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_EXACT = 2**62


def whole(embeddings: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and x, array<long>, of the vectors that take part."""
    fine = embeddings.where(F.size("embedding") > 0).select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("c"))
    odd = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return fine.where(~odd).select("vec_id", F.transform("c", lambda c: F.floor(c * scale) + F.lit(offset).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """Rows of the first column, many enough for a tall matrix."""
    held, rows = [], 0
    for batch in batches:
        held.append(_matrix(batch.column(0), d))
        rows += len(held[-1])
        if rows >= TALL * d:
            yield np.vstack(held)
            held, rows = [], 0
    if rows:
        yield np.vstack(held)


def _above(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """n*x - S as exact whole numbers, of Python's own where 64 bits are too few."""
    if not x.size:
        return x
    most = max(abs(int(x.min())), abs(int(x.max())), max(abs(s) for s in sums.tolist()) // n + 1)
    return n * x - sums.astype(np.int64) if most * n < _EXACT else n * x.astype(object) - sums


def _squares(above: np.ndarray) -> list[int]:
    """Exact sums of squares by row."""
    if above.dtype != object and above.size and int(np.abs(above).max()) ** 2 * above.shape[1] < _EXACT:
        return (above * above).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in above.tolist()]


def _summed(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Rows and exact sums by dimension; the driver sees a number per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, [0] * d
        for x in _blocks(batches, d):
            most = max(abs(int(x.min())), abs(int(x.max())))
            part = x.sum(axis=0) if most * len(x) < _EXACT else x.astype(object).sum(axis=0)
            rows, sums = rows + len(x), [a + b for a, b in zip(sums, part.tolist())]
        if rows:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, d), pa.int32()), "total": pa.array([Decimal(v) for v in [rows, *sums]], pa.decimal128(38, 0))})

    found = {r["at"]: int(r["total"]) for r in fit.mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()}
    return found[-1], np.array([found[i] for i in range(d)], object)


def _stacked(factors: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(factors), mode="r")


def triangular(fit: DataFrame, d: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The R of all centred rows: one factor a partition, then a tree of merges. The driver gets the last factor alone."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for x in _blocks(batches, d):
            r = _stacked([centred(x)] if r is None else [r, centred(x)])
        if r is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        r = _stacked([np.asarray(r).reshape(-1, d) for r in group["r"]])
        return pd.DataFrame({"node": [group["node"].iloc[0] // FAN], "r": [r.ravel()]})

    factors = written(fit.mapInArrow(leaf, "node long, r array<double>"), "whitening-factors")
    width = factors.agg(F.max("node")).first()[0] + 1
    while width > 1:
        factors = factors.groupBy(F.floor(F.col("node") / FAN).alias("parent")).applyInPandas(lambda group: merge(group[["node", "r"]]), "node long, r array<double>")
        width = -(-width // FAN)
    (last,) = factors.collect()
    return np.array(last["r"]).reshape(-1, d)


@dataclass
class Model:
    """What whitens vectors of one length: rows, exact sums, axes over square roots of eigenvalues, shares of variance."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (_above(x, self.sums, self.n) / self.n).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes


def _identity_error(fit: DataFrame, d: int, model: Model) -> float | None:
    """The largest absolute entry of the covariance of whitened rows, minus the identity, over components with variance."""
    some = np.flatnonzero(model.explained > 0)
    k = len(some)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) * k)
        for x in _blocks(batches, d):
            w = model.whitened(x)[:, some]
            total += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "total": pa.array(total)})

    found = dict(fit.mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total")).collect())
    total = np.array([found[i] for i in range((k + 1) * k)]) / model.n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Model:
    """The model of the distinct vectors of length d."""
    rows = written(vectors.where(F.size("x") == d).select("x").distinct(), "whitening-fit")
    n, sums = _summed(rows, d)
    model = Model(n, sums, np.zeros((d, 0)), np.zeros(0))
    _, s, axes = np.linalg.svd(triangular(rows, d, model.centred))
    s = np.concatenate([s, np.zeros(d - len(s))])
    s[s <= s[0] * d * np.finfo(float).eps * 4] = 0
    axes, k = axes * np.sign(axes[np.arange(d), np.abs(axes).argmax(axis=1)])[:, None], min(components, d)
    with np.errstate(divide="ignore"):
        scale = np.where(s[:k] > 0, np.sqrt(n) / s[:k], np.nan)
    model.axes, model.explained = axes[:k].T * scale, s[:k] ** 2 / max((s**2).sum(), np.finfo(float).tiny)
    model.identity_error = _identity_error(rows, d, model)
    return model


def apply(vectors: DataFrame, d: int, model: Model) -> DataFrame:
    """SCHEMA: a row for each vector of length d and each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            deviation = [Decimal(v) for v in _squares(_above(x, model.sums, model.n))]
            w = model.whitened(x)
            offsets = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), from_pandas=True))  # nan to null
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "w"])

    rows = vectors.where(F.size("x") == d).mapInArrow(run, "vec_id long, deviation decimal(38,0), w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(v)) for v in model.explained]), F.col("at"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """SCHEMA for all vectors that take part. The lengths that occur, usually one, are fitted in turn."""
    vectors = whole(embeddings).withColumn("vec_id", F.col("vec_id").cast("long"))
    lengths = sorted(r[0] for r in vectors.select(F.size("x")).distinct().collect())
    if not lengths:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, [apply(vectors, d, fit(vectors, d, components)) for d in lengths])


def query(embeddings: DataFrame) -> DataFrame:
    """`deviation` is null where it needs more than 64 bits; `deviation_exact` has it."""
    narrow = F.col("deviation").try_cast("long")
    return whiten(embeddings).select("vec_id", "component", "n", narrow.alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))
