"""Language identification by nearest centroid (operator 5).

A text's vector counts its byte 1- to 3-grams (lower case, hashed to DIMENSIONS places), damped by a logarithm, weighted
by inverse document frequency over all training rows, and normalised. Each language has a few centroids, clustered
from a bounded sample of its distinct training texts by spherical k-means, in one task per language. A text gets the language of
the centroid with the largest cosine. It is rejected if its distance from that centroid is beyond the language's
radius: the largest distance of a training sample, widened by MARGIN.

Texts that are null or have no letter get `und`, score 0, and are rejected. Without training rows every text does.
Ties go to the language that comes first by name. Repeated rows and extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.tokens import released

DIMENSIONS = 4096
CENTROIDS = 4
#: Distinct texts per language that the centroids are clustered from, at most: those of the least hashes.
SAMPLE = 800
#: The radius is the largest distance in the sample and this share of what is left up to 1.
MARGIN = 0.5
UNKNOWN = "und"
#: Texts whose vectors are held at a time, about 64 kB each; a batch from Spark may have far more rows.
ROWS = 256


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


#: ASCII letters and the bytes of all other characters stay, everything else becomes a space.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """Counts of the whole text's byte 1- to 3-grams by hashed place, over words between single spaces."""
    words = b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())
    b = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    grams = b
    total = np.bincount((grams * np.uint32(2654435761) >> np.uint32(20)).astype(np.intp), minlength=DIMENSIONS)
    for n in (2, 3):
        if len(b) < n:
            break
        grams = (grams[:-1] << np.uint32(8)) + b[n - 1 :]
        total += np.bincount((((grams ^ np.uint32(n << 28)) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.intp), minlength=DIMENSIONS)
    return total


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    v = np.empty((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(v, texts):
        row[:] = counts(text)
    np.log1p(v, out=v)
    v *= idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # languages x CENTROIDS x DIMENSIONS
    radius: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine and whether it is rejected."""
        found, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for at in range(0, len(known), ROWS):
            part = known[at : at + ROWS]
            near = vectors([texts[i] for i in part], self.idf) @ self.centroids.reshape(-1, DIMENSIONS).T
            near = near.reshape(len(part), len(self.languages), -1).max(axis=2)
            for i, row in zip(part, near):
                best = int(np.argmax(row))
                found[i], score[i] = self.languages[best], float(min(1.0, max(0.0, row[best])))
                rejected[i] = bool(1 - row[best] > self.radius[best])
        return found, score, rejected


def _frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all training rows each place occurs, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        total, rows = np.zeros(DIMENSIONS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[:-1] += counts(text) > 0
                rows += 1
        total[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(total)], ["place", "n"])

    got = training.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(DIMENSIONS + 1, np.int64)
    for place, n in got:
        total[place] = n
    return total[:-1], int(total[-1])


def _cluster(idf: np.ndarray, centroids: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("text", kind="stable")
        v = vectors(rows["text"].tolist(), idf)
        middle = v.mean(axis=0)
        picked = [int(np.argmax(v @ middle))]
        while len(picked) < min(centroids, len(v)):
            picked.append(int(np.argmin((v @ v[picked].T).max(axis=1))))  # the farthest from all so far
        c = v[picked]
        for _ in range(10):
            own = np.argmax(v @ c.T, axis=1)
            c = np.array([v[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        c = np.vstack([c, *[c[:1]] * (centroids - len(c))])
        far = float(1 - (v @ c.T).max(axis=1).min())
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "centroids": [c.astype("<f4").tobytes()], "far": [far]})

    return run


def fit(training: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """Learns from `text` and `lang` of all rows that have both."""
    training = training.select("text", "lang").where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    frequency, rows = _frequencies(training)
    idf = (np.log((1 + rows) / (1 + frequency)) + 1).astype(np.float32)
    named = training.where(F.length("text") > 0).select("lang", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    distinct = named.select("lang", "h", "g").distinct()
    sizes = {r[0]: r[1] for r in distinct.groupBy("lang").count().collect()}  # one row per language
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 2 * sample / n)]), F.col("lang")) if sizes else F.lit(1.0)
    least = distinct.where((share >= 1) | (F.col("h") / F.lit(2.0**64) + 0.5 <= share))  # about twice the sample, so that the order is of few
    least = least.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "g"))).where(F.col("i") <= sample).drop("i")
    picked = named.join(F.broadcast(least), ["lang", "h", "g"]).groupBy("lang", "h", "g").agg(F.min("text").alias("text")).select("text", "lang")  # languages x sample rows
    got = picked.groupBy("lang").applyInPandas(_cluster(idf, centroids), "lang string, centroids binary, far double").orderBy("lang").collect()
    c = np.array([np.frombuffer(r[1], "<f4").reshape(centroids, DIMENSIONS) for r in got], np.float32).reshape(len(got), centroids, DIMENSIONS)
    far = np.array([r[2] for r in got])
    return Model([r[0] for r in got], idf, c, far + MARGIN * (1 - far))


def predict(documents: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """Adds a struct of lang_pred, score and rejected; the other columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # languages x CENTROIDS x DIMENSIONS floats

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        released()
        for texts in batches:
            got = shared.value.predict(texts.tolist())
            yield pd.DataFrame(dict(zip(("lang_pred", "score", "rejected"), got)))

    return documents.withColumn(name, run(F.col("text")))


def held_out() -> Column:
    """The rows that the query keeps out of training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(documents: DataFrame) -> DataFrame:
    model = fit(documents.where(~held_out()))
    return predict(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "language.*")
