"""A corpus pipeline of four stages over `documents`, each written as Parquet and read again by the next.

Every stage takes empty tables, any further columns, whatever their names, and returns all columns but for the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import jaccard_join, language, line_dedup, packing
from lexspark.llm.common import free, named, shared_dir, table
from lexspark.llm.tokens import vocabulary_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; the others, and those without a letter or text, go.

    Repeated rows stay repeated. Without any labelled row nothing is recognised.
    """
    found = free(docs, "language")
    return language.predict(docs, language.fit(docs), found).where(~F.col(found)["rejected"]).select(*named(docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzy copies of lines go from the texts; a document that loses all its lines stays, with an empty text.

    Null texts stay null. Rows equal in doc_id and text stay alike.
    """
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the least by doc_id, a null one first, then by text.

    Empty texts are copies of one another, null texts of nothing. Rows equal in doc_id and text count once.
    """
    return jaccard_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids as little-endian unsigned 32-bit integers. Null and empty texts are one end id."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
    return docs


#: Fuzzy stages and learned models are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None
