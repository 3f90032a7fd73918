"""Sinks: keyed upserts and idempotent overwrites on Parquet, chunk tables, reviews, CSV and N-Triples exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T


def upserted(old: DataFrame, new: DataFrame, key: str, changing: list[str]) -> DataFrame:
    """Old rows with the new values of the changing columns, and new rows of keys not yet there. Of equal new keys the greatest row counts."""
    one = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in changing]))).where("_r = 1").drop("_r")
    taken = one.select(key, *[F.col(c).alias(f"_{c}") for c in changing], F.lit(True).alias("_new"))
    kept = old.join(taken, key, "left")
    for c in changing:
        kept = kept.withColumn(c, F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)))
    return kept.select(*old.columns).unionByName(one.join(old.select(key), key, "left_anti").select(*old.columns))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the keys that come new go before the new ones are added, so that a repeated run changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stored_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with ids made from their place, valid types and content hashes; an unknown document is an error."""
    missing = chunks.join(documents.select("doc_id"), "doc_id", "left_anti").select("doc_id").limit(1).collect()
    if missing:
        raise ValueError(f"no document {missing[0][0]}")
    place = F.concat_ws("|", F.col("doc_id").cast("string"), "doc_class", F.col("pos").cast("string"))
    return chunks.withColumn("id", F.md5(place)).withColumn("chunk_type", T.valid_chunk_type(F.col("chunk_type"))).withColumn("content_hash", F.md5("content"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Partitioned by class; only the classes that are written anew are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_class").parquet(path)


def logged_questions(questions: DataFrame) -> DataFrame:
    """Contexts are kept to 500 characters."""
    cut = lambda c: F.substring(F.col(c), 1, 500).alias(c)
    return questions.select(*[cut(c) if c.startswith("context_") else F.col(c) for c in questions.columns])


def job_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """Non-null new values win; the end is set for done and error only."""
    n = new.select("job_id", *[F.col(c).alias(f"_{c}") for c in ("status", "error_message", "updated")])
    rows = old.join(n, "job_id", "left")
    status = F.coalesce("_status", "status")
    finished = F.when(status.isin("done", "error"), F.coalesce("_updated", "updated"))
    return rows.select("job_id", status.alias("status"), F.coalesce("_error_message", "error_message").alias("error_message"), F.coalesce("_updated", "updated").alias("updated"), finished.alias("finished"))


def reviewed(questions: DataFrame, prefix: str, decision: str) -> DataFrame:
    """Marks the questions whose id starts with a prefix."""
    hit = F.col("id").startswith(prefix)
    return questions.withColumn("decision", F.when(hit, decision).otherwise(F.col("decision"))).withColumn("reviewed", F.col("reviewed") | hit)


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolons; a byte-order mark starts the header so that spreadsheets read UTF-8."""
    marked = df.withColumnRenamed(df.columns[0], chr(0xFEFF) + df.columns[0])
    marked.write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


def write_triples(lines: DataFrame, path: str) -> None:
    """graph, value: text files per graph, each graph replaced as a whole."""
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph").text(path)


def sync_log(old: DataFrame, exported: DataFrame) -> DataFrame:
    """A row per chunk with the triples it gave; exported chunks replace their rows."""
    new = exported.groupBy("chunk_id").agg(F.count("*").alias("triple_count")).withColumn("status", F.lit("done"))
    return replaced(old.select("chunk_id", "triple_count", "status"), new, "chunk_id")
