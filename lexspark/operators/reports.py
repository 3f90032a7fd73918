"""Grouped reports over documents, chunks, statements, entities, jobs and questions.

Groupings combine before the shuffle; top lists end in a bounded sort with a tie-breaker; shares divide by a total over
the few grouped rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(n: str, digits: int = 2) -> Column:
    """Percent of the total over an already grouped, small frame."""
    return F.round(F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy(F.lit(0))), digits)


def flag(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def top(df: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key).limit(n)


def norm_type_distribution(svo: DataFrame) -> DataFrame:
    grouped = svo.groupBy("norm_type").agg(F.count("*").alias("n"), F.round(F.avg("norm_confidence"), 3).alias("avg_confidence"), F.round(F.min("norm_confidence"), 3).alias("min_confidence"))
    return grouped.withColumn("percent", share("n"))


def svo_completeness(svo: DataFrame) -> DataFrame:
    has = lambda c: F.col(c).isNotNull()
    return svo.agg(
        F.count("*").alias("total"), flag(has("subject")).alias("with_subject"), flag(has("object")).alias("with_object"), flag(has("subject") & has("object")).alias("complete"),
        flag(F.lower("subject").isin("er", "sie", "es", "man")).alias("pronouns"), F.round(F.avg("confidence"), 3).alias("avg_confidence"),
        F.round(F.avg("norm_confidence"), 3).alias("avg_norm_confidence"), F.round(flag(has("subject")) * 100.0 / F.nullif(F.count("*"), F.lit(0)), 1).alias("subject_percent"))


def ner_by_source(ner: DataFrame) -> DataFrame:
    return ner.groupBy("label", "source").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def model_share(ner: DataFrame) -> DataFrame:
    return ner.agg(F.round(flag(F.col("source") == "flair") * 100.0 / F.nullif(F.count("*"), F.lit(0)), 1).alias("flair_percent"), F.count("*").alias("total"))


def document_overview(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document, also those without chunks."""
    per = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), flag(F.col("has_embedding")).alias("with_embedding"), flag(F.size("abbrevs") > 0).alias("with_abbrevs"),
        F.max("doc_class").alias("doc_class"), F.sum("token_count").alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id", "title").join(per, "doc_id", "left").select("doc_id", "title", zero("chunks"), zero("with_embedding"), zero("with_abbrevs"), "doc_class", zero("tokens"))


def chunk_statistics(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    per = chunks.groupBy("doc_id").agg(
        flag(F.col("hierarchy_level") == 1).alias("parents"), flag(F.col("hierarchy_level") > 1).alias("children"), F.sum("token_count").alias("tokens"),
        F.round(F.avg("token_count"), 6).alias("avg_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"))
    return docs.select("doc_id", "title").join(per, "doc_id")


def abbreviation_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document the resolved abbreviations, each distinct list once."""
    lists = chunks.where(F.size("abbrevs") > 0).groupBy("doc_id", "abbrevs").agg(F.min(F.size("abbrevs")).alias("n"))
    sums = lists.groupBy("doc_id").agg(F.sum("n").alias("n"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("abbreviations"))


def coverage(chunks: DataFrame, found: DataFrame) -> DataFrame:
    covered = found.agg(F.countDistinct("chunk_id").alias("covered"))
    total = chunks.agg(F.count("*").alias("chunks"))
    both = covered.join(total)  # one row each
    return both.select("covered", "chunks", F.round(F.col("covered") * 100.0 / F.nullif("chunks", F.lit(0)), 1).alias("percent"))


def recommendations(svo: DataFrame) -> DataFrame:
    rate = lambda c: F.round(flag(c) * 100.0 / F.nullif(F.count("*"), F.lit(0)), 1)
    rates = svo.agg(rate(F.col("norm_type") == "UNKNOWN").alias("unknown_percent"), rate(F.col("object").isNull()).alias("no_object_percent"))
    return rates.withColumn("advice", F.concat_ws(";", F.when(F.col("unknown_percent") > 20, "extend patterns"), F.when(F.col("no_object_percent") > 50, "check objects")))


def job_state(events: DataFrame) -> DataFrame:
    """A job per user: its state is that of its latest event; error wins as message; finished only for done or error."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    per = events.groupBy("user_id").agg(last.alias("event_type"), F.max("ts").alias("updated"), F.min("ts").alias("started"), F.count("*").alias("updates"), flag(F.col("event_type") == "error").alias("errors"))
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("parsing")
    seconds = F.when(status.isin("done", "error"), F.unix_timestamp("updated") - F.unix_timestamp("started"))
    return per.select("user_id", status.alias("status"), "updates", "errors", seconds.cast("long").alias("seconds"))


def bundle_state(jobs: DataFrame) -> DataFrame:
    """Bundles of jobs by user_id % 7: counters, pending, and the derived status."""
    done, failed = flag(F.col("status") == "done"), flag(F.col("status") == "error")
    per = jobs.groupBy((F.col("user_id") % 7).alias("bundle")).agg(F.count("*").alias("total"), done.alias("done"), failed.alias("errors"))
    pending = F.greatest(F.lit(0), F.col("total") - F.col("done") - F.col("errors"))
    status = F.when(pending > 0, "running").when(F.col("errors") == 0, "done").when(F.col("done") == 0, "error").otherwise("partial")
    return per.select("bundle", "total", "done", "errors", pending.cast("long").alias("pending"), status.alias("status"))


def open_questions(questions: DataFrame, title_part: str | None = None) -> DataFrame:
    """Questions that nobody has reviewed, of documents whose title has a part, in any case."""
    rows = questions.where(~F.col("reviewed"))
    return rows if title_part is None else rows.where(F.col("title").ilike(f"%{title_part}%"))


def jobs_of_documents(jobs: DataFrame, docs: DataFrame, title_part: str, limit: int = 50) -> DataFrame:
    """The latest jobs of documents whose title has a part; jobs name documents by text."""
    named = docs.where(F.col("title").ilike(f"%{title_part}%")).select(F.col("doc_id").cast("string").alias("doc_id"), "title")
    return jobs.join(named, "doc_id").orderBy(F.desc("ts"), "event_id").limit(limit)
