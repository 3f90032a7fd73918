"""Document types from scored rules, query plans, and records from model answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import rules as R
from lexspark.functions import text as T

#: Parts of a norm that its citations name.
NORM_PARTS = [r"\bAbs\.\s*\d", r"\bSatz\s*\d", r"\bNr\.\s*\d"]


def document_type(title: Column, filename: Column, text: Column, rules: dict[str, dict]) -> Column:
    """The best-scored type that reaches its minimum, else `text`.

    rules: type -> title, filename and signals (patterns), min_paragraphs, max_paragraphs, question_share, minimum, and
    whether two of Abs., Satz and Nr. (norm_structure), a table of contents (toc), ids of requirements (requirements) count.
    Title .40, filename .30, signals .05 each up to .20 (first 5000 characters), structure .10 or .05 each.
    """
    head = F.substring(text, 1, 5000)
    paragraphs = F.regexp_count(text, F.lit(r"§\s*\d+"))
    questions = F.try_divide(F.regexp_count(text, F.lit(r"\?")).cast("double"), F.regexp_count(text, F.lit(r"[.!?]")).cast("double"))
    bonus = lambda c, w: F.when(c, w).otherwise(0.0)
    scored = []
    for name, rule in rules.items():
        hits = sum((bonus(F.lower(head).rlike(p), 0.05) for p in rule.get("signals", [])), F.lit(0.0))
        score = F.lit(0.0) + F.least(F.lit(0.20), hits)
        if rule.get("title"):
            score += bonus(F.lower(title).rlike(R.unbordered(rule["title"])), 0.40)
        if rule.get("filename"):
            score += bonus(F.lower(filename).rlike(R.unbordered(rule["filename"])), 0.30)
        if "min_paragraphs" in rule:
            score += bonus(paragraphs >= rule["min_paragraphs"], 0.10)
        if "max_paragraphs" in rule:
            score += bonus(paragraphs <= rule["max_paragraphs"], 0.05)
        if rule.get("norm_structure"):
            score += bonus(sum((F.when(text.rlike(p), 1).otherwise(0) for p in NORM_PARTS), F.lit(0)) >= 2, 0.10)
        if rule.get("toc"):
            score += bonus(T.structure(text)["toc"], 0.10)
        if rule.get("requirements"):
            score += bonus(text.rlike(r"\b[A-Z]-\d{3}\b"), 0.10)
        if "question_share" in rule:
            score += bonus((F.length(text) > 100) & (F.coalesce(questions, F.lit(0.0)) >= rule["question_share"]), 0.10)
        scored.append(F.when(score >= rule["minimum"], F.struct(F.round(score, 4).alias("score"), F.lit(-len(scored)).alias("order"), F.lit(name).alias("name"))))
    return F.coalesce(F.array_max(F.array(*scored))["name"], F.lit("text"))


def repaired(answer: str | None) -> str | None:
    """The first JSON value in an answer, without a code fence; a cut-off list keeps its whole objects. Null if there is none."""
    text = (answer or "").strip()
    start = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if start < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(text[start:])
        return json.dumps(value, ensure_ascii=False)
    except ValueError:
        pass
    found, at = [], start + 1
    while text[start] == "[" and (at := text.find("{", at)) >= 0:
        try:
            value, used = json.JSONDecoder().raw_decode(text[at:])
        except ValueError:
            break
        found.append(value)
        at += used
    return json.dumps(found, ensure_ascii=False) if found else None


def json_of(answer: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for answers in batches:
            yield answers.map(repaired)

    return run(answer)


def answered_labels(answers: DataFrame) -> DataFrame:
    """batch, n, norm_type, level: the records of each answer by their place. answers: batch, answer."""
    parsed = answers.select("batch", F.from_json(json_of(F.col("answer")), "array<struct<id:string,norm_type:string,konfidenz:string>>").alias("r"))
    rows = parsed.select("batch", F.posexplode("r").alias("n", "x"))
    valid = F.when(F.col("x.norm_type").isin([n for n, _, _ in R.NORM_TYPES]), F.col("x.norm_type")).otherwise("UNKNOWN")
    return rows.select("batch", (F.col("n") + 1).alias("n"), valid.alias("norm_type"), F.lower("x.konfidenz").alias("level"))


def generated_answer(answer: Column) -> Column:
    """antwort, normtyp, quellen, konfidenz, hinweis, nicht_beantwortbar of a generated answer, with defaults."""
    read = F.from_json(json_of(answer), "struct<antwort:string,normtyp:string,quellen:array<string>,konfidenz:string,hinweis:string,nicht_beantwortbar:boolean>")
    return F.struct(
        F.coalesce(read["antwort"], F.trim(answer)).alias("antwort"), F.coalesce(read["normtyp"], F.lit("UNKNOWN")).alias("normtyp"), F.coalesce(read["quellen"], F.array().cast("array<string>")).alias("quellen"),
        F.coalesce(read["konfidenz"], F.lit("niedrig")).alias("konfidenz"), read["hinweis"].alias("hinweis"), F.coalesce(read["nicht_beantwortbar"], F.lit(False)).alias("nicht_beantwortbar"))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """percent, rate (per second) and eta (seconds)."""
    rate = F.try_divide(done.cast("double"), seconds.cast("double"))
    return F.struct(F.round(F.try_divide(done * 100.0, total), 1).alias("percent"), F.round(rate, 3).alias("rate"), F.round(F.try_divide((total - done).cast("double"), rate), 0).cast("long").alias("eta"))


def query_plan(queries: DataFrame) -> DataFrame:
    """query_id, strategy, weight, text: the query itself, a step back for norm questions, a hypothetical answer unless it has a reference.

    Given variants (columns `hyde`, `step_back`) are used where they are not null.
    """
    kind, reference = T.query_type(F.col("text")), T.query_reference(F.col("text"))
    each = F.array(
        F.struct(F.lit("direct").alias("strategy"), F.lit(1.0).alias("weight"), F.col("text").alias("variant")),
        F.struct(F.lit("hyde").alias("strategy"), F.lit(0.8).alias("weight"), F.when(reference.isNull(), F.col("hyde")).alias("variant")),
        F.struct(F.lit("step_back").alias("strategy"), F.lit(0.6).alias("weight"), F.when(kind == "NORM", F.col("step_back")).alias("variant")))
    rows = queries.select("query_id", kind.alias("kind"), reference.alias("reference"), F.explode(each).alias("x"))
    classes = F.when(F.col("kind") == "NORM", "A").when(F.col("kind").isin("IM", "ENTITY"), "A,B")
    return rows.where("x.variant is not null").select("query_id", "kind", "reference", "x.strategy", "x.weight", F.col("x.variant").alias("text"), classes.alias("classes"), (F.col("kind") == "IM").alias("needs_signals"))


def ranked_jobs(jobs: DataFrame) -> DataFrame:
    """The newest first, numbered per status."""
    return jobs.withColumn("n", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("updated"), "job_id")))
