"""Every query of the library by name, with the SQL that gives the same rows where SQL can express it.

Names start with the operator's id. A query gets `Views` and returns a DataFrame of scalar columns.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import abbreviations as A
from lexspark.functions import rules as R
from lexspark.functions import text as T
from lexspark.operators import chunking, extraction, fulltext, graph, reports, retrieval, statements, trees
from lexspark.plans.adapters import Views, with_views
from lexspark.sources import files, shared, sinks, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = datetime.date(2025, 1, 1)


def query(name: str, make: Callable[[Views], DataFrame], sql: str = "", *views: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(Views(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = with_views(sql, *views)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg_01_norm_type_distribution"](spark, sf_dir)


C = F.col


def pick_extension(key):
    return F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".TXT", ".xls", "")]), (key % 4 + 1).cast("int"))


def n(name: str = "n"):
    return F.count("*").alias(name)


# ---- distributions, totals and overviews
query("agg_01_norm_type_distribution", lambda v: reports.norm_type_distribution(v.svo), """
SELECT norm_type, count(*) AS n, round(avg(norm_confidence), 3) AS avg_confidence, round(min(norm_confidence), 3) AS min_confidence,
  round(count(*)::DOUBLE * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM svo GROUP BY norm_type""", "svo")
query("agg_02_svo_completeness", lambda v: reports.svo_completeness(v.svo), """
SELECT count(*) AS total, CAST(sum((subject IS NOT NULL)::INT) AS BIGINT) AS with_subject, CAST(sum((object IS NOT NULL)::INT) AS BIGINT) AS with_object,
  CAST(sum((subject IS NOT NULL AND object IS NOT NULL)::INT) AS BIGINT) AS complete, CAST(sum(CASE WHEN lower(subject) IN ('er', 'sie', 'es', 'man') THEN 1 ELSE 0 END) AS BIGINT) AS pronouns,
  round(avg(confidence), 3) AS avg_confidence, round(avg(norm_confidence), 3) AS avg_norm_confidence, round(sum((subject IS NOT NULL)::INT)::DOUBLE * 100.0 / nullif(count(*), 0), 1) AS subject_percent FROM svo""", "svo")
for name, column in (("agg_03_top_subjects", "subject"), ("agg_03_top_objects", "object")):
    query(name, lambda v, c=column: reports.top(v.svo, c, 10), f"SELECT {column}, count(*) AS n FROM svo WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY n DESC, {column} LIMIT 10", "svo")
query("agg_04_ner_by_source", lambda v: reports.ner_by_source(v.ner), "SELECT label, source, count(*) AS n, round(avg(confidence), 3) AS avg_confidence FROM ner GROUP BY label, source", "ner")
query("agg_04_model_share", lambda v: reports.model_share(v.ner), "SELECT round(sum((source = 'flair')::INT)::DOUBLE * 100.0 / nullif(count(*), 0), 1) AS flair_percent, count(*) AS total FROM ner", "ner")
query("agg_05_top_entities", lambda v: v.ner.where(C("confidence") > 0.7).groupBy("text", "label").agg(n()).orderBy(F.desc("n"), "text", "label").limit(20),
      "SELECT text, label, count(*) AS n FROM ner WHERE confidence > 0.7 GROUP BY text, label ORDER BY n DESC, text, label LIMIT 20", "ner")
query("agg_06_distinct_entities", lambda v: v.ner.groupBy("label").agg(n("occurrences"), F.countDistinct("text").alias("different")),
      "SELECT label, count(*) AS occurrences, count(DISTINCT text) AS different FROM ner GROUP BY label", "ner")
for name, kind in (("agg_07_svo_coverage", "svo"), ("agg_07_ner_coverage", "ner")):
    query(name, lambda v, k=kind: reports.coverage(v.chunks, getattr(v, k)), f"""SELECT covered, chunks, round(covered::DOUBLE * 100.0 / nullif(chunks, 0), 1) AS percent
FROM (SELECT count(DISTINCT chunk_id) AS covered FROM {kind}), (SELECT count(*) AS chunks FROM chunks)""", kind)
query("agg_08_document_overview", lambda v: reports.document_overview(v.docs, v.chunks), """
SELECT d.doc_id, d.title, count(c.chunk_id) AS chunks, CAST(coalesce(sum(c.has_embedding::INT), 0) AS BIGINT) AS with_embedding, CAST(coalesce(sum((len(c.abbrevs) > 0)::INT), 0) AS BIGINT) AS with_abbrevs,
  max(c.doc_class) AS doc_class, CAST(coalesce(sum(c.token_count), 0) AS BIGINT) AS tokens FROM docs d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id, d.title""", "docs", "chunks")
query("agg_09_overview_by_class_and_day", lambda v: v.docs.join(v.chunks.drop("doc_class"), "doc_id").groupBy("doc_class", "ingest_day").agg(F.countDistinct("doc_id").alias("documents"), n("chunks")),
      "SELECT d.doc_class, d.ingest_day, count(DISTINCT d.doc_id) AS documents, count(*) AS chunks FROM docs d JOIN chunks c USING (doc_id) GROUP BY d.doc_class, d.ingest_day", "docs", "chunks")
query("agg_10_chunk_statistics", lambda v: reports.chunk_statistics(v.docs, v.chunks), """
SELECT d.doc_id, d.title, CAST(sum((hierarchy_level = 1)::INT) AS BIGINT) AS parents, CAST(sum((hierarchy_level > 1)::INT) AS BIGINT) AS children, CAST(sum(token_count) AS BIGINT) AS tokens,
  round(avg(token_count), 6) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens FROM docs d JOIN chunks c USING (doc_id) GROUP BY d.doc_id, d.title""", "docs", "chunks")
query("agg_11_chunk_types_by_class", lambda v: v.chunks.groupBy("doc_class", "chunk_type").agg(n(), F.round(F.avg("token_count")).cast("long").alias("avg_tokens"), F.round(F.avg("confidence_weight"), 2).alias("avg_weight")),
      "SELECT doc_class, chunk_type, count(*) AS n, CAST(round(avg(token_count)) AS BIGINT) AS avg_tokens, round(avg(confidence_weight), 2) AS avg_weight FROM chunks GROUP BY doc_class, chunk_type", "chunks")
query("agg_12_levels", lambda v: v.chunks.groupBy("doc_class", "hierarchy_level").agg(n()), "SELECT doc_class, hierarchy_level, count(*) AS n FROM chunks GROUP BY doc_class, hierarchy_level", "chunks")
query("agg_13_chunk_types_by_document", lambda v: v.chunks.groupBy("doc_id", "chunk_type").agg(n()), "SELECT doc_id, chunk_type, count(*) AS n FROM chunks GROUP BY doc_id, chunk_type", "chunks")
query("agg_14_token_median", lambda v: v.chunks.groupBy("doc_class").agg(F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.round(F.avg("token_count"), 2).alias("mean"), F.round(F.expr("percentile(token_count, 0.5)"), 2).alias("median")),
      "SELECT doc_class, min(token_count) AS least, max(token_count) AS most, round(avg(token_count), 2) AS mean, round(quantile_cont(token_count, 0.5), 2) AS median FROM chunks GROUP BY doc_class", "chunks")
query("agg_15_embedding_completeness", lambda v: v.chunks.agg(n("chunks"), reports.flag(C("has_embedding")).alias("embedded"), reports.flag(~C("has_embedding")).alias("missing")),
      "SELECT count(*) AS chunks, CAST(sum(has_embedding::INT) AS BIGINT) AS embedded, CAST(sum((NOT has_embedding)::INT) AS BIGINT) AS missing FROM chunks", "chunks")
query("agg_16_abbreviation_frequency", lambda v: v.chunks.select(F.explode("abbrevs").alias("abbrev"), "doc_id").groupBy("abbrev").agg(n(), F.countDistinct("doc_id").alias("documents")),
      "SELECT abbrev, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT unnest(abbrevs) AS abbrev, doc_id FROM chunks) GROUP BY abbrev", "chunks")
query("agg_18_job_totals", lambda v: reports.job_state(v.jobs).where("status = 'done'").agg(n("jobs"), F.sum("updates").cast("long").alias("updates"), F.sum("seconds").cast("long").alias("seconds")), """
SELECT count(*) AS jobs, CAST(sum(updates) AS BIGINT) AS updates, CAST(sum(seconds) AS BIGINT) AS seconds FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, count(*) AS updates, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM events GROUP BY user_id) WHERE last = 'purchase'""")
query("agg_19_recommendations", lambda v: reports.recommendations(v.svo), """
SELECT *, concat_ws(';', CASE WHEN unknown_percent > 20 THEN 'extend patterns' END, CASE WHEN no_object_percent > 50 THEN 'check objects' END) AS advice FROM (
SELECT round(sum((norm_type = 'UNKNOWN')::INT)::DOUBLE * 100.0 / nullif(count(*), 0), 1) AS unknown_percent, round(sum((object IS NULL)::INT)::DOUBLE * 100.0 / nullif(count(*), 0), 1) AS no_object_percent FROM svo)""", "svo")
query("agg_20_sync_statistics", lambda v: v.chunks.where(C("chunk_id") % 3 == 0).join(v.docs.select("doc_id", "title"), "doc_id").groupBy("title").agg(n("exported"), F.sum(C("token_count") % 9).cast("long").alias("triples")),
      "SELECT title, count(*) AS exported, CAST(sum(token_count % 9) AS BIGINT) AS triples FROM chunks JOIN docs USING (doc_id) WHERE chunk_id % 3 = 0 GROUP BY title", "docs", "chunks")
query("agg_21_law_references", lambda v: v.chunks.select("doc_id", F.explode(T.cross_references(C("content"))).alias("ref")).distinct().groupBy("ref").agg(n("documents")).orderBy(F.desc("documents"), "ref").limit(100), rf"""
SELECT ref, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(list_distinct(regexp_extract_all(content, '{T.CROSS_REFERENCE}'))[1:10]) AS ref FROM chunks) GROUP BY ref ORDER BY documents DESC, ref LIMIT 100""", "chunks")
query("agg_22_unknown_predicates", lambda v: reports.top(v.svo.where("norm_type = 'UNKNOWN'").withColumn("lemma", F.lower("predicate")), "lemma", 30),
      "SELECT lower(predicate) AS lemma, count(*) AS n FROM svo WHERE norm_type = 'UNKNOWN' AND predicate IS NOT NULL GROUP BY 1 ORDER BY n DESC, lemma LIMIT 30", "svo")
query("agg_23_totals", lambda v: v.svo.agg(n("statements")).join(v.ner.agg(n("entities"))), "SELECT (SELECT count(*) FROM svo) AS statements, (SELECT count(*) FROM ner) AS entities", "svo", "ner")
query("agg_25_entity_frequency", lambda v: v.ner.groupBy("text", "label", "norm_reference").agg(n()).orderBy(F.desc("n"), "text", "label", "norm_reference").limit(30),
      "SELECT text, label, c.norm_reference, count(*) AS n FROM ner JOIN chunks c USING (chunk_id) GROUP BY text, label, c.norm_reference ORDER BY n DESC, text, label, c.norm_reference NULLS FIRST LIMIT 30", "ner")
query("agg_26_ner_by_document", lambda v: v.ner.groupBy("doc_id", "label").agg(n()), "SELECT doc_id, label, count(*) AS n FROM ner GROUP BY doc_id, label", "ner")
query("agg_27_chunk_counts", lambda v: v.chunks.groupBy("doc_id").agg(n("chunks")), "SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY doc_id", "chunks")
query("snk_08_agg_28_bundles", lambda v: reports.bundle_state(reports.job_state(v.jobs)), """
SELECT bundle, total, done, errors, CAST(greatest(0, total - done - errors) AS BIGINT) AS pending,
  CASE WHEN total - done - errors > 0 THEN 'running' WHEN errors = 0 THEN 'done' WHEN done = 0 THEN 'error' ELSE 'partial' END AS status
FROM (SELECT user_id % 7 AS bundle, count(*) AS total, CAST(sum((last = 'purchase')::INT) AS BIGINT) AS done, CAST(sum((last = 'error')::INT) AS BIGINT) AS errors
  FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id) GROUP BY 1)""")

# ---- filters and projections
query("fil_01_title_contains", lambda v: v.docs.where(C("title").ilike("%KUMENT 1%")).select("doc_id", "title"), "SELECT doc_id, title FROM docs WHERE title ILIKE '%KUMENT 1%'", "docs")
query("fil_02_valid_on_day", lambda v: v.docs.where(F.coalesce(C("valid_to") >= F.lit(AS_OF), F.lit(True))).select("doc_id", "valid_to"), "SELECT doc_id, valid_to FROM docs WHERE valid_to IS NULL OR valid_to >= DATE '2025-01-01'", "docs")
query("fil_03_class_and_source", lambda v: v.docs.where(C("doc_class").isin("A", "B") & C("source_type").isin("gesetz", "verordnung", "standard")).select("doc_id", "doc_class", "source_type"),
      "SELECT doc_id, doc_class, source_type FROM docs WHERE doc_class IN ('A', 'B') AND source_type IN ('gesetz', 'verordnung', 'standard')", "docs")
query("fil_04_with_abbreviations", lambda v: v.chunks.where(F.size("abbrevs") > 0).select("chunk_id", F.array_join("abbrevs", ",").alias("abbrevs")), "SELECT chunk_id, array_to_string(abbrevs, ',') AS abbrevs FROM chunks WHERE len(abbrevs) > 0", "chunks")
query("fil_05_reference_pattern", lambda v: v.chunks.where(C("norm_reference").ilike("§ 1%") | C("norm_reference").ilike("§%5%")).select("chunk_id", "norm_reference"),
      "SELECT chunk_id, norm_reference FROM chunks WHERE norm_reference ILIKE '§ 1%' OR norm_reference ILIKE '§%5%'", "chunks")
query("fil_07_any_of", lambda v: v.chunks.where(F.array_contains("abbrevs", "BGB")).select("chunk_id"), "SELECT chunk_id FROM chunks WHERE list_contains(abbrevs, 'BGB')", "chunks")
query("fil_08_confident", lambda v: statements.found_once(v.svo.select("svo_id", "confidence"), "confidence").where(C("confidence") > 0.7), "SELECT svo_id, confidence FROM svo WHERE confidence > 0.7", "svo")
query("fil_09_short_chunks", lambda v: v.chunks.where((F.length(F.trim("content")) < 60) | ((C("doc_class") == "A") & C("norm_reference").isNull())).select("chunk_id", "content"),
      "SELECT chunk_id, content FROM chunks WHERE length(trim(content, ' ')) < 60 OR (doc_class = 'A' AND norm_reference IS NULL)", "chunks")
query("fil_11_complete_statements", lambda v: v.svo.where("subject is not null and object is not null and norm_type in ('MUST', 'MUST_NOT')").select("svo_id", "subject", "predicate", "object", "norm_type"),
      "SELECT svo_id, subject, predicate, object, norm_type FROM svo WHERE subject IS NOT NULL AND object IS NOT NULL AND norm_type IN ('MUST', 'MUST_NOT')", "svo")
query("fil_12_nonempty_chunks", lambda v: v.chunks.where(F.trim("content") != "").select("chunk_id", F.when(C("token_count") == 0, T.token_estimate(C("content"))).otherwise(C("token_count")).alias("tokens")),
      "SELECT chunk_id, CASE WHEN token_count = 0 THEN greatest(1, length(content) // 4) ELSE token_count END AS tokens FROM chunks WHERE trim(content, ' ') <> ''", "chunks")
query("fil_13_resolved_sample", lambda v: v.chunks.where(F.size("abbrevs") > 1).orderBy("chunk_id").limit(10).select("chunk_id", F.left("content", F.lit(80)).alias("head")), "SELECT chunk_id, left(content, 80) AS head FROM chunks WHERE len(abbrevs) > 1 ORDER BY chunk_id LIMIT 10", "chunks")
query("fil_14_failed_jobs", lambda v: v.jobs.where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 200")
query("fil_15_latest_statements", lambda v: v.svo.where("subject is not null and object is not null").orderBy(F.desc("svo_id")).limit(5).select("svo_id", "subject", "object"), "SELECT svo_id, subject, object FROM svo WHERE subject IS NOT NULL AND object IS NOT NULL ORDER BY svo_id DESC LIMIT 5", "svo")
query("prj_01_06_projections", lambda v: v.docs.select("doc_id", F.coalesce(C("valid_to").cast("string"), F.lit("offen")).alias("until"), F.datediff(F.lit(AS_OF), "valid_from").cast("long").alias("days"), F.date_format("valid_from", "dd.MM.yyyy").alias("shown"), F.upper(F.left("title", F.lit(3))).alias("short")),
      "SELECT doc_id, coalesce(CAST(valid_to AS VARCHAR), 'offen') AS until, CAST(date_diff('day', valid_from, DATE '2025-01-01') AS BIGINT) AS days, strftime(valid_from, '%d.%m.%Y') AS shown, upper(left(title, 3)) AS short FROM docs", "docs")
query("prj_05_job_days", lambda v: v.jobs.groupBy(F.to_date("ts").alias("day"), "event_type").agg(n()), "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")

query("fil_10_open_questions", lambda v: reports.open_questions(v.sentences.where(T.is_question(C("sentence"))).withColumn("reviewed", (C("chunk_id") + C("i")) % 3 == 0).join(v.docs.select("doc_id", "title"), "doc_id"), "KUMENT 1").select("chunk_id", "i", "title", "sentence"),
      "SELECT chunk_id, i, title, sentence FROM sentences JOIN docs USING (doc_id) WHERE length(sentence) BETWEEN 10 AND 300 AND ends_with(rtrim(sentence, ' '), '?') AND (chunk_id + i) % 3 <> 0 AND title ILIKE '%KUMENT 1%'", "sentences", "docs")

# ---- joins
query("joi_01_chunks_with_documents", lambda v: v.chunks.join(v.docs.select("doc_id", "title", "source_type"), "doc_id").groupBy("source_type").agg(n(), F.sum("token_count").cast("long").alias("tokens")),
      "SELECT source_type, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks JOIN docs USING (doc_id) GROUP BY source_type", "docs", "chunks")
#: A type that a filter asks for comes out of a generator, below which no filter is pushed, so that it is found once.
query("joi_03_statements_in_context", lambda v: v.svo.select("svo_id", "doc_id", "norm_reference", F.explode(F.array("norm_type")).alias("norm_type")).where("norm_type <> 'UNKNOWN'").join(v.docs.select("doc_id", "title"), "doc_id").select("svo_id", "norm_type", "norm_reference", "title"),
      "SELECT svo_id, norm_type, c.norm_reference, title FROM svo s JOIN chunks c USING (chunk_id) JOIN docs d ON d.doc_id = s.doc_id WHERE norm_type <> 'UNKNOWN'", "svo", "docs")
query("joi_04_entities_in_context", lambda v: v.ner.join(v.docs.select("doc_id", "source_type"), "doc_id").groupBy("source_type", "chunk_type", "label").agg(n()),
      "SELECT source_type, c.chunk_type, label, count(*) AS n FROM ner e JOIN chunks c USING (chunk_id) JOIN docs d ON d.doc_id = e.doc_id GROUP BY ALL", "ner", "docs")
query("joi_05_chunks_with_norm_type", lambda v: v.chunks.join(v.svo.where(C("norm_type").isin("COMPETENCE", "DEF", "MUST")).select("chunk_id"), "chunk_id", "left_semi").select("chunk_id"),
      "SELECT chunk_id FROM chunks c WHERE EXISTS (SELECT 1 FROM svo s WHERE s.chunk_id = c.chunk_id AND norm_type IN ('COMPETENCE', 'DEF', 'MUST'))", "svo")
query("joi_06_not_exported", lambda v: v.chunks.join(v.chunks.where(C("chunk_id") % 3 == 0).select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"), "SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id % 3 = 0)", "chunks")
query("joi_07_jobs_of_customers", lambda v: v.table("customer").select(C("c_custkey").alias("user_id")).join(v.jobs.groupBy("user_id").agg(n("events")), "user_id", "left"), "SELECT c_custkey AS user_id, events FROM customer LEFT JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY user_id) e ON e.user_id = c_custkey")
query("joi_09_abbreviations_per_document", lambda v: reports.abbreviation_counts(v.docs, v.chunks), """
SELECT d.doc_id, CAST(coalesce((SELECT sum(n) FROM (SELECT min(len(abbrevs)) AS n, abbrevs, doc_id FROM chunks WHERE len(abbrevs) > 0 GROUP BY doc_id, abbrevs) a WHERE a.doc_id = d.doc_id), 0) AS BIGINT) AS abbreviations FROM docs d""", "docs", "chunks")
query("joi_12_jobs_of_documents", lambda v: reports.jobs_of_documents(v.jobs.select("event_id", C("user_id").cast("string").alias("doc_id"), "event_type", "ts"), v.docs, "kument 1").select("event_id", "doc_id", "event_type", "title"), """
SELECT event_id, user_id::VARCHAR AS doc_id, event_type, title FROM events JOIN docs d ON user_id::VARCHAR = d.doc_id::VARCHAR WHERE title ILIKE '%kument 1%' ORDER BY ts DESC, event_id LIMIT 50""", "docs")
query("joi_18_job_errors", lambda v: v.table("events").select("event_id", "event_type", F.when(C("event_type") == "error", F.left("props", F.lit(80))).alias("error")), "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN left(props, 80) END AS error FROM events")
query("joi_13_near_rule_entities", lambda v: statements.without_near_rules(v.ner).select("chunk_id", "i", "label", "source"), """
SELECT chunk_id, i, label, source FROM ner a WHERE source = 'flair' OR NOT EXISTS (SELECT 1 FROM ner b WHERE b.source = 'flair' AND b.chunk_id = a.chunk_id AND b.label = a.label AND abs(a.i - b.i) < 5)""", "ner")
_NEAR = "EXISTS (SELECT 1 FROM ner b WHERE b.source = 'flair' AND b.chunk_id = a.chunk_id AND b.label = a.label AND abs(a.i - b.i) < 5)"
query("ner_03_strategies", lambda v: reduce(DataFrame.unionByName, [statements.combined(v.ner, s).groupBy("label", "source").agg(n()).withColumn("strategy", F.lit(s)) for s in ("merge", "flair_only", "rules_only")]), f"""
SELECT label, source, count(*) AS n, 'merge' AS strategy FROM ner a WHERE confidence >= 0.6 AND (source = 'flair' OR NOT {_NEAR}) GROUP BY ALL
UNION ALL SELECT label, source, count(*), CASE source WHEN 'flair' THEN 'flair_only' ELSE 'rules_only' END FROM ner WHERE confidence >= 0.6 GROUP BY ALL""", "ner")
query("joi_15_parent_references", lambda v: v.chunks.select("chunk_id", "parent_id").join(v.chunks.select(C("chunk_id").alias("parent_id"), C("norm_reference").alias("parent_reference")), "parent_id").select("chunk_id", "parent_reference"),
      "SELECT c.chunk_id, p.norm_reference AS parent_reference FROM chunks c JOIN chunks p ON p.chunk_id = c.parent_id", "chunks")

# ---- text
query("txt_01_token_estimate", lambda v: v.table("documents").select("doc_id", T.token_estimate(C("text")).alias("tokens")), "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
_WORD = r"[\p{L}\p{N}_]"
#: The cleaner's steps in a dialect without looking around: pattern, replacement, and how often (what stands before a match is consumed).
_STEPS_SQL = {
    "control": (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", 1), "spaces": (r"[\x{a0}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}]", " ", 1), "hyphens": (rf"({_WORD})-\n({_WORD})", r"\1\2", 1), "links": (r"https?://\S+", "", 1), "www": (r"www\.\S+", "", 1),
    "image rights": (r"(?i)bildrechte[a-z0-9_]*\s*::?\s*.*?(?:\n|$)", "", 1), "stock photos": (r"(?i)©\s*\S+.*?stock\.adobe\.com\S*", "", 1), "copyright lines": (r"(?m)^\s*©\s*.{0,80}$", "", 1), "bullet starts": (r"(?m)^[▪•·‣◦●⁃►▸]\s*", "", 1),
    "bullets": (r"[▪•·‣◦●⁃►▸]", " ", 1), "double quotes": (r"[„“”«»]", '"', 1), "single quotes": (r"[‘’‹›]", "''", 1), "private use": (r"[\x{e000}-\x{f8ff}]", "", 1), "zero width": (r"[\x{200b}-\x{200f}\x{2028}\x{2029}\x{feff}]", "", 1),
    "footnote after word": (rf"({_WORD})\d+\)", r"\1", 1), "footnote before word": (r"(^|[^\p{L}\p{N}_§])\d{1,2}([A-ZÄÖÜ])", r"\1\2", 1), "footnote after paragraph": (rf"(§\s*\d+{_WORD}*)\d\)", r"\1", 1), "footnote lines": (r"(?m)^\s*\d+\)\s*.+$", "", 1),
    "blanks": (r"[ \t]{2,}", " ", 1), "blank lines": (r"\n{3,}", "\n\n", 1), "joined paragraphs": (r"\n\n([a-zäöü])", r" \1", 1), "joined lines": (r"(^|[^.!?:;\n])\n([a-zäöüA-ZÄÖÜ])", r"\1 \2", 2), "blank lines again": (r"\n{3,}", "\n\n", 1),
}


def _step_sql(step: str, text: str) -> str:
    if step == "repeated lines":
        return f"(SELECT array_to_string(list_filter(l, lambda x, i: i = 1 OR trim(x, ' ') <> trim(l[i - 1], ' ')), chr(10)) FROM (SELECT string_split({text}, chr(10)) AS l))"
    pattern, new, times = _STEPS_SQL[step]
    for _ in range(times):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


_CLEANED = "c0 AS (SELECT chunk_id, content AS t FROM chunks), " + ", ".join(f"c{i + 1} AS MATERIALIZED (SELECT chunk_id, {_step_sql(step, 't')} AS t FROM c{i})" for i, (step, _, _) in enumerate(T.CLEANING))
query("txt_02_clean", lambda v: v.chunks.select("chunk_id", F.md5(T.clean(C("content"))).alias("md5")), with_views("", "chunks").rstrip() + ", " + _CLEANED + rf"""
SELECT chunk_id, md5(trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), chr(10)), '  +', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' ')) AS md5 FROM c{len(T.CLEANING)}""")
query("txt_02a_control_characters", lambda v: v.chunks.select("chunk_id", F.md5(T.clean_step(C("content"), "control")).alias("md5")), r"SELECT chunk_id, md5(regexp_replace(content, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS md5 FROM chunks", "chunks")
query("txt_02b_spaces", lambda v: v.chunks.select("chunk_id", F.md5(T.clean_step(C("content"), "spaces")).alias("md5")), r"SELECT chunk_id, md5(regexp_replace(content, '[\x{a0}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}]', ' ', 'g')) AS md5 FROM chunks", "chunks")
query("txt_02d_links", lambda v: v.table("pages").select("page_id", F.md5(T.clean_step(T.clean_step(C("html"), "links"), "www")).alias("md5")), r"SELECT page_id, md5(regexp_replace(regexp_replace(html, 'https?://\S+', '', 'g'), 'www\.\S+', '', 'g')) AS md5 FROM pages")
query("txt_02e_repeated_lines", lambda v: v.table("documents").select("doc_id", F.md5(T.drop_repeated_lines(C("text"))).alias("md5")), "SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: i = 1 OR trim(x, ' ') <> trim(l[i - 1], ' ')), chr(10))) AS md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
query("txt_02g_bullets", lambda v: v.chunks.select("chunk_id", F.md5(T.clean_step(C("content"), "bullets")).alias("md5")), "SELECT chunk_id, md5(regexp_replace(content, '[▪•·‣◦●⁃►▸]', ' ', 'g')) AS md5 FROM chunks", "chunks")
query("txt_02h_quotes", lambda v: v.chunks.select("chunk_id", F.md5(T.clean_step(T.clean_step(C("content"), "double quotes"), "single quotes")).alias("md5")), """SELECT chunk_id, md5(regexp_replace(regexp_replace(content, '[„“”«»]', '"', 'g'), '[‘’‹›]', '''', 'g')) AS md5 FROM chunks""", "chunks")
query("txt_02i_invisible", lambda v: v.chunks.select("chunk_id", F.md5(T.clean_step(T.clean_step(C("content"), "private use"), "zero width")).alias("md5")), r"SELECT chunk_id, md5(regexp_replace(content, '[\x{e000}-\x{f8ff}\x{200b}-\x{200f}\x{2028}\x{2029}\x{feff}]', '', 'g')) AS md5 FROM chunks", "chunks")
query("txt_02k_blanks", lambda v: v.table("documents").select("doc_id", F.md5(T.clean_step(T.clean_step(C("text"), "blanks"), "blank lines")).alias("md5")), r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS md5 FROM documents")
for step in ("hyphens", "image rights", "footnote after word", "footnote before word", "joined lines"):
    query("txt_02_" + step.replace(" ", "_"), lambda v, s=step: v.table("documents").select("doc_id", F.md5(T.clean_step(C("text"), s)).alias("md5")), f"SELECT doc_id, md5({_step_sql(step, 'text')}) AS md5 FROM documents")
def _structured(v: Views) -> DataFrame:
    """Rendered documents, some with a heading in capitals, some with a table of contents, in a line of its own or not."""
    d = C("doc_id")
    front = F.when(d % 7 == 2, "ALLGEMEINE HINWEISE\n").when(d % 11 == 3, " Inhaltsverzeichnis \n").when(d % 11 == 4, "Zum Inhaltsverzeichnis\n").when(d % 13 == 5, "§ 1a\n").otherwise("")
    return chunking.rendered_documents(v.chunks).select("doc_id", F.concat(front, "text").alias("text"))


_STRUCTURED = r"""structured AS (SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN 'ALLGEMEINE HINWEISE' || chr(10) WHEN doc_id % 11 = 3 THEN ' Inhaltsverzeichnis ' || chr(10) WHEN doc_id % 11 = 4 THEN 'Zum Inhaltsverzeichnis' || chr(10)
  WHEN doc_id % 13 = 5 THEN '§ 1a' || chr(10) ELSE '' END || text AS text FROM (SELECT doc_id, string_agg(content, chr(10) ORDER BY pos) AS text FROM chunks GROUP BY doc_id)),
classed AS (SELECT *, CASE WHEN paragraphs >= 3 AND NOT (toc OR headings >= 5) THEN 'A' WHEN headings >= 2 OR toc THEN 'B' ELSE 'C' END AS doc_class FROM (
SELECT doc_id, len(regexp_extract_all(text, '(?m)^\s*§\s*\d+[\p{L}\p{N}_]*\s+\S'))::BIGINT AS paragraphs, len(regexp_extract_all(text, '(?m)^(\d+\.\d+(?:\.\d+)*\s+.+)$|^([A-ZÄÖÜ][A-ZÄÖÜ\s]{4,})$'))::BIGINT AS headings,
  regexp_matches(left(text, 5000), '(?im)^\s*(?:inhaltsverzeichnis|table\s+of\s+contents)\s*$') AS toc FROM structured))"""
query("txt_03_04_structure_and_class", lambda v: _structured(v).select("doc_id", T.structure(C("text")).alias("s")).select("doc_id", "s.*", T.class_hint(C("s.paragraphs"), C("s.headings"), C("s.toc")).alias("doc_class")),
      with_views("", "chunks").rstrip() + ", " + _STRUCTURED + " SELECT doc_id, paragraphs, headings, toc, doc_class FROM classed")
query("chk_r_routed_chunks", lambda v: chunking.routed(_structured(v)).select("doc_id", "doc_class", "place", "hierarchy_level", "chunk_type", "token_count", F.md5("content").alias("md5")))
query("txt_05_norm_reference", lambda v: v.chunks.select("chunk_id", T.norm_reference(C("content")).alias("reference")).where("reference is not null"), r"""
SELECT chunk_id, CASE WHEN title <> '' THEN head || ' ' || title WHEN l[2] IS NOT NULL AND length(l[2]) < 80 AND NOT regexp_matches(l[2], '^\(\d+\)') AND NOT starts_with(l[2], '§') THEN head || ' ' || l[2] ELSE head END AS reference
FROM (SELECT chunk_id, l, regexp_extract(l[1], '^(§\s*\d+[\p{L}\p{N}_]*)((?:\s+[\p{L}\p{N}_]+)*)', 1) AS head, trim(regexp_extract(l[1], '^(§\s*\d+[\p{L}\p{N}_]*)((?:\s+[\p{L}\p{N}_]+)*)', 2), ' ') AS title
  FROM (SELECT chunk_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM chunks)) WHERE head <> ''""", "chunks")
_REFS = "list_filter(regexp_extract_all(content, '" + T.CROSS_REFERENCE + "'), lambda x, k: list_position(regexp_extract_all(content, '" + T.CROSS_REFERENCE + "'), x) = k)[1:10]"
query("txt_06_cross_references", lambda v: v.chunks.select("chunk_id", F.array_join(T.cross_references(C("content")), ";").alias("refs")).where("refs <> ''"), f"SELECT chunk_id, array_to_string({_REFS}, ';') AS refs FROM chunks WHERE len(regexp_extract_all(content, '{T.CROSS_REFERENCE}')) > 0", "chunks")
query("txt_07_chunk_type", lambda v: v.chunks.groupBy("chunk_type").agg(n()), "SELECT chunk_type, count(*) AS n FROM chunks GROUP BY chunk_type", "chunks")
query("txt_08_requirement_id", lambda v: v.chunks.select("chunk_id", T.requirement_id(F.concat("content", F.lit(" REQ-0"), C("pos").cast("string"), F.lit("01"))).alias("requirement")), r"SELECT chunk_id, nullif(regexp_extract(content || ' REQ-0' || pos || '01', '\b([A-Z]{1,4}-\d{3,})\b', 1), '') AS requirement FROM chunks", "chunks")
query("txt_09_sentences", lambda v: v.sentences.groupBy("doc_id").agg(n("sentences"), F.sum(F.length("sentence")).cast("long").alias("chars")), "SELECT doc_id, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM sentences GROUP BY doc_id", "sentences")
query("txt_10_content_hash", lambda v: v.table("documents").groupBy(F.md5("text").alias("md5")).agg(n()).where("n > 1"), "SELECT md5(text) AS md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
query("txt_14_row_prose", lambda v: v.table("customer").select("c_custkey", T.row_prose(F.array(F.lit("Kunde"), F.lit("Segment")), F.array("c_name", "c_mktsegment", F.when(C("c_custkey") % 2 == 0, C("c_custkey").cast("string")))).alias("prose")), """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Kunde: ' || c_name || '. Segment: ' || c_mktsegment || '. Spalte 3: ' || c_custkey || '.' ELSE 'Kunde "' || c_name || '": Segment ist "' || c_mktsegment || '".' END AS prose FROM customer""")
query("txt_16_query_type", lambda v: v.sentences.select("chunk_id", "i", T.query_type(C("sentence")).alias("kind")).groupBy("kind").agg(n()), "SELECT CASE WHEN regexp_matches(lower(sentence), '" + R.QUERY_NORM + "') THEN 'NORM' WHEN regexp_matches(lower(sentence), '" + R.bordered(R.QUERY_IM) + "') THEN 'IM' WHEN regexp_matches(lower(sentence), '" + R.bordered(R.QUERY_ENTITY) + "') THEN 'ENTITY' ELSE 'GENERAL' END AS kind, count(*) AS n FROM sentences GROUP BY 1", "sentences")
_ASKED_FOR = T.QUERY_REFERENCE.replace("(?iu)", "(?i)").replace(r"G\b)", r"G)(?:[^\p{L}\p{N}_]|$)")  # \b of this dialect knows ASCII alone
_ASKED = "concat_ws(' ', '§ ' || nullif(regexp_extract(sentence, '%s', 1), ''), 'Abs. ' || nullif(regexp_extract(sentence, '%s', 2), ''), 'Satz ' || nullif(regexp_extract(sentence, '%s', 3), ''), 'Nr. ' || nullif(regexp_extract(sentence, '%s', 4), ''), nullif(regexp_extract(sentence, '%s', 5), ''))".replace("%s", _ASKED_FOR)
query("txt_17_query_reference", lambda v: v.sentences.select(T.query_reference(C("sentence")).alias("reference")).where("reference is not null").groupBy("reference").agg(n()), f"SELECT {_ASKED} AS reference, count(*) AS n FROM sentences WHERE regexp_matches(sentence, '{_ASKED_FOR}') GROUP BY 1", "sentences")
query("txt_20_template", lambda v: v.docs.select("doc_id", T.render(F.lit("{{title}} ({{kind}}){{none}}"), {"title": C("title"), "kind": C("source_type")}).alias("text")), "SELECT doc_id, title || ' (' || source_type || ')' AS text FROM docs", "docs")
query("txt_21_uri_parts", lambda v: v.docs.select("doc_id", T.uri_part(F.concat("title", F.lit(" / "), "source_type")).alias("uri"), F.format_string("%.4f", C("doc_id") / 8.0).alias("number")), r"SELECT doc_id, regexp_replace(trim(title || ' / ' || source_type), '[^\p{L}\p{N}_-]+', '_', 'g') AS uri, printf('%.4f', doc_id / 8.0) AS number FROM docs", "docs")
query("txt_22_targets", lambda v: reports.svo_completeness(v.svo).select(T.meets_target(C("subject_percent"), 80.0).alias("subject_ok"), T.meets_target(C("avg_confidence"), 0.65).alias("confidence_ok")), "SELECT round(sum((subject IS NOT NULL)::INT)::DOUBLE * 100.0 / count(*), 1) > 80.0 AS subject_ok, round(avg(confidence), 3) > 0.65 AS confidence_ok FROM svo", "svo")

# ---- chunkers and questions
query("chk_a_paragraph_chunks", lambda v: chunking.class_a(chunking.rendered_documents(v.chunks)).select("doc_id", "para", "n", "hierarchy_level", "chunk_type", "token_count", F.md5("content").alias("md5")))
query("chk_b_section_chunks", lambda v: chunking.class_b(chunking.rendered_documents(v.chunks)).select("doc_id", "section", "part", "n", "hierarchy_level", "breadcrumb", "chunk_type", "requirement_id", "token_count", F.md5("content").alias("md5")))
query("chk_c_sentence_windows", lambda v: chunking.class_c(chunking.rendered_documents(v.chunks)).select("doc_id", "n", "token_count", F.md5("content").alias("md5")))
query("chk_l_first_chunks", lambda v: v.chunks.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("r <= 5").select("doc_id", "chunk_id"), "SELECT doc_id, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 5", "chunks")
_QTYPE = f"""CASE WHEN regexp_matches(lower(s), '{R.unbordered(R.RHETORICAL)}') THEN 'rhetorisch' WHEN regexp_extract(lower(s), '^[^\\p{{L}}]*(\\p{{L}}+)', 1) IN ({', '.join("'" + w + "'" for w in R.QUESTION_WORDS)}) THEN 'direkt' WHEN len(regexp_extract_all(s, '\\?')) >= 2 THEN 'mehrfach' ELSE 'indirekt' END"""
query("qst_01_questions", lambda v: v.sentences.where(T.is_question(C("sentence"))).select("chunk_id", "i", "sentence", T.question_type(C("sentence")).alias("kind")), f"SELECT chunk_id, i, s AS sentence, {_QTYPE} AS kind FROM (SELECT chunk_id, i, sentence AS s FROM sentences) WHERE length(s) BETWEEN 10 AND 300 AND ends_with(rtrim(s, ' '), '?')", "sentences")
query("qst_02_chunks_without_questions", lambda v: v.chunks.where("doc_class <> 'A'").join(v.sentences.where(T.is_question(C("sentence"))).select("chunk_id").distinct(), "chunk_id", "left_anti").groupBy("doc_class").agg(n()), "SELECT doc_class, count(*) AS n FROM chunks WHERE doc_class <> 'A' AND chunk_id NOT IN (SELECT chunk_id FROM sentences WHERE length(sentence) BETWEEN 10 AND 300 AND ends_with(rtrim(sentence, ' '), '?')) GROUP BY doc_class", "sentences")
query("set_03_distinct_questions", lambda v: v.sentences.where(T.is_question(C("sentence"))).groupBy("doc_id", F.lower(F.trim("sentence")).alias("key")).agg(F.min(F.struct("chunk_id", "i", "sentence")).alias("first")).select("doc_id", "first.sentence"), "SELECT doc_id, min({'a': chunk_id, 'b': i, 'c': sentence}).c AS sentence FROM sentences WHERE length(sentence) BETWEEN 10 AND 300 AND ends_with(rtrim(sentence, ' '), '?') GROUP BY doc_id, lower(trim(sentence, ' '))", "sentences")

# ---- statements and entities
query("svo_07_norm_types", lambda v: v.svo.where("norm_type <> 'UNKNOWN'").select("svo_id", "norm_type", "norm_confidence"), "SELECT svo_id, norm_type, norm_confidence FROM svo WHERE norm_type <> 'UNKNOWN'", "svo")
query("svo_08_entity_types", lambda v: v.svo.groupBy("subject_type", "object_type").agg(n()), "SELECT subject_type, object_type, count(*) AS n FROM svo GROUP BY subject_type, object_type", "svo")
query("svo_09_confidence", lambda v: v.svo.groupBy("confidence").agg(n()), "SELECT confidence, count(*) AS n FROM svo GROUP BY confidence", "svo")
_L = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
query("svo_10_filters", lambda v: statements.filtered(v.svo).select("svo_id", "subject", "object", F.round("confidence", 3).alias("confidence"), "subject_type"), rf"""
SELECT svo_id, s AS subject, o AS object, round(CASE WHEN coalesce(lower(s) IN ({_L(R.PRONOUNS)}), false) THEN greatest(0, confidence - 0.3) ELSE confidence END, 3) AS confidence,
  CASE WHEN coalesce(lower(s) IN ({_L(R.PRONOUNS)}), false) THEN 'PRONOMEN' ELSE subject_type END AS subject_type FROM (
SELECT *, CASE WHEN NOT (lower(subject) IN ({_L(R.STOP_SUBJECTS)}) OR length(subject) < 3 OR regexp_matches(subject, '^(S\.|Abs\.|Nr\.)\s*\d+$') OR regexp_matches(subject, '^\d+$')) THEN subject END AS s,
  CASE WHEN NOT (lower(object) IN ({_L([x.lower() for x in R.STOP_OBJECTS])}) OR length(object) < 3 OR regexp_matches(object, '^\d{{1,4}}$')) THEN object END AS o
FROM svo WHERE confidence >= 0.5) WHERE predicate IS NOT NULL AND predicate <> '' AND predicate NOT IN ({_L(R.STOP_PREDICATES)})""", "svo")
#: The last pattern's words, whose borders this dialect does not know, are taken out of runs of word characters.
_RULES = rf"""deadlines AS (SELECT chunk_id, 'FRIST' AS label, unnest(regexp_extract_all(content, '(?i){"|".join(f"(?:{p})" for p in R.NER_REGEX["FRIST"])}')) AS text FROM chunks),
laws AS (SELECT chunk_id, 'GESETZ' AS label, unnest(regexp_extract_all(content, '(?i){"|".join(f"(?:{p})" for p in R.NER_REGEX["GESETZ"][:-1])}|[\p{{L}}\p{{N}}_]+')) AS text FROM chunks),
rule_entities AS (SELECT * FROM deadlines UNION ALL SELECT * FROM laws WHERE regexp_matches(text, '(?i)^(?:§|art\.\s*\d)') OR regexp_full_match(text, '(?i)[a-z][a-z]+g'))"""
query("ner_01_rule_entities", lambda v: statements.rule_entities(v.chunks).groupBy("label").agg(n(), F.countDistinct("chunk_id").alias("chunks")), with_views("", "chunks").rstrip() + ", " + _RULES + " SELECT label, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM rule_entities GROUP BY label")
query("ner_01_word_entities", lambda v: v.ner.select("chunk_id", "i", "text", "label", "confidence"), "SELECT chunk_id, i, text, label, confidence FROM ner", "ner")
query("ner_04_05_corrected", lambda v: statements.corrected(v.ner).groupBy("text", "label").agg(n()), f"""
SELECT text, CASE WHEN text IN ({_L(R.AGNOSTIC_OBJECTS)}) THEN 'DATENOBJEKT' {' '.join(f"WHEN text = '{k}' THEN '{x}'" for k, x in R.NER_CORRECTIONS.items())} ELSE label END AS label, count(*) AS n FROM ner WHERE confidence >= 0.5 AND text NOT IN ({_L(R.NER_BLACKLIST)}) GROUP BY ALL""", "ner")
query("ner_06_without_references", lambda v: statements.rule_entities(v.chunks).where(~((C("label") == "GESETZ") & C("text").rlike(r"^§\s*\d+"))).groupBy("label").agg(n()), with_views("", "chunks").rstrip() + ", " + _RULES + r" SELECT label, count(*) AS n FROM rule_entities WHERE NOT (label = 'GESETZ' AND regexp_matches(text, '^§\s*\d+')) GROUP BY label")
query("ner_07_context", lambda v: statements.context_checked(v.ner, v.chunks).groupBy("label").agg(n()), "SELECT CASE " + " ".join(f"WHEN label = '{k}' AND NOT regexp_matches(around, '({'|'.join(x.replace('.', chr(92) + '.') for x in words)})') THEN 'SONSTIGE'" for k, words in R.NER_CONTEXT.items()) + """ ELSE label END AS label, count(*) AS n
FROM (SELECT n.*, lower(substr(content, greatest(1, instr(content, text) - 80), instr(content, text) + 80 + length(text) - greatest(1, instr(content, text) - 80))) AS around FROM ner n JOIN (SELECT chunk_id, content FROM chunks) c USING (chunk_id)) GROUP BY 1""", "ner")
query("set_04_best_entities", lambda v: statements.best_entities(v.ner).select("chunk_id", "i", "text", "label"), "SELECT chunk_id, i, text, label FROM ner QUALIFY row_number() OVER (PARTITION BY chunk_id, lower(text), label ORDER BY confidence DESC, i) = 1", "ner")
query("ims_01_model_signals", lambda v: statements.model_signals(v.svo, v.ner), f"""
SELECT p.chunk_id, CASE WHEN binding THEN names END AS entities, attributes, persistence FROM (
  SELECT chunk_id, bool_or(norm_type = 'MUST' AND regexp_matches(lower(sentence), '{R.bordered(R.ATTRIBUTE_PREDICATES)}')) AS attributes, bool_or(norm_type = 'MUST' AND regexp_matches(lower(sentence), '{R.bordered(R.PERSISTENCE_PREDICATES)}')) AS persistence,
    bool_or(norm_type IN ('MUST', 'DEF')) AS binding FROM svo GROUP BY chunk_id) p
LEFT JOIN (SELECT chunk_id, array_to_string(list_sort(list(DISTINCT text)), ',') AS names FROM ner WHERE label IN ('ROLLE', 'DATENOBJEKT') GROUP BY chunk_id) e USING (chunk_id)""", "svo", "ner")


def _annotated(v: Views) -> DataFrame:
    """Signals of a chunk: names by label, the first subject of a definition, pairs of subject and object of duties."""
    named = lambda label: F.array_sort(F.collect_set(F.when(C("label") == label, C("text"))))
    names = v.ner.groupBy("chunk_id").agg(named("ROLLE").alias("entities"), named("DATENOBJEKT").alias("attributes"))
    pairs = F.array_sort(F.collect_set(F.when(C("norm_type") == "MUST", F.struct(C("subject").alias("von"), C("object").alias("zu")))))
    said = v.svo.groupBy("chunk_id").agg(F.min(F.when(C("norm_type") == "DEF", C("subject"))).alias("definition"), F.bool_or(C("norm_type") == "DEADLINE").alias("persistence"), pairs.alias("relations"))
    lines = statements.annotations(C("entities"), C("definition"), C("attributes"), C("persistence"), C("relations"))
    return said.join(names, "chunk_id", "left").select("chunk_id", F.array_join(lines, "\n").alias("lines"))


query("ctx_02_annotations", _annotated, """
SELECT chunk_id, array_to_string(list_concat(list_transform(coalesce(entities, []), lambda x: '[IM-ENTITY-KANDIDAT: ' || x || ' → Tabelle]'), CASE WHEN definition IS NOT NULL THEN ['[IM-ENTITY-DEF: ' || definition || ' = kanonische Definition]'] ELSE [] END,
  list_transform(coalesce(attributes, []), lambda x: '[IM-ATTRIBUT-KANDIDAT: ' || x || ' → Spalte]'), CASE WHEN persistence THEN ['[IM-PERSISTENZ: Datenpersistenz erforderlich]'] ELSE [] END,
  list_transform(coalesce(relations, []), lambda x: '[IM-RELATION: ' || x.von || ' → ' || x.zu || ']')), chr(10)) AS lines
FROM (SELECT chunk_id, min(subject) FILTER (WHERE norm_type = 'DEF') AS definition, bool_or(norm_type = 'DEADLINE') AS persistence,
  list_sort(list(DISTINCT {'von': subject, 'zu': object}) FILTER (WHERE norm_type = 'MUST' AND subject IS NOT NULL AND object IS NOT NULL)) AS relations FROM svo GROUP BY chunk_id)
LEFT JOIN (SELECT chunk_id, list_sort(list(DISTINCT text) FILTER (WHERE label = 'ROLLE')) AS entities, list_sort(list(DISTINCT text) FILTER (WHERE label = 'DATENOBJEKT')) AS attributes FROM ner GROUP BY chunk_id) USING (chunk_id)""", "svo", "ner")
_CALLS = r"""places AS (SELECT *, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY svo_id) - 1) // 20 AS BIGINT) AS batch FROM svo WHERE norm_type = 'UNKNOWN'),
offsets AS (SELECT doc_id, coalesce(sum(batches) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, max(batch) + 1 AS batches FROM places GROUP BY doc_id)),
calls AS (SELECT *, CAST(before + batch + 1 AS BIGINT) AS call, CASE WHEN length(trim(sentence)) < 15 THEN 'Text zu kurz' WHEN regexp_matches(trim(predicate), '^\p{Lu}\p{L}*$') AND length(trim(predicate)) > 3 THEN 'Prädikat ist Substantiv' END AS why FROM places JOIN offsets USING (doc_id)),
assigned AS (SELECT *, CASE WHEN reason IS NULL THEN sum((reason IS NULL)::INT) OVER (PARTITION BY doc_id, batch ORDER BY svo_id) END AS n FROM (SELECT *, CASE WHEN call > {budget} THEN 'Budget erreicht' ELSE why END AS reason FROM calls))"""
query("llm_00_prompt_batches", lambda v: statements.prompt_batches(v.svo).select("doc_id", "batch", "call", "asked", "statements", F.md5("prompt").alias("md5")), with_views("", "svo").rstrip() + ", " + _CALLS.replace("{budget}", "1e18") + """
SELECT doc_id, batch, call, count(n) AS asked, count(*) AS statements, md5(string_agg(printf('SVO-%03d: %s', CAST(n AS INTEGER), sentence), chr(10) ORDER BY n) FILTER (n IS NOT NULL)) AS md5 FROM assigned GROUP BY ALL HAVING count(n) > 0""")
query("llm_01_calls_within_budget", lambda v: statements.assigned(v.svo, budget=100).groupBy("reason", (C("call") <= 100).alias("within")).agg(n(), F.countDistinct("call").alias("calls"), F.max("n").cast("long").alias("most")), with_views("", "svo").rstrip() + ", " + _CALLS.replace("{budget}", "100") + """
SELECT reason, call <= 100 AS within, count(*) AS n, count(DISTINCT call) AS calls, CAST(max(n) AS BIGINT) AS most FROM assigned GROUP BY ALL""")


def _answers(v: Views) -> DataFrame:
    key = C("svo_id")
    return v.svo.where(key % 11 == 0).select("svo_id", F.when(key % 2 == 0, "MUST").otherwise("MAY").alias("norm_type"), F.when(key % 3 == 0, "hoch").when(key % 3 == 1, "mittel").otherwise("?").alias("level"))


query("llm_02_03_merged_labels", lambda v: statements.merged_labels(v.svo, _answers(v)).groupBy("norm_type").agg(n(), F.round(F.avg("norm_confidence"), 3).alias("avg_confidence")), """
SELECT norm_type, count(*) AS n, round(avg(norm_confidence), 3) AS avg_confidence FROM (
  SELECT CASE WHEN u THEN CASE WHEN svo_id % 2 = 0 THEN 'MUST' ELSE 'MAY' END ELSE norm_type END AS norm_type, CASE WHEN u THEN 0.9::DOUBLE ELSE norm_confidence END AS norm_confidence
  FROM (SELECT *, norm_type = 'UNKNOWN' AND svo_id % 11 = 0 AND svo_id % 3 = 0 AS u FROM svo)) GROUP BY norm_type""", "svo")

# ---- retrieval: the query set of Views.asked against all chunks
_THRESHOLDS = {"A": 0.2, "B": 0.2, "C": 0.2}


def _vector_queries(v: Views) -> DataFrame:
    return v.table("embeddings").where(C("vec_id") % 20 == 0).select(C("vec_id").alias("query_id"), C("embedding").alias("q"))


def _similar(query: str, chunk: str) -> str:
    return f"round(list_inner_product({query}, {chunk}) / (sqrt(list_inner_product({query}, {query})) * sqrt(list_inner_product({chunk}, {chunk}))), 6)"


query("ret_03_top_01_win_02_vector_search", lambda v: retrieval.vector_search(_vector_queries(v), v.vectors.select(C("vec_id").alias("chunk_id"), "doc_class", C("embedding").alias("v")), _THRESHOLDS), f"""
SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.doc_class, {_similar('q.embedding', 'c.embedding')} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id, c.doc_class ORDER BY score DESC, c.vec_id) AS INTEGER) AS rank
  FROM vectors q, vectors c WHERE q.vec_id % 20 = 0 QUALIFY score >= 0.2) WHERE rank <= 12""", "vectors")


def _vector_hits(v: Views) -> DataFrame:
    return retrieval.vector_search(v.asked, v.chunk_vectors, _THRESHOLDS)


def _text_hits(v: Views) -> DataFrame:
    return fulltext.search(v.asked, v.chunks)


_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_FTS = rf"""qwords AS (SELECT query_id, unnest({_WORDS.format('text')}) AS word FROM asked),
places AS (SELECT chunk_id, doc_class, unnest(w) AS word, unnest(generate_series(1, len(w))) AS place FROM (SELECT chunk_id, doc_class, {_WORDS.format('content')} AS w FROM chunks)),
distinct_words AS (SELECT word FROM places UNION SELECT word FROM qwords), {fulltext.STEMS_SQL.strip()},
qterms AS (SELECT DISTINCT query_id, term FROM qwords JOIN vocabulary USING (word)), wanted AS (SELECT query_id, count(*) AS wanted FROM qterms GROUP BY query_id),
entries AS (SELECT query_id, chunk_id, doc_class, term, place FROM places JOIN vocabulary USING (word) JOIN qterms USING (term)),
complete AS (SELECT query_id, chunk_id, wanted FROM (SELECT query_id, chunk_id, count(DISTINCT term) AS held FROM entries GROUP BY ALL) JOIN wanted USING (query_id) WHERE held = wanted),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY place) AS j FROM entries JOIN complete USING (query_id, chunk_id)),
latest AS (SELECT query_id, chunk_id, a.doc_class, a.wanted, a.j, a.place, b.term, max(b.j) AS l, max(b.place) AS lp FROM numbered a JOIN numbered b USING (query_id, chunk_id) WHERE b.j <= a.j GROUP BY ALL),
spans AS (SELECT query_id, chunk_id, doc_class, min(l) AS first, min(lp) AS first_place, j, place FROM latest GROUP BY query_id, chunk_id, doc_class, wanted, j, place HAVING count(*) = wanted),
covers AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id, first ORDER BY j) = 1),
densities AS (SELECT query_id, chunk_id, doc_class, round(sum(0.1::DOUBLE / (1 + (place - first_place) - (j - first))), 6) AS score FROM covers GROUP BY ALL),
fts AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, doc_class ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM densities) WHERE rank <= 12)"""
query("ret_04_full_text", _text_hits, with_views("", "chunks", "asked").rstrip() + ", " + _FTS + " SELECT * FROM fts")


def _lookup(v: Views) -> DataFrame:
    return retrieval.direct_lookup(v.asked, v.chunks)


_LOOKUP = r"""found AS (SELECT query_id, chunk_id, hierarchy_level, starts_with(norm_reference, reference) AS exact FROM asked JOIN chunks ON regexp_extract(norm_reference, '\d+') = regexp_extract(reference, '\d+')),
lookup AS (SELECT * FROM (SELECT query_id, chunk_id, CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, hierarchy_level, chunk_id) AS INTEGER) AS rank
  FROM (SELECT *, bool_or(exact) OVER (PARTITION BY query_id) AS any_exact FROM found) WHERE exact OR NOT any_exact) WHERE rank <= 6)"""
query("ret_02_direct_lookup", _lookup, with_views("", "chunks", "asked").rstrip() + ", " + _LOOKUP + " SELECT query_id, chunk_id, score, rank FROM lookup")


def _fused(v: Views) -> DataFrame:
    return retrieval.fuse(_text_hits(v), _lookup(v))


_RAG = with_views("", "chunk_vectors", "asked").rstrip() + ", " + _FTS + ", " + _LOOKUP + """,
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS lists FROM (SELECT query_id, chunk_id, rank FROM fts UNION ALL SELECT query_id, chunk_id, rank FROM lookup) GROUP BY ALL)"""
query("ret_05_fusion", _fused, _RAG + " SELECT * FROM fused")


def _parents_of(found: str) -> str:
    return f"""SELECT query_id, chunk_id FROM (SELECT DISTINCT f.query_id, c.parent_id AS chunk_id FROM {found} f JOIN chunks c USING (chunk_id)
  WHERE c.parent_id IS NOT NULL AND (c.doc_class = 'A' OR (c.doc_class = 'B' AND (c.token_count > 450 OR c.chunk_type = 'tabelle'))) AND c.parent_id IN (SELECT chunk_id FROM chunks)) p
  WHERE NOT EXISTS (SELECT 1 FROM {found} f WHERE f.query_id = p.query_id AND f.chunk_id = p.chunk_id)"""


query("ret_08_joi_10_set_02_parents", lambda v: retrieval.with_parents(_fused(v), v.chunks), _RAG + f" SELECT query_id, chunk_id, score FROM fused UNION ALL SELECT query_id, chunk_id, 0.0::DOUBLE FROM ({_parents_of('fused')})")


def _links(v: Views) -> DataFrame:
    """§ references of a chunk resolved to the chunk with that number in its own document."""
    heads = v.chunks.where("hierarchy_level = 1 and norm_reference is not null").groupBy("doc_id", "norm_reference").agg(F.min("chunk_id").alias("target"))
    refs = v.chunks.select("chunk_id", "doc_id", F.explode(T.cross_references(C("content"))).alias("ref")).select("chunk_id", "doc_id", F.concat(F.lit("§ "), F.regexp_extract("ref", r"(\d+)", 1)).alias("norm_reference"))
    return refs.join(heads, ["doc_id", "norm_reference"]).select("chunk_id", "target").distinct()


_LINKS = r"""heads AS (SELECT doc_id, norm_reference, min(chunk_id) AS target FROM chunks WHERE hierarchy_level = 1 AND norm_reference IS NOT NULL GROUP BY ALL),
refs AS (SELECT chunk_id, doc_id, '§ ' || regexp_extract(unnest(""" + _REFS + r"""), '(\d+)', 1) AS norm_reference FROM chunks),
links AS (SELECT DISTINCT chunk_id, target FROM refs JOIN heads USING (doc_id, norm_reference))"""


def _reached_from(found: str) -> str:
    return f"""one AS (SELECT DISTINCT query_id, target AS chunk_id FROM {found} JOIN links USING (chunk_id) WHERE (query_id, target) NOT IN (SELECT (query_id, chunk_id) FROM {found})),
two AS (SELECT DISTINCT query_id, target AS chunk_id FROM one JOIN links USING (chunk_id) WHERE (query_id, target) NOT IN (SELECT (query_id, chunk_id) FROM {found} UNION ALL SELECT (query_id, chunk_id) FROM one))"""


query("ret_09_joi_11_cross_references", lambda v: retrieval.with_cross_references(_fused(v), _links(v)), _RAG + ", " + _LINKS + ", " + _reached_from("fused") + """
SELECT query_id, chunk_id, score FROM fused UNION ALL SELECT query_id, chunk_id, 0.0::DOUBLE FROM one UNION ALL SELECT query_id, chunk_id, 0.0::DOUBLE FROM two""")


def _whole(v: Views) -> DataFrame:
    """Lookup, vectors, text, fusion by class, parents and tables, and cross references of class A."""
    return retrieval.retrieved(_lookup(v), [_vector_hits(v), _text_hits(v)], v.chunks, _links(v))


_WHOLE = _RAG + ", " + _LINKS + f""",
alike AS (SELECT query_id, chunk_id, c.doc_class, {_similar('q.embedding', 'c.embedding')} AS score, CAST(row_number() OVER (PARTITION BY query_id, c.doc_class ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM asked JOIN vectors q ON q.vec_id = query_id % 500, chunk_vectors c QUALIFY score >= 0.2),
weighed AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)) * CASE doc_class WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END, 9) AS score
  FROM (SELECT query_id, chunk_id, doc_class, rank FROM fts UNION ALL SELECT query_id, chunk_id, doc_class, rank FROM alike WHERE rank <= 12) GROUP BY query_id, chunk_id, doc_class),
seen AS (SELECT query_id, chunk_id, score, true AS direct FROM lookup UNION ALL SELECT query_id, chunk_id, score, false FROM weighed w WHERE NOT EXISTS (SELECT 1 FROM lookup l WHERE l.query_id = w.query_id AND l.chunk_id = w.chunk_id)),
grown AS (SELECT * FROM seen UNION ALL SELECT query_id, chunk_id, 0.0::DOUBLE, false FROM ({_parents_of('seen')})),
of_a AS (SELECT g.* FROM grown g JOIN chunks c USING (chunk_id) WHERE c.doc_class = 'A'), {_reached_from('of_a')},
whole AS (SELECT * FROM grown UNION ALL SELECT query_id, chunk_id, 0.0::DOUBLE, false FROM (SELECT * FROM one UNION ALL SELECT * FROM two) r WHERE NOT EXISTS (SELECT 1 FROM grown g WHERE g.query_id = r.query_id AND g.chunk_id = r.chunk_id))"""
_RERANK = """,
once AS (SELECT e.*, c.confidence_weight, c.token_count, max(score) OVER w AS best, row_number() OVER (w ORDER BY chunk_id) AS r FROM whole e JOIN chunks c USING (chunk_id) WINDOW w AS (PARTITION BY query_id, md5(content))),
pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, chunk_id) AS p FROM once WHERE r = 1) WHERE p <= 16),
final AS (SELECT query_id, chunk_id, round(best * confidence_weight * CASE WHEN direct THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score, token_count FROM pre),
ranked AS (SELECT query_id, chunk_id, score, rank, token_count FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM final) WHERE rank <= 8)"""
query("ret_07_whole_search", lambda v: _whole(v).select("query_id", "chunk_id", "score", "direct"), _WHOLE + " SELECT * FROM whole")
query("rnk_02_direct_hits_first", lambda v: retrieval.rerank(_whole(v), v.chunks), _WHOLE + _RERANK + " SELECT * FROM ranked")
query("rnk_03_set_05_top_02_rerank", lambda v: retrieval.rerank(_fused(v), v.chunks), _RAG + ", whole AS (SELECT *, false AS direct FROM fused)" + _RERANK + " SELECT * FROM ranked")
query("win_03_ctx_03_context", lambda v: retrieval.context(retrieval.within_budget(retrieval.rerank(_whole(v), v.chunks), 400), v.chunks).select("query_id", "used", "chunks", F.md5("context").alias("md5")), _WHOLE + _RERANK + """
SELECT query_id, CAST(max(used) AS BIGINT) AS used, count(*) AS chunks, md5(string_agg('[' || concat_ws(' | ', 'Q' || rank, norm_reference, upper(chunk_type), CASE WHEN doc_class = 'C' THEN 'Konfidenz: niedrig' END) || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS md5
FROM (SELECT *, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM ranked) r JOIN (SELECT chunk_id, norm_reference, chunk_type, doc_class, content FROM chunks) c USING (chunk_id) WHERE used <= 400 GROUP BY query_id""")
query("emb_01_normalised", lambda v: v.vectors.select("vec_id", F.round(F.aggregate(T.normalised(C("embedding")), F.lit(0.0), lambda a, x: a + x), 6).alias("total")), "SELECT vec_id, round(list_sum(embedding) / sqrt(list_inner_product(embedding, embedding)), 6) AS total FROM vectors", "vectors")
query("emb_02_compute_once", lambda v: v.table("documents").select("doc_id", F.md5("text").alias("h")).join(v.table("documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("computed_for")), "h").select("doc_id", "computed_for"), "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS computed_for FROM documents")
query("emb_03_cosine", lambda v: _vector_queries(v).join(F.broadcast(v.vectors.where("vec_id = 7").agg(F.min("embedding").alias("embedding")))).select("query_id", F.round(T.cosine(C("q"), C("embedding")), 6).alias("cosine")), "SELECT q.vec_id AS query_id, round(list_cosine_similarity(q.embedding, c.embedding), 6) AS cosine FROM vectors q, vectors c WHERE q.vec_id % 20 = 0 AND c.vec_id = 7", "vectors")
query("srt_01_ordered_limit", lambda v: v.chunks.orderBy(F.desc("token_count"), "chunk_id").limit(50).select("chunk_id", "token_count"), "SELECT chunk_id, token_count FROM chunks ORDER BY token_count DESC, chunk_id LIMIT 50", "chunks")
query("srt_02_random_sample", lambda v: v.svo.orderBy(F.md5(C("svo_id").cast("string")), "svo_id").limit(15).select("svo_id", "sentence"), "SELECT svo_id, sentence FROM svo ORDER BY md5(svo_id::VARCHAR), svo_id LIMIT 15", "svo")
query("win_04_latest_job", lambda v: v.jobs.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type"), "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
query("snk_07_job_states", lambda v: reports.job_state(v.jobs), """
SELECT user_id, CASE last WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'parsing' END AS status, updates, errors, CASE WHEN last IN ('purchase', 'error') THEN seconds END AS seconds FROM (
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, count(*) AS updates, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS errors, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM events GROUP BY user_id)""")

# ---- graph


def _triples(v: Views) -> DataFrame:
    return graph.norm_triples(v.docs, v.chunks).unionByName(graph.svo_triples(v.svo)).unionByName(graph.ner_triples(v.ner))


def _resource(space: str, key: str) -> str:
    return rf"'{graph.BASE}{space}/' || regexp_replace(CAST({key} AS VARCHAR), '[^\p{{L}}\p{{N}}_\-.]', '_', 'g')"


def _rows(name: str, subject: str, source: str, values: list[tuple[str, str, str, str, str]]) -> str:
    """Triples of a graph: predicate, value, kind, language, datatype."""
    quoted = lambda x: f"'{x}'" if x else "NULL"
    each = ", ".join(f"{{'p': '{graph.iri_of(p)}', 'o': CAST({o} AS VARCHAR), 'kind': '{kind}', 'lang': {quoted(lang)}, 'datatype': {quoted(datatype)}}}" for p, o, kind, lang, datatype in values)
    return f"SELECT '{name}' AS graph, s, x.p, x.o, x.kind, x.lang, x.datatype FROM (SELECT {subject} AS s, unnest([{each}]) AS x FROM {source}) WHERE x.o IS NOT NULL AND x.o <> ''"


_LIT, _IRI = "literal", "iri"
_CLASS = "CASE label " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in R.RDF_CLASSES.items()) + " ELSE 'Entity' END"
_ENTITY = _resource("entity", "label || '_' || text")
_GRAPHS = {
    "norms": _rows("norms", _resource("norm", "doc_id"), "docs", [
        ("type", f"'{graph.ONTOLOGY}NormDocument'", _IRI, "", ""), ("title", "title", _LIT, "de", ""), ("sourceType", "source_type", _LIT, "", ""), ("docId", "doc_id", _LIT, "", ""), ("jurisdiction", "jurisdiction", _LIT, "", ""), ("validFrom", "valid_from", _LIT, "", graph.DATE)])
    + " UNION ALL " + _rows("norms", _resource("norm", "doc_id"), "(SELECT DISTINCT doc_id, norm_reference FROM chunks)", [("normReference", "norm_reference", _LIT, "", "")]),
    "svo": _rows("svo", _resource("svo", "svo_id"), "(SELECT * FROM svo WHERE subject IS NOT NULL)", [
        ("type", f"'{graph.ONTOLOGY}SVOTriple'", _IRI, "", ""), ("subject", "subject", _LIT, "de", ""), ("predicate", "predicate", _LIT, "de", ""), ("predicateLemma", "predicate_lemma", _LIT, "de", ""), ("object", "object", _LIT, "de", ""),
        ("objectType", "CASE WHEN object IS NOT NULL THEN object_type END", _LIT, "", ""), ("subjectType", "subject_type", _LIT, "", ""), ("normType", "norm_type", _LIT, "", ""), ("confidence", "printf('%.4f', confidence)", _LIT, "", graph.DECIMAL),
        ("fromChunk", _resource("chunk", "chunk_id"), _IRI, "", ""), ("fromDocument", _resource("norm", "doc_id"), _IRI, "", ""), ("normReference", "norm_reference", _LIT, "", ""), ("context", "context", _LIT, "de", "")]),
    "ner": _rows("ner", _ENTITY, "(SELECT DISTINCT label, text FROM ner WHERE confidence > 0.7)", [
        ("type", f"'{graph.ONTOLOGY}' || {_CLASS}", _IRI, "", ""), ("type", f"'{graph.ONTOLOGY}NamedEntity'", _IRI, "", ""), ("label", "text", _LIT, "de", ""), ("nerLabel", "label", _LIT, "", "")])
    + " UNION ALL " + _rows("ner", _resource("entity", "'occ_' || chunk_id || '_' || i"), "(SELECT * FROM ner WHERE confidence > 0.7)", [
        ("type", f"'{graph.ONTOLOGY}EntityOccurrence'", _IRI, "", ""), ("entity", _ENTITY, _IRI, "", ""), ("inChunk", _resource("chunk", "chunk_id"), _IRI, "", ""), ("inDocument", _resource("norm", "doc_id"), _IRI, "", ""),
        ("confidence", "printf('%.4f', confidence)", _LIT, "", graph.DECIMAL), ("nerSource", "source", _LIT, "", ""), ("normReference", "norm_reference", _LIT, "", "")]),
}


def _over(sql: str, *graphs: str) -> str:
    """SQL over a table `triples` of some graphs."""
    views = {"norms": ["docs", "chunks"], "svo": ["svo"], "ner": ["ner"]}
    return with_views("", *[v for g in graphs for v in views[g]]).rstrip() + ", triples AS (" + "\nUNION ALL ".join(_GRAPHS[g] for g in graphs) + ")\n" + sql


query("kg_01_norm_triples", lambda v: graph.norm_triples(v.docs, v.chunks), _over("SELECT * FROM triples", "norms"))
query("kg_02_svo_triples", lambda v: graph.svo_triples(v.svo, v.chunks.where(C("chunk_id") % 3 == 0)).groupBy("p", "kind", "lang", "datatype").agg(n(), F.countDistinct("o").alias("objects")), _over(f"""
SELECT p, kind, lang, datatype, count(*) AS n, count(DISTINCT o) AS objects FROM triples WHERE s IN (SELECT {_resource('svo', 'svo_id')} FROM svo WHERE chunk_id % 3 <> 0) GROUP BY ALL""", "svo"))
query("kg_03_ner_triples", lambda v: graph.ner_triples(v.ner).groupBy("p", "kind", "lang", "datatype").agg(n(), F.countDistinct("s").alias("subjects")), _over("SELECT p, kind, lang, datatype, count(*) AS n, count(DISTINCT s) AS subjects FROM triples GROUP BY ALL", "ner"))
query("kg_04_exported_graphs", lambda v: graph.export_all(v.spark, {"norms": lambda: graph.norm_triples(v.docs, v.chunks), "svo": lambda: graph.svo_triples(v.svo), "ner": lambda: graph.ner_triples(v.ner), "lost": lambda: graph.norm_triples(v.table("region"))}).select("graph", "triples", C("error").isNotNull().alias("failed")),
      _over("SELECT graph, count(*) AS triples, false AS failed FROM triples GROUP BY graph UNION ALL SELECT 'lost', 0, true", "norms", "svo", "ner"))
query("kg_06_entities_by_label", lambda v: graph.entities_by_label(graph.ner_triples(v.ner), "ROLLE"), """
SELECT text, norm_reference AS "normReference", count(*) AS frequency FROM ner WHERE label = 'ROLLE' GROUP BY 1, 2 ORDER BY frequency DESC, text, "normReference" NULLS FIRST LIMIT 30""", "ner")
query("kg_05_joi_16_by_subject", lambda v: graph.by_subject(graph.svo_triples(v.svo), "die").select("s", "predicate", "object", "normType", "normReference"), f"""
SELECT {_resource('svo', 'svo_id')} AS s, predicate, object, norm_type AS "normType", norm_reference AS "normReference" FROM svo WHERE lower(subject) = 'die' AND predicate IS NOT NULL ORDER BY printf('%.4f', confidence) DESC, s LIMIT 50""", "svo")
query("kg_07_joi_17_dependencies", lambda v: graph.dependencies(_triples(v)), """
SELECT d.norm_reference AS "normReference", title, n FROM (SELECT DISTINCT doc_id, norm_reference FROM chunks) d JOIN docs USING (doc_id) JOIN (SELECT norm_reference, count(*) AS n FROM svo WHERE subject IS NOT NULL GROUP BY 1) s ON s.norm_reference = d.norm_reference
ORDER BY n DESC, 1, title LIMIT 50""", "svo", "docs")
query("kg_08_impact", lambda v: graph.impact(graph.svo_triples(v.svo), "3"), f"""
SELECT {_resource('svo', 'svo_id')} AS s, {_resource('chunk', 'chunk_id')} AS "fromChunk", subject, predicate, object, norm_reference AS "normReference" FROM svo WHERE doc_id = 3 AND subject IS NOT NULL AND predicate IS NOT NULL ORDER BY norm_reference NULLS FIRST, s LIMIT 100""", "svo")
query("kg_09_rdf_classes", lambda v: v.ner.groupBy(T.lookup(C("label"), R.RDF_CLASSES, "Entity").alias("class")).agg(n()), """SELECT CASE label WHEN 'BEHÖRDE' THEN 'Authority' WHEN 'ROLLE' THEN 'Role' WHEN 'DATENOBJEKT' THEN 'DataObject' END AS "class", count(*) AS n FROM ner GROUP BY 1""", "ner")
query("snk_11_n_triples", lambda v: graph.n_triples(_triples(v)).groupBy("graph").agg(n("lines"), F.sum(F.length("value")).alias("characters")), _over(r"""
SELECT graph, count(*) AS lines, CAST(sum(length('<' || s || '> <' || p || '> ' || CASE kind WHEN 'iri' THEN '<' || o || '>' ELSE '"' || replace(replace(replace(replace(o, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r') || '"' || coalesce('@' || lang, '') || coalesce('^^<' || datatype || '>', '') END || ' .')) AS BIGINT) AS characters
FROM triples GROUP BY graph""", "norms", "svo", "ner"))
query("snk_11_parsed_lines", lambda v: graph.parsed(graph.n_triples(_triples(v))).groupBy("graph", "p", "kind", "lang", "datatype").agg(n(), F.min("s").alias("first"), F.max("o").alias("last"), F.sum(F.length("o")).alias("characters")), _over(
    "SELECT graph, p, kind, lang, datatype, count(*) AS n, min(s) AS first, max(o) AS last, CAST(sum(length(o)) AS BIGINT) AS characters FROM triples GROUP BY ALL", "norms", "svo", "ner"))

# ---- abbreviations, document types, answers, progress
query("txt_11_abbreviations", lambda v: v.chunks.select("chunk_id", A.abbreviations(C("content")).alias("r")).select("chunk_id", F.size("r.map").cast("long").alias("replaced"), F.length("r.text").cast("long").alias("chars")).where("replaced > 0"), r"""
SELECT chunk_id, CAST(len(regexp_extract_all(content, '\bDSGVO\b')) AS BIGINT) AS replaced, CAST(length(regexp_replace(content, '\bDSGVO\b', 'Datenschutz-Grundverordnung', 'g')) AS BIGINT) AS chars FROM chunks WHERE regexp_matches(content, '\bDSGVO\b')""", "chunks")
_VARIANTS = ", ".join("('" + v + "', '" + c + "', " + ("[" + ", ".join(f"'{w.lower()}'" for w in words) + "]::VARCHAR[]" if words else "[]::VARCHAR[]") + ")" for c, variants, words in A.SYNONYMS for v in variants)
query("txt_12_synonyms", lambda v: v.chunks.select("chunk_id", F.explode(A.synonyms(C("content"))["map"]).alias("m")).select("chunk_id", "m.abbrev", "m.resolved", *[C("m." + c).cast("long").alias(c) for c in ("orig_start", "orig_end", "res_start", "res_end")]),
      with_views("", "chunks").rstrip() + rf""", variants(variant, canonical, words) AS (VALUES {_VARIANTS}),
split AS (SELECT chunk_id, content, variant, canonical, words, string_split(lower(content), lower(variant)) AS s FROM chunks JOIN variants ON contains(lower(content), lower(variant))),
placed AS (SELECT chunk_id, content, canonical, words, length(variant) AS size, unnest(list_transform(range(1, len(s)), lambda k: CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + (k - 1) * length(variant) AS BIGINT))) AS place FROM split),
near AS (SELECT *, substr(content, place + 1, size) AS found, lower(substr(content, greatest(1, place - 149), place + size + 151 - greatest(1, place - 149))) AS around FROM placed WHERE NOT regexp_matches(CASE WHEN place > 0 THEN substr(content, place, 1) ELSE ' ' END || substr(content, place + size + 1, 1), '[\p{{L}}\p{{N}}_]')),
counted AS (SELECT * FROM near WHERE len(words) = 0 OR len(list_filter(words, lambda w: contains(around, w))) > 0),
kept AS (SELECT * FROM counted a WHERE NOT EXISTS (SELECT 1 FROM counted b WHERE b.chunk_id = a.chunk_id AND b.place < a.place + a.size AND a.place < b.place + b.size AND (b.size > a.size OR (b.size = a.size AND b.place < a.place)))),
cased AS (SELECT chunk_id, found AS abbrev, place, size, CASE WHEN found = upper(found) THEN upper(canonical) WHEN found = lower(found) THEN lower(canonical) WHEN found[1] = upper(found[1]) THEN upper(canonical[1]) || canonical[2:] ELSE canonical END AS resolved FROM kept)
SELECT chunk_id, abbrev, resolved, place AS orig_start, place + size AS orig_end, CAST(place + moved AS BIGINT) AS res_start, CAST(place + moved + length(resolved) AS BIGINT) AS res_end
FROM (SELECT *, coalesce(sum(length(resolved) - size) OVER (PARTITION BY chunk_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved FROM cased)""")
query("txt_13_original", lambda v: v.chunks.select("chunk_id", "content", A.abbreviations(C("content")).alias("r")).select("chunk_id", (A.original(C("r.text"), C("r.map")) == C("content")).alias("same")), "SELECT chunk_id, true AS same FROM chunks", "chunks")
#: Rules of the query below; the operator takes any.
_TYPES = {
    "gesetz": {"title": [r"gesetz", r"dokument \d*0$"], "filename": [r"gesetz"], "signals": [r"§", r"abs\."], "min_paragraphs": 3, "norm_structure": True, "minimum": 0.55},
    "leitfaden": {"title": [r"leitfaden", r"dokument \d*[5-9]$"], "filename": [r"leitfaden"], "signals": [r"kann", r"hinweis"], "max_paragraphs": 2, "question_share": 0.1, "toc": True, "minimum": 0.5},
    "lastenheft": {"title": [r"dokument \d*[34]$"], "signals": [r"anforderung"], "requirements": True, "minimum": 0.45},
}


def _typed(v: Views) -> DataFrame:
    d = C("doc_id")
    more = F.when(d % 4 == 0, " Satz 1").when(d % 4 == 3, " A-123").when(d % 3 == 2, "\nInhaltsverzeichnis").otherwise("")
    text = chunking.rendered_documents(v.chunks).select("doc_id", F.concat("text", more).alias("text"))
    return text.join(v.docs.select("doc_id", "title"), "doc_id").select("doc_id", extraction.document_type(C("title"), F.concat(C("title"), F.lit(".pdf")), C("text"), _TYPES).alias("kind"))


query("txt_15_document_type", _typed, r"""
SELECT doc_id, CASE WHEN g >= 0.5499 THEN 'gesetz' WHEN l >= 0.4999 THEN 'leitfaden' WHEN r >= 0.4499 THEN 'lastenheft' ELSE 'text' END AS kind FROM (
SELECT doc_id, CASE WHEN regexp_matches(title, '[0]$') THEN 0.4 ELSE 0 END + least(0.2, CASE WHEN contains(h, '§') THEN 0.05 ELSE 0 END + CASE WHEN contains(h, 'abs.') THEN 0.05 ELSE 0 END) + CASE WHEN p >= 3 THEN 0.1 ELSE 0 END
    + CASE WHEN regexp_matches(text, '\bAbs\.\s*\d')::INT + regexp_matches(text, '\bSatz\s*\d')::INT + regexp_matches(text, '\bNr\.\s*\d')::INT >= 2 THEN 0.1 ELSE 0 END AS g,
  CASE WHEN regexp_matches(title, '[5-9]$') THEN 0.4 ELSE 0 END + least(0.2, CASE WHEN contains(h, 'kann') THEN 0.05 ELSE 0 END + CASE WHEN contains(h, 'hinweis') THEN 0.05 ELSE 0 END) + CASE WHEN p <= 2 THEN 0.05 ELSE 0 END
    + CASE WHEN length(text) > 100 AND coalesce(q::DOUBLE / nullif(e, 0), 0) >= 0.1 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(left(text, 5000), '(?im)^\s*(?:inhaltsverzeichnis|table\s+of\s+contents)\s*$') THEN 0.1 ELSE 0 END AS l,
  CASE WHEN regexp_matches(title, '[34]$') THEN 0.4 ELSE 0 END + CASE WHEN contains(h, 'anforderung') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(text, '\b[A-Z]-\d{3}\b') THEN 0.1 ELSE 0 END AS r
FROM (SELECT doc_id, title, text, lower(left(text, 5000)) AS h, len(regexp_extract_all(text, '§\s*\d+')) AS p, len(regexp_extract_all(text, '\?')) AS q, len(regexp_extract_all(text, '[.!?]')) AS e
  FROM (SELECT doc_id, string_agg(content, chr(10) ORDER BY pos) || CASE WHEN doc_id % 4 = 0 THEN ' Satz 1' WHEN doc_id % 4 = 3 THEN ' A-123' WHEN doc_id % 3 = 2 THEN chr(10) || 'Inhaltsverzeichnis' ELSE '' END AS text FROM chunks GROUP BY doc_id) t JOIN docs USING (doc_id)))""", "chunks", "docs")
query("txt_18_ret_01_query_plan", lambda v: extraction.query_plan(v.sentences.where(T.is_question(C("sentence"))).select((C("chunk_id") * 1000 + C("i")).alias("query_id"), C("sentence").alias("text"), F.lit("Eine Antwort.").alias("hyde"), F.lit("Allgemein?").alias("step_back"))).groupBy("kind", "strategy", "weight", "classes").agg(n()), f"""
SELECT kind, strategy, weight, CASE WHEN kind = 'NORM' THEN 'A' WHEN kind IN ('IM', 'ENTITY') THEN 'A,B' END AS classes, count(*) AS n FROM (
SELECT kind, unnest(['direct', 'hyde', 'step_back']) AS strategy, unnest([1.0::DOUBLE, 0.8::DOUBLE, 0.6::DOUBLE]) AS weight, unnest([true, NOT referred, kind = 'NORM']) AS used FROM (
SELECT CASE WHEN regexp_matches(lower(sentence), '{R.QUERY_NORM}') THEN 'NORM' WHEN regexp_matches(lower(sentence), '{R.bordered(R.QUERY_IM)}') THEN 'IM' WHEN regexp_matches(lower(sentence), '{R.bordered(R.QUERY_ENTITY)}') THEN 'ENTITY' ELSE 'GENERAL' END AS kind,
  regexp_matches(sentence, '{_ASKED_FOR}') AS referred FROM sentences WHERE length(sentence) BETWEEN 10 AND 300 AND ends_with(rtrim(sentence, ' '), '?'))) WHERE used GROUP BY ALL""", "sentences")
#: Shapes of model answers by doc_id: before and after the title. None: the answer has no title.
_JSON_ANSWERS = [('Antwort: ```json [{"id": "', '"}, {"id": '), ('```json {"id": "', '", "n": 3} ```'), ("keine Antwort zu ", ""), ('[{"id": "', '", "l": [1, 2]}, {"id": "x"}] und mehr'), ('vorher {"a": {"b": null, "c": "', '"}} nachher [1]'), ('[{"id": "', '"}, {"id": "y"}, {"id": "z", "l": [')]
_JSON_FOUND = [('[{"id": "', '"}]'), ('{"id": "', '", "n": 3}'), None, ('[{"id": "', '", "l": [1, 2]}, {"id": "x"}]'), ('{"a": {"b": null, "c": "', '"}}'), ('[{"id": "', '"}, {"id": "y"}]')]
_ANSWERS = [('{"antwort": "', '", "konfidenz": "hoch"}'), ('```json {"antwort": "', '", "normtyp": "MUST", "quellen": ["§ 1", "§ 2"], "konfidenz": "mittel", "hinweis": "geprüft", "nicht_beantwortbar": false} ```'), ("  Frei: ", "  "), ('{"nicht_beantwortbar": true, "hinweis": "', '"}'), ('{"antwort": "', '", "quellen": []')]


def _shaped(shapes: list[tuple[str, str]]) -> Column:
    """The title in a shape that the id gives."""
    part = lambda k: F.get(F.array(*[F.lit(x[k]) for x in shapes]), (C("doc_id") % len(shapes)).cast("int"))
    return F.concat(part(0), "title", part(1))


query("txt_19_json_answers", lambda v: v.docs.select("doc_id", extraction.json_of(_shaped(_JSON_ANSWERS)).alias("json")), "SELECT doc_id, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{x[0]}' || title || '{x[1]}'" for i, x in enumerate(_JSON_FOUND) if x) + " END AS json FROM docs", "docs")
query("txt_23_progress", lambda v: reports.job_state(v.jobs).select("user_id", extraction.progress(C("updates"), C("updates") + C("errors"), F.lit(60)).alias("p")).select("user_id", "p.percent", "p.rate"), """
SELECT user_id, round(count(*) * 100.0::DOUBLE / (count(*) + sum((event_type = 'error')::INT)), 1) AS percent, round(count(*)::DOUBLE / 60, 3) AS rate FROM events GROUP BY user_id""")
query("ans_01_generated_answers", lambda v: v.docs.select("doc_id", extraction.generated_answer(_shaped(_ANSWERS)).alias("a")).select("doc_id", "a.antwort", "a.normtyp", F.array_join("a.quellen", ";").alias("quellen"), "a.konfidenz", "a.hinweis", "a.nicht_beantwortbar"), """
SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'Frei: ' || title WHEN 3 THEN '{"nicht_beantwortbar": true, "hinweis": "' || title || '"}' WHEN 4 THEN '{"antwort": "' || title || '", "quellen": []' ELSE title END AS antwort, CASE doc_id % 5 WHEN 1 THEN 'MUST' ELSE 'UNKNOWN' END AS normtyp,
  CASE doc_id % 5 WHEN 1 THEN '§ 1;§ 2' ELSE '' END AS quellen, CASE doc_id % 5 WHEN 0 THEN 'hoch' WHEN 1 THEN 'mittel' ELSE 'niedrig' END AS konfidenz, CASE doc_id % 5 WHEN 1 THEN 'geprüft' WHEN 3 THEN title END AS hinweis, doc_id % 5 = 3 AS nicht_beantwortbar FROM docs""", "docs")


def _in(labels: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in labels) + ")"


def _first_child(name: str, labels: list[str], nominal: bool = False) -> str:
    """The first child with one of the labels; if nominal, only where that child is no verb."""
    first = f"SELECT sent_id, head, min(i) AS c FROM kids WHERE dep IN {_in(labels)} GROUP BY ALL"
    return f"{name} AS ({f'SELECT f.* FROM ({first}) f JOIN tokens t ON t.sent_id = f.sent_id AND t.i = f.c WHERE t.pos NOT IN {_VERBAL}' if nominal else first})"


def _phrase(name: str, noun: str) -> str:
    allowed = f"dep NOT IN {_in(trees.PHRASE_ENDS)} AND pos NOT IN ('VERB', 'AUX', 'PUNCT') AND (dep IN {_in(trees.MODIFIERS)} OR pos = 'ADJ')"
    return f"""{name}_near AS (SELECT p.sent_id, p.i AS root, k.i FROM parts p JOIN kids k ON k.sent_id = p.sent_id AND k.head = p.{noun} WHERE {allowed.replace('dep', 'k.dep').replace('pos', 'k.pos')}),
{name}_words AS (SELECT m.*, t.text, sum((t.pos <> 'DET' AND lower(t.text) NOT IN {_in(trees.DETERMINERS)})::INT) OVER (PARTITION BY m.sent_id, m.root ORDER BY m.i) AS words FROM (SELECT sent_id, i AS root, {noun} AS i FROM parts WHERE {noun} IS NOT NULL
  UNION SELECT * FROM {name}_near UNION SELECT n.sent_id, n.root, k.i FROM {name}_near n JOIN kids k ON k.sent_id = n.sent_id AND k.head = n.i WHERE k.pos = 'ADJ' AND k.dep IN {_in(trees.MODIFIERS)}) m JOIN tokens t ON t.sent_id = m.sent_id AND t.i = m.i),
{name} AS (SELECT p.sent_id, p.i AS root, coalesce((SELECT string_agg(text, ' ' ORDER BY i) FROM {name}_words w WHERE w.sent_id = p.sent_id AND w.root = p.i AND words > 0), any_value(t.text)) AS phrase FROM parts p JOIN tokens t ON t.sent_id = p.sent_id AND t.i = p.{noun} GROUP BY p.sent_id, p.i)"""


_VERBAL = "('VERB', 'AUX')"
_PARTS = rf"""kids AS (SELECT * FROM tokens WHERE head <> i), roots AS (SELECT * FROM tokens WHERE dep = 'ROOT'),
{_first_child('subjects', trees.SUBJECTS)}, {_first_child('objects', trees.OBJECTS)}, {_first_child('under', trees.OBJECTS_BELOW_OBJECT, True)}, {_first_child('near', trees.OBJECTS_BELOW_VERB, True)}, {_first_child('low', trees.OBJECTS_BELOW_INFINITIVE, True)},
deepest AS (SELECT k.sent_id, k.head, arg_min(l.c, k.i) AS c FROM kids k JOIN low l ON l.sent_id = k.sent_id AND l.head = k.i WHERE k.pos = 'VERB' GROUP BY ALL),
of_child AS (SELECT sent_id, head, coalesce(n.c, d.c) AS c FROM near n FULL JOIN deepest d USING (sent_id, head)),
by_auxiliary AS (SELECT k.sent_id, k.head, arg_min(o.c, k.i) AS c FROM kids k JOIN of_child o ON o.sent_id = k.sent_id AND o.head = k.i WHERE k.pos IN {_VERBAL} AND k.dep IN {_in(trees.VERBS_BELOW_AUXILIARY)} GROUP BY ALL),
by_verb AS (SELECT k.sent_id, k.head, arg_min(l.c, k.i) AS c FROM kids k JOIN low l ON l.sent_id = k.sent_id AND l.head = k.i WHERE k.pos = 'VERB' AND k.dep IN {_in(trees.VERBS_BELOW_VERB)} GROUP BY ALL),
main AS (SELECT sent_id, head, min(i) AS c FROM kids WHERE pos = 'VERB' AND dep IN {_in(trees.MAIN_VERB)} GROUP BY ALL),
found AS (SELECT r.sent_id, r.i, CASE WHEN s.pos IN {_VERBAL} THEN coalesce(s2.c, s1.c) ELSE s1.c END AS subject, CASE WHEN o.pos IN {_VERBAL} THEN u.c ELSE o1.c END AS own, CASE r.pos WHEN 'AUX' THEN a.c WHEN 'VERB' THEN v.c END AS other, CASE WHEN r.pos = 'AUX' THEN coalesce(m.c, r.i) ELSE r.i END AS main
  FROM roots r LEFT JOIN subjects s1 ON s1.sent_id = r.sent_id AND s1.head = r.i LEFT JOIN tokens s ON s.sent_id = r.sent_id AND s.i = s1.c LEFT JOIN subjects s2 ON s2.sent_id = r.sent_id AND s2.head = s1.c
  LEFT JOIN objects o1 ON o1.sent_id = r.sent_id AND o1.head = r.i LEFT JOIN tokens o ON o.sent_id = r.sent_id AND o.i = o1.c LEFT JOIN under u ON u.sent_id = r.sent_id AND u.head = o1.c
  LEFT JOIN by_auxiliary a ON a.sent_id = r.sent_id AND a.head = r.i LEFT JOIN by_verb v ON v.sent_id = r.sent_id AND v.head = r.i LEFT JOIN main m ON m.sent_id = r.sent_id AND m.head = r.i),
cluster AS (SELECT sent_id, i AS root, i FROM found UNION SELECT sent_id, i, main FROM found UNION SELECT f.sent_id, f.i, k.i FROM found f JOIN kids k ON k.sent_id = f.sent_id AND k.head = f.i WHERE k.pos = 'AUX' AND k.dep IN {_in(trees.AUXILIARIES)}),
predicates AS (SELECT c.sent_id, c.root, string_agg(t.text, ' ' ORDER BY c.i) AS predicate FROM cluster c JOIN tokens t ON t.sent_id = c.sent_id AND t.i = c.i GROUP BY ALL),
parts AS (SELECT sent_id, i, main, predicate, CASE WHEN passive THEN subject ELSE object END AS object, CASE WHEN NOT passive THEN subject END AS subject FROM (SELECT *, coalesce(own, other) AS object,
  coalesce(own, other) IS NULL AND subject IS NOT NULL AND regexp_matches(predicate, '(^|[^\p{{L}}\p{{N}}_])zu[\p{{L}}\p{{N}}_]+en($|[^\p{{L}}\p{{N}}_])') AS passive FROM found JOIN predicates p USING (sent_id) WHERE p.root = found.i)),
{_phrase('subject_phrases', 'subject')},
{_phrase('object_phrases', 'object')},
adverbials AS (SELECT k.sent_id, p.i AS root, k.i AS top FROM parts p JOIN kids k ON k.sent_id = p.sent_id AND k.head = p.i WHERE k.dep IN {_in(trees.CONTEXT)} AND k.pos NOT IN ('PUNCT', 'CCONJ') AND k.i IS DISTINCT FROM p.object AND k.i IS DISTINCT FROM p.subject),
below AS (SELECT sent_id, root, top, top AS i FROM adverbials UNION ALL SELECT b.sent_id, b.root, b.top, k.i FROM below b JOIN kids k ON k.sent_id = b.sent_id AND k.head = b.i),
contexts AS (SELECT sent_id, root, string_agg(phrase, '; ' ORDER BY top) AS context FROM (SELECT b.sent_id, b.root, b.top, string_agg(t.text, ' ' ORDER BY b.i) AS phrase FROM below b JOIN tokens t ON t.sent_id = b.sent_id AND t.i = b.i GROUP BY ALL) WHERE length(phrase) < 100 GROUP BY ALL)
SELECT p.sent_id, s.phrase AS subject, p.predicate, m.lemma AS predicate_lemma, o.phrase AS object, c.context FROM parts p JOIN tokens m ON m.sent_id = p.sent_id AND m.i = p.main LEFT JOIN subject_phrases s ON s.sent_id = p.sent_id AND s.root = p.i
  LEFT JOIN object_phrases o ON o.sent_id = p.sent_id AND o.root = p.i LEFT JOIN contexts c ON c.sent_id = p.sent_id AND c.root = p.i"""
query("svo_02_06_statements", lambda v: trees.statements(v.tokens, v.chunks.select(C("chunk_id").alias("sent_id"), C("content").alias("sentence"))).select("sent_id", "subject", "predicate", "predicate_lemma", "object", "context"),
      with_views("", "tokens").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _PARTS)

# ---- sources and sinks
query("src_02_content_types", lambda v: v.docs.select("doc_id", F.concat("title", pick_extension(C("doc_id"))).alias("filename")).select("doc_id", files.content_type(C("filename")).alias("content_type"), files.table_kind(C("filename")).alias("kind")), """
SELECT doc_id, (['application/pdf', 'text/plain', 'application/vnd.ms-excel', 'application/octet-stream'])[doc_id % 4 + 1] AS content_type, (['pdf', NULL, 'sheet', NULL])[doc_id % 4 + 1] AS kind FROM docs""", "docs")
_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?i)</(p|div|li|h[1-6]|tr)>|<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_entity}', '{_char}')"
query("src_03_html_text", lambda v: v.table("pages").select("page_id", F.md5(files.html_text(C("html"))).alias("md5")), f"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace({_VISIBLE}, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS md5 FROM pages")
query("src_04_joined_parts", lambda v: v.table("documents").select("doc_id", F.md5(files.joined_parts(F.split("text", "\n"))).alias("md5")), r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10) || chr(10))) AS md5 FROM documents")
query("src_10_chunk_scan", lambda v: v.chunks.where(C("doc_class").isin("A", "B") & (C("token_count") >= 10)).select("chunk_id", "doc_class", "token_count"), "SELECT chunk_id, doc_class, token_count FROM chunks WHERE doc_class IN ('A', 'B') AND token_count >= 10", "chunks")
query("src_13_bundle_jobs", lambda v: files.bundle_jobs(v.docs.select(F.floor(C("doc_id") / 40).alias("bundle_id")).distinct().select("bundle_id", F.sequence(C("bundle_id") * 40, C("bundle_id") * 40 + 44).alias("doc_ids")), v.docs.where("doc_id % 9 <> 0")), """
SELECT bundle_id, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM docs WHERE doc_id % 9 <> 0) THEN 'queued' ELSE 'error' END AS status FROM (SELECT bundle_id, unnest(generate_series(bundle_id * 40, bundle_id * 40 + 44)) AS doc_id FROM (SELECT DISTINCT doc_id // 40 AS bundle_id FROM documents))""", "docs")
query("snk_01_upsert", lambda v: sinks.upserted(v.docs.where("doc_id % 2 = 0").select("doc_id", "title", "source_type"), v.docs.where("doc_id % 3 = 0").select("doc_id", F.upper("title").alias("title"), F.lit("neu").alias("source_type")), "doc_id", ["title"]), """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN doc_id % 2 = 0 THEN source_type ELSE 'neu' END AS source_type FROM docs WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""", "docs")
def _stored_upserts(v: Views) -> DataFrame:
    """Three commits to a stored table, one of them tried again, and what is read back."""
    table = snapshots.Table(v.spark, f"{shared.folder(v.spark)}/documents-{uuid.uuid4().hex}", "doc_id", 16)
    rows = v.docs.select("doc_id", "title", "source_type")
    table.upsert("first", rows.where("doc_id % 2 = 0"), ["title"])
    for _ in range(2):
        table.upsert("second", rows.where("doc_id % 3 = 0").select("doc_id", F.upper("title").alias("title"), F.lit("neu").alias("source_type")), ["title"])
    table.replace("third", rows.where("doc_id % 10 = 4").select("doc_id", F.lit("ersetzt").alias("title"), "source_type"))
    return table.read()


query("snk_01_05_stored_upserts", _stored_upserts, """
SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'ersetzt' WHEN doc_id % 3 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN doc_id % 10 <> 4 AND doc_id % 2 <> 0 THEN 'neu' ELSE source_type END AS source_type FROM docs WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 10 = 4""", "docs")
query("snk_02_03_stored_chunks", lambda v: sinks.stored_chunks(v.chunks, v.docs).select("chunk_id", "id", "chunk_type", "content_hash"), "SELECT chunk_id, md5(doc_id || '|' || doc_class || '|' || pos) AS id, chunk_type, md5(content) AS content_hash FROM chunks", "chunks")
query("snk_05_replaced", lambda v: sinks.replaced(v.ner.select("chunk_id", "i", "label"), v.ner.where("chunk_id % 5 = 0").select("chunk_id", "i", F.lit("neu").alias("label")), "chunk_id"), "SELECT chunk_id, i, CASE WHEN chunk_id % 5 = 0 THEN 'neu' ELSE label END AS label FROM ner", "ner")
query("snk_12_sync_log", lambda v: sinks.sync_log(v.chunks.select("chunk_id", F.lit(0).cast("long").alias("triple_count"), F.lit("pending").alias("status")), v.ner), """
SELECT c.chunk_id, coalesce(n, 0) AS triple_count, CASE WHEN n IS NULL THEN 'pending' ELSE 'done' END AS status FROM chunks c LEFT JOIN (SELECT chunk_id, count(*) AS n FROM ner GROUP BY chunk_id) e USING (chunk_id)""", "ner")
query("snk_15_16_reviews", lambda v: sinks.reviewed(v.chunks.select(F.md5(C("chunk_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("decision"), F.lit(False).alias("reviewed")), "a", "keep").groupBy("decision", "reviewed").agg(n()), """
SELECT CASE WHEN md5(chunk_id::VARCHAR) LIKE 'a%' THEN 'keep' END AS decision, md5(chunk_id::VARCHAR) LIKE 'a%' AS reviewed, count(*) AS n FROM chunks GROUP BY ALL""", "chunks")
query("agg_17_review_statistics", lambda v: v.sentences.where(T.is_question(C("sentence"))).groupBy(T.question_type(C("sentence")).alias("kind")).agg(n(), reports.flag(C("chunk_id") % 2 == 0).alias("kept")), f"SELECT {_QTYPE} AS kind, count(*) AS n, CAST(sum((chunk_id % 2 = 0)::INT) AS BIGINT) AS kept FROM (SELECT *, sentence AS s FROM sentences) WHERE length(s) BETWEEN 10 AND 300 AND ends_with(rtrim(s, ' '), '?') GROUP BY 1", "sentences")
query("agg_24_source_histogram", lambda v: _fused(v).join(v.chunks.select("chunk_id", "doc_class"), "chunk_id").groupBy("query_id", "doc_class", "lists").agg(n()), _RAG + " SELECT query_id, doc_class, lists, count(*) AS n FROM fused JOIN chunks USING (chunk_id) GROUP BY ALL")
query("joi_14_outside_references", lambda v: v.chunks.select("chunk_id", F.regexp_replace("content", T.CROSS_REFERENCE, "").alias("rest")).select("chunk_id", F.regexp_count("rest", F.lit(r"\d+")).cast("long").alias("numbers")).where("numbers > 0"), rf"SELECT chunk_id, numbers FROM (SELECT chunk_id, CAST(len(regexp_extract_all(regexp_replace(content, '{T.CROSS_REFERENCE}', '', 'g'), '\d+')) AS BIGINT) AS numbers FROM chunks) WHERE numbers > 0", "chunks")
query("set_01_first_seen", lambda v: retrieval.first_seen(_text_hits(v).select("query_id", "chunk_id", "score", F.lit(1).alias("o")).unionByName(_lookup(v).select("query_id", "chunk_id", "score", F.lit(0).alias("o"))), "o").select("query_id", "chunk_id", "o"), _RAG + " SELECT query_id, chunk_id, min(o) AS o FROM (SELECT query_id, chunk_id, 1 AS o FROM fts UNION ALL SELECT query_id, chunk_id, 0 FROM lookup) GROUP BY ALL")
