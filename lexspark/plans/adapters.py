"""Views of the norm model over the base tables, as DataFrames and as the SQL that gives the same rows.

The base tables have no legal markers, so lines of `documents` are rendered with them by arithmetic on their keys.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import rules as R
from lexspark.functions import text as T

#: Appended to a line by (doc_id + pos) % 12.
MARKERS = [
    "Der Halter muss dies anmelden.", "Dies darf nicht erfolgen.", "Dies erfolgt binnen 2 Wochen.", "Halter im Sinne dieses Gesetzes sind Personen.",
    "Die Aufsicht obliegt der Gemeinde.", "Hunde sind ausgenommen.", "Die Behörde kann nach § 5 Abs. 2 Ausnahmen erteilen.", "Wer ist hier zuständig?",
    "Die Meldung nach DSGVO und § 9 ist zu prüfen.", "Die haltende Person muss den Hund im zentralen Register und im Hunderegister registrieren, EIGENTÜMERIN und Chip angeben.",
    "Halterinnen und Halter weisen Versicherungsschutz nach; die örtlich zuständige Behörde prüft die persönlichen Daten.", ""]
#: Asked of every other document of the query set; the others are asked for two words of their own.
QUESTIONS = ["Muss der Halter anmelden?", "Aufsichten der Gemeinden", "Ausnahme der Behörden", "Meldungen zur DSGVO", "ausgenommener Hund"]
#: Labels and tags of the tokens, some more often than others.
TOKEN_LABELS = ["sb", "oa", "oc", "mo", "nk", "nk", "det", "attr", "op", "rc", "og", "aux", "cj", "punct", "obl", "sp"]
TOKEN_TAGS = ["NOUN", "NOUN", "VERB", "ADJ", "DET", "AUX", "PUNCT", "NOUN", "PRON", "ADJ"]
ABBREVIATIONS = [["DSGVO", "BGB"], ["DSGVO"], [], ["BSI", "BGB", "DSGVO"]]


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        d = F.col("doc_id")
        day = lambda s: F.lit(s).cast("date")
        return self.table("documents").select(
            "doc_id", F.concat(F.lit("Dokument "), d.cast("string")).alias("title"), pick(R.SOURCE_TYPES, d % 7).alias("source_type"),
            pick(["DE", "NI", "NW", "BY"], d % 4).alias("jurisdiction"), F.date_add(day("2020-01-01"), (d % 1000).cast("int")).alias("valid_from"),
            F.when(d % 5 == 0, day("2023-12-31")).when(d % 5 == 1, day("2027-12-31")).alias("valid_to"), F.col("lang").alias("language"),
            pick(["A", "B", "C"], d % 3).alias("doc_class"), F.date_add(day("2024-01-01"), (d % 30).cast("int")).alias("ingest_day"))

    @cached_property
    def chunks(self) -> DataFrame:
        lines = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
        d, p = F.col("doc_id"), F.col("pos").cast("long")
        para, kind = p - p % 4 + 1, pick(["A", "B", "C"], d % 3)
        head = F.when((kind == "A") & (p % 4 == 0), F.concat(F.lit("§ "), para.cast("string"), F.lit(" "))).when(kind == "A", F.concat(F.lit("("), (p % 4).cast("string"), F.lit(") "))).when(
            (kind == "B") & (p % 4 == 0), F.concat(F.lit("1."), para.cast("string"), F.lit(" "))).otherwise("")
        marker = pick(MARKERS, (d + p) % 12)
        content = F.concat(head, F.trim("line"), F.when(marker != "", F.concat(F.lit(" "), marker)).otherwise(""))
        key = d * 100000 + p
        rows = lines.select(
            key.alias("chunk_id"), "doc_id", p.alias("pos"), kind.alias("doc_class"), F.when(p % 4 == 0, 1).otherwise(2).cast("long").alias("hierarchy_level"),
            F.when(p % 4 != 0, key - p % 4).alias("parent_id"), content.alias("content"), F.when(kind == "A", F.concat(F.lit("§ "), para.cast("string"))).alias("norm_reference"),
            (p % 7 != 0).alias("has_embedding"),
            F.element_at(F.array(*[F.array(*[F.lit(x) for x in a]).cast("array<string>") for a in ABBREVIATIONS]), (d % 4 + 1).cast("int")).alias("abbrevs"))
        kind = F.when((F.col("doc_class") == "B") & F.contains("content", F.lit("|")), "tabelle").otherwise(T.chunk_type(F.col("content")))
        return rows.withColumn("token_count", T.token_estimate(F.col("content"))).withColumn("chunk_type", kind).withColumn(
            "confidence_weight", F.when(F.col("doc_class") == "A", 1.0).when(F.col("doc_class") == "B", 0.85).otherwise(0.65))

    @cached_property
    def sentences(self) -> DataFrame:
        each = self.chunks.select("chunk_id", "doc_id", "pos", "doc_class", "norm_reference", F.posexplode(T.sentences(F.col("content"))).alias("i", "sentence"))
        return each.withColumn("i", F.col("i").cast("long"))

    @cached_property
    def svo(self) -> DataFrame:
        i, s = F.col("i"), F.col("sentence")
        key = F.col("chunk_id") * 1000 + i
        word = lambda n: F.nullif(F.regexp_extract(s, r"^\s*" + r"\S+\s+" * n + r"(\S+)", 1), F.lit(""))
        last = F.nullif(F.regexp_extract(s, r"(?s)^(?:.*\s)?(\S*[\p{L}\p{N}])[^\p{L}\p{N}]*$", 1), F.lit(""))  # found from the end
        base = self.sentences.select(
            key.alias("svo_id"), "chunk_id", "doc_id", "doc_class", "norm_reference", "sentence", F.lower(word(1)).alias("predicate_lemma"), F.when(key % 4 == 0, word(2)).alias("context"), F.when(key % 3 != 0, word(0)).alias("subject"), word(1).alias("predicate"),
            F.when(key % 2 == 0, last).alias("object"), T.norm_type(s).alias("norm_type"))
        base = base.withColumn("norm_confidence", T.norm_confidence(F.col("norm_type")))
        have = lambda c: F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
        confidence = F.round(0.35 * have("subject") + 0.30 * have("predicate") + 0.25 * have("object") + 0.10 * F.col("norm_confidence"), 3)
        return base.withColumn("confidence", confidence).withColumn("subject_type", T.entity_type(F.col("subject"), R.SUBJECT_EXACT, R.SUBJECT_SUFFIX)).withColumn(
            "object_type", T.entity_type(F.col("object"), R.OBJECT_EXACT, R.OBJECT_SUFFIX))

    @cached_property
    def ner(self) -> DataFrame:
        words = self.chunks.select("chunk_id", "doc_id", "norm_reference", "chunk_type", F.posexplode(F.split("content", " ")).alias("i", "word"))
        word = F.regexp_extract("word", r"^[^\p{L}]*([\p{L}\p{N}-]*\p{L})[^\p{L}]*$", 1)
        rows = words.select("chunk_id", "doc_id", "norm_reference", "chunk_type", F.col("i").cast("long").alias("i"), word.alias("text")).where("text <> ''")
        lower = F.lower("text")
        label = kind = None
        for name, values in R.NER_EXACT.items():
            hit = lower.isin(values)
            label = F.when(hit, name) if label is None else label.when(hit, name)
        exact = label
        for name, values in R.NER_SUFFIX.items():
            label = label.when(lower.rlike("(" + "|".join(values) + ")$"), name)
        kind = F.when(exact.isNotNull(), R.NER_CONFIDENCE["exact"]).otherwise(R.NER_CONFIDENCE["suffix"])
        return rows.select("*", label.alias("label"), kind.alias("confidence"), pick(["rule", "flair"], (F.col("chunk_id") + F.col("i")) % 2).alias("source")).where("label is not null")

    @cached_property
    def jobs(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", "ts", "event_type")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", pick(["A", "B", "C"], F.col("label") % 3).alias("doc_class"), "embedding")

    @cached_property
    def asked(self) -> DataFrame:
        """The query set: every document whose id is divisible by 20, with a text, a reference and a vector."""
        d = F.col("doc_id")
        own = F.regexp_extract("text", r"^\S+\s+(\S+\s+\S+)", 1)
        rows = self.table("documents").where(d % 20 == 0).select(d.alias("query_id"), F.when(d % 40 == 0, pick(QUESTIONS, F.floor(d / 40) % 5)).otherwise(own).alias("text"), F.concat(F.lit("§ "), (d % 50 * 4 + 1).cast("string")).alias("reference"))
        return rows.join(self.table("embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("q")), F.col("query_id") % 500 == F.col("v")).drop("v")

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        vector = self.table("embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
        return self.chunks.where("has_embedding").join(vector, (F.col("doc_id") * 7 + F.col("pos")) % 500 == F.col("i")).select("chunk_id", "doc_class", "v")

    @cached_property
    def tokens(self) -> DataFrame:
        """Words of the chunks with trees of many shapes, labels and tags by a hash of their places, in the stead of a parser."""
        words = self.chunks.select(F.col("chunk_id").alias("sent_id"), F.split("content", " ").alias("w")).select("sent_id", F.size("w").alias("n"), F.posexplode("w").alias("i", "text"))
        i, root = F.col("i").cast("long"), F.least(F.col("sent_id") % 3, F.col("n") - 1)
        rows = words.select("sent_id", "i", "text", root.alias("root"), ((F.col("sent_id") * 7919 + i * i * 131 + i * 104729) % 1000003).alias("h"))
        h, r, i = F.col("h"), F.col("root"), F.col("i")
        head = F.when(i < r, F.when(h % 2 == 0, r).otherwise(i + 1)).otherwise(F.when(h % 5 < 2, r).otherwise(F.greatest(r, i + 1 - h % 5)))
        dep, pos = pick(TOKEN_LABELS, F.floor(h / 5) % len(TOKEN_LABELS)), pick(TOKEN_TAGS, F.floor(h / 101) % len(TOKEN_TAGS))
        return rows.select(
            "sent_id", "i", "text", F.lower("text").alias("lemma"), F.when(i == r, F.when(F.col("sent_id") % 2 == 0, "AUX").otherwise("VERB")).otherwise(pos).alias("pos"),
            F.when(i == r, "ROOT").otherwise(dep).alias("dep"), F.when(i == r, r).otherwise(head).cast("int").alias("head"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_case(column: str, ordered: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{n}'" for n, p in ordered) + f" ELSE {default} END"


def _sql_entity(column: str, exact: dict[str, str], suffix: dict[str, str]) -> str:
    return "CASE " + " ".join([f"WHEN contains(lower({column}), '{k}') THEN '{v}'" for k, v in exact.items()] + [f"WHEN ends_with(lower({column}), '{k}') THEN '{v}'" for k, v in suffix.items()]) + " END"


_NER_EXACT = " ".join(f"WHEN list_contains({_sql_list(v)}, lower(text)) THEN '{k}'" for k, v in R.NER_EXACT.items())
_NER_SUFFIX = " ".join(f"WHEN regexp_matches(lower(text), '({'|'.join(v)})$') THEN '{k}'" for k, v in R.NER_SUFFIX.items())
_NORM_CONFIDENCE = "CASE norm_type " + " ".join(f"WHEN '{n}' THEN {round(min(1.0, R.NORM_BASE + b), 4)}" for n, b, _ in R.NORM_TYPES) + f" ELSE {R.NORM_UNKNOWN} END"

CTE: dict[str, str] = {
    "docs": f"""docs AS (SELECT doc_id, 'Dokument ' || doc_id AS title, ({_sql_list(R.SOURCE_TYPES)})[doc_id % 7 + 1] AS source_type, (['DE', 'NI', 'NW', 'BY'])[doc_id % 4 + 1] AS jurisdiction,
  CAST(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS DATE) AS valid_from, CASE doc_id % 5 WHEN 0 THEN DATE '2023-12-31' WHEN 1 THEN DATE '2027-12-31' END AS valid_to, lang AS language,
  (['A', 'B', 'C'])[doc_id % 3 + 1] AS doc_class, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS ingest_day FROM documents)""",
    "chunks": f"""lines AS (SELECT * FROM (SELECT doc_id, CAST(unnest(generate_series(0, len(l) - 1)) AS BIGINT) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line, ' ') <> ''),
rendered AS (SELECT *, (['A', 'B', 'C'])[doc_id % 3 + 1] AS doc_class, pos - pos % 4 + 1 AS para, ({_sql_list(MARKERS)})[(doc_id + pos) % 12 + 1] AS marker FROM lines),
contents AS (SELECT *, CASE WHEN doc_class = 'A' AND pos % 4 = 0 THEN '§ ' || para || ' ' WHEN doc_class = 'A' THEN '(' || (pos % 4) || ') ' WHEN doc_class = 'B' AND pos % 4 = 0 THEN '1.' || para || ' ' ELSE '' END
  || trim(line, ' ') || CASE WHEN marker <> '' THEN ' ' || marker ELSE '' END AS content FROM rendered),
chunks AS (SELECT doc_id * 100000 + pos AS chunk_id, doc_id, pos, doc_class, CAST(CASE WHEN pos % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS hierarchy_level, CASE WHEN pos % 4 <> 0 THEN doc_id * 100000 + pos - pos % 4 END AS parent_id,
  content, CASE WHEN doc_class = 'A' THEN '§ ' || para END AS norm_reference, pos % 7 <> 0 AS has_embedding, ([{', '.join(_sql_list(a) + '::VARCHAR[]' for a in ABBREVIATIONS)}])[doc_id % 4 + 1] AS abbrevs,
  CAST(greatest(1, length(content) // 4) AS BIGINT) AS token_count, CASE WHEN doc_class = 'B' AND contains(content, '|') THEN 'tabelle' ELSE {_sql_case('content', [(n, R.unbordered(p)) for n, p in R.CHUNK_TYPES], "'tatbestand'")} END AS chunk_type,
  CASE doc_class WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END AS confidence_weight FROM contents)""",
    "sentences": r"""parts AS (SELECT chunk_id, doc_id, pos, doc_class, norm_reference, list_filter(string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS l FROM chunks),
sentences AS (SELECT chunk_id, doc_id, pos, doc_class, norm_reference, CAST(unnest(generate_series(0, len(l) - 1)) AS BIGINT) AS i, unnest(l) AS sentence FROM parts)""",
    "svo": rf"""svo0 AS (SELECT chunk_id * 1000 + i AS svo_id, chunk_id, doc_id, doc_class, norm_reference, sentence, lower(nullif(regexp_extract(sentence, '^\s*\S+\s+(\S+)', 1), '')) AS predicate_lemma,
  CASE WHEN (chunk_id * 1000 + i) % 4 = 0 THEN nullif(regexp_extract(sentence, '^\s*\S+\s+\S+\s+(\S+)', 1), '') END AS context, CASE WHEN (chunk_id * 1000 + i) % 3 <> 0 THEN nullif(regexp_extract(sentence, '^\s*(\S+)', 1), '') END AS subject,
  nullif(regexp_extract(sentence, '^\s*\S+\s+(\S+)', 1), '') AS predicate, CASE WHEN (chunk_id * 1000 + i) % 2 = 0 THEN nullif(regexp_extract(sentence, '(\S*[\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}]*$', 1), '') END AS object,
  {_sql_case('sentence', [(n, R.bordered(p)) for n, _, p in R.NORM_TYPES], "'UNKNOWN'")} AS norm_type FROM sentences),
svo1 AS (SELECT *, CAST({_NORM_CONFIDENCE} AS DOUBLE) AS norm_confidence FROM svo0),
svo AS (SELECT *, round(0.35::DOUBLE * (subject IS NOT NULL)::INT + 0.30::DOUBLE * (predicate IS NOT NULL)::INT + 0.25::DOUBLE * (object IS NOT NULL)::INT + 0.10::DOUBLE * norm_confidence, 3) AS confidence,
  {_sql_entity('subject', R.SUBJECT_EXACT, R.SUBJECT_SUFFIX)} AS subject_type, {_sql_entity('object', R.OBJECT_EXACT, R.OBJECT_SUFFIX)} AS object_type FROM svo1)""",
    "ner": rf"""words AS (SELECT chunk_id, doc_id, norm_reference, chunk_type, CAST(unnest(generate_series(0, len(l) - 1)) AS BIGINT) AS i, unnest(l) AS word FROM (SELECT chunk_id, doc_id, norm_reference, chunk_type, string_split(content, ' ') AS l FROM chunks)),
tokens AS (SELECT chunk_id, doc_id, norm_reference, chunk_type, i, regexp_extract(word, '^[^\p{{L}}]*([\p{{L}}\p{{N}}-]*\p{{L}})[^\p{{L}}]*$', 1) AS text FROM words),
ner AS (SELECT chunk_id, doc_id, norm_reference, chunk_type, i, text, CASE {_NER_EXACT} {_NER_SUFFIX} END AS label, CASE WHEN (CASE {_NER_EXACT} END) IS NOT NULL THEN 0.85::DOUBLE ELSE 0.80::DOUBLE END AS confidence,
  (['rule', 'flair'])[(chunk_id + i) % 2 + 1] AS source FROM tokens WHERE text <> '' AND (CASE {_NER_EXACT} {_NER_SUFFIX} END) IS NOT NULL)""",
    "vectors": "vectors AS (SELECT vec_id, (['A', 'B', 'C'])[label % 3 + 1] AS doc_class, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)",
}
CTE["asked"] = rf"""asked AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 40 = 0 THEN ({_sql_list(QUESTIONS)})[doc_id // 40 % 5 + 1] ELSE regexp_extract(text, '^\S+\s+(\S+\s+\S+)', 1) END AS text, '§ ' || (doc_id % 50 * 4 + 1) AS reference FROM documents WHERE doc_id % 20 = 0)"""
CTE["chunk_vectors"] = "chunk_vectors AS (SELECT chunk_id, c.doc_class, embedding FROM chunks c JOIN vectors ON vec_id = (doc_id * 7 + pos) % 500 WHERE has_embedding)"
CTE["tokens"] = f"""token_words AS (SELECT chunk_id AS sent_id, len(w) AS n, CAST(unnest(generate_series(0, len(w) - 1)) AS BIGINT) AS i, unnest(w) AS text FROM (SELECT chunk_id, string_split(content, ' ') AS w FROM chunks)),
token_hashes AS (SELECT *, least(sent_id % 3, n - 1) AS r, (sent_id * 7919 + i * i * 131 + i * 104729) % 1000003 AS h FROM token_words),
tokens AS (SELECT sent_id, i, text, lower(text) AS lemma, CASE WHEN i = r THEN CASE WHEN sent_id % 2 = 0 THEN 'AUX' ELSE 'VERB' END ELSE ({_sql_list(TOKEN_TAGS)})[h // 101 % {len(TOKEN_TAGS)} + 1] END AS pos,
  CASE WHEN i = r THEN 'ROOT' ELSE ({_sql_list(TOKEN_LABELS)})[h // 5 % {len(TOKEN_LABELS)} + 1] END AS dep,
  CASE WHEN i = r THEN r WHEN i < r THEN CASE WHEN h % 2 = 0 THEN r ELSE i + 1 END WHEN h % 5 < 2 THEN r ELSE greatest(r, i + 1 - h % 5) END AS head FROM token_hashes)"""
_NEEDS = {"tokens": ["chunks"], "chunk_vectors": ["chunks", "vectors"], "sentences": ["chunks"], "svo": ["sentences"], "ner": ["chunks"]}


def with_views(sql: str, *names: str) -> str:
    """SQL behind the views it names and those that they need."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return ("WITH " + ",\n".join(CTE[n] for n in wanted) + "\n" if wanted else "") + sql
