"""Subject-predicate-object statements: filters after extraction, entities by rule, and information-model signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import rules as R
from lexspark.sources.shared import written


def confidence(subject: Column, predicate: Column, obj: Column, norm: Column) -> Column:
    have = lambda c: F.when(c.isNotNull() & (c != ""), 1.0).otherwise(0.0)
    return F.round(0.35 * have(subject) + 0.30 * have(predicate) + 0.25 * have(obj) + 0.10 * norm, 3)


def found_once(df: DataFrame, name: str) -> DataFrame:
    """The frame with a column that comes out of a generator, below which no filter is pushed: what it is made of is computed once for each row."""
    return df.withColumn(name, F.explode(F.array(name)))


def filtered(svo: DataFrame) -> DataFrame:
    """The statement filters in their order: least confidence, subjects and objects nulled, pronouns, predicates."""
    subject, obj = F.col("subject"), F.col("object")
    no_subject = F.lower(subject).isin(R.STOP_SUBJECTS) | (F.length(subject) < 3) | subject.rlike(r"^(S\.|Abs\.|Nr\.)\s*\d+$") | subject.rlike(r"^\d+$")
    no_object = F.lower(obj).isin([x.lower() for x in R.STOP_OBJECTS]) | (F.length(obj) < 3) | obj.rlike(r"^\d{1,4}$")
    kept = found_once(svo, "confidence").where(F.col("confidence") >= R.MIN_CONFIDENCE)
    nulled = kept.withColumn("subject", F.when(~no_subject, subject)).withColumn("object", F.when(~no_object, obj))
    pronoun = F.coalesce(F.lower("subject").isin(R.PRONOUNS), F.lit(False))
    fined = nulled.withColumn("subject_type", F.when(pronoun, "PRONOMEN").otherwise(F.col("subject_type"))).withColumn(
        "confidence", F.when(pronoun, F.greatest(F.lit(0.0), F.col("confidence") - R.PRONOUN_PENALTY)).otherwise(F.col("confidence")))
    return fined.where(F.col("predicate").isNotNull() & (F.col("predicate") != "") & ~F.col("predicate").isin(R.STOP_PREDICATES))


def best_entities(ner: DataFrame) -> DataFrame:
    """One entity per chunk, lower-cased text and label: the most confident, the first on a tie."""
    order = Window.partitionBy("chunk_id", F.lower("text"), "label").orderBy(F.desc("confidence"), "i")
    return ner.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def without_near_rules(ner: DataFrame, near: int = 5) -> DataFrame:
    """Rule entities go where a model entity of the same chunk and label starts closer than `near` places.

    Places lie in bins of `near`: a rule entity can only be near to model entities of its own bin and of the two beside it,
    which stand in for their neighbours, so that the join has the bin in its key.
    """
    model = ner.where("source = 'flair'").select(F.col("chunk_id").alias("mc"), F.col("label").alias("ml"), F.col("i").alias("mi"))
    model = model.withColumn("mb", F.explode(F.array(*[F.floor(F.col("mi") / near) + step for step in (-1, 0, 1)])))
    rule = ner.where("source = 'rule'").withColumn("_bin", F.floor(F.col("i") / near))
    same = (F.col("chunk_id") == F.col("mc")) & (F.col("label") == F.col("ml")) & (F.col("_bin") == F.col("mb"))
    kept = rule.join(model, same & (F.abs(F.col("i") - F.col("mi")) < near), "left_anti").drop("_bin")
    return kept.unionByName(ner.where("source = 'flair'"))


def combined(ner: DataFrame, strategy: str = "merge", least: float = 0.6, near: int = 5) -> DataFrame:
    """Entities by strategy: those of the model (`flair_only`) or of the rules (`rules_only`), or the model's with what the
    rules add (`merge`); then the least confidence."""
    if strategy not in ("merge", "flair_only", "rules_only"):
        raise ValueError(f"no strategy {strategy}")
    source = {"flair_only": "flair", "rules_only": "rule"}.get(strategy)
    rows = ner.where(F.col("source") == source) if source else without_near_rules(ner, near)
    return rows.where(F.col("confidence") >= least)


def corrected(ner: DataFrame, least: float = 0.5) -> DataFrame:
    """Least confidence, blacklist, label corrections, then agnostic data objects."""
    table = F.create_map(*[F.lit(x) for kv in R.NER_CORRECTIONS.items() for x in kv])
    label = F.coalesce(F.when(F.col("text").isin(R.AGNOSTIC_OBJECTS), F.lit("DATENOBJEKT")), F.element_at(table, F.col("text")), F.col("label"))
    return ner.where((F.col("confidence") >= least) & ~F.col("text").isin(R.NER_BLACKLIST)).withColumn("label", label)


def context_checked(ner: DataFrame, chunks: DataFrame) -> DataFrame:
    """BEHÖRDE and GESETZ keep their label only near a word of their context, else SONSTIGE."""
    joined = ner.join(chunks.select("chunk_id", "content"), "chunk_id")
    at = F.position("text", "content")
    w = R.NER_CONTEXT_WINDOW
    start = F.greatest(F.lit(1), at - w)
    around = F.lower(F.col("content").substr(start, at + F.length("text") + w - start))
    label = F.col("label")
    for name, words in R.NER_CONTEXT.items():
        pattern = "(" + "|".join(x.replace(".", r"\.") for x in words) + ")"
        label = F.when((F.col("label") == name) & ~around.rlike(pattern), "SONSTIGE").otherwise(label)
    return joined.withColumn("label", label).drop("content")


def rule_entities(chunks: DataFrame) -> DataFrame:
    """Deadlines and law references by pattern: every occurrence's text, with its number in the chunk."""
    out = None
    for label, patterns in R.NER_REGEX.items():
        found = F.regexp_extract_all("content", F.lit("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(0))
        rows = chunks.select("chunk_id", F.posexplode(found).alias("i", "text")).select("chunk_id", F.lit(label).alias("label"), F.col("i").cast("long").alias("i"), "text", F.lit(R.NER_CONFIDENCE["regex"]).alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    return out


def model_signals(svo: DataFrame, ner: DataFrame) -> DataFrame:
    """Per chunk: entity candidates, whether attributes are demanded, and whether something is to be persisted."""
    must = F.col("norm_type") == "MUST"
    lower = F.lower("sentence")
    hit = lambda words: lower.rlike(R.bordered(words))
    per = svo.groupBy("chunk_id").agg(F.bool_or(must & hit(R.ATTRIBUTE_PREDICATES)).alias("attributes"), F.bool_or(must & hit(R.PERSISTENCE_PREDICATES)).alias("persistence"), F.bool_or(F.col("norm_type").isin("MUST", "DEF")).alias("binding"))
    names = ner.where(F.col("label").isin("ROLLE", "DATENOBJEKT")).groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("text")), ",").alias("names"))
    joined = per.join(names, "chunk_id", "left")
    return joined.select("chunk_id", F.when(F.col("binding"), F.col("names")).alias("entities"), "attributes", "persistence")


def annotations(entities: Column, definition: Column, attributes: Column, persistence: Column, relations: Column) -> Column:
    """Lines for a chunk's model signals, in this order; arrays of names, a name, a flag, and an array of (von, zu)."""
    filled = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    lines = lambda a, before, after: F.transform(filled(a), lambda x: F.concat(F.lit(before), x, F.lit(after)))
    pairs = F.filter(F.coalesce(relations, F.array().cast("array<struct<von:string,zu:string>>")), lambda r: (F.coalesce(r["von"], F.lit("")) != "") & (F.coalesce(r["zu"], F.lit("")) != ""))
    return F.concat(
        lines(entities, "[IM-ENTITY-KANDIDAT: ", " → Tabelle]"), lines(F.array(definition), "[IM-ENTITY-DEF: ", " = kanonische Definition]"), lines(attributes, "[IM-ATTRIBUT-KANDIDAT: ", " → Spalte]"),
        F.when(F.coalesce(persistence, F.lit(False)), F.array(F.lit("[IM-PERSISTENZ: Datenpersistenz erforderlich]"))).otherwise(F.array().cast("array<string>")),
        F.transform(pairs, lambda r: F.concat(F.lit("[IM-RELATION: "), r["von"], F.lit(" → "), r["zu"], F.lit("]"))))


def merged_labels(svo: DataFrame, answers: DataFrame) -> DataFrame:
    """Model answers (svo_id, norm_type, level) replace UNKNOWN where they are sure enough; levels hoch .9, mittel .7, niedrig .5.

    Of several answers to one id the surest counts, so that every statement stays one row, also where ids repeat.
    """
    sure = F.when(F.col("level") == "hoch", 0.9).when(F.col("level") == "mittel", 0.7).when(F.col("level") == "niedrig", 0.5).otherwise(0.0)
    answer = F.when(sure >= 0.75, F.col("norm_type")).otherwise("UNKNOWN")
    best = answers.groupBy("svo_id").agg(F.max(F.struct(sure.alias("confidence"), answer.alias("answer"))).alias("best"))
    valid = best.select("svo_id", "best.answer", F.col("best.confidence").alias("answer_confidence"))
    joined = svo.join(valid, "svo_id", "left")
    use = (F.col("norm_type") == "UNKNOWN") & F.col("answer").isNotNull() & (F.col("answer") != "UNKNOWN")
    return joined.withColumn("norm_confidence", F.when(use, F.col("answer_confidence")).otherwise(F.col("norm_confidence"))).withColumn("norm_type", F.when(use, F.col("answer")).otherwise(F.col("norm_type"))).drop("answer", "answer_confidence")


# ---- fixed values: why a statement is not sent to a model
TOO_SHORT, IS_NOUN, NO_BUDGET = "Text zu kurz", "Prädikat ist Substantiv", "Budget erreicht"
#: Ranges of documents within which calls are numbered.
RANGES = 64


def numbered_calls(per: DataFrame, key: str, many: str, ranges: int = RANGES) -> DataFrame:
    """Adds `before`: the sum of `many` over all rows with a lesser key, a distinct number.

    Two levels of sums: rows lie in ranges of the key by its approximate quantiles, the sum of a range is one number to the
    driver, and a row adds what its range holds before it. No task sees more than a range, and any bounds give right sums.
    """
    wanted = [i / ranges for i in range(1, ranges)]
    bounds = sorted({int(x) for x in per.select(F.col(key).cast("double")).approxQuantile(key, wanted, 0.1 / ranges)})
    place = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    ranged = per.withColumn("_range", place)
    sums = dict(ranged.groupBy("_range").agg(F.sum(many)).collect())
    offsets, total = [], 0
    for i in range(len(bounds) + 1):
        offsets.append(total)
        total += sums.get(i) or 0
    before = F.sum(many).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("before", F.coalesce(before, F.lit(0)) + F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_range"))).drop("_range")


def assigned(svo: DataFrame, size: int = 20, budget: int = 0) -> DataFrame:
    """svo_id, doc_id, batch, call, n, reason, sentence of every UNKNOWN statement.

    The statements of a document are cut into batches of `size` in order; calls are all batches in order of the documents,
    from 1. Within a batch, short texts and nouns in the place of predicates are skipped, with their reason; so is all
    beyond `budget` calls, if one is given. n numbers what is left of a batch.
    """
    order, of_batch = Window.partitionBy("doc_id").orderBy("svo_id"), Window.partitionBy("doc_id", "batch").orderBy("svo_id")
    text, predicate = F.trim(F.coalesce("sentence", F.lit(""))), F.trim(F.coalesce("predicate", F.lit("")))
    noun = predicate.rlike(r"^\p{Lu}\p{L}*$") & (F.length(predicate) > 3)
    asked = found_once(svo.select("svo_id", "doc_id", "sentence", "predicate", "norm_type"), "norm_type").where("norm_type = 'UNKNOWN'")
    rows = asked.select("svo_id", "doc_id", "sentence", F.when(F.length(text) < 15, TOO_SHORT).when(noun, IS_NOUN).alias("reason"), F.floor((F.row_number().over(order) - 1) / size).cast("long").alias("batch"))
    batches = written(asked.groupBy("doc_id").agg(F.ceil(F.count("*") / size).cast("long").alias("batches")), "batches")  # read three times
    rows = rows.join(numbered_calls(batches, "doc_id", "batches").select("doc_id", "before"), "doc_id").withColumn("call", F.col("before") + F.col("batch") + 1)
    if budget:
        rows = rows.withColumn("reason", F.when(F.col("call") > budget, NO_BUDGET).otherwise(F.col("reason")))
    sent = F.when(F.col("reason").isNull(), F.sum(F.col("reason").isNull().cast("int")).over(of_batch))
    return rows.select("svo_id", "doc_id", "batch", "call", sent.alias("n"), "reason", "sentence")


def prompt_batches(svo: DataFrame, size: int = 20, budget: int = 0) -> DataFrame:
    """doc_id, batch, call, prompt, asked, statements: UNKNOWN statements as numbered lines, by assigned(). Batches of which nothing is asked have no prompt."""
    rows = assigned(svo, size, budget)
    line = F.when(F.col("n").isNotNull(), F.struct("n", F.format_string("SVO-%03d: %s", F.col("n"), F.col("sentence")).alias("line")))
    per = rows.groupBy("doc_id", "batch", "call").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.count("n").alias("asked"), F.count("*").alias("statements"))
    return per.where("asked > 0").select("doc_id", "batch", "call", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("prompt"), "asked", "statements")
