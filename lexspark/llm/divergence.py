"""Audit of how sources of one language differ in their words, by a baseline-correction inverted index (operator 12).

A language keeps the terms of at least MIN_DOCS of its documents, V in number. Within a (lang, source) group, a term of
count c has the smoothed share p = 1 + floor(BILLION * (c + 2) / (N + 2 * V)), N the group's counts of kept terms. Two
groups differ by the sum of f = floor((p - q)^2 / (p + q)) over all V terms. That sum is never formed term by term: each
pair starts at V times the f of two zero counts, and the postings add what is not zero in

* the change by a term of one group against a zero count in the other, once per group and share, times the terms of it;
* for a term in both, f of both shares less these two changes and the baseline.

So absent terms cost nothing, and a term costs the pairs of sources that hold it. Words are counted within tasks before
they are shuffled; a posting list is as long as the sources of a language, whatever the number of documents, and is
joined, not collected. All arithmetic is in whole numbers.

Null text, lang and source count as empty strings. Every row is a document, repeated or not. A group without terms has
pairs but no terms of its own; where V is 0, all pairs are 0. Ties go by the item's UTF-8 bytes. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import written

MIN_DOCS = 10
TOP = 10
BILLION = 1_000_000_000
#: Counted terms that a task holds before it hands them on.
HELD = 200_000

_LETTER = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Bytes of a UTF-8 text to terms apart by blanks: A to Z lower-cased, other letters and all beyond ASCII as they are.
_TERMS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _LETTER else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Matches of [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A to Z lower-cased, as UTF-8."""
    return text.encode().translate(_TERMS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, source, term.decode(), n, docs[term]) for (lang, source), (counts, docs) in held.items() for term, n in counts.items()]
        held.clear()
        names, kinds = ("lang", "source", "term", "count", "docs"), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text)
            counts.update(found)
            docs.update(set(found))
        if sum(len(c) for c, _ in held.values()) > HELD:
            yield out()
    if any(c for c, _ in held.values()):
        yield out()


def _share(count: Column, n: Column, v: Column) -> Column:
    """p of a count; null where there are no terms. The product is a decimal, as BILLION * count outgrows 64 bits."""
    product = F.lit(BILLION).cast("decimal(10,0)") * (count.cast("long") + 2).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", product, F.nullif(n + 2 * v, F.lit(0).cast("long")).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def postings(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, count, with the term's count in the language and whether it is the term's first row there."""
    counted = documents.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    grouped = counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    wide = grouped.withColumns({"all_docs": F.sum("docs").over(of_term), "all_count": F.sum("count").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    return wide.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "count", "all_count", "first")


def _groups(documents: DataFrame, index: DataFrame) -> DataFrame:
    """Every (lang, source) with N, the language's N and V, and the share p0 of a zero count."""
    of_group = index.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    of_lang = index.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.sum(F.col("first").cast("long")).alias("v"))
    rows = documents.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "lang_n", "v"])
    return rows.withColumn("p0", _share(F.lit(0), F.col("n"), F.col("v")))


def pair_parts(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, low, high, value: baselines and nonzero corrections, to be summed by pair of sources."""
    left, right = groups.select("lang", "v", F.col("source"), F.col("p0")), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = left.join(right, "lang").where(F.col("source") != F.col("item"))
    ends = [F.least("source", "item").alias("low"), F.greatest("source", "item").alias("high")]
    base = _f(F.col("p0"), F.col("q0"))
    zero = pairs.where("source < item").select("lang", *ends, F.coalesce(F.col("v") * base, F.lit(0).cast("long")).alias("value"))
    alike = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    one = alike.join(pairs, ["lang", "source"]).select("lang", *ends, (F.col("terms") * (_f(F.col("p"), F.col("q0")) - base)).alias("value"))
    other = shares.select("lang", "term", *[F.col(a).alias(b) for a, b in (("source", "item"), ("p", "q"), ("p0", "q0"))])
    change = _f(F.col("p"), F.col("q")) - _f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q")) + base
    both = shares.join(other, ["lang", "term"]).where("source < item").select("lang", *ends, change.alias("value"))
    summed = lambda rows: rows.where("value <> 0").groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    return zero.unionByName(summed(one)).unionByName(summed(both))


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    documents = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    index = written(postings(documents, min_docs), "divergence-postings")
    groups = written(_groups(documents, index), "divergence-groups")
    joined = index.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))
    shares = written(joined.select("lang", "source", "term", "p", "p0", _share(F.col("all_count"), F.col("lang_n"), F.col("v")).alias("lang_p")), "divergence-shares")

    pairs = pair_parts(groups, shares).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item")))
    pairs = pairs.select("lang", "value", F.explode(ways).alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    own = shares.where("p > lang_p").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("lang_p")).alias("value"))
    return ranked(pairs).unionByName(ranked(own).where(F.col("rank") <= top))


query = audit

ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (SELECT doc, lang, source, unnest(words) AS term FROM d
), kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM d
), counts AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""
