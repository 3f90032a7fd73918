"""Chunkers for paragraph-structured (A), chapter-structured (B) and free (C) documents, from array functions, with Arrow functions for the greedy steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

# fixed values: limits of chunks, the pattern of definitions, of numbered headings, of tables
PARENT_TOKENS, CHILD_TOKENS, SENTENCE_TOKENS = 1024, 256, 128
WINDOW_WORDS, PREFIX_WORDS, INTRO_TOKENS = 436, 76, 128
WINDOW_TOKENS, LEAST_TOKENS, OVERLAP = 384, 50, 0.20
NUMBERED = r"(?mdU)^(\d+(?:\.\d+)*)\s+(.+?)(?:\s*\.{3,}.*)?$"
#: Two lines with a bar inside, or three with a tab, from the start of a line on: a search within lines would take the square of their length.
TABLE = r"(?md)^(?:(?>(?:[^\n]+\|[^\n]+\n){2,}+)|(?>(?:[^\n]+\t[^\n]+\n){3,}+))"
DEFINITION = r"im\s+sinne\s+(?:dieses\s+gesetzes|dieser\s+verordnung|des\s+§\s*\d+)"


def rendered_documents(chunks: DataFrame) -> DataFrame:
    """doc_id and the text of its line chunks in order."""
    lines = F.array_sort(F.collect_list(F.struct("pos", "content")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["content"]), "\n").alias("text"))


def _groups(sizes: Column, limit: int) -> Column:
    """Begins and sizes of the groups of a greedy packing: a group closes before the size that would pass the limit."""

    @F.pandas_udf("array<struct<at:int,k:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def groups(values: np.ndarray | None) -> list[dict[str, int]] | None:
            if values is None:
                return None
            ends, out, at = np.cumsum(values), [], 0
            while at < len(ends):
                end = max(at + 1, int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), "right")))
                out.append({"at": at, "k": end - at})
                at = end
            return out

        for rows in batches:
            yield rows.map(groups)

    return run(sizes)


def packed_sentences(text: Column, limit: int) -> Column:
    """Sentences joined greedily: a group closes before the sentence that would pass the token limit. Linear in the text."""
    each = T.sentences(text)
    return F.transform(_groups(F.transform(each, T.token_estimate), limit), lambda g: F.array_join(F.slice(each, g["at"] + 1, g["k"]), " "))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def class_a(documents: DataFrame) -> DataFrame:
    """A parent chunk per paragraph with a reference, then its sections, definitions and sentence groups."""
    parts = F.filter(F.transform(F.split("text", r"\n(?=[ \t]*§[ \t]*\d+)"), _trimmed), lambda p: p != "")
    paras = documents.select("doc_id", F.posexplode(parts).alias("para", "body")).withColumn("body", F.regexp_replace("body", r"(?U)(§\s*\d+\w*)\s*\n+\s*", "$1 "))
    paras = paras.withColumn("norm_reference", T.norm_reference(F.col("body"))).where("norm_reference is not null")
    sections = F.filter(F.transform(F.split("body", r"(?m)(?=^\s*(?:\(\d+\)|Abs\.\s*\d+))"), _trimmed), lambda s: F.length(s) > 20)
    head = F.get(sections, F.lit(0)).startswith(F.trim(F.substring("body", 1, 30)))
    own = F.when(F.coalesce(head, F.lit(False)), F.slice(sections, 2, 1 << 30)).otherwise(sections)
    groups = packed_sentences(F.col("body"), CHILD_TOKENS)
    groups = F.when(T.token_estimate(F.get(groups, F.lit(0))) < 15, F.slice(groups, 2, 1 << 30)).otherwise(groups)
    children = paras.withColumn("sections", own).withColumn("sections", F.when(F.size("sections") > 0, F.col("sections")).otherwise(groups))
    each = children.select("doc_id", "para", "norm_reference", F.posexplode("sections").alias("section", "content"))
    definition = F.lower("content").rlike(DEFINITION)
    split = ~definition & (T.token_estimate(F.col("content")) > CHILD_TOKENS)
    pieces = F.when(split, packed_sentences(F.col("content"), SENTENCE_TOKENS)).otherwise(F.array(F.substring("content", 1, 4 * CHILD_TOKENS)))
    typed = each.select("doc_id", "para", "norm_reference", "section", F.when(definition, "definition").otherwise(T.chunk_type(F.col("content"))).alias("chunk_type"), F.when(split, 3).otherwise(2).alias("hierarchy_level"),
                        F.when(~split, T.token_estimate(F.col("content"))).alias("whole"), F.posexplode(pieces).alias("piece", "content"))
    lower = typed.select("doc_id", "para", "norm_reference", F.concat_ws(".", (F.col("section") + 1).cast("string"), (F.col("piece") + 1).cast("string")).alias("n"), "hierarchy_level", "chunk_type", F.coalesce("whole", T.token_estimate(F.col("content"))).alias("token_count"), "content")
    parents = paras.select("doc_id", "para", "norm_reference", F.lit("0").alias("n"), F.lit(1).alias("hierarchy_level"), F.lit("tatbestand").alias("chunk_type"), T.token_estimate(F.col("body")).alias("token_count"), F.substring("body", 1, 4 * PARENT_TOKENS).alias("content"))
    return parents.unionByName(lower)


def _sections(text: Column) -> Column:
    """path, head, body of the sections at numbered headings; without any, the whole text as one section."""
    parts = F.split(F.regexp_replace(text, NUMBERED, "\u0001$1\u0002$2\u0003"), "\u0001")  # headings are found one after the other
    section = lambda p: F.struct(F.substring_index(p, "\u0002", 1).alias("path"), _trimmed(F.split_part(F.substring_index(p, "\u0003", 1), F.lit("\u0002"), F.lit(2))).alias("head"), _trimmed(F.split_part(p, F.lit("\u0003"), F.lit(2))).alias("body"))
    whole = F.array(F.struct(F.lit("1").alias("path"), F.lit("Inhalt").alias("head"), text.alias("body")))
    return F.when(F.size(parts) > 1, F.transform(F.slice(parts, 2, 1 << 30), section)).otherwise(whole)


def intro(text: Column, limit: int = INTRO_TOKENS) -> Column:
    """The first whole sentences, up to the one that would pass the token limit."""
    each = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: F.struct(s.alias("s"), T.token_estimate(s).alias("n")))
    state = F.struct(F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("kept"), F.lit(True).alias("going"))

    def add(a: Column, x: Column) -> Column:
        fits = a["going"] & (a["tokens"] + x["n"] <= limit)
        return F.struct(F.when(fits, a["tokens"] + x["n"]).otherwise(a["tokens"]).alias("tokens"), F.when(fits, a["kept"] + 1).otherwise(a["kept"]).alias("kept"), fits.alias("going"))

    few = F.slice(each, 1, limit + 1)  # a sentence has a token at least
    kept = F.aggregate(few, state, add, lambda a: a["kept"])
    return F.array_join(F.transform(F.slice(few, 1, kept), lambda x: x["s"]), " ")


def class_b(documents: DataFrame) -> DataFrame:
    """doc_id, section, part, n, hierarchy_level, breadcrumb, chunk_type, requirement_id, token_count, content.

    Part 0 of a section is its heading with the first sentences; parts 1 are its tables, parts 2 windows of WINDOW_WORDS
    words of the rest. The first window of a section begins with up to PREFIX_WORDS last words of the window before it.
    Text before the first heading belongs to no section. All window functions run within a document.
    """
    nothing = F.array().cast("array<struct<depth:int,head:string>>")
    trail = F.struct(nothing.alias("stack"), F.array().cast("array<string>").alias("crumbs"))

    def push(a: Column, x: Column) -> Column:
        depth = F.size(F.split(x["path"], r"\."))
        stack = F.concat(F.filter(a["stack"], lambda e: e["depth"] < depth), F.array(F.struct(depth.alias("depth"), F.substring(x["head"], 1, 30).alias("head"))))
        return F.struct(stack.alias("stack"), F.concat(a["crumbs"], F.array(F.array_join(F.transform(stack, lambda e: e["head"]), " > "))).alias("crumbs"))

    secs = documents.select("doc_id", _sections(F.col("text")).alias("secs"))
    crumbs = F.aggregate("secs", trail, push, lambda a: a["crumbs"])
    each = secs.select("doc_id", F.posexplode(F.arrays_zip(F.col("secs").alias("s"), crumbs.alias("crumb"))).alias("section", "z"))
    depth = F.size(F.split("z.s.path", r"\.")).alias("depth")
    each = each.select("doc_id", "section", "z.s.head", "z.s.body", F.col("z.crumb").alias("breadcrumb"), depth, F.regexp_extract_all("z.s.body", F.lit(TABLE), F.lit(0)).alias("tables"))
    columns = ["doc_id", "section", "part", "n", "hierarchy_level", "breadcrumb", "chunk_type", "requirement_id", "token_count", "content"]
    none = F.lit(None).cast("string").alias("requirement_id")
    first = intro(F.col("body"))
    heads = each.select("doc_id", "section", F.lit(0).alias("part"), F.lit(0).alias("n"), F.col("depth").alias("hierarchy_level"), "breadcrumb", F.when(F.col("depth") > 1, "anforderung").otherwise("tatbestand").alias("chunk_type"), none,
                        T.token_estimate(first).alias("token_count"), _trimmed(F.concat("head", F.lit("\n"), first)).alias("content"))
    tables = each.select("doc_id", "section", F.lit(1).alias("part"), (F.col("depth") + 1).alias("hierarchy_level"), "breadcrumb", F.posexplode("tables").alias("n", "table"))
    tables = tables.select(*columns[:3], "n", "hierarchy_level", "breadcrumb", F.lit("tabelle").alias("chunk_type"), none, T.token_estimate(F.col("table")).alias("token_count"), _trimmed(F.col("table")).alias("content"))

    words = F.filter(F.split(F.regexp_replace("body", TABLE, ""), r"(?U)\s+"), lambda w: w != "")
    rows = each.select("doc_id", "section", "depth", "breadcrumb", words.alias("w")).where(F.size("w") > 0)
    here = Window.partitionBy("doc_id").orderBy("section")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    count = F.ceil(F.size("w") / WINDOW_WORDS)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.size("w")).over(before), F.lit(0)))
    # where the last window before begins, if that is not the only one of its section, whose prefix goes on
    rows = rows.withColumn("last", F.when(count > 1, F.col("start") + (count - 1) * WINDOW_WORDS)).withColumn("since", F.coalesce(F.max("last").over(before), F.lit(0)))
    tail = F.flatten(F.collect_list(F.slice("w", -F.least(F.size("w"), F.lit(PREFIX_WORDS)), PREFIX_WORDS)).over(here.rowsBetween(-PREFIX_WORDS, -1)))
    rows = rows.withColumn("tail", tail).withColumn("reach", F.least(F.lit(PREFIX_WORDS), F.col("start") - F.col("since")).cast("int"))
    prefix = F.when(F.col("reach") > 0, F.slice("tail", -F.greatest(F.lit(1), F.col("reach")), F.col("reach"))).otherwise(F.array().cast("array<string>"))
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(WINDOW_WORDS)), lambda at: F.array_join(F.concat(F.when(at == 0, F.col("prefix")).otherwise(F.array().cast("array<string>")), F.slice("w", at + 1, WINDOW_WORDS)), " "))
    windows = rows.withColumn("prefix", prefix).select("doc_id", "section", F.lit(2).alias("part"), (F.col("depth") + 1).alias("hierarchy_level"), "breadcrumb", F.posexplode(cut).alias("n", "content"))
    named = T.requirement_id(F.col("content"))
    windows = windows.select(*columns[:3], "n", "hierarchy_level", "breadcrumb", F.when(named.isNotNull(), "anforderung").otherwise("tatbestand").alias("chunk_type"), named.alias("requirement_id"), T.token_estimate(F.col("content")).alias("token_count"), "content")
    return heads.unionByName(tables).unionByName(windows).where(_trimmed(F.col("content")) != "")


def routed(documents: DataFrame) -> DataFrame:
    """doc_id, doc_class, place, hierarchy_level, chunk_type, token_count, content: each document by the chunker of its structure's class."""
    found = documents.select("doc_id", "text", T.structure(F.col("text")).alias("s")).withColumn("doc_class", T.class_hint(F.col("s.paragraphs"), F.col("s.headings"), F.col("s.toc")))
    of = lambda name: found.where(F.col("doc_class") == name).select("doc_id", "text")
    shaped = lambda df, name, place, level, kind: df.select("doc_id", F.lit(name).alias("doc_class"), F.concat_ws("/", *[F.col(c).cast("string") for c in place]).alias("place"), level.cast("int").alias("hierarchy_level"), kind.alias("chunk_type"), "token_count", "content")
    a = shaped(class_a(of("A")), "A", ["para", "n"], F.col("hierarchy_level"), F.col("chunk_type"))
    b = shaped(class_b(of("B")), "B", ["section", "part", "n"], F.col("hierarchy_level"), F.col("chunk_type"))
    c = shaped(class_c(of("C")), "C", ["n"], F.lit(1), T.chunk_type(F.col("content")))
    return a.unionByName(b).unionByName(c).where(F.trim("content") != "")


def _windows(lengths: Column, size: Column, overlap: Column) -> Column:
    """Begins and sizes of windows over sentences of these lengths.

    A window has the usual size, or more until it has the least number of tokens or reaches the end; the next begins where
    it, or a window of the usual size if that is longer, ends, less the overlap, and one further on at least.
    """

    @F.pandas_udf("array<struct<at:int,k:int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def spans(values: np.ndarray, size: int, overlap: int) -> list[dict[str, int]]:
            ends, out, at = np.r_[0, np.cumsum(values + 1)], [], 0  # with the blanks between
            while at < len(values):
                k = min(size, len(values) - at)
                least = int(np.searchsorted(ends, ends[at] + 4 * LEAST_TOKENS + 1, "left")) - at
                k = min(max(k, least), len(values) - at)
                out.append({"at": at, "k": k})
                at += max(1, max(k, size) - overlap)
            return out

        for rows in batches:
            yield pd.Series([spans(*row) for row in zip(*rows)])

    return run(lengths, size, overlap)


def class_c(documents: DataFrame) -> DataFrame:
    """Windows of sentences: 3 to 10 by the mean size of the first twenty, grown to the least size, a fifth of all overlapping."""
    s = documents.select("doc_id", F.transform(T.sentences(F.col("text"), capital=True), _trimmed).alias("s")).where(F.size("s") > 0)
    first = F.slice("s", 1, 20)
    mean = F.aggregate(first, F.lit(0).cast("long"), lambda a, x: a + T.token_estimate(x)) / F.size(first)
    size = F.greatest(F.lit(3), F.least(F.lit(10), F.floor(F.lit(WINDOW_TOKENS) / mean))).cast("int")
    overlap = F.greatest(F.lit(1), F.floor(F.size("s") * F.lit(OVERLAP))).cast("int")
    rows = s.select("doc_id", "s", _windows(F.transform("s", F.length), size, overlap).alias("spans"))
    each = rows.select("doc_id", "s", F.posexplode("spans").alias("n", "span"))
    return each.select("doc_id", "n", F.array_join(F.slice("s", F.col("span.at") + 1, F.col("span.k")), " ").alias("content")).withColumn("token_count", T.token_estimate(F.col("content")))
