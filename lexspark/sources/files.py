"""Document sources: file listings, content types, parts of parsed texts, raw HTML, spreadsheet grids and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

# ---- fixed values: content types by file extension
CONTENT_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel", "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odt": "application/vnd.oasis.opendocument.text", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "html": "text/html", "htm": "text/html",
    "txt": "text/plain", "md": "text/markdown", "xml": "application/xml", "json": "application/json", "rtf": "application/rtf", "csv": "text/csv",
    "odp": "application/vnd.oasis.opendocument.presentation", "ppt": "application/vnd.ms-powerpoint", "tsv": "text/tab-separated-values", "epub": "application/epub+zip",
    "eml": "message/rfc822", "msg": "application/vnd.ms-outlook"}
#: Types without a stable structure: always class C.
FORCED_C = [CONTENT_TYPES[x] for x in ("pptx", "ppt", "odp", "eml", "msg")]
DEFAULT_TYPE = "application/octet-stream"
TABLE_KINDS = {"docx": "docx", "pdf": "pdf", "xlsx": "sheet", "xls": "sheet", "ods": "sheet"}


def extension(name: Column) -> Column:
    return F.lower(F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(""))


def content_type(name: Column) -> Column:
    return T.lookup(extension(name), CONTENT_TYPES, DEFAULT_TYPE)


def table_kind(name: Column) -> Column:
    """Which extractor reads a file's tables; null where none does."""
    return T.lookup(extension(name), TABLE_KINDS)


def accepted(files: DataFrame, name: str = "filename") -> DataFrame:
    """Files of a known content type; the forced class, if any, must be A, B or C."""
    ok = content_type(F.col(name)) != DEFAULT_TYPE
    if "force_class" in files.columns:
        ok &= F.col("force_class").isNull() | F.col("force_class").isin("A", "B", "C")
    return files.where(ok)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """doc_id (the folder), filename, content: the first file by name of every `doc_id/` folder below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("doc_id"), F.element_at(parts, -1).alias("filename"), "content")
    first = named.groupBy("doc_id").agg(F.min("filename").alias("filename"))
    return named.join(first, ["doc_id", "filename"])


def joined_parts(parts: Column) -> Column:
    """The parts of a parsed document with blank lines between; empty ones go."""
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), "\n\n")


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags go, block ends become line breaks, the common entities are resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|h[1-6]|tr)>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def sheet_tables(cells: DataFrame) -> DataFrame:
    """cells: sheet, row, values. The first row is the header if none of its cells is a number, else columns are numbered."""
    first = cells.groupBy("sheet").agg(F.min_by("values", "row").alias("head"), F.min("row").alias("start"))
    numeric = F.exists("head", lambda x: F.coalesce(x.rlike(r"^\s*-?\d+([.,]\d+)?\s*$"), F.lit(False)))
    rows = cells.join(first, "sheet").withColumn("numeric", numeric)
    header = F.when(F.col("numeric"), F.transform("head", lambda x, i: F.concat(F.lit("Spalte "), (i + 1).cast("string")))).otherwise(F.col("head"))
    body = rows.where(F.col("numeric") | (F.col("row") > F.col("start"))).where(F.exists("values", lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    return body.select("sheet", "row", header.alias("header"), "values", T.row_prose(header, F.col("values")).alias("prose"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """cells: table, row, col, text. A run of equal neighbours in a row, as merged cells give, counts once."""
    before = F.lag("text").over(Window.partitionBy("table", "row").orderBy("col"))
    return cells.withColumn("before", before).where("before is null or before <> text").drop("before")


def bundle_jobs(bundles: DataFrame, files: DataFrame) -> DataFrame:
    """bundle_id, doc_id, status of every document of a bundle: queued, or error where its file is missing."""
    each = bundles.select("bundle_id", F.explode("doc_ids").alias("doc_id"))
    there = files.select("doc_id").distinct().withColumn("there", F.lit(True))
    return each.join(there, "doc_id", "left").select("bundle_id", "doc_id", F.when(F.col("there"), "queued").otherwise("error").alias("status"))
