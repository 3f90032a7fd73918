"""URL filters by a temporal list join (operator 1).

A list is a table of dated entries (list_name, kind, pattern, action, day): `add` and `remove` of a host, of a domain
with all its subdomains, or of a path prefix. Entries become validity intervals [day, next entry's day). A capture is
checked against the entries in force on the day it was fetched: its URL gives a few keys (its host, the host's parent
domains, its path prefixes), and an equality join on the key with a range condition on the day finds them.

Captures are first counted by key and day, within tasks before they are shuffled, so a host with a third of all captures
meets the list once a day, and the verdicts are joined back on key and day. There, keys of more than one in HOT of all
rows, fewer than HOT in number, are split into SALTS parts by a hash of the capture. Keys reach as far as the list does:
the fewest and most labels of its domains and the most parts of its prefixes are looked up first, in one row, so that
captures do not meet under `com` unless the list holds it. Of several entries for one pattern on one day the
last by action (`remove` after `add`) counts, and repeated ones count once.

A result row stands for all captures of one capture_id, host, path and day, and `captures` says how many they are; so
none is lost where ids repeat or are null. Nulls: a null or malformed URL has no host and no keys and is never blocked;
so is one fetched on an unknown day. Entries with a null in any column are ignored. Hosts and patterns compare in lower
case, paths as they are. Extra columns are ignored. A tie between lists goes to the entry that came into force first,
then by names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import written

HOT, SALTS = 1000, 64


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)


def depths(entries: DataFrame) -> tuple[int, int, int]:
    """The fewest and most labels of a domain, and the most parts of a prefix's path, in the list."""
    labels = F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))
    parts = F.max(F.when(F.col("kind") == "prefix", F.size(F.filter(F.split("pattern", "/"), lambda x: x != "")) - 1))
    found = entries.agg(F.min(labels), F.max(labels), parts).first()
    return found[0] or 1, found[1] or 0, found[2] or 0


def keys_of(host: Column, path: Column, fewest: int, labels: int, parts: int) -> Column:
    """kind:pattern strings that an entry can match: the host, its domains of fewest to most labels, its path prefixes of so many parts."""
    own, names = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    upto = lambda n, first=1: F.filter(F.sequence(F.lit(0), n), lambda k: k >= first)
    domains = F.transform(upto(F.least(F.size(own), F.lit(labels)), fewest), lambda k: F.concat(F.lit("domain:"), F.array_join(F.slice(own, -k, k), ".")))
    prefixes = F.transform(upto(F.least(F.size(names), F.lit(parts))), lambda k: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(names, 1, k), "/")))
    keys = F.concat(F.array(F.concat(F.lit("host:"), host)), domains, F.coalesce(prefixes, F.array().cast("array<string>")))
    return F.when(F.coalesce(host, F.lit("")) != "", keys).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, key, valid_from, valid_to (exclusive; null while in force)."""
    host = F.lower(F.substring_index("pattern", "/", 1))
    rest = F.array_join(F.filter(F.split("pattern", "/"), lambda x: x != ""), "/")
    whole = F.when(F.col("kind") == "prefix", F.concat(host, F.substring(rest, F.length(host) + 1, F.length(rest)))).otherwise(F.lower("pattern"))
    key = F.concat("kind", F.lit(":"), whole)
    daily = entries.select("list_name", key.alias("key"), "action", "day").dropna().groupBy("list_name", "key", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list_name", "key").orderBy("day")  # a row a day at most
    lasting = daily.withColumn("valid_to", F.lead("day").over(order)).where("action = 'add'")
    return lasting.select("list_name", "key", F.col("day").alias("valid_from"), "valid_to")


def _joined(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Captures' keys with their verdicts; the keys and days of the most rows are split by a salt."""
    total = verdicts.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") * HOT > total
    hot = verdicts.where(is_hot).select("key", "day", F.lit(True).alias("hot"))  # fewer than HOT rows
    salted = asked.join(F.broadcast(hot), ["key", "day"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("capture_id", "host", "path"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(verdicts.select("key", "day", "entry", "n", F.explode(salts).alias("salt")), ["key", "day", "salt"]).drop("salt")


def check(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, host, path, day, captures, blocked, entries (in force), list_name, key and valid_from of the one longest in force."""
    fewest, labels, parts = depths(entries)
    each = ["capture_id", "host", "path", "day"]
    rows = captures.select("capture_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "day").groupBy(each).agg(F.count("*").alias("captures"))
    asked = rows.where("day is not null").select(*each, F.explode(keys_of(F.col("host"), F.col("path"), fewest, labels, parts)).alias("key"))  # no row without a key
    lists = intervals(entries)
    counted = asked.groupBy("key", "day").agg(F.count("*").alias("rows"))
    found = counted.join(lists, "key").where((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    entry = F.struct("valid_from", "list_name", "key")
    verdicts = written(found.groupBy("key", "day").agg(F.min(entry).alias("entry"), F.count("*").alias("n"), F.first("rows").alias("rows")), "url-verdicts")
    blocked = _joined(asked, verdicts).groupBy(each).agg(F.sum("n").alias("entries"), F.min("entry").alias("entry"))
    renamed = blocked.select(*[F.col(c).alias(f"_{c}") for c in each], "entries", "entry")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in each]
    out = rows.join(renamed, same, "left")
    return out.select(*each, "captures", F.col("entry").isNotNull().alias("blocked"), F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), "entry.list_name", "entry.key", "entry.valid_from")


def _number(text: Column) -> Column:
    """A number below 2^28 from the start of a text's MD5: the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def sample_captures(pages: DataFrame) -> DataFrame:
    """Every page as a capture on a day of 2024 that its id gives."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.expr("date_add(date'2024-01-01', cast(conv(substring(md5(cast(page_id as string)), 1, 7), 16, 10) % 366 as int))").alias("day"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from all hosts of the pages, by numbers that their names give."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("n", _number(F.col("host")))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    n = F.col("n")
    made = lambda keep, name, kind, pattern, action, at: hosts.where(keep).select(F.lit(name).alias("list_name"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day(at).alias("day"))
    last = F.substring_index("host", ".", -3)
    return (
        made(n % 3 == 0, "abuse", "host", F.col("host"), "add", n % 200)
        .unionByName(made(n % 6 == 0, "abuse", "host", F.col("host"), "remove", n % 200 + 60))
        .unionByName(made(n % 12 == 0, "abuse", "host", F.col("host"), "add", n % 200 + 100))
        .unionByName(made(n % 5 == 0, "adult", "domain", last, "add", n % 300))
        .unionByName(made(n % 2 == 0, "spam", "prefix", F.concat("host", F.lit("/en")), "add", n % 365))
        .unionByName(made(n % 2 == 1, "spam", "prefix", F.concat("host", F.lit("/en/page/archive/deep")), "add", n % 365))
    )


def query(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url")
    return check(sample_captures(pages), sample_entries(pages))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id AS capture_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1) AS path,
    CAST(DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 7) AS BIGINT) % 366 AS INTEGER) AS DATE) AS day
  FROM pages
), h AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS n, string_split(host, '.') AS labels FROM (SELECT DISTINCT host FROM p WHERE host <> '')
), e AS (
  SELECT 'abuse' AS list_name, 'host:' || host AS key, 'add' AS action, n % 200 AS offs FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'abuse', 'host:' || host, 'remove', n % 200 + 60 FROM h WHERE n % 6 = 0
  UNION ALL SELECT 'abuse', 'host:' || host, 'add', n % 200 + 100 FROM h WHERE n % 12 = 0
  UNION ALL SELECT 'adult', 'domain:' || array_to_string(labels[-3:], '.'), 'add', n % 300 FROM h WHERE n % 5 = 0
  UNION ALL SELECT 'spam', 'prefix:' || host || '/en', 'add', n % 365 FROM h WHERE n % 2 = 0
  UNION ALL SELECT 'spam', 'prefix:' || host || '/en/page/archive/deep', 'add', n % 365 FROM h WHERE n % 2 = 1
), d AS (
  SELECT list_name, key, CAST(DATE '2024-01-01' + CAST(offs AS INTEGER) AS DATE) AS valid_from, max(action) AS action FROM e GROUP BY ALL
), i AS (
  SELECT * FROM (SELECT *, lead(valid_from) OVER (PARTITION BY list_name, key ORDER BY valid_from) AS valid_to FROM d) WHERE action = 'add'
), q AS (
  SELECT capture_id, host, path, day, count(*) AS captures, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda y: y <> '') AS parts FROM p GROUP BY ALL
), k AS (
  SELECT capture_id, host, path, day, unnest(list_concat(['host:' || host],
    list_transform(range(1, len(labels) + 1), lambda g: 'domain:' || array_to_string(labels[-g:], '.')),
    list_transform(range(1, coalesce(len(parts), 0) + 1), lambda g: 'prefix:' || host || '/' || array_to_string(parts[1:g], '/')))) AS key
  FROM q WHERE host <> ''
), m AS (
  SELECT k.capture_id, k.host, k.path, k.day, i.list_name, i.key, i.valid_from FROM k JOIN i ON i.key = k.key AND i.valid_from <= k.day AND (i.valid_to IS NULL OR k.day < i.valid_to)
), f AS (
  SELECT capture_id, host, path, day, count(*) AS entries, min({'a': valid_from, 'b': list_name, 'c': key}) AS entry FROM m GROUP BY capture_id, host, path, day
)
SELECT q.capture_id, q.host, q.path, q.day, q.captures, f.entry IS NOT NULL AS blocked, CAST(coalesce(f.entries, 0) AS BIGINT) AS entries, f.entry.b AS list_name, f.entry.c AS key, f.entry.a AS valid_from
FROM q LEFT JOIN f ON q.capture_id IS NOT DISTINCT FROM f.capture_id AND q.host IS NOT DISTINCT FROM f.host AND q.path IS NOT DISTINCT FROM f.path AND q.day IS NOT DISTINCT FROM f.day
"""
