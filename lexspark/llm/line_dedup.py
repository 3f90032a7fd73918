"""Fuzzy line dedup by MinHash, in DataFrame operations only (operator 6).

A line's character shingles are taken from its fixed-width encoding, STRIDE to a row, so that every position is found at
once however long the line is. Each shingle is hashed once; its orders are by nearness of that hash to anchors, spread
evenly over all hashes, so that the firsts of two orders are hardly ever one shingle. The first of each order is taken
per line. Only these leave the tasks that read the texts. A band is three of the orders, and each two of them are in just one band (the lines of the affine plane of order
3), so that few orders give many bands: a pair of similarity 0.8 meets in one of them with a chance of 0.990. Candidates
are all pairs of a band's bucket. First each line of a bucket is compared with one line of it, another in every band, and
a distributed union-find over the pairs that pass names the components. So large families come together at linear cost.
Then all pairs of a bucket that still lie in different components are compared, by salted pairs of chunks in separate
tasks, and the components they link become one. There, pairs are ruled out if the bitmaps of their shingle sets show that
too much is missing on one side, a bound that never rules out a similar pair. In both passes the exact Jaccard similarity
of the whole shingle sets decides. Only the texts of candidates are fetched, and only texts travel: a set, eight times as
large, is made in the task that compares it. Of each component the first line by (doc_id, text, position) stays, in its
document; all others go.

A line is named by a 64-bit and a 32-bit hash.

Blank lines stay. Null texts stay null, and a text that loses all its lines becomes empty; no document goes. Documents
of one doc_id are told apart by their texts, in the order of their hashes; rows equal in both are one document, and stay
alike. A null doc_id comes first. All columns stay; text is changed, and n_chars where there is one of that name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import free, named, partitions, written
from lexspark.llm.components import components

SIMILARITY = 0.8
SHINGLE = 8
#: Shingles that are hashed in one row.
STRIDE = 4
#: Bands of three orders each: the points of the lines of the affine plane of order 3.
BANDS = [tuple(3 * x + (m * x + c) % 3 for x in range(3)) for m in range(3) for c in range(3)] + [(3 * c, 3 * c + 1, 3 * c + 2) for c in range(3)]
FUNCTIONS = 9
#: Parts that the occurrences of a line are dealt to when its text is fetched.
SALT = 8
#: Lines, and shingles, of a chunk. A task of the second pass compares two chunks at a time.
CHUNK = 1024
CHUNK_SHINGLES = 1 << 19
#: Longs of the bitmap of a shingle set, a power of two.
WORDS = 64
BITS = [f"w{w}" for w in range(WORDS)]
#: A shingle's place in an order is its hash, xor the order's anchor.
ANCHORS = [(2**64 // FUNCTIONS * i + 0x1B873593CC9E2D51) % 2**64 - 2**63 for i in range(FUNCTIONS)]


def lines(documents: DataFrame) -> DataFrame:
    """h, g (the name), line, doc, d (the text's hash), pos of all lines that are not blank."""
    every = documents.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("d"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return every.where(F.trim("line") != "").select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line", "doc", "d", "pos")


def first_places(every: DataFrame) -> DataFrame:
    """h, g, first: the place of the first of equal lines."""
    return every.groupBy("h", "g").agg(F.min(F.struct("doc", "d", "pos")).alias("first"))


def shingled(texts: DataFrame, stride: int) -> DataFrame:
    """h, g, s0, s1, ...: hashes of a line's shingles, `stride` to a row; the last may come several times."""
    fixed = texts.select("h", "g", F.encode("line", "UTF-32").alias("b"))  # 4 bytes a character
    fixed = fixed.withColumn("last", F.greatest(F.lit(0), F.length("b") / 4 - SHINGLE).cast("int"))
    rows = fixed.select("h", "g", "b", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(stride))).alias("at"))
    return rows.select("h", "g", *[F.xxhash64(F.expr(f"substring(b, least(at + {k}, last) * 4 + 1, {4 * SHINGLE})")).alias(f"s{k}") for k in range(stride)])


def signatures(every: DataFrame) -> DataFrame:
    """h, g, and the least place m0, m1, ... of every distinct line's shingles in each order."""
    first = lambda anchor: F.least(*[F.col(f"s{k}").bitwiseXOR(F.lit(anchor)) for k in range(STRIDE)])
    return shingled(every, STRIDE).groupBy("h", "g").agg(*[F.min(first(anchor)).alias(f"m{i}") for i, anchor in enumerate(ANCHORS)])


def buckets(signed: DataFrame) -> DataFrame:
    """bucket, h, one, members: the lines of all buckets of several lines, with the bucket's chosen line."""
    keys = F.array(*[F.xxhash64(F.lit(b), *[f"m{i}" for i in band]) for b, band in enumerate(BANDS)])
    rows = signed.select("h", F.explode(keys).alias("bucket")).repartition(partitions(signed.sparkSession), "bucket")
    each = rows.groupBy("bucket").agg(F.min_by("h", F.xxhash64("h", "bucket")).alias("one"), F.count("*").alias("members")).where("members > 1")
    return rows.join(each.hint("shuffle_hash"), "bucket")  # few buckets hold several lines


def candidates(bucketed: DataFrame) -> DataFrame:
    """Distinct pairs (hub, h): every line of a bucket with the bucket's chosen line. part: deals out those of a frequent hub."""
    pairs = bucketed.where("h <> one").groupBy(F.least("h", "one").alias("a"), F.greatest("h", "one").alias("b")).agg(F.min("one").alias("hub"), F.max("members").alias("members"))
    other = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return pairs.select("hub", other.alias("h"), F.pmod(F.hash(other), F.ceil(F.col("members") / CHUNK).cast("int")).alias("part"))


def line_texts(wanted: DataFrame, every: DataFrame) -> DataFrame:
    """h, g, line: the lines of some h. A line that stands very often is dealt to several tasks."""
    salted = wanted.select("h").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = every.select("h", "g", "line", F.pmod(F.hash("d", "pos"), F.lit(SALT)).alias("salt"))
    return rows.join(salted.hint("shuffle_hash"), ["h", "salt"], "left_semi").groupBy("h", "g").agg(F.min("line").alias("line"))


def _shingles(line: Column) -> Column:
    """A line's distinct hashes."""
    bound = F.array(F.encode(line, "UTF-32"))  # so that it is encoded once
    last = lambda b: F.greatest(F.lit(1), F.length(b) - (4 * SHINGLE - 1))
    each = F.transform(bound, lambda b: F.transform(F.sequence(F.lit(1), last(b), F.lit(4)), lambda at: F.xxhash64(F.substring(b, at, F.lit(4 * SHINGLE)))))
    return F.array_distinct(F.get(each, F.lit(0)))


def bitmaps(texts: DataFrame) -> DataFrame:
    """h, g, n: the size of a line's shingle set; w0, w1, ...: a bitmap, in which every shingle sets the bit that its hash names.

    more: by how many the shingles exceed the bits. The words are columns, not an array, so that a pair's test is short code.
    """
    word = F.shiftright("s0", 6).bitwiseAND(F.lit(WORDS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s0").bitwiseAND(F.lit(63)).cast("int"))
    none = F.lit(0).cast("long")
    own = shingled(texts, 1).select("h", "g", word.alias("word"), bit.alias("bit")).groupBy("h", "g", "word").agg(F.bit_or("bit").alias("bits"))
    words = own.groupBy("h", "g").agg(F.sum(F.bit_count("bits")).cast("int").alias("set"), *[F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), none).alias(x) for w, x in enumerate(BITS)])
    sizes = texts.select("h", "g", F.size(_shingles(F.col("line"))).alias("n"))
    return words.join(sizes, ["h", "g"]).select("h", "g", "n", (F.col("n") - F.col("set")).alias("more"), *BITS)


def _enough(common: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether so many common shingles of n and m make the Jaccard similarity large enough."""
    share = round(similarity * 1000)
    return common * (1000 + share) >= (n + m) * share


def _possible(similarity: float) -> Column:
    """False only if the sets of a pair cannot be similar: common shingles share their bits, and a bit has one, but for `more`."""
    shared = F.least("more_a", "more_b")
    for x in BITS:
        shared += F.bit_count(F.col(f"{x}_a").bitwiseAND(F.col(f"{x}_b")))
    n, m = F.col("n_a"), F.col("n_b")
    return _enough(F.least(n, m), n, m, similarity) & _enough(shared, n, m, similarity)


def _similar(a: Column, b: Column, similarity: float) -> Column:
    return _enough(F.size(F.array_intersect(a, b)), F.size(a), F.size(b), similarity)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: names of the lines of pairs (hub, part, h) whose whole shingle sets are similar enough.

    Lines are dealt by hub and part as texts; the set of a hub is made once in each of its parts. The other's is made before
    the join: a column made after it would go into the join's condition, which makes it as often as it reads it.
    """
    n = partitions(pairs.sparkSession)
    name = F.struct("h", "g")
    hubs = pairs.select("hub", "part").distinct().join(texts.withColumnRenamed("h", "hub"), "hub")
    hubs = hubs.repartition(n, "hub", "part").select("hub", "part", F.struct(F.col("hub").alias("h"), "g").alias("u"), _shingles(F.col("line")).alias("shingles_a"))
    others = pairs.join(texts, "h").select("hub", "part", name.alias("v"), "line").repartition(n, "hub", "part")
    others = others.select("hub", "part", "v", _shingles(F.col("line")).alias("shingles_b"))
    both = others.join(hubs.hint("shuffle_hash"), ["hub", "part"])
    return both.where(_similar(F.col("shingles_a"), F.col("shingles_b"), similarity)).select("u", "v")


def mixed_rows(bucketed: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """bucket, members, h, g, component: lines other than the chosen one, of buckets in which these lie in several components.

    Pairs with the chosen line are known already. A line without a link is a component of its own.
    """
    rows = bucketed.where("members > 2 and h <> one").select("bucket", "h").join(texts.select("h", "g"), "h")
    rows = rows.join(roots.select("node.h", "node.g", "component"), ["h", "g"], "left").withColumn("component", F.coalesce("component", F.struct("h", "g")))
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("members")).where("least <> most")
    return rows.join(mixed.select("bucket", "members"), "bucket")


def dealt(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """The rows with their lines' buckets and bitmaps, once for each pair of chunks (low, high) that `chunk` is in."""
    own = rows.groupBy("h", "g").agg(F.collect_set("bucket").alias("buckets"))  # one per band at most
    rows = rows.join(own.join(maps, ["h", "g"]), ["h", "g"])
    sizes = rows.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    rows = rows.join(sizes, "bucket").withColumn("chunk", F.pmod(F.hash("h", "g"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select("bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "h", "g", F.col("component.h").alias("root_h"), F.col("component.g").alias("root_g"), "buckets", "n", "more", *BITS)


KEY = ["bucket", "low", "high"]


def _paired(rows: DataFrame, similarity: float, more: Callable[[DataFrame], DataFrame] = lambda side: side) -> DataFrame:
    """Pairs of rows of one key, with _a and _b after their names: those that may be similar, each from one of its buckets.

    more: what each side gets in the task that compares it.
    """

    def side(end: str, name: str) -> DataFrame:
        own = more(rows.where(F.col("chunk") == F.col(end)).repartition(partitions(rows.sparkSession), *KEY))
        return own.select(*KEY, *[F.col(c).alias(f"{c}_{name}") for c in own.columns if c not in KEY])

    both = side("low", "a").hint("merge").join(side("high", "b"), KEY)
    once = (F.col("low") < F.col("high")) | (F.col("h_a") < F.col("h_b")) | ((F.col("h_a") == F.col("h_b")) & (F.col("g_a") < F.col("g_b")))
    apart = (F.col("root_h_a") != F.col("root_h_b")) | (F.col("root_g_a") != F.col("root_g_b"))
    first = F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket")
    return both.where(once & apart & _possible(similarity) & first)


def crossing(rows: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: names of similar lines of one bucket in different components. rows: those of dealt().

    Which rows have a possible partner is found from bitmaps; only these get their texts, and their sets.
    """
    name = lambda end: F.struct(F.col(f"h_{end}").alias("h"), F.col(f"g_{end}").alias("g"))
    may = _paired(rows, similarity).select(*KEY, F.explode(F.array(name("a"), name("b"))).alias("x")).select(*KEY, "x.h", "x.g").distinct()
    wanted = written(rows.join(may, [*KEY, "h", "g"], "left_semi"), "line-wanted")
    whole = wanted.join(texts, ["h", "g"])
    both = _paired(whole, similarity, lambda side: side.withColumn("shingles", _shingles(F.col("line"))).drop("line"))
    similar = both.where(_similar(F.col("shingles_a"), F.col("shingles_b"), similarity))
    return similar.select(name("a").alias("u"), name("b").alias("v"))


def joined_components(bucketed: DataFrame, texts: DataFrame) -> DataFrame:
    """node, component: those of stars, made one where a pair of a bucket links them."""
    first = written(verified(written(candidates(bucketed), "line-pairs"), texts), "line-links")
    roots = written(components(first, "line-components"), "line-roots")
    rows = written(mixed_rows(bucketed, roots, texts), "line-mixed")
    own = texts.join(rows.select("h", "g").distinct(), ["h", "g"], "left_semi")
    links = written(crossing(written(dealt(rows, bitmaps(own)), "line-chunks"), own), "line-links")
    if links.isEmpty():
        return roots
    return written(components(roots.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links), "line-components"), "line-roots")


def kept(places: DataFrame, roots: DataFrame) -> DataFrame:
    """doc, d, kept: positions of the lines that stay, but for blank ones."""
    known = roots.select("node.h", "node.g", "component")
    members = places.join(known, ["h", "g"], "left").withColumn("component", F.coalesce("component", F.struct("h", "g")))
    stay = members.groupBy("component").agg(F.min("first").alias("first"))
    return stay.groupBy("first.doc", "first.d").agg(F.collect_list("first.pos").alias("kept"))


def _rebuilt(parts: Column, places: Column) -> Column:
    """The lines that are blank or at one of the places, in order."""
    blank = F.filter(F.transform(parts, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    stay = F.array_sort(F.array_intersect(F.sequence(F.lit(0), F.size(parts) - 1), F.concat(blank, places)))
    return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The same columns and rows, with `text` (and n_chars) of the lines that stay."""
    every = lines(documents.select("doc_id", "text"))
    bucketed = written(buckets(signatures(every)), "line-buckets")
    roots = joined_components(bucketed, written(line_texts(bucketed, every), "line-texts"))
    places = written(kept(first_places(every), roots), "line-places")
    doc, d, stay = (free(documents, x) for x in ("doc_of_places", "text_of_places", "places"))
    places = places.select(F.col("doc").alias(doc), F.col("d").alias(d), F.col("kept").alias(stay))
    none = F.array().cast("array<int>")
    bound = F.array(F.struct(F.split("text", "\n").alias("parts"), F.coalesce(stay, none).alias("kept")))  # so that it is split once
    text = F.when(F.col("text").isNotNull(), F.get(F.transform(bound, lambda x: _rebuilt(x["parts"], x["kept"])), F.lit(0)))
    joined = documents.join(places, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(d)), "left")
    whole = joined.withColumn("text", text)
    if "n_chars" in documents.columns:
        whole = whole.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return whole.select(*named(documents.columns))


def query(documents: DataFrame) -> DataFrame:
    return dedup_lines(documents.select("doc_id", "text"))
