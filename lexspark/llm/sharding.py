"""Sharding by balanced label propagation, in DataFrame operations only (operator 4).

Documents of equal text are linked, as a star around their group, never as pairs. A group that would fill a large part
of a shard is hot: it is dealt, row by row, to a stretch of shards, as few as it fills, and takes their room before all
others. Every other linked document starts in a shard chosen by its own hash. In each round a group's members look at
how many of them every shard with room holds (one grouped count), and those outside the shard with most of them want to
move there; so do all that stand in a shard that hot groups fill. A shard accepts as many rows as its quota has room
for, whole groups at a time, in the order of a hash that changes with the round. Documents without links, which cost
nothing wherever they are, then fill what room is left. At last the shards' contents are laid end to end in the order of
label and group, and cut into equal parts: so row counts differ by one at most, and each of the cuts splits one group at
most.

Law `rows`. Null texts are linked to nothing, have the size 8 and no CRC. Repeated rows are rows of their own. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import removed, written

SHARDS = 24
ROUNDS = 5
#: A shard may hold this share more than its part while labels move.
SLACK = 0.1
#: Groups of more rows than a shard's part over this are hot. There are at most SHARDS * HOT of them.
HOT = 16
#: Cells of a label, in the order of the groups' hashes, that row numbers are counted in.
CELLS = 256


def _unit(h: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return h / F.lit(2.0**64) + F.lit(0.5)


def _cell(h: Column, n: int) -> Column:
    """A hash's place among n equal ranges, rising with the hash."""
    return F.least(F.floor(_unit(h) * n), F.lit(n - 1)).cast("int")


def nodes(documents: DataFrame) -> DataFrame:
    """A small row per document: its id, size, CRC, and the digest of its text, which is its group."""
    return documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.sha2(F.col("text"), 256).alias("digest"),
    )


def _targets(linked: DataFrame, rooms: list[float], turn: int) -> DataFrame:
    """digest, target: the shard with room that holds most of each group, ties in the order of a hash; else any with room."""
    open_shards = [s for s, room in enumerate(rooms) if room > 0]
    is_open = F.col("label").isin(open_shards)
    held = linked.groupBy("digest", "label").agg(F.count("*").alias("n"))
    best = held.groupBy("digest").agg(F.max_by(F.when(is_open, F.col("label")), F.when(is_open, F.struct("n", F.xxhash64("digest", "label")))).alias("target"))
    any_open = F.get(F.array(*[F.lit(s) for s in open_shards]), F.pmod(F.xxhash64("digest", F.lit(turn)), F.lit(max(1, len(open_shards)))).cast("int"))
    return best.withColumn("target", F.coalesce("target", any_open))


def propagate(linked: DataFrame, rooms: list[float], turn: int) -> DataFrame:
    """One round: the same rows with new labels. rooms: rows that each shard may hold of them."""
    asked = linked.join(_targets(linked, rooms, turn), "digest")
    wanting = F.coalesce(F.col("label") != F.col("target"), F.lit(False))
    counted = asked.groupBy("label", "target", wanting.alias("wanting")).count().collect()  # a row per pair of shards at most
    wanted, staying = [0] * len(rooms), [0] * len(rooms)
    for r in counted:
        if r["wanting"]:
            wanted[r["target"]] += r["count"]
        else:
            staying[r["label"]] += r["count"]
    share = [float(min(1.0, max(0.0, room - n) / max(1, w))) for room, n, w in zip(rooms, staying, wanted)]
    quota = F.get(F.array(*[F.lit(x) for x in share]), F.col("target"))
    lot = _unit(F.xxhash64("digest", "target", F.lit(turn)))
    return asked.withColumn("label", F.when(wanting & (lot < quota), F.col("target")).otherwise(F.col("label"))).drop("target")


def _stretches(sizes: list[tuple[str, int]], each: float, shards: int) -> tuple[list[tuple[str, int, int]], list[float]]:
    """(digest, members, first row) of hot groups one after the other, and the rows of each shard that they fill."""
    stretches, at = [], 0
    for digest, members in sorted(sizes, key=lambda x: (-x[1], x[0])):
        stretches.append((digest, members, at))
        at += members
    return stretches, [min(max(0.0, at - s * each), each) for s in range(shards)]


def labelled(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Adds `label`, a shard that holds a document's group as far as quotas allow, and `hot`."""
    spark = rows.sparkSession
    total = rows.count()
    each = max(1.0, total / shards)
    texts = rows.where("digest is not null")
    sizes = written(texts.groupBy("digest").agg(F.count("*").alias("members")).where("members > 1"), "shard-groups")
    large = sizes.where(F.col("members") > each / HOT).collect()  # at most shards * HOT rows
    stretches, filled = _stretches([(r["digest"], r["members"]) for r in large], each, shards)
    hot_groups = F.broadcast(spark.createDataFrame(stretches, "digest string, members long, first long"))
    marked = texts.join(hot_groups, "digest", "left")
    place = F.col("first") + _unit(F.xxhash64("doc_id", "digest")) * F.col("members")
    hot = marked.where("members is not null").withColumn("label", F.least(F.floor(place / each), F.lit(shards - 1)).cast("int")).drop("members", "first")
    cold = marked.where("members is null").drop("members", "first").join(sizes, "digest", "left")
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    linked = written(cold.where("members is not null").drop("members").withColumn("label", start), "shard-labels")
    rooms = [each * (1 + SLACK) - f if f < each else 0.0 for f in filled]
    for turn in range(rounds):
        last, linked = linked, written(propagate(linked, rooms, turn), "shard-labels")
        removed(last)
    held = {r[0]: r[1] for r in linked.groupBy("label").count().collect()}  # a row per shard
    free = [max(0.0, each - f - held.get(s, 0)) for s, f in enumerate(filled)]
    edges = [sum(free[: s + 1]) / max(1e-9, sum(free)) for s in range(shards - 1)]
    single = cold.where("members is null").drop("members").unionByName(rows.where("digest is null"))
    lot = _unit(F.xxhash64("doc_id", "size", F.lit("single")))
    single = single.withColumn("label", F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda e: e <= lot)) if edges else F.lit(0))
    return single.unionByName(linked).withColumn("hot", F.lit(False)).unionByName(hot.withColumn("hot", F.lit(True)))


def shard(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: row counts of shards differ by one at most, slots are gapless from 0."""
    rows = labelled(nodes(documents), shards, rounds)
    group = F.xxhash64(F.coalesce("digest", F.col("doc_id").cast("string")))
    spread = F.when(F.col("hot"), _cell(F.xxhash64("doc_id", "size"), CELLS)).otherwise(F.lit(0))
    placed = written(rows.select("doc_id", "size", "text_crc32", "label", group.alias("g"), _cell(group, CELLS).alias("cell"), F.col("hot"), spread.alias("part")), "shard-order")
    sizes = _cells(placed)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("cell", "h", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    labels = {r[0]: r[1] for r in sizes.groupBy("label").agg(F.sum("n")).collect()}
    offsets, at = {}, 0
    for s in range(shards):
        offsets[s] = at
        at += labels.get(s, 0)
    first = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, offsets[s])]), F.col("label")).cast("long")
    starts = sizes.select("label", "cell", "h", "part", (before + first).alias("before"))
    within = Window.partitionBy("label", "cell", "h", "part").orderBy("g", "doc_id", "text_crc32", "size")
    numbered = _keyed(placed).withColumn("i", F.row_number().over(within) - 1).join(F.broadcast(starts), ["label", "cell", "h", "part"])  # at most CELLS * (2 * shards + hot groups) rows: 110 592
    position = F.col("before") + F.col("i")
    each, more = divmod(at, shards)
    large = more * (each + 1)
    number = F.when(position < large, F.floor(position / (each + 1))).otherwise(more + F.floor((position - large) / max(each, 1))).cast("int")
    start = F.when(F.col("shard") < more, F.col("shard") * (each + 1)).otherwise(large + (F.col("shard") - more) * each)
    return numbered.withColumn("shard", number).select("doc_id", "size", "text_crc32", "shard", (position - start).cast("long").alias("slot"), "g")


def _keyed(placed: DataFrame) -> DataFrame:
    """h: 0 for the ordinary rows of a cell, else the hash of a hot group, which so lies in one piece."""
    return placed.withColumn("h", F.when(F.col("hot"), F.col("g")).otherwise(F.lit(0)))


def _cells(placed: DataFrame) -> DataFrame:
    return _keyed(placed).groupBy("label", "cell", "h", "part").agg(F.count("*").alias("n"))


def query(documents: DataFrame) -> DataFrame:
    return shard(documents).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
