"""N-gram Jaccard join by a MinHash LSH forest (operator 3).

Every text's word-shingle set is hashed to TREES labels of DEPTH MinHash values, the leaves of prefix tries: texts in the
order of their labels' prefixes, so that a subtree is a run of them. Every text starts with its whole labels, and the
members of its subtrees are verified exactly by their whole shingle sets. From the similarities found, a text's recall is
estimated: a link of similarity s is found at depth d with the chance 1 - (1 - s^d)^TREES, so each found one stands for
the inverse of that many. Texts that do not yet reach RECALL, or have found nothing, shorten their prefixes by one and
meet all members of their larger subtrees; the others rest. The shortest prefix is the one at which even a pair of the
least similarity is found with RECALL. So copies of one text, which fill large subtrees, stay at full depth, and only
texts with few or distant partners look further.

Texts of one shingle set are a class and take part once. A subtree with the members of another one is dropped. A pair
that is in several subtrees is verified in the first of them only, and in no later round. In a subtree of more than a
chunk, members of similarity TIGHT or more to one of them are a cluster: Jaccard distance obeys the triangle inequality,
so all of a cluster's pairs are links, and need no verification. The others are verified by pairs of chunks in separate
tasks, none of which has two chunks of one cluster: so sets are copied once for each chunk outside their cluster, a task
holds two chunks at most, and gives a row per text, not per pair. No link is lost in a large group of near copies, and
none is written out.

No join is broadcast: the driver, which would build the tables, holds none of them, whatever their size. What several
steps of a round read is written once.

Result, a row per document: doc_id, class_id (the least doc_id of its component of links), links (other documents of
similarity SIMILARITY or more). Texts without words are linked to equal texts only; null texts are linked to nothing and
have themselves as class. A null doc_id counts as least, and class_id is then the row's own doc_id. Repeated rows are
documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.common import free, named, partitions, written
from lexspark.llm.components import components
from lexspark.llm.shingles import digest, shingles, signature

SIMILARITY = 0.8
TREES, DEPTH = 10, 5
RECALL = 0.999
#: Texts of a chunk. A task compares two chunks.
CHUNK = 1024
#: Two texts of this similarity to a third are links of similarity SIMILARITY: 1 - 2 * (1 - 0.9) = 0.8.
TIGHT = 0.9


def chance(similarity: float, length: int, trees: int = TREES) -> float:
    """That two texts share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(similarity: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of this similarity is found with this recall."""
    for length in range(depth, 0, -1):
        if chance(similarity, length, trees) >= recall:
            return length
    raise ValueError(f"{trees} trees cannot reach a recall of {recall}")


def name_of(text: str | None, found: np.ndarray) -> str | None:
    """Names a class: by the shingle set, by the text where it has no words; null texts have none."""
    return digest(found) if len(found) or text is None else "text " + xxhash.xxh3_128_hexdigest(text.encode("utf-8", "replace"))


def labels(documents: DataFrame) -> DataFrame:
    """doc_id, md5 and x (hashes of the text), digest, labels: per tree, the leaf's values as a hexadecimal string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, leaves = [], []
            for text in batch.column(3).to_pylist():
                found = shingles(text)
                digests.append(name_of(text, found))
                leaf = signature(found, TREES * DEPTH).astype(">u4").tobytes().hex() if len(found) else ""
                leaves.append([leaf[i : i + 8 * DEPTH] for i in range(0, len(leaf), 8 * DEPTH)])
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.string()), pa.array(leaves, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "md5", "x", "digest", "labels"])

    return documents.select("doc_id", F.md5("text").alias("md5"), F.xxhash64("text").alias("x"), "text").mapInArrow(run, "doc_id long, md5 string, x long, digest string, labels array<string>")


def _subtrees(classes: DataFrame, depth: int, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """subtree, node, members: of several members, some of them still looking, one of those with the same members, and
    none that was there at a larger depth; and the fingerprints of the subtrees' members (a, b) so far."""
    prefixes = classes.select("node", "looking", F.posexplode("labels").alias("tree", "label"))
    rows = prefixes.select("node", "looking", F.xxhash64("tree", F.substring("label", 1, 8 * depth)).alias("subtree"))
    members = (F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64(F.reverse("node"))).alias("b"), F.max("looking").alias("looking"))
    each = rows.groupBy("subtree").agg(*members).where("members > 1 and looking")
    kept = each.groupBy("members", "a", "b").agg(F.min("subtree").alias("subtree"))
    if known is not None:
        kept = kept.join(known.hint("merge"), ["members", "a", "b"], "left_anti")
    kept = written(kept, "jaccard-subtrees")
    return rows.join(kept.select("subtree", "members").hint("shuffle_hash"), "subtree").select("subtree", "node", "members"), kept.drop("subtree")


def _shingled(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds `found`, the bytes of the sorted shingle set of a class, from the text of its least document (least_id, x)."""
    carried = [c for c in candidates.columns if c not in ("least_id", "x")]
    node = 1 + carried.index("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            right = [len(s) > 0 and digest(s) == name for s, name in zip(sets, batch.column(node).to_pylist())]  # doc_ids may repeat
            yield batch.set_column(0, "found", pa.array([s.tobytes() for s in sets], pa.binary())).filter(pa.array(right))

    # both keys, so that rows without a doc_id are dealt to all tasks
    joined = documents.select("doc_id", "text").join(candidates.hint("merge"), F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.xxhash64("text") == F.col("x"))).select("text", *carried)
    return joined.mapInArrow(run, T.StructType([T.StructField("found", T.BinaryType()), *joined.schema[1:]]))


def _overlaps(found: list[np.ndarray], split: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersections and unions of the first `split` sets (or of all, if 0) with the others."""
    place = np.repeat(np.arange(len(found)), [len(x) for x in found])
    values, inverse, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    number = np.cumsum(counts > 1) - 1
    column, row = number[inverse[shared]], place[shared]
    left, right = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    both = np.zeros((len(found[left]), len(found[right])), np.int64)
    for start in range(0, int(number[-1]) + 1, 8192):  # a bounded slice of the shared shingles at a time
        here = (column >= start) & (column < start + 8192)
        m = np.zeros((len(found), min(8192, int(number[-1]) + 1 - start)), np.float32)
        m[row[here], column[here] - start] = 1
        both += np.rint(m[left] @ m[right].T).astype(np.int64)
    size = np.array([len(x) for x in found])
    return both, size[left][:, None] + size[right][None, :] - both


def _apart(lists: list[list[int]], split: int) -> np.ndarray:
    """Pairs whose lists of subtrees have nothing in common."""
    number = {s: i for i, s in enumerate(sorted({s for x in lists for s in x}))}
    m = np.zeros((len(lists), len(number)), np.float32)
    for i, x in enumerate(lists):
        m[i, [number[s] for s in x]] = 1
    return (m[:split] @ m[split:].T if split else m @ m.T) == 0


def _least_linked(similar: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each node the least name of its component, for a symmetric matrix over sorted names."""
    own = np.arange(len(names))
    while True:
        new = np.where(similar, own[None, :], len(names)).min(axis=1)
        new = np.minimum(own, new)
        new = new[new]
        if (new == own).all():
            return names[own]
        own = new


#: Rows of a task: two chunks (low <= high) of one subtree.
_DEALT = ["subtree", "low", "high", "chunk", "node", "found", "copies", "looking", "cluster", "subtrees", "before"]
_LINKS = "node string, root string, links long, " + ", ".join(f"e{d} double" for d in range(1, DEPTH + 1))


def _verified(rows: list[tuple]) -> list[tuple]:
    """node, root, links, and the links that these stand for at each depth, of the texts of one chunk or two that have some."""
    rows = [dict(zip(_DEALT, r)) for r in rows]
    rows = list({(r["chunk"], r["node"]): r for r in rows}.values())
    low, high = rows[0]["low"], rows[0]["high"]
    first = sorted((r for r in rows if r["chunk"] == low), key=lambda r: r["node"])
    second = sorted((r for r in rows if r["chunk"] == high), key=lambda r: r["node"]) if low != high else []
    rows = first + second
    if len(rows) < 2 or not first or low != high and not second:
        return []
    split = len(first) if second else 0
    common, union = _overlaps([np.frombuffer(r["found"], np.uint64) for r in rows], split)
    own = rows[0]["subtree"]
    similar = common * 1000 >= union * round(SIMILARITY * 1000)
    similar &= _apart([[s["subtree"] for s in r["subtrees"] if s["subtree"] < own] + r["before"] for r in rows], split)
    similarity = np.where(similar, common / np.maximum(union, 1), 0.0)
    if split:
        whole = np.zeros((len(rows), len(rows)))
        whole[:split, split:] = similarity
        whole[split:, :split] = similarity.T
    else:
        whole = similarity
        np.fill_diagonal(whole, 0)
    looking = np.array([r["looking"] for r in rows])
    cluster = np.array([r["cluster"] or "" for r in rows])
    whole *= looking[:, None] | looking[None, :]
    whole[(cluster[:, None] == cluster[None, :]) & (cluster != "")[:, None]] = 0  # known links
    names, copies = np.array([r["node"] for r in rows]), np.array([r["copies"] for r in rows], np.int64)
    linked = whole > 0
    links = linked @ copies
    stand = [(linked / np.where(linked, chance(whole, d), 1)) @ copies for d in range(1, DEPTH + 1)]
    order = np.argsort(names)
    roots = np.empty(len(rows), names.dtype)
    roots[order] = _least_linked(linked[np.ix_(order, order)], names[order])
    return [(str(a), str(b), int(n), *map(float, e)) for a, b, n, *e in zip(names, roots, links, *stand) if n]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that follow one another with the same first columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _grouped(batches, 3):
        if out := _verified(group):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [x.split()[0] for x in _LINKS.split(", ")])


def _near_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, cluster: members of a chunk of a subtree that are TIGHT to its centre, which comes first."""
    for group in _grouped(batches, 2):
        if group[0][2]:
            continue  # the centre's text is not there
        centre, rest = group[0], group[1:]
        for at in range(0, len(rest), CHUNK):
            part = rest[at : at + CHUNK]
            common, union = _overlaps([np.frombuffer(r[4], np.uint64) for r in (centre, *part)], 1)
            if near := [r[3] for r, ok in zip(part, (common * 1000 >= union * round(TIGHT * 1000))[0]) if ok]:
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array([centre[3]] * len(near))], ["node", "cluster"])


def _clusters(members: DataFrame, documents: DataFrame) -> DataFrame:
    """node, cluster: one for every text that is TIGHT to the centre of a subtree of more than a chunk."""
    large = members.withColumn("s", F.explode("subtrees")).where(F.col("s.members") > CHUNK).select("least_id", "x", "node", F.col("s.subtree").alias("subtree"), F.ceil(F.col("s.members") / CHUNK).cast("int").alias("chunks"))
    own = large.select("least_id", "x", "node", "subtree", F.pmod(F.hash("node"), "chunks").alias("chunk"), F.lit(True).alias("member"))
    centres = large.groupBy("subtree", "chunks").agg(F.min_by(F.struct("least_id", "x", "node"), F.xxhash64("node", "subtree")).alias("c"))
    centres = centres.select("c.*", "subtree", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("member"))
    dealt = _shingled(own.unionByName(centres), documents).select("subtree", "chunk", "member", "node", "found")
    dealt = dealt.repartition(partitions(members.sparkSession), "subtree", "chunk").sortWithinPartitions("subtree", "chunk", "member")
    return dealt.mapInArrow(_near_centre, "node string, cluster string").groupBy("node").agg(F.min("cluster").alias("cluster"))


def _dealt(members: DataFrame) -> DataFrame:
    """node, tasks (subtree, low, high, chunk): in which pairs of chunks each text is verified.

    Chunks of a subtree are numbered cluster by cluster. Rows are small: no texts, no sets.
    """
    rows = members.select("node", "looking", "cluster", F.explode("subtrees").alias("s")).select("node", "looking", "cluster", "s.subtree", "s.members")
    task = F.struct("subtree", "low", "high", "chunk").alias("task")
    zero = F.lit(0)
    small = rows.where(F.col("members") <= CHUNK).select("node", F.struct("subtree", zero.alias("low"), zero.alias("high"), zero.alias("chunk")).alias("task"))
    large = rows.where(F.col("members") > CHUNK).withColumn("cluster", F.coalesce("cluster", F.lit("")))
    sizes = large.groupBy("subtree", "cluster").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.max("looking").alias("looking"))
    before = Window.partitionBy("subtree").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)  # a row per cluster
    sizes = written(sizes.withColumn("first", F.coalesce(F.sum("chunks").over(before), zero).cast("int")), "jaccard-chunks")
    chunks = sizes.select("subtree", "cluster", "looking", F.explode(F.expr("sequence(first, first + chunks - 1)")).alias("chunk"))
    other = chunks.select("subtree", F.col("cluster").alias("its"), F.col("looking").alias("its_looking"), F.col("chunk").alias("other"))
    pairs = chunks.join(other.hint("merge"), "subtree").where("(cluster = '' or cluster <> its) and (looking or its_looking)").select("subtree", "chunk", "other")
    numbered = large.join(sizes.select("subtree", "cluster", "first", "chunks").hint("merge"), ["subtree", "cluster"]).withColumn("chunk", F.col("first") + F.pmod(F.hash("node"), "chunks"))
    each = numbered.join(pairs.hint("merge"), ["subtree", "chunk"]).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    return small.unionByName(each.select("node", task)).groupBy("node").agg(F.collect_list("task").alias("tasks"))


def _links(members: DataFrame, documents: DataFrame) -> DataFrame:
    """node, root, links, ... of each task's part of a subtree. A text's set is shuffled once for each of its tasks."""
    ready = _shingled(members.join(_dealt(members).hint("merge"), "node"), documents).withColumn("t", F.explode("tasks"))
    dealt = ready.select("t.subtree", "t.low", "t.high", "t.chunk", *_DEALT[4:])
    return dealt.repartition(partitions(members.sparkSession), "subtree", "low", "high").sortWithinPartitions("subtree", "low", "high").mapInArrow(_verify, _LINKS)


def linked(classes: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, root, links of all verified parts, and node, cluster of the texts in clusters; classes: node, least_id, x, copies, labels."""
    none = F.array().cast("array<long>")
    looking = classes.select("node").withColumn("looking", F.lit(True))
    known = before = verified = clusters = found = None
    for depth in range(DEPTH, shortest_prefix(SIMILARITY, RECALL) - 1, -1):
        current = classes.join(looking.hint("merge"), "node", "left").withColumn("looking", F.coalesce("looking", F.lit(False)))
        subtrees, kept = _subtrees(current.select("node", "looking", "labels"), depth, known)
        known = kept if known is None else known.unionByName(kept)
        lists = subtrees.groupBy("node").agg(F.collect_list(F.struct("subtree", "members")).alias("subtrees"))  # TREES at most
        members = current.select("node", "least_id", "x", "copies", "looking").join(lists.hint("merge"), "node")
        if before is not None:
            members = members.join(before.hint("merge"), "node", "left")
        members = members.withColumn("before", F.coalesce("before", none) if before is not None else none)
        members = written(members, "jaccard-members")  # it is read several times
        if clusters is None:
            clusters = written(_clusters(members, documents), "jaccard-clusters")
        got = written(_links(members.join(clusters.hint("merge"), "node", "left"), documents), "jaccard-links")
        found = got if found is None else found.unionByName(got)
        own = members.select("node", F.transform("subtrees", lambda x: x["subtree"]).alias("before"))
        verified = own if verified is None else verified.unionByName(own)
        before = verified.groupBy("node").agg(F.flatten(F.collect_list("before")).alias("before"))
        # a text of a cluster has found its partners there for certain
        sums = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum(f"e{depth}").alias("stand"))
        sums = sums.join(clusters.hint("merge"), "node", "full").select("node", (F.coalesce("links", F.lit(0)) < RECALL * F.coalesce("stand", F.lit(0.0))).alias("short"))
        looking = classes.select("node").join(sums.hint("merge"), "node", "left").where("short is null or short").select("node", F.lit(True).alias("looking"))
        if depth > shortest_prefix(SIMILARITY, RECALL):
            looking = written(looking, "jaccard-looking")
    return found, clusters


def classified(documents: DataFrame) -> DataFrame:
    """doc_id, md5 (of the text), class_id, links, stays: whether it is the one row of its class, by least (doc_id, md5)."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(labels(documents), "jaccard-labels")
    groups = signed.where("digest is not null").groupBy(F.col("digest").alias("node"))
    classes = groups.agg(F.min(F.struct("doc_id", "md5", "x")).alias("least"), F.count("*").alias("copies"), F.min("labels").alias("labels"))
    classes = written(classes, "jaccard-nodes")
    found, clusters = linked(classes.select("node", F.col("least.doc_id").alias("least_id"), "least.x", "copies", "labels"), documents)
    edges = found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(clusters.select(F.col("node").alias("u"), F.col("cluster").alias("v")))
    roots = components(edges, "jaccard-components")
    own = clusters.join(classes.select("node", "copies").hint("merge"), "node")
    together = own.groupBy("cluster").agg(F.sum("copies").alias("together"))
    within = own.join(together.hint("merge"), "cluster").select("node", (F.col("together") - F.col("copies")).alias("links"))
    links = found.select("node", "links").unionByName(within).groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "least", "copies").join(links.hint("merge"), "node", "left").join(roots.hint("merge"), "node", "left")
    known = written(known.withColumn("component", F.coalesce("component", "node")), "jaccard-classes")
    first = known.groupBy("component").agg(F.min("least").alias("first"))
    others = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    per_set = known.join(first.hint("merge"), "component").select(F.col("node").alias("digest"), "first", others.alias("links"))
    rows = signed.where("digest is not null").select("doc_id", "md5", "digest").join(per_set.hint("merge"), "digest")
    stays = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.md5") == F.col("md5"))
    rows = rows.select("doc_id", "md5", F.coalesce("first.doc_id", "doc_id").alias("class_id"), "links", stays.alias("stays"))
    null = signed.where("digest is null").select("doc_id", "md5", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("stays"))
    return rows.unionByName(null)


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents without all but the least of each class; all columns stay. Rows of equal doc_id and text count once."""
    doc, md5, own = (free(documents, x) for x in ("kept_doc", "kept_md5", "own_md5"))
    one = classified(documents).where("stays").select(F.col("doc_id").alias(doc), F.col("md5").alias(md5)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col(own).eqNullSafe(F.col(md5))
    return documents.withColumn(own, F.md5("text")).join(one, same).dropDuplicates([doc, md5]).select(*named(documents.columns))


def query(documents: DataFrame) -> DataFrame:
    return classified(documents).select("doc_id", "class_id", "links")
