"""Document fingerprints by content-defined chunking (operator 9).

A gear hash runs over the UTF-8 bytes of a text; as it shifts by one bit a byte, its low 32 bits depend on the last 32
bytes alone, so the hash at every place is computed at once by doubling. Chunk ends are places where masked bits are
zero. Chunking is normalised: up to the normal size a mask of more bits is asked for, beyond it one of fewer, between a
least and a largest size. A fingerprint is the set of the chunks' digests, each with the bytes that it covers; an edit
moves only the chunk ends near it, so containment, weighted by bytes, tells how much of one text is in another.

Null texts count as empty: an empty fingerprint, which is like another empty one by 1 and like any other by 0.
Equal texts have equal fingerprints. Documents of equal doc_id follow one another by their
texts' hashes; null doc_ids come first. A doc_id that holds many rows is dealt to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import partitions, ranged

LEAST, NORMAL, LARGEST = 8, 24, 96
#: Masks of 6 and 3 high bits: ends every 64 bytes before the normal size and every 8 after it.
STRICT, LOOSE = np.uint32(0x3F << 26), np.uint32(0x7 << 29)
#: One fixed random-looking number per byte, made by a rule so that fingerprints agree between runs and machines.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)

Fingerprint = dict[str, int]


def gear_hashes(data: bytes) -> np.ndarray:
    """The low 32 bits of the gear hash after each byte: the sum of GEAR[byte] << age over the last 32."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            h[width:] += h[:-width] << np.uint32(width)
    return h


def boundaries(data: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk."""
    size = len(data)
    h = gear_hashes(data)
    loose = np.flatnonzero((h & LOOSE) == 0) + 1
    strict = loose[(h[loose - 1] & STRICT) == 0].tolist()
    loose = loose.tolist()
    start = i = j = 0
    while start < size:
        least, normal, end = start + LEAST, start + NORMAL, min(start + LARGEST, size)
        while i < len(strict) and strict[i] < least:
            i += 1
        if i < len(strict) and strict[i] <= min(normal, size):
            end = strict[i]
        else:
            while j < len(loose) and loose[j] <= normal:
                j += 1
            if j < len(loose) and loose[j] < end:
                end = loose[j]
        yield start, end
        start = end


def fingerprint(text: str) -> Fingerprint:
    data = text.encode("utf-8", "replace")
    found: Fingerprint = {}
    for start, end in boundaries(data):
        digest = xxhash.xxh3_64_hexdigest(data[start:end])
        found[digest] = found.get(digest, 0) + end - start
    return found


def containment(a: Fingerprint, b: Fingerprint) -> float:
    """The share of a's bytes in chunks that b has as well, at most as often."""
    whole = sum(a.values())
    if not whole:
        return float(not b)
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / whole


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Containment of the larger in the smaller one's terms: symmetric, 1 for equal sets, 0 for disjoint ones."""
    return min(containment(a, b), containment(b, a))


def as_text(found: Fingerprint) -> str:
    """digest:bytes of every chunk, in order of digests."""
    return " ".join(f"{d}:{n}" for d, n in sorted(found.items()))


def edited(text: str, other: str) -> str:
    """The last quarter of the code points replaced by as many from the start of the other text, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + other[:k]


def with_next(documents: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, bucket, own: the documents in ranges of doc_id, and after each range the first row of the next.

    The last range is followed by the first document of all. One row is looked up per range, so no text passes the
    driver, and each text is shuffled once. A range may be empty.
    """
    spread, _ = ranged(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", buckets, F.xxhash64("text"))
    firsts = [r[0] for r in spread.select("bucket").distinct().orderBy("bucket").collect()]
    before = F.array(*[F.lit(b) for b in firsts])  # one number per range
    place = F.array_position(before, F.col("bucket")).cast("int")
    heads = _heads(spread)
    previous = F.element_at(before, F.when(place > 1, place - 1).otherwise(F.lit(-1)))
    copies = heads.withColumn("bucket", previous) if firsts else heads
    return spread.withColumn("own", F.lit(True)).unionByName(copies.withColumn("own", F.lit(False)))


def _heads(spread: DataFrame) -> DataFrame:
    """The first document of each range, by doc_id, then hash, then text."""
    first = F.min(F.struct("doc_id", F.xxhash64("text").alias("tie"), "text"))
    return spread.groupBy("bucket").agg(first.alias("first")).select("first.doc_id", "first.text", "bucket")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    last = None  # (doc_id, text, bucket, its fingerprint)
    for batch in batches:
        for doc, text, bucket, own in zip(*(c.to_pylist() for c in batch.columns)):
            mine = fingerprint(text)
            if last and last[2] == bucket:
                yield (*last, text, mine)
            last = (doc, text, bucket, mine) if own else None


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for doc, text, _, mine, other, its in _rows(batches):
        changed = edited(text, other)
        new = fingerprint(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
        out.append((doc, len(text), sha, as_text(mine), as_text(new), likeness(mine, new), likeness(mine, its)))
        if len(out) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)


def fingerprints(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds `fingerprint` to every document: map of digest to bytes."""

    @F.pandas_udf("map<string,long>")
    def run(texts):
        return texts.map(lambda t: fingerprint(t or ""))

    return documents.withColumn("fingerprint", run(F.col(text)))


def query(documents: DataFrame) -> DataFrame:
    n = partitions(documents.sparkSession)
    rows = with_next(documents, 4 * n)
    ordered = rows.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("own"), "doc_id", F.xxhash64("text"), "text")
    return ordered.mapInArrow(compare, OUT)
