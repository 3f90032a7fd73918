"""Token-id files: documents in ascending doc_id order, their ids in range-coded, checksummed blocks (operator 2).

A file set is a Parquet table, so that Spark's commit protocol makes writing safe against lost executors and any store
will do. A row is a segment: whole documents of one range of doc_ids, about SEGMENT ids, cut into blocks of
range_coder.BLOCK ids that are coded independently. Columns: bucket (the range), segment (its number there), docs and
sizes (doc_ids and their numbers of ids), n_tokens, blocks, and crcs (of each block's ids). Reading checks every block.

Null texts count as empty; every document ends with the end id. A null doc_id comes first; documents of one doc_id come
in the order of their texts' hashes, and a doc_id that holds many rows fills buckets of its own. An empty table gives an empty file set. Extra columns are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import partitions, ranged, sliced
from lexspark.llm.range_coder import BLOCK, LANES, checksum, decode_blocks, encode_blocks
from lexspark.llm.tokens import ended_ids, library_table

END_ID = 2
#: Ids of a segment, from which on it is closed.
SEGMENT = 32 * BLOCK

FILES = "bucket int, segment int, docs array<long>, sizes array<long>, n_tokens long, blocks array<binary>, crcs array<long>"
_FILES = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("blocks", pa.list_(pa.binary())), ("crcs", pa.list_(pa.int64()))])
DOCUMENTS = "bucket int, segment int, doc_id long, within long, n_tokens long, ids binary"
_DOCUMENTS = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _segments(documents: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, list[int], list[int], np.ndarray]]:
    """(bucket, doc_id, ids) in order to (bucket, number, doc_ids, sizes, ids)."""
    at, number, total, docs, held = None, 0, 0, [], []
    for bucket, doc, ids in documents:
        if docs and (bucket != at or total >= SEGMENT):
            yield at, number, docs, [len(x) for x in held], np.concatenate(held)
            number = number + 1 if bucket == at else 0
            total, docs, held = 0, [], []
        elif bucket != at:
            number = 0
        at = bucket
        docs.append(doc)
        held.append(ids)
        total += len(ids)
    if docs:
        yield at, number, docs, [len(x) for x in held], np.concatenate(held)


def _coded(segments: list[tuple]) -> pa.RecordBatch:
    """Segments as rows of the files; their blocks are coded side by side."""
    cut = [[s[4][i : i + BLOCK] for i in range(0, len(s[4]), BLOCK)] for s in segments]
    codes = iter(encode_blocks([b for blocks in cut for b in blocks]))
    rows = [(*s[:4], len(s[4]), [next(codes) for _ in blocks], [checksum(b) for b in blocks]) for s, blocks in zip(segments, cut)]
    return _batch(rows, _FILES)


def encode(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Rows of the file set. Each text is shuffled once, to its range of doc_ids."""
    n = partitions(documents.sparkSession)

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        table = library_table(path)
        for batch in sliced(batches):
            ids, bounds = ended_ids(table, batch.column(2), end_id)
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.split(ids, bounds[1:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = documents_of(batches)
        held: list[tuple] = []
        blocks = 0
        for segment in _segments(rows):
            held.append(segment)
            blocks += -(-len(segment[4]) // BLOCK)
            if blocks >= LANES:
                yield _coded(held)
                held, blocks = [], 0
        if held:
            yield _coded(held)

    tie = F.xxhash64("text")
    rows, _ = ranged(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", 4 * n, tie)
    ordered = rows.select("bucket", "doc_id", "text").repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", tie, "text")
    return ordered.mapInArrow(run, FILES)


def _decoded(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    sizes = [min(BLOCK, r["n_tokens"] - BLOCK * i) for r in rows for i in range(len(r["blocks"]))]
    blocks = decode_blocks([b for r in rows for b in r["blocks"]], sizes)
    if [checksum(b) for b in blocks] != [c for r in rows for c in r["crcs"]]:
        raise ValueError("a block's checksum is wrong")
    rest = iter(blocks)
    for r in rows:
        ids = np.concatenate([next(rest) for _ in r["blocks"]]).astype("<u4")
        starts = np.cumsum([0, *r["sizes"]])
        yield _batch([(r["bucket"], r["segment"], d, int(s), n, ids[s : s + n].tobytes()) for d, s, n in zip(r["docs"], starts, r["sizes"])], _DOCUMENTS)


def decode(files: DataFrame) -> DataFrame:
    """A row per document, with where its ids start in its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                held.extend(batch.slice(i, 1).to_pylist())
                if sum(len(r["blocks"]) for r in held) >= LANES:
                    yield from _decoded(held)
                    held = []
        if held:
            yield from _decoded(held)

    return files.mapInArrow(run, DOCUMENTS)


def segment_starts(files: DataFrame) -> DataFrame:
    """bucket, segment, first: the ids of all segments before each, from the small columns alone."""
    sizes = files.select("bucket", "segment", "n_tokens")
    totals = sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect()  # a row per range
    before, at = {}, 0
    for bucket, n in totals:
        before[bucket], at = at, at + n
    if not before:
        return sizes.select("bucket", "segment", F.lit(0).cast("long").alias("first"))
    base = F.element_at(F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)]), F.col("bucket"))
    earlier = F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("bucket", "segment", (base + F.coalesce(earlier, F.lit(0))).cast("long").alias("first"))


def query(documents: DataFrame, path: str, place: str) -> DataFrame:
    """Writes the files to `place`, reads them back, and gives the digests."""
    spark = documents.sparkSession
    encode(documents, path).write.parquet(place)
    files = spark.read.schema(FILES).parquet(place)
    found = decode(files).select("bucket", "segment", "doc_id", "within", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    starts = segment_starts(files)
    return found.join(starts, ["bucket", "segment"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
