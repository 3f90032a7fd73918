"""Sum-of-squares online packing of token ids into windows (operator 8).

Documents longer than a window first give whole windows; the rest of each is an item. An item goes, on arrival, to the
fill level at which the sum of the squared numbers of windows per level grows least, an empty window counting as level
0; `levels` holds these numbers. Each Spark partition packs what it has, in its order, so nothing is shuffled, and a
retried task gives the same windows. At the end of a partition the windows still open keep what was placed in them, but
for the emptiest: their items, cut where need be, top up the fullest, until all are full. What is left, less than a
window, fills windows whose sizes are powers of two, which need no padding. So only the topping is placed by another rule,
and its share falls as partitions grow; `SumOfSquares.topped` counts its ids.

Null texts count as empty; every document ends with the end id, so that an empty one is a piece of length 1.
Repeated doc_ids give one set of pieces each. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import sliced
from lexspark.llm.tokens import ended_ids, library_table

WINDOW = 1024
END_ID = 0
#: Windows of a partition are numbered from the partition's number times this.
_PART = 1 << 36

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


class SumOfSquares:
    """add(item) places (doc_id, start, length, doc_tokens, ids) and gives the pieces of a window that it fills."""

    def __init__(self, window: int):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.topped = 0
        self._open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level whose choice makes the sum of squares smallest; the fullest of equals."""
        top = self.window - size
        here, there = self.levels[1 : top + 1], self.levels[size + 1 : self.window + 1]
        change = np.where(here > 0, 2 * (there - here) + 2, np.iinfo(np.int64).max)
        if top and here[-1]:
            change[-1] = 1 - 2 * here[-1]  # the window is full and leaves the levels
        best = len(change) - int(np.argmin(change[::-1])) if top else 0
        return best if best and change[best - 1] <= 2 * self.levels[size] + 1 else 0

    def add(self, item: tuple) -> list[tuple] | None:
        size = item[2]
        level = self.level_for(size) if size < self.window else 0
        held = [item]
        if level:
            held = self._open[level].pop()
            held.append(item)
            self.levels[level] -= 1
        if level + size == self.window:
            return held
        self._open[level + size].append(held)
        self.levels[level + size] += 1
        return None

    def finish(self) -> Iterator[list[tuple]]:
        """The windows still open: the emptiest ones top up the fullest; the last is cut into powers of two."""
        held = [(level, x) for level in range(self.window - 1, 0, -1) for x in self._open[level]]
        first, last = 0, len(held) - 1
        while first < last:
            room, own = self.window - held[first][0], list(held[first][1])
            while room and first < last:
                level, items = held[last]
                item = items.pop()
                if item[2] > room:
                    item, more = _cut(item, room)
                    items.append(more)
                own.append(item)
                room -= item[2]
                self.topped += item[2]
                held[last] = (level - item[2], items)
                last -= not items
            if room:
                held[first] = (self.window - room, own)
            else:
                yield own
                first += 1
        for _, items in held[first : last + 1]:
            yield from _powers_of_two(items)


def _cut(item: tuple, at: int) -> tuple[tuple, tuple]:
    doc, start, length, total, ids = item
    return (doc, start, at, total, ids[:at]), (doc, start + at, length - at, total, ids[at:])


def _powers_of_two(items: list[tuple]) -> Iterator[list[tuple]]:
    """Windows of falling powers of two."""
    queue = items[::-1]
    left = sum(x[2] for x in queue)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        held = []
        while room:
            item = queue.pop()
            if item[2] > room:
                item, more = _cut(item, room)
                queue.append(more)
            held.append(item)
            room -= item[2]
        yield held


def windows(documents: Iterator[tuple[int, np.ndarray]], packer: SumOfSquares) -> Iterator[list[tuple]]:
    """(doc_id, ids) to the pieces of one sequence after the other."""
    for doc, ids in documents:
        item = (doc, 0, len(ids), len(ids), ids)
        while item[2] > packer.window:
            full, item = _cut(item, packer.window)
            yield [full]
        if item[2] and (done := packer.add(item)):
            yield done
    yield from packer.finish()


def pack(documents: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: SCHEMA, with their ids as little-endian unsigned 32-bit integers."""

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        table = library_table(path)
        for batch in sliced(batches):
            ids, bounds = ended_ids(table, batch.column(1), end_id)
            yield from zip(batch.column(0).to_pylist(), np.split(ids, bounds[1:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * _PART
        numbered = enumerate(windows(documents_of(batches), SumOfSquares(window)), first)
        while part := list(itertools.islice(numbered, 512)):
            rows = [(*x[:4], n, at, x[4].tobytes()) for n, held in part for x, at in zip(held, itertools.accumulate((y[2] for y in held), initial=0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(documents: DataFrame, path: str) -> DataFrame:
    return pack(documents, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
