"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank vocabulary (operator 10).

The model file is a ModelProto message written field by field: one piece per rank, its bytes mapped to one character
each, scored by the negative rank, so that sentencepiece's best-score-first merges are the lowest-rank-first merges of
byte-level BPE; identity normalisation, no dummy prefix, no white-space handling. Every match of the pre-token pattern
is encoded separately; a match that is itself a piece is that piece, as in rank-based encoders. Decoding maps the pieces
of ids back to bytes.

Nulls count as empty text, which has no ids. Null ids decode to empty bytes; an unknown id is an error.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.tokens import BYTE_CHARS, PieceTable, as_bytes, mapped


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model file: ids are ranks, and the unknown piece that the format demands has the id after the last."""
    in_order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in in_order] != list(range(len(in_order))):
        raise ValueError("ranks must be gapless from 0")
    normal, unknown, bpe = 1, 2, 2
    pieces = b"".join(_piece("".join(BYTE_CHARS[b] for b in p), -float(ranks[p]), normal) for p in in_order)
    absent = b"".join(_number(field, 2**64 - 1) for field in (41, 42, 43))  # begin, end, padding: -1
    trainer = _message(2, _number(3, bpe) + _number(40, len(in_order)) + absent)
    identity = _message(3, _message(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5)))
    return pieces + _piece("<unk>", 0.0, unknown) + trainer + identity


@functools.cache
def _encoder(path: str):
    import sentencepiece

    ranks = read_ranks(path)
    model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
    whole = {"".join(BYTE_CHARS[b] for b in p): n for p, n in ranks.items()}

    def ids(pretoken: str) -> bytes:
        text = mapped(pretoken)
        return as_bytes([whole[text]] if text in whole else model.encode(text))

    return PieceTable(ids)


@functools.cache
def _pieces(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    return sorted(ranks, key=ranks.__getitem__)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds (or replaces) `ids`, array<int>, of the whole text."""

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _encoder(path)
        for texts in batches:
            ids, bounds = table.encode(pa.Array.from_pandas(texts, type=pa.string()))
            ids = ids.astype(np.int32)
            yield pd.Series([ids[a:b] for a, b in zip(bounds, bounds[1:])], dtype=object)

    return df.withColumn(ids, run(F.col(text)))


def decode(ids: Column, path: str) -> Column:
    """Ids as the bytes that they stand for."""

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _pieces(path)
        for lists in batches:
            yield pd.Series([b"" if x is None else b"".join([table[i] for i in x.tolist()]) for x in lists], dtype=object)

    return run(ids)


def query(documents: DataFrame, path: str) -> DataFrame:
    """Digests per document of its ids and of what they decode to."""
    encoded = encode(documents.select("doc_id", "text"), path).select("doc_id", "ids")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
