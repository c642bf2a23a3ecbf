"""Byte-level BPE encoding and decoding (operator 7).

Ranks come from a local file in tiktoken's format; its path is a parameter, and every worker process loads it once.
A long text is cut where a match of the pattern ends in any case: between a word character and a space. No
alternative of the pattern holds a non-space before a space, and only a look-ahead at white space looks further, so
the pieces are matched exactly as the whole would be. A text without such a place stays whole.

Null and empty texts have no ids. Repeated rows are encoded each; further columns pass through, but for one named
like an output, which is replaced.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, types as T

from .common import append

#: A text longer than this is cut at the next safe place behind every multiple.
PIECE_CHARS = 1 << 16
#: Bytes of text, or of ids, that a task works on at once.
SLICE = 1 << 20
SAFE = re.compile(r"\w(?= )")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS):
    """``text`` cut at safe places, ``size`` code points or a little more each."""
    start = 0
    while len(text) - start > size and (m := SAFE.search(text, start + size - 1)):
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str | None) -> np.ndarray:
    return np.concatenate([np.asarray(enc.encode_ordinary(p), dtype="<u4") for p in pieces(text or "")])


def encode(df: DataFrame, rank_file: str, pattern: str, column: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """``df`` with the ids of ``column``: an array of int, or little-endian unsigned 32-bit integers if ``packed``."""

    def fn(texts: pa.Array) -> list[pa.Array]:
        enc = encoding(rank_file, pattern)
        ids = [encode_text(enc, t) for t in texts.to_pylist()]
        return [pa.array([x.tobytes() for x in ids], pa.binary()) if packed else pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32()))]

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    return append(df, column, [T.StructField(out, kind)], fn, SLICE)


def round_trip(df: DataFrame, rank_file: str, pattern: str, column: str = "text", out: str = "ids", same: str = "round_trip") -> DataFrame:
    """``df`` with the packed ids of ``column`` and whether their decoded bytes are those of the text; one pass, text by text."""

    def fn(texts: pa.Array) -> list[pa.Array]:
        enc = encoding(rank_file, pattern)
        ids, back = [], []
        for t in texts:
            text = t.as_py() or ""
            own = encode_text(enc, text)
            ids.append(own.tobytes())
            back.append(enc.decode_bytes(own.tolist()) == text.encode())
        return [pa.array(ids, pa.binary()), pa.array(back, pa.bool_())]

    return append(df, column, [T.StructField(out, T.BinaryType()), T.StructField(same, T.BooleanType())], fn, SLICE)


def decode(df: DataFrame, rank_file: str, pattern: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of the ids in ``column``, an array of int or packed; they need not be UTF-8. Null gives none."""
    packed = isinstance(df.schema[column].dataType, T.BinaryType)
    if not packed:
        df = df.withColumn(column, df[column].cast("array<int>"))

    def fn(ids: pa.Array) -> list[pa.Array]:
        enc = encoding(rank_file, pattern)
        lists = (np.frombuffer(x.as_py() or b"", dtype="<u4").tolist() if packed else x.as_py() or [] for x in ids)
        return [pa.array([enc.decode_bytes(x) for x in lists], pa.binary())]

    return append(df, column, [T.StructField(out, T.BinaryType())], fn, SLICE)
