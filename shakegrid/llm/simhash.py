"""SimHash near-dedup (operator 8): multi-index hashing over the segments of a 64-bit fingerprint.

Words are cut at ASCII white space after A-Z are lower-cased; shingles are counted with repeats. Fingerprints link at
two or fewer differing bits. Every distinct fingerprint enumerates the ball of radius one within each of its segments,
the other segments unchanged, and is stored and fetched under these keys: two bits apart in one segment or in two
segments, fingerprints meet at the key between them. So no link is lost, and at most 65 fingerprints can meet at one
key, however large a group of copies is. Complete distances are verified before the links are united.

Equal fingerprints are one node. Null and empty texts have fingerprint zero and link like any other. Rows with a null
id keep a row; a component of such rows only has a null id. Repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut
from .common import append, words
from .components import components

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; unsigned."""
    ws = words(text)
    if not ws:
        return 0
    n = max(1, len(ws) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, CHUNK):
        part = ws[start : min(start + CHUNK, n) + size - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in (zip(*(part[i:] for i in range(size))) if len(ws) >= size else [part])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, column: str = "text", size: int = 3, out: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of ``column`` as a signed 64-bit integer."""

    def fn(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, size) for t in texts.to_pylist()], dtype="<u8").view("<i8"))]

    return append(df, column, [T.StructField(out, T.LongType())], fn)


def balls(fps: DataFrame, segments: int = 4) -> DataFrame:
    """(fp, key): the fingerprint and, within each segment, its values at distance one."""
    width = 64 // segments
    flips = [1 << (s * width + i) for s in range(segments) for i in range(width)]
    keys = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(x - (1 << 64) if x >> 63 else x).cast("long")) for x in flips)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within ``max_bits`` (2 at most) of each other.

    Members of a key are linked with its smallest one; where ``max_bits`` is 2, all members of a key are within reach
    of each other, so this loses no connection.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("balls of radius one find fingerprints at two or fewer differing bits")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    table = balls(fps)
    first = table.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("key", "a")
    if max_bits == 1:  # a fingerprint meets its neighbours under its own value
        first = fps.select(F.col("fp").alias("key"), F.col("fp").alias("a"))
    # Both sides hold up to 65 rows a fingerprint; sized as the fingerprints alone, either could be sent whole.
    met = table.hint("merge").join(first.hint("merge"), "key").select("a", F.col("fp").alias("b"))
    return met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).distinct()


def _grouped(df: DataFrame, id_column: str, column: str, size: int, max_bits: int) -> DataFrame:
    """(id, h, fp, root, component_id) of each row; h is a hash of the text, root the fingerprint that stands for the group."""
    text = df.select(df[id_column].alias("id"), F.xxhash64(df[column]).alias("h"), df[column].alias("text"))
    fp = cut(fingerprints(text, "text", size).select("id", "h", "fp"))
    nodes = cut(fp.groupBy("fp").agg(F.min("id").alias("first")))
    roots = cut(components(links(nodes.select("fp"), max_bits)))
    # Packed tables are sized far below their rows: nothing here is sent whole.
    nodes, roots, fp = nodes.hint("merge"), roots.hint("merge"), fp.hint("merge")
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fp.join(named.hint("merge").join(smallest.hint("merge"), "root").select("fp", "root", "component_id").hint("merge"), "fp")


def groups(df: DataFrame, id_column: str = "doc_id", column: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``df``: its id, fp (signed), component_id (smallest id reachable, itself included)."""
    g = _grouped(df, id_column, column, size, max_bits)
    return g.select(F.col("id").alias(id_column), "fp", "component_id")


def representatives(df: DataFrame, id_column: str = "doc_id", column: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``df`` for each group: that of the smallest id (ties: by a hash of the text; null ids only if there is no other)."""
    of = F.struct(F.col("id").isNull(), "id", "h")
    first = _grouped(df, id_column, column, size, max_bits).groupBy("root").agg(F.min(of).alias("x")).select("x.id", "x.h")
    rows = df.withColumn("__h", F.xxhash64(df[column]))
    kept = rows.join(first, rows[id_column].eqNullSafe(first["id"]) & rows["__h"].eqNullSafe(first["h"]), "left_semi")
    return kept.dropDuplicates([id_column, "__h"]).drop("__h")


def hex_fingerprint(fp):
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
