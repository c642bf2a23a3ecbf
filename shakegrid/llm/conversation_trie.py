"""Conversation prefix trie (operator 12): every shared prefix of conversations by ROLLUP over turn-id columns.

A turn is the SHA-256 (16 bytes of it) of role and text, followed by its number of words (4 bytes); texts themselves are not
moved. A conversation is cut into blocks of ``width`` turns. A block is a row: the key of the node it hangs from, which is
the hash along the path of all earlier blocks, and its turns in ``width`` columns. One ROLLUP over these columns, within
(block, key), then aggregates all prefixes of all blocks together; ``grouping_id`` says how many columns are kept, which
is the depth within the block. A second ROLLUP, over the nodes so found, sums over subtrees. What lies in deeper blocks
is first summed by the node it hangs from, block by block from the deepest up, over one row for each such node.

The ids that end at a node are sorted by a range shuffle on (node, id), joined in pieces by the tasks and hashed piece by
piece, so memory stays bounded, while a digest is one sequence by definition. Other sums are partial before they move; the
join with the parents, in which the children of one node may be many, comes last, where the adaptive planner can split it.

Turns are ordered by turn (null first), then role and hash; null role and text are empty. Rows without conv_id belong to no
conversation and are left out. Repeated rows are turns of their own. A conversation without turns is a member of the root.
No conversations, no rows. Further columns are left out. A task holds the turn ids (20 bytes each) of one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut

WIDTH, PIECE = 8, 4096
WORD = r"[^\x20\x09-\x0D]+"
TURN_BYTES, KEY_BYTES = 20, 16


def hashed(value: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a text or of bytes."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * KEY_BYTES))


def root_key() -> Column:
    return F.unhex(F.lit("00" * KEY_BYTES))


def turn_id(role: Column, text: Column) -> Column:
    """Hash of role and text, then the words of the text."""
    same = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(hashed(same), F.unhex(F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0")))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turn ids of each conversation in order; ``conversations`` has conv_id, turn, role, text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), turn_id(role, text).alias("id"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "id"))).alias("t"))
    return grouped.select("conv_id", F.col("t.id").alias("turns"))


def rebuilt(of: DataFrame, stride: int = 20, heads: int = 4) -> DataFrame:
    """Conversations (conv_id, turns) that begin with turns of another: c starts with the first h of c - c % stride, h = crc32(c) % heads.

    Its own turns after the first h follow.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = of.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(stride))).alias("base"))
    first = of.select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("first"))
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return own.join(first, "base", "left").select("conv_id", turns.alias("turns"))


def blocks(of: DataFrame, width: int) -> DataFrame:
    """(conv_id, n, block, prior, t1 ..): a row for each block of each conversation, one at least; n is its number of turns."""
    n = F.size("turns")
    last = F.greatest(F.floor((n - 1) / width), F.lit(0)).cast("int")

    def onward(keys: Column, block: Column) -> Column:
        parts = [F.get("turns", (block - 1) * width + i) for i in range(width)]
        return F.concat(keys, F.array(hashed(F.concat(F.element_at(keys, -1), *parts))))

    keys = F.aggregate(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.slice(F.array(F.lit(1)), 1, 0)), F.array(root_key()), onward)
    rows = of.select("conv_id", n.alias("n"), "turns", F.posexplode(keys).alias("block", "prior"))
    return rows.select("conv_id", "n", "block", "prior", *(F.get("turns", F.col("block") * width + i).alias(f"t{i + 1}") for i in range(width)))


def rolled_up(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """``sums`` by (block, prior) and every prefix of the columns t1 .. that the rows have, with its level.

    Rows with nulls behind their last turn fall into prefixes that end in a null; these, and the empty prefix of later
    blocks (the node that they hang from), are dropped before anything is summed.
    """
    t = [f"t{i + 1}" for i in range(width)]
    real = " ".join(f"WHEN {i + 1} THEN {c} IS NOT NULL" for i, c in enumerate(t))
    return rows.sparkSession.sql(
        f"""SELECT * FROM (SELECT block, prior, {', '.join(t)}, {width} - bit_count(grouping_id()) AS level, {sums}
            FROM {{rows}} GROUP BY block, prior, ROLLUP({', '.join(t)})) WHERE CASE level WHEN 0 THEN block = 0 {real} END""",
        rows=rows,
    )


def with_keys(nodes: DataFrame, width: int) -> DataFrame:
    """``nodes`` with key and parent_key (null for the root): the hash of prior and the turns up to the node."""
    upto = [root_key() if not d else hashed(F.concat("prior", *(f"t{i + 1}" for i in range(d)))) for d in range(width + 1)]
    key, parent = F.when(F.col("level") == 0, F.col("prior")), F.when(F.col("level") == 1, F.col("prior"))
    for d in range(1, width + 1):
        key = key.when(F.col("level") == d, upto[d])
        parent = parent.when(F.col("level") == d + 1, upto[d])
    return nodes.withColumns({"key": key, "parent_key": parent})


def below(nodes: DataFrame, width: int) -> DataFrame | None:
    """(key, leaves, saved) summed over all deeper blocks, for the nodes that blocks hang from; None if there is one block only."""
    deepest = nodes.agg(F.max("block")).first()[0] or 0
    if not deepest:
        return None
    own = nodes.where("block > 0").groupBy("block", F.col("prior").alias("key")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    up = nodes.where(F.col("level") == width).select("key", F.col("prior").alias("up"))
    own = cut(own.join(up, "key"))
    out = deeper = None
    for b in range(deepest, 0, -1):
        here = own.where(F.col("block") == b).select("key", "up", "leaves", "saved")
        if deeper is not None:
            here = here.join(deeper, "key", "left").select("key", "up", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
        here = cut(here)
        deeper = here.groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        out = here if out is None else out.union(here)
    return out.drop("up")


def digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, conv_id): the digest of each node's ids in numeric order, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key"), batch.column("conv_id")
            texts = pc.cast(ids, pa.string()).to_pylist()
            change = pc.not_equal(keys.slice(1), keys.slice(0, max(len(keys) - 1, 0))).to_numpy(zero_copy_only=False).nonzero()[0] + 1
            bounds = [0, *change.tolist(), len(keys)]
            cuts = [(i, min(i + PIECE, b)) for a, b in zip(bounds, bounds[1:]) for i in range(a, b, PIECE)]
            at = [a for a, _ in cuts]
            yield pa.RecordBatch.from_arrays([keys.take(at), ids.take(at), pa.array([",".join(texts[a:b]) for a, b in cuts], pa.string())], names=["key", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == now:
                    digest.update(b"," + ids.encode())
                    continue
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["key", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    ordered = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("first", ends.schema["conv_id"].dataType), T.StructField("ids", T.StringType())])
    return ordered.mapInArrow(pieces, schema).repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "key binary, ends_sha256 string")


def trie(of: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each node of the trie of ``of`` (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = cut(blocks(of, width))
    nodes = rolled_up(rows, width, "count(1) AS n_convs, min(conv_id) AS conv_id, max(n) AS longest")
    words = F.conv(F.hex(F.substring(F.coalesce(*(f"t{i}" for i in range(width, 0, -1))), KEY_BYTES + 1, TURN_BYTES - KEY_BYTES)), 16, 10).cast("long")
    depth = F.col("block").cast("long") * width + F.col("level")
    nodes = with_keys(nodes, width).withColumns({
        "leaves": (F.col("longest") == depth).cast("long"), "saved": F.coalesce((F.col("n_convs") - 1) * words, F.lit(0).cast("long")),
    })
    nodes = cut(nodes.drop("longest", "parent_key"))
    deeper = below(nodes, width)
    if deeper is not None:
        more = deeper.select("key", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        nodes = nodes.join(more, "key", "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
    # A subtree's smallest member and number of members are those of its top.
    whole = rolled_up(nodes, width, "max(n_convs) AS n_convs, min(conv_id) AS conv_id, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens")
    whole = cut(with_keys(whole, width).select("key", "parent_key", depth.alias("depth"), "conv_id", "n_convs", "n_leaves", "saved_tokens"))
    at_end = rows.where(F.col("n") <= (F.col("block") + 1) * width)
    at_end = with_keys(at_end.withColumn("level", (F.col("n") - F.col("block") * width).cast("int")), width).select("key", "conv_id")
    children = whole.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    empty = hashlib.sha256(b"").hexdigest()
    out = whole.join(children, "key", "left").join(digests(cut(at_end)), "key", "left")
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return out.join(parents, "parent_key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
