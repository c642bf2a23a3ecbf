"""Centroid clustering over space-filling-curve zone maps (operator 13): exact integer k-means.

A component x becomes the integer floor(scale * x). Vectors are put in the order of a Hilbert curve over a coarse grid
(two bits a component, cells cut at the mean and one standard deviation to either side), range-partitioned by key and row
number so that copies of one vector spread over partitions, and packed into blocks of at most ``block`` vectors with the
smallest and largest value of each component, and the sum. A round reads the blocks: the distance from a centroid
to a box has a lower and an upper bound, and centroids whose lower bound is above the least upper bound are no candidates
of the block. A block with one candidate adds its stored sum; all others compare their vectors with the candidates
exactly. Sums are made by task, then by (centroid, component) in exact decimals; only k centroids ever reach the driver
and the tasks. Rounds after one that moved nothing are the same and are not run.

Vectors that are null, of another length than ``dims``, or hold a null or non-finite component are left out, as are those
with a component of 2^17 or more in size: no long holds their squared distances. A null id counts as empty text where
starts are drawn, and is returned as null. Repeated rows are vectors of their own; rows whose start hashes are equal are
taken in the order of id and vector. Fewer vectors than ``k`` give fewer centroids; none give no rows. Ties of distance
go to the smaller centroid; an empty centroid stays where it is. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut

K, ROUNDS, DIMS, SCALE, BLOCK, BITS = 8, 10, 64, 1024, 256, 2
#: Components are below this in size, so that squared distances of 64 components fit a long.
LARGEST = 2.0**17


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of cells (n, dims) with coordinates below 2^bits, as rows of bytes in order of size.

    The coordinates are turned into the transposed index by exchanges and inversions from the highest bit down, then
    into Gray code; all cells of the batch at once.
    """
    n, dims = cells.shape
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for i in range(dims):
            high = (x[i] >> np.uint32(b) & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap).astype(np.uint32)
            if i:
                x[i] ^= swap.astype(np.uint32)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint32(b) & 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([x >> np.uint32(b) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return np.packbits(planes.reshape(bits * dims, n).T, axis=1)


def fixed(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a binary column whose values are ``dtype`` numbers, all of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def packed(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def integers(df: DataFrame, id_col: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, x) of the vectors that are kept, x with ``dims`` integers."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST * 1024 / scale))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def moments(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation by component; they only order the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, dims))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, dims).astype(np.float64)
            sums += np.stack([np.full(dims, len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), *map(pa.array, sums)], names=["dim", "n", "s", "ss"])

    got = vectors.select("x").mapInArrow(run, "dim long, n double, s double, ss double").groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    rows = sorted(got.collect())
    n, s, ss = np.array([r[1:] for r in rows]).T if rows else np.zeros((3, dims))
    n = np.maximum(n, 1)
    return s / n, np.sqrt(np.maximum(ss / n - (s / n) ** 2, 0))


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of "seed:id"."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r.x) for r in vectors.select(h.alias("h"), "id", "x").orderBy("h", "id", "x").limit(k).collect()]


def blocks(vectors: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """(ids, x, lo, hi, total): blocks of vectors in Hilbert order with their boxes and sums, written once.

    ``x`` holds int32 rows; ``lo`` and ``hi`` the box; ``total`` int64 sums of the components.
    """
    mean, deviation = moments(vectors, dims)
    id_type = vectors.schema["id"].dataType

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, dims)
            steps = np.clip(np.floor((x - mean) / np.maximum(deviation, 1e-9)) + (1 << BITS - 1), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed(x.astype(np.int32)), packed(hilbert_keys(steps.astype(np.uint32)))], names=["id", "x", "key"])

    rows = cut(vectors.mapInArrow(keyed, T.StructType([T.StructField("id", id_type), T.StructField("x", T.BinaryType()), T.StructField("key", T.BinaryType())])))
    # Row numbers of a written table: they part copies of a vector, repeated ids included.
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    ordered = salted.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt").select("id", "x")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table) -> pa.RecordBatch:
            x = fixed(table.column("x").combine_chunks(), np.int32)
            ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table.column("id").combine_chunks())
            parts = [x, x.min(0), x.max(0), x.sum(0, dtype=np.int64)]
            return pa.RecordBatch.from_arrays([ids, *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["ids", "x", "lo", "hi", "total"])

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = rows if rest is None else pa.concat_tables([rest, rows])
            while rest.num_rows >= block:
                yield made(rest.slice(0, block))
                rest = rest.slice(block)
        if rest is not None and rest.num_rows:
            yield made(rest)

    binary = [T.StructField(c, T.BinaryType()) for c in ("x", "lo", "hi", "total")]
    return cut(ordered.mapInArrow(pack, T.StructType([T.StructField("ids", T.ArrayType(id_type)), *binary])))


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Whether each centroid may be the nearest of a vector inside each box: (boxes, centroids)."""
    least, most = [], []
    for c in centroids:
        outside = np.maximum(np.maximum(lo - c, c - hi), 0)
        across = np.maximum(c - lo, hi - c)
        least.append((outside * outside).sum(1))
        most.append((across * across).sum(1))
    return np.stack(least, 1) <= np.stack(most, 1).min(1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of the centroids ``which`` (ascending) for each row; exact."""
    far = np.stack([((x - centroids[c]) ** 2).sum(1) for c in which], 1)
    at = far.argmin(1)
    return which[at], far[np.arange(len(x)), at]


def boxes(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch of blocks with the candidates of each."""
    lo, hi = (fixed(batch.column(c), np.int32).astype(np.int64) for c in ("lo", "hi"))
    for i, fits in enumerate(candidates(lo, hi, centroids)):
        yield i, np.flatnonzero(fits)


def moved(packed_blocks: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Centroids after one round: the floor of the exact mean of what is nearest to each."""
    c = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((len(c), dims), np.int64), np.zeros(len(c), np.int64)
        for batch in batches:
            for i, which in boxes(batch, c):
                x = batch.column("x")[i].as_buffer()
                if len(which) == 1:
                    sums[which[0]] += np.frombuffer(batch.column("total")[i].as_buffer(), np.int64)
                    n[which[0]] += x.size // (4 * dims)
                    continue
                x = np.frombuffer(x, np.int32).reshape(-1, dims).astype(np.int64)
                own, _ = nearest(x, c, which)
                for k in which:
                    mine = own == k
                    sums[k] += x[mine].sum(0)
                    n[k] += mine.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(c)), dims)), pa.array(np.tile(np.arange(dims), len(c))), pa.array(sums.ravel()), pa.array(np.repeat(n, dims))],
            names=["cluster", "dim", "s", "n"])

    parts = packed_blocks.select("x", "lo", "hi", "total").mapInArrow(run, "cluster long, dim long, s long, n long").where("n > 0")
    new = [list(x) for x in centroids]
    for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        new[r.cluster][r.dim] = int(r.s) // r.n
    return new


def assigned(packed_blocks: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    c = np.array(centroids, np.int64)
    id_type = packed_blocks.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, which in boxes(batch, c):
                x = np.frombuffer(batch.column("x")[i].as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
                own, far = nearest(x, c, which)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(own.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return packed_blocks.select("ids", "x", "lo", "hi").mapInArrow(run, schema)


def cluster(
    df: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 3, block: int = BLOCK, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector of ``df``."""
    vectors = integers(df, id_col, vector, dims, scale)
    centroids = starts(vectors, k, seed)
    spark = df.sparkSession
    if not centroids:
        none = F.lit(None)
        return vectors.limit(0).select(F.col("id").alias(id_col), none.cast("int").alias("cluster"), *(none.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), none.cast("string").alias("centroid_sha256"))
    ordered = blocks(vectors, dims, block)
    for _ in range(rounds):
        before, centroids = centroids, moved(ordered, centroids, dims)
        if centroids == before:
            break
    found = cut(assigned(ordered, centroids, dims))
    own = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    # A row a centroid.
    by = [(i, int(own[i]), int(sum(own.values())), digests[i]) for i in sorted(own)]
    by = spark.createDataFrame(by, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
