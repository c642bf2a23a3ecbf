"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Bytes of text that a task turns into Python strings at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at the ASCII white space 20 and 09-0D; both hold for bytes.lower and bytes.split."""
    return text.encode().lower().split() if text else []


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive pieces that hold about ``size`` bytes of ``column`` each, one row at least."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    if pa.types.is_list(values.type):
        sizes = [8 * (n or 0) for n in pc.list_value_length(values).to_pylist()]
    else:
        sizes = [n or 0 for n in pc.binary_length(values).to_pylist()]
    start, total = 0, 0
    for i, end in enumerate(accumulate(sizes)):
        if i > start and end - total > size:
            yield batch.slice(start, i - start)
            start, total = i, end - sizes[i]
    yield batch.slice(start)


def append(df: DataFrame, columns: str | list[str], fields: list[T.StructField], fn: Callable[..., list[pa.Array]], size: int = SLICE_BYTES) -> DataFrame:
    """All columns of ``df`` and, behind them, what ``fn`` makes of the values of ``columns``, piece by piece.

    The first of ``columns`` sets the size of a piece, about ``size`` bytes. A column of ``df`` with the name of a new field is replaced. Work
    stays in the task that reads the row.
    """
    columns = [columns] if isinstance(columns, str) else columns
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new]
    inner = [f"__in{i}" for i in range(len(columns))]
    while {*inner} & {c.lower() for c in keep}:
        inner = [x + "_" for x in inner]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, inner[0], size):
                made = fn(*(part.column(c) for c in inner))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=[*keep, *(f.name for f in fields)])
                del made
            # Workers live on; what a batch took goes back.
            pa.default_memory_pool().release_unused()

    return df.select(*(df[c] for c in keep), *(df[c].alias(x) for c, x in zip(columns, inner))).mapInArrow(run, schema)


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
