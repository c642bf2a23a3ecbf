"""Labelled documents for the operators that learn: all of them, whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut

#: Bits in a bitmap of ids, as ``bitmap_construct_agg`` makes it, and the bitmaps that may be sent to tasks, 4 KB each.
BITS, BITMAPS = 15, 8192


def labelled(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ``columns``, ``label``) of every document with text that ``labels`` (doc_id, ``label``) names and ``where`` admits.

    A document counts once for each value of its label, however often its row or the label is repeated. Ids that occur
    once, all of them as a rule, stay where they lie if the labelled ids fit BITMAPS bitmaps, as whole numbers that lie close
    do, or are few enough to be sent; only rows of the other ids are grouped. Otherwise texts meet their labels in a join.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label).distinct()
    rows = docs.where((F.length("text") > 0) & F.col("doc_id").isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.select("doc_id", "text", *columns)
    again = cut(rows.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"))
    if not again.isEmpty():
        first = F.min(F.struct("text", *columns)).alias("_row")
        repeated = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("doc_id", "_row.*")
        rows = rows.join(again, "doc_id", "left_anti").unionByName(repeated)
    if not all(isinstance(x.schema["doc_id"].dataType, (T.LongType, T.IntegerType)) for x in (rows, marked)):
        return rows.join(marked, "doc_id")
    bucket, place = F.shiftright(F.col("doc_id").cast("long"), BITS), F.col("doc_id").cast("long").bitwiseAND((1 << BITS) - 1)
    if marked.select(label, bucket).distinct().limit(BITMAPS + 1).count() > BITMAPS:
        return rows.join(marked, "doc_id")
    bits = marked.groupBy(label, bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    named = F.expr("shiftright(_byte, _bit) & 1") == 1
    met = rows.withColumn("_id_bucket", bucket).join(F.broadcast(bits), F.col("_id_bucket") == F.col("_bucket"))
    met = met.withColumns({"_byte": byte, "_bit": place.bitwiseAND(7).cast("int")}).where(named)
    return met.select("doc_id", "text", *columns, label)
