"""Document fingerprints by consistent weighted sampling (operator 4), with DataFrame functions only.

Terms are lower-cased words, weighted by their count in the text. For each of SAMPLES draws and each term, a hash of both
gives r and c, gamma distributed with shape two, and b, uniform; t = floor(ln(weight) / r + b), and the term with the
least ln(c) - r (t - b + 1) is drawn, together with its t. Two texts draw the same pair with the probability of their
generalised Jaccard similarity, the sum of least over the sum of greatest weights. A fingerprint holds four hexadecimal
digits of each draw; the likeness of two is the share of equal draws.

``edited`` compares each text with itself after an edit and with the document behind it in descending order of ids
(after the last, the first). Only ids, hashes and lengths are put in order, by ranges; each text then moves to its id, the
first part that its neighbour takes of it to the neighbour's, and there terms are counted and sampled without a
further shuffle.

Null texts are empty; an empty text has an empty fingerprint, like that of another empty text and unlike any other.
Null ids come last; rows with equal ids and different texts are ordered by a hash of the text. Repeated rows are one
document here and get a row of the result each. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

#: Draws made in one pass over a term (as many as generated code takes well), and passes.
UNROLLED, PASSES = 8, 6
SAMPLES = UNROLLED * PASSES
DIGITS = 4
#: Partitions of the sampling stage for each one of the session.
FINER = 8
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
NO_ID = -(1 << 63)
#: Neither text 0 nor 1 alone.
BOTH = 2


def signatures(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signature) from rows (keys, term, weight): term long, weight at least 1; null weights draw nothing."""
    return _written(draws(weighted, keys), keys)


def draws(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pass, m0 ..): minima over the terms, the value in the upper half, the identity of the drawn pair in the lower."""
    bits = (1 << 12) - 1

    def both(h: Column, x: int, y: int) -> Column:
        u = lambda s: F.shiftrightunsigned(h, s).bitwiseAND(F.lit(bits).cast("long")) + 0.5
        return u(x) * u(y) * (1.0 / (bits + 1) ** 2)

    n = range(UNROLLED)
    rows = weighted.select(*keys, "term", F.log("weight").alias("lw"), F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("pass"))
    rows = rows.select("*", *(F.xxhash64("term", "pass", F.lit(k)).alias(f"h{k}") for k in n))
    rows = rows.select(
        *keys, "term", "lw", "pass",
        *((-F.log(both(F.col(f"h{k}"), 0, 12))).alias(f"r{k}") for k in n),
        *((-F.log(both(F.col(f"h{k}"), 24, 36))).alias(f"c{k}") for k in n),
        *((F.shiftrightunsigned(F.col(f"h{k}"), 48).cast("double") * 2.0**-16).alias(f"b{k}") for k in n),
    )
    rows = rows.select("*", *(F.floor(F.col("lw") / F.col(f"r{k}") + F.col(f"b{k}")).alias(f"t{k}") for k in n))

    def drawn(k: int) -> Column:
        value = F.log(f"c{k}") - F.col(f"r{k}") * (F.col(f"t{k}") - F.col(f"b{k}") + 1)
        return F.shiftleft((value * F.lit(2.0**20)).cast("long"), 32).bitwiseOR(F.xxhash64("term", f"t{k}").bitwiseAND(F.lit(0xFFFFFFFF)))

    return rows.groupBy(*keys, "pass").agg(*(F.min(drawn(k)).alias(f"m{k}") for k in n))


def _written(least: DataFrame, keys: list[str]) -> DataFrame:
    digits = [F.lpad(F.hex(F.col(f"m{k}").bitwiseAND(F.lit((1 << 4 * DIGITS) - 1).cast("long"))), DIGITS, "0") for k in range(UNROLLED)]
    parts = least.select(*keys, "pass", F.lower(F.concat(*digits)).alias("part"))
    whole = parts.groupBy(*keys).agg(*(F.max(F.when(F.col("pass") == i, F.col("part"))).alias(f"p{i}") for i in range(PASSES)))
    return whole.select(*keys, F.concat(*(f"p{i}" for i in range(PASSES))).alias("signature"))


def paired_signatures(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """(keys, which, signature) of the two texts of each key, ``which`` 0 and 1.

    A term that both texts hold equally often draws once, as BOTH, and its draws count for either.
    """
    split = texts.select(*keys, "which", F.explode(F.split(F.lower(column), SPACE)).alias("word"))
    term = F.when(F.col("word") != "", F.xxhash64("word"))
    counts = split.groupBy(*keys, term.alias("term")).agg(*(F.count_if(F.col("which") == i).alias(f"n{i}") for i in (0, 1)))
    # blank pieces have no weight and keep the row of their key
    equal = F.col("term").isNull() | (F.col("n0") == F.col("n1"))
    weights = F.array(
        F.struct(F.when(equal, BOTH).otherwise(0).alias("which"), F.when(F.col("term").isNotNull(), F.col("n0")).alias("weight")),
        F.struct(F.lit(1).alias("which"), F.when(equal, 0).otherwise(F.col("n1")).alias("weight")),
    )
    weighted = counts.select(*keys, "term", F.inline(weights)).where("weight is null or weight > 0")
    least = draws(weighted, [*keys, "which"])
    each = least.withColumn("which", F.explode(F.when(F.col("which") == BOTH, F.array(F.lit(0), F.lit(1))).otherwise(F.array("which"))))
    keys = [*keys, "which"]
    return _written(each.groupBy(*keys, "pass").agg(*(F.min(f"m{k}").alias(f"m{k}") for k in range(UNROLLED))), keys)


def likeness(a: str, b: str) -> Column:
    """Share of equal draws; 1 for two empty fingerprints."""
    same = "+".join(f"int(substr({a}, {i * DIGITS + 1}, {DIGITS}) = substr({b}, {i * DIGITS + 1}, {DIGITS}))" for i in range(SAMPLES))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(F.expr(f"({same}) / double({SAMPLES})"))


def successors(nodes: DataFrame, parts: int) -> DataFrame:
    """(id0, h, nid, nh): each node and the one behind it in descending order, the first behind the last.

    Neighbours within a range come from a window over that range; between ranges, from the first node of each.
    """
    by_range = nodes.repartitionByRange(parts, F.desc("id0"), F.desc("h")).select("id0", "h", F.spark_partition_id().alias("range"))
    ordered = cut(by_range)
    node = F.struct("id0", "h")
    heads = ordered.groupBy("range").agg(F.max(node).alias("head"))  # a row for each range
    behind = F.lead("head").over(Window.orderBy("range"))
    first = F.max("head").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("range", F.coalesce(behind, first).alias("other"))
    lead = F.lead(node).over(Window.partitionBy("range").orderBy(F.desc("id0"), F.desc("h")))
    rows = ordered.withColumn("next", lead).join(F.broadcast(heads), "range")
    return rows.select("id0", "h", F.coalesce("next", "other").alias("n")).select("id0", "h", F.col("n.id0").alias("nid"), F.col("n.h").alias("nh"))


def edited(df: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    parts = FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(df[column], F.lit(""))
    rows = df.select(F.coalesce(df[id_column].cast("long"), F.lit(NO_ID)).alias("id0"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = ["id0", "h"]
    chain = cut(successors(rows.select(*keys).distinct(), parts))
    texts = rows.repartition(parts, *keys).groupBy(*keys).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    # each text learns how much the document before it takes, and only that much moves on
    sizes = rows.select(*keys, half.alias("takes")).distinct()
    takers = chain.join(sizes, keys).select(F.col("nid").alias("id0"), F.col("nh").alias("h"), F.col("id0").alias("to_id"), F.col("h").alias("to_h"), "takes")
    given = texts.join(takers, keys).select("to_id", "to_h", F.left("text", F.col("takes")).alias("other")).repartition(parts, "to_id", "to_h")
    pairs = texts.join(given.withColumnsRenamed({"to_id": "id0", "to_h": "h"}), keys)
    pairs = pairs.withColumn("n_chars", n.cast("long")).withColumn("changed", F.concat(F.left("text", n - half), "other"))
    # all that the result says of a pair goes along with its terms, so the texts are read once
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(c).alias("text")) for i, c in enumerate(("text", "changed"))))).alias("x")
    info = [*keys, "copies", "n_chars", "sha"]
    pairs = pairs.withColumn("sha", F.unhex(F.sha2("changed", 256))).select(*info, both).select(*info, "x.which", "x.text")
    of = [F.coalesce(F.max(F.when(F.col("which") == i, F.col("signature"))), F.lit("")) for i in (0, 1)]
    found = paired_signatures(pairs, info).groupBy(*info).agg(of[0].alias("fingerprint"), of[1].alias("edited_fingerprint"))
    found = cut(found)
    behind = chain.join(found.select(F.col("id0").alias("nid"), F.col("h").alias("nh"), F.col("fingerprint").alias("next_fingerprint")), ["nid", "nh"])
    out = found.join(behind.select(*keys, "next_fingerprint"), keys)
    out = out.withColumn("near_edited", likeness("fingerprint", "edited_fingerprint")).withColumn("near_next", likeness("fingerprint", "next_fingerprint"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    name = F.when(F.col("id0") != NO_ID, F.col("id0")).alias(id_column)
    return out.select(name, "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
