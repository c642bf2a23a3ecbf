"""Documents to training tokens: quality, toxicity, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and returns a DataFrame; all but
the last return the columns of documents. Labels, where a stage learns, are those of the documents it is given.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shakegrid.llm import byte_bpe, kneser_ney, mixing, simhash, toxicity  # noqa: E402
from shakegrid.llm.common import table  # noqa: E402
from shakegrid.session import cut  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_multi_50k.tiktoken"
#: A document goes if its toxicity is at least this.
TOXIC = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is at most the threshold of their language."""
    return kneser_ney.judge(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.representatives(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: part by part, and in each part from the first row on.

    Readers pack parts as they like, so the order may not outlive a reread. Positions follow from the rows alone, and
    ``encoded`` returns them.
    """
    return mixing.in_order(mixing.mix(docs.select(*COLUMNS)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with mix_position, their place in the mixture, ids, n_tokens, and whether the bytes of the ids are those of the text."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    placed = mixing.mix(docs.select(*COLUMNS)).drop("mix_block", "mix_slot")
    tripped = byte_bpe.round_trip(placed, ranks, pattern)
    return tripped.select(*COLUMNS, "mix_position", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "round_trip")


STAGES = [("quality", quality), ("toxicity", toxic), ("near_copies", near_copies), ("mixing", mixed), ("encoding", encoded)]
#: Scores, groups and ids cannot be said in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
