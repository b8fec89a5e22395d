"""A corpus pipeline of five stages: quality classifier, line dedup, near-dedup, decontamination, tokens.

Each stage is a function of (spark, docs, sf_dir) and takes what the one before it kept. All stages
but the last return the columns of documents, with n_chars brought up to date where the text changed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.bpe import bpe_round_trip
from orrery.llm.common import discard, documents, scratch, tuned, written
from orrery.llm.decontaminate import remove_contamination
from orrery.llm.lines import drop_recurring_lines
from orrery.llm.quality import keep_good
from orrery.llm.setsketch import keep_representatives


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go."""
    tuned(spark)
    return keep_good(docs)


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, from all documents; every document stays."""
    return _counted(drop_recurring_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id."""
    tuned(spark)
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows are cut from the texts."""
    tuned(spark)
    return _counted(remove_contamination(docs, documents(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    tuned(spark)
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again for the next.

    What a stage has kept for itself goes once its rows are written, and these go once the next stage's are.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        table, last = "stage-" + name.replace(" ", "-"), docs
        with scratch(table):
            docs = written(stage(spark, docs, sf_dir), table)
        if hasattr(last, "kept_at"):
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and the tokenizer are beyond SQL; the tests hold the pipeline against a plain version of each stage.
ORACLE_SQL = None
