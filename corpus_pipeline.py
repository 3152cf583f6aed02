"""A corpus pipeline of five stages: quality rules, line dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; ``run`` writes each result to
the shared folder and reads it again. All stages but the last return the columns of the documents they were given, with
whatever names and values. Documents are identified by doc_id: rows that repeat one stay or go together. Null, empty and
short texts fail the quality rules and go there; rows without a doc_id lose no lines and no passages and are dropped by the
quality rules only; very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenbase.llm import line_dedup, packing, quality, simhash, substring_dedup
from lumenbase.llm.common import prepared, removed, scratch, temporary, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the rules are a projection, so nothing is shuffled."""
    prepared(spark)
    return quality.kept_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that another document keeps."""
    prepared(spark)
    return line_dedup.without_shared_lines(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    prepared(spark)
    return simhash.without_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; a text that loses nothing stays as it is."""
    prepared(spark)
    return substring_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    import public_tokenizers

    prepared(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: Tokenizing cannot be said in SQL; tests/llm/test_tables.py holds the result against plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's own intermediate tables and its input go once its result is written; those of the last stay, as its
    result is read from them."""
    prepared(spark)
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        with temporary(spark):
            docs = written(stage(spark, docs, sf_dir), path=path)
        if old:
            removed(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
