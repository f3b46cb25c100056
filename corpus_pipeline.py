"""The corpus pipeline: five of the operators in a row, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm.common import documents, written
from sitelens.llm.line_dedup import without_repeated_lines
from sitelens.llm.mixing import mixed
from sitelens.llm.near_dedup import keep_one_of_each_group
from sitelens.llm.packing import packed
from sitelens.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, but for one word, go; documents stay, if with less text."""
    return without_repeated_lines(docs).drop("n_lines", "n_dropped")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words a shingle, similarity 0.8)."""
    return keep_one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target weights of their sources and dealt out anew."""
    return mixed(docs).drop("copy_no", "mix_key")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Tokenizers and trained models are beyond SQL. run() is held against nothing; a test runs stages 2 to 4 and looks at their columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = written(docs, name)
    return docs
