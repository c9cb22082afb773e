"""A training-data pipeline: toxic and poor documents go, near-duplicates are reduced, benchmark items go, sources are mixed.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor left them, and returns the columns of documents.
An empty table gives an empty one; extra columns, whatever their names, pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import decontaminate, mixing, near_dup, quality, toxicity
from vantage.llm.shared import bounded_batches, clear_written, numbered, written, written_so_far


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the toxicity threshold; null and empty texts, and all texts where no labels teach, stay; repeated rows go or stay together."""
    bounded_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(model)(F.col("text")) < toxicity.THRESHOLD)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose chance of the upper grade reaches the selection threshold; texts without words go; repeated rows go or stay together."""
    bounded_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.tail_probability(model)(F.col("text")) >= quality.SELECT_AT)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8): that of the smallest id, rows without id coming last.

    Rows are told apart by a number, so a row that repeats an id goes or stays by its own text; rows without words stay.
    """
    bounded_batches(spark)
    keyed, row = numbered(docs)
    before = written_so_far()
    spare = written(near_dup.near_duplicates(keyed, k=5, percent=80, row_col=row).where("NOT first").select(F.col("row_key").alias(row)))
    clear_written(spark, before, spare)
    return keyed.join(spare, row, "left_anti").drop(row)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, nor an edited copy of one, however long they are; texts without words, and all if there are no items, stay."""
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it, nulls and repeated rows like others."""
    return mixing.emit(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_dedup", one_of_each), ("decontamination", drop_benchmark), ("mixing", mix_sources)]

#: trained models cannot be expressed in SQL; tests/llm compares the pipeline with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written_so_far()
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        clear_written(spark, before, docs)
    return docs
