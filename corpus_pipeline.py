"""A training corpus from raw documents, as stages that each call one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.llm.common import written
from assaymill.llm.decontaminate import drop_leaks
from assaymill.llm.minhash import keep_one
from assaymill.llm.mixing import mix
from assaymill.llm.suffix import drop_repeats
from assaymill.llm.toxicity import grade_texts, train


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely than not of a severity above 0 go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade_texts(docs, model).where(~F.col("toxic")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8."""
    return keep_one(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 240 bytes or more (about 40 words) that occur elsewhere are cut out."""
    return drop_repeats(docs, length=240)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to shares by the root of their size, and all rows shuffled."""
    return mix(docs, power=0.5, seed=17)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", one_of_each),
    ("suffix_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

# The toxicity stage fits a model, which SQL cannot say; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages, one after the other, to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
