"""The corpus pipeline: four stages over ``documents``, each one an operator of debitage.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a
stage returns as Parquet in the shared checkpoint folder and reads it again as the
next stage's docs, so a lost executor never costs an earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from debitage.iterate import shared_folder
from debitage.llm.decontam import drop_contaminated
from debitage.llm.nearcopies import drop_near_copies
from debitage.llm.packing import pack
from debitage.llm.queries import tokenizer_path
from debitage.llm.toxicity import drop_toxic

#: Trained models and tokenizers can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the rest, packed into sequences."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("best_fit_packing", best_fit)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
