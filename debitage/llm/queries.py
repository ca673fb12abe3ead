"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from debitage.iterate import shared_folder
from debitage.llm import ann, balltree, binout, decontam, licenses, packing, quality, resampling, sharding, simhash, toxicity, urls, wrapper


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where this machine keeps a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every hundredth vector; see ann.nearest for odd rows."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; see toxicity.toxicity for odd rows."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page; see wrapper.extract for odd rows."""
    return wrapper.extract(_table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; see packing.pack for odd rows."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items inside it; see decontam.contained_items for odd rows."""
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and a score of every document; see licenses.scan for odd rows."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; see sharding.shard for odd rows."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence with its slot, and the shard file and byte where it was written; see binout.ordered and binout.materialised for odd rows."""
    folder = shared_folder(spark)
    return binout.materialised(binout.ordered(_table(spark, sf_dir, "documents"), tokenizer_path(), folder), f"{folder}/shards-{uuid.uuid4().hex}")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see simhash.near_duplicates for odd rows."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page; see urls.judge for odd rows."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark; see resampling.resample for odd rows."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; see balltree.ranked for odd rows."""
    return balltree.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a verdict on the quality of every document; see quality.judge for odd rows."""
    return quality.judge(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_toxicity": op2_toxicity,
    "op3_html_extraction": op3_html_extraction,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_sharding": op7_sharding,
    "op8_token_shards": op8_token_shards,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_ranked_search": op12_ranked_search,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op5_benchmark_decontamination": decontam.oracle(),
    "op6_license_scan": licenses.oracle(),
    "op11_importance_resampling": resampling.oracle(),
    "op12_ranked_search": balltree.oracle(),
    "op13_quality_rules": quality.oracle(),
}
