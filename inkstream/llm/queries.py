"""The registered queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import sql
from inkstream.llm.debruijn import dedup
from inkstream.llm.langid import identify
from inkstream.llm.mixing import mix
from inkstream.llm.licenses import scan as scan_licenses
from inkstream.llm.quality import judge
from inkstream.llm.secrets import scan
from inkstream.llm.sstable import tokenize
from inkstream.llm.superminhash import near_duplicates
from inkstream.llm.templates import leaks
from inkstream.llm.toxicity import score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and divergence verdicts of all documents; distances to nine places."""
    rounded = {name: F.round(name, 9) for name in ("class_distance", "word_distance")}
    return judge(table(spark, sf_dir, "documents")).withColumns(rounded)


def op2_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards of all documents, written and read back."""
    return tokenize(table(spark, sf_dir, "documents"))


def op4_sliding_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def op5_piece_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return identify(table(spark, sf_dir, "documents"))


def op6_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix(table(spark, sf_dir, "documents"))


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items, by template windows."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents; a document lies in source/lang, as file doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), path.alias("path"), "text")
    return scan_licenses(files).withColumnRenamed("key", "doc_id")


def op9_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of all documents after removing repeated 20-word windows."""
    return dedup(table(spark, sf_dir, "documents"))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 4-word shingles at 0.8."""
    groups = near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_distribution_divergence": op1_distribution_divergence,
    "op2_subword_softmax": op2_subword_softmax,
    "op3_sstable": op3_sstable,
    "op4_sliding_entropy": op4_sliding_entropy,
    "op5_piece_unigrams": op5_piece_unigrams,
    "op6_min_cost_flow": op6_min_cost_flow,
    "op7_template_decontamination": op7_template_decontamination,
    "op8_license_inheritance": op8_license_inheritance,
    "op9_debruijn": op9_debruijn,
    "op10_superminhash": op10_superminhash,
}

#: The others learn or tokenise; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_distribution_divergence": sql.divergence(),
    "op4_sliding_entropy": sql.secret_spans(),
    "op6_min_cost_flow": sql.mixture(),
    "op8_license_inheritance": sql.license_scan(),
    "op9_debruijn": sql.substrings(),
    "op10_superminhash": sql.near_groups(),
}
