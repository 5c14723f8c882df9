"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token shards.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
what the next one gets as docs, after it was written as Parquet and read again.  All
but the last return the columns of ``documents``.  Every stage sees all that the one
before it kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import _stash
from inkstream.llm._stash import Stash
from inkstream.llm.mixing import mix
from inkstream.llm.quality import keep
from inkstream.llm.sstable import tokenize
from inkstream.llm.superminhash import near_duplicates
from inkstream.llm.templates import leaks


def _named(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """``docs`` with ids above all others where they are null, and the largest given id; None if no id is null.

    The ids are written, so every use sees the same; they hold for one stage.
    """
    top, bare = docs.agg(F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if not bare:
        return docs, None
    top = -1 if top is None else top
    key = F.lit(top + 1).cast("long") + F.monotonically_increasing_id()
    given = Stash(docs.sparkSession, "ids").put(docs.filter("doc_id is null").withColumn("doc_id", key), "given")
    return docs.filter("doc_id is not null").unionByName(given), top


def _unnamed(docs: DataFrame, top: int | None) -> DataFrame:
    """``docs`` with the ids that ``_named`` gave null again."""
    return docs if top is None else docs.withColumn("doc_id", F.when(F.col("doc_id") <= top, F.col("doc_id")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and short texts go, ids do not matter."""
    return keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles at 0.8.

    Equal rows under one id are one document; every row without an id is one of its own
    and gives way to a near-duplicate with an id.
    """
    named, top = _named(docs)
    kept = near_duplicates(named, width=5, percent=80).filter("kept").select("doc_id").distinct()
    return _unnamed(named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]), top).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; all rows of an id that has one go."""
    named, top = _named(docs)
    found = leaks(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return _unnamed(named.join(found, "doc_id", "left_anti"), top).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one taken in part counts as taken.

    Rows without an id are mixed like others; which of them it takes can differ between runs.
    """
    named, top = _named(docs)
    taken = mix(named).filter("taken > 0")
    times = taken.groupBy("doc_id").agg(F.max(F.ceil(F.col("taken") / F.col("size")).cast("int")).alias("times"))
    repeated = named.join(times, "doc_id").withColumn("time", F.explode(F.sequence(F.lit(1), "times")))
    return _unnamed(repeated, top).select(docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, written and read back; rows without an id come first."""
    return tokenize(docs)


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mixture),
    ("token shards", shards),
]

#: The stages after the first are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    stash = Stash(spark, "pipeline")
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with _stash.stage():
            docs = stash.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            stash.drop(written)
        written = docs
        stash.release()
    return STAGES[-1][1](spark, docs, sf_dir)
