"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HEAVY of the rows is heavy; there are fewer than HEAVY of them.
HEAVY = 2000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: int = HEAVY) -> DataFrame:
    """Inner join with ``right``, which has one narrow row a key and in ``times`` how many rows of ``left`` have it.

    Heavy keys are fewer than ``heavy`` by their definition, so their rows of ``right`` are
    broadcast and those of ``left`` stay where they lie; the others meet by a shuffle in which no
    key has more than 1/``heavy`` of the rows.  Both tables should be written ones: they are
    read twice.
    """
    total = right.agg(F.sum("times")).first()[0] or 0
    right = right.toDF(*right.columns)  # the two may share a source
    large = right.filter(F.col("times") * heavy > total)
    hot = left.join(F.broadcast(large), keys)
    cold = left.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(right.filter(F.col("times") * heavy <= total), keys)
    return hot.unionByName(cold)
