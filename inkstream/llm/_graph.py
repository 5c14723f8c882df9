"""Connected components by partitioned union-find and alternating stars.

Each task first runs union-find over its own edges, so a partition sends on at
most one edge a node.  What joins partitions is settled by the alternating
large-star / small-star steps (Kiveris et al., SoCC 2014): equi-joins and
partial-aggregated minimums over edges, nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm._stash import Stash

SCHEMA = "v long, u long"
#: Edges a task's union-find holds at once; more go through as several forests.
FOREST_EDGES = 2_000_000


def _forest(v: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
    nodes, flat = np.unique(np.concatenate([v, u]), return_inverse=True)
    a, b = flat[: len(v)], flat[len(v) :]
    parent = np.arange(len(nodes))
    # vectorised union-find: hook larger roots under smaller ones, then halve paths
    while len(a):
        ra, rb = parent[a], parent[b]
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        live = high != low
        if not live.any():
            break
        a, b, high, low = a[live], b[live], high[live], low[live]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    keep = parent != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[parent[keep]])], names=["v", "u"])


def _forests(batches):
    vs, us, held = [], [], 0
    for batch in batches:
        vs.append(batch.column(0).to_numpy(zero_copy_only=False))
        us.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= FOREST_EDGES:
            yield _forest(np.concatenate(vs), np.concatenate(us))
            vs, us, held = [], [], 0
    if held:
        yield _forest(np.concatenate(vs), np.concatenate(us))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (v > u).  Links each node's neighbours to the least of them and itself."""
    if small:
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        out = edges.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        out = out.unionByName(least.select("v", F.col("m").alias("u")))
    else:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # only neighbours above the node move
        out = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).join(least.withColumnRenamed("v", "n"), "n")
        out = out.select(F.col("w").alias("v"), F.col("m").alias("u"))
    return out.filter("v <> u").distinct()


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(v, u): each node that is not its component's least node, with that node.

    ``edges`` has long columns v and u in either order, without nulls; self-loops
    and repeats are harmless.  Nodes that are absent are components of their own.
    """
    edges = edges.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).filter("v <> u")
    now = stash.put(edges.mapInArrow(_forests, SCHEMA), "forest")
    before = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0x7FFFFFFFF))).alias("s")).first()
        if not row.n or (row.n, row.s) == before:
            return now
        before = (row.n, row.s)
        stepped = stash.put(_star(_star(now, small=False), small=True), "stars")
        stash.drop(now)
        now = stepped
