"""Substring dedup over the de Bruijn graph of token k-mers.

Nodes are sequences of K-1 words, a window of K words is the edge from its first K-1
words to its last.  Only nodes that are visited twice matter, and they are few:

1. exact copies collapse by a 128-bit digest of their word sequence; a copy of an
   earlier document is repeated as a whole;
2. in each node the least-hashed run of ``ANCHOR`` words is its anchor.  Equal nodes have
   equal anchors, so a node whose anchor occurs once is visited once.  Anchors are about
   one word in eight, and only they are counted;
3. visits of nodes with a repeated anchor carry the words before and after.  Minimums and
   maximums of these, partial-aggregated, tell each node's in- and out-degree.  A node
   visited twice whose degrees are not both one is a junction, and so is one at an end
   of a text;
4. visits are joined with the junctions.  Between two junctions a text follows a
   nonbranching path, which is thereby one row, named by its first edge: all texts with
   that edge follow the whole path;
5. joining paths with the first of each gives every repeated one its source coordinates;
   the source's words are read again, and a span counts only if a 128-bit digest of its
   own words, which are not those the node was told by, equals the source's;
6. the words that spans cover are removed.

Keys that may hold any share of the rows (an anchor, a junction or a path in every
document) are joined by ``spread_join``.  Results of each step are written, so no step
depends on another's shuffle files.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstream.llm import _text
from inkstream.llm._skew import spread_join
from inkstream.llm._stash import Stash

K = 20
ANCHOR = 6
_SALT = np.uint64(0x5851F42D4C957F2D)
_CHECKS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))
_SPANS = "array<struct<start:bigint,words:bigint,e1:bigint,e2:bigint>>"


def anchors(words: np.ndarray, own: np.ndarray, size: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of ``size`` words that lies in one text: its first word, its anchor's place and the anchor's hash."""
    n = len(words) - size + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    anchor = min(anchor, size)
    h = _text.window_hashes(words, anchor)
    ranks = _text.mix(h ^ _SALT)
    best = np.arange(n)
    for i in range(1, size - anchor + 1):  # the leftmost least one
        best = np.where(ranks[i : n + i] < ranks[best], np.arange(i, n + i), best)
    at = np.flatnonzero(own[:n] == own[size - 1 :])
    return at, best[at], h[best[at]]


def digests(words: np.ndarray, begin: np.ndarray, end: np.ndarray, salts=(np.uint64(0), _SALT)) -> list[np.ndarray]:
    """A 64-bit digest of the words from ``begin`` to ``end`` for each salt."""
    out = []
    for salt in salts:
        w = _text.mix(words ^ salt) if salt else words
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * _text.powers(_text._WORD_BASE, len(w)) if len(w) else w, out=sums[1:])
        out.append(_text.mix((sums[end] - sums[begin]) * _text.powers(_text._WORD_INV, len(w) + 1)[begin] + (end - begin).astype(np.uint64)).view(np.int64))
    return out


def _first_pass(k: int, anchor: int):
    def run(batches):
        for batch, data, offs in _text.chunks(batches):
            starts, ends, first = _text.word_bounds(data, offs)
            words, own = _text.word_hashes(data, starts, ends), _text.owner(first)
            d1, d2 = digests(words, first[:-1], first[1:])
            at, place, h = anchors(words, own, k - 1, anchor)
            new = np.ones(len(at), bool)
            new[1:] = place[1:] != place[:-1]
            value, whose = h[new], own[place[new]]
            bounds = np.searchsorted(whose, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first)), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.view(np.int64)))],
                names=["doc_id", "n_words", "d1", "d2", "anchors"],
            )

    return run


def _visits(k: int, anchor: int):
    """(doc_id, text, places of repeated anchors in its anchor list) to visits of nodes.

    ``before`` and ``after`` are 32 bits of the words beside the node, 0 at a text's end.
    """
    size = k - 1

    def run(batches):
        for batch, data, offs in _text.chunks(batches):
            starts, ends, first = _text.word_bounds(data, offs)
            words, own = _text.word_hashes(data, starts, ends), _text.owner(first)
            at, place, _ = anchors(words, own, size, anchor)
            new = np.ones(len(at), bool)
            new[1:] = place[1:] != place[:-1]
            nth = np.cumsum(new) - 1  # of the chunk's anchors
            base = np.searchsorted(own[place[new]], np.arange(batch.num_rows + 1))
            lists = batch.column(batch.schema.get_field_index("repeated"))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            wanted = np.repeat(base[:-1], np.diff(lists.offsets.to_numpy())) + flat
            repeated = np.zeros(base[-1] + 1, bool)
            repeated[wanted[wanted < base[-1]]] = True
            at = at[repeated[nth]] if len(at) else at
            # a word's tag, between tags of 0 for what lies outside its text
            tag = np.zeros(len(words) + 2, np.uint32)
            tag[1:-1] = np.maximum(_text.mix(words ^ _SALT) >> np.uint64(32), np.uint64(1)).astype(np.uint32)
            doc = own[at]
            before = np.where(at > first[doc], tag[at], 0).astype(np.uint32)
            after = np.where(at + size < first[doc + 1], tag[at + size + 1], 0).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_text.window_hashes(words, size)[at].view(np.int64)),
                    pa.array(before.view(np.int32)),
                    pa.array(after.view(np.int32)),
                    pa.array(batch.column(0).to_numpy(zero_copy_only=False)[doc], pa.int64()),
                    pa.array((at - first[doc]).astype(np.int32)),
                ],
                names=["node", "before", "after", "doc_id", "at"],
            )

    return run


def _read_sources(k: int):
    """(doc_id, text, paths of (at, edges)) to a digest of each path's words."""

    def run(batches):
        for batch, data, offs in _text.chunks(batches):
            starts, ends, first = _text.word_bounds(data, offs)
            words = _text.word_hashes(data, starts, ends)
            lists = batch.column(batch.schema.get_field_index("paths"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at, edges = (lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            begin = np.minimum(first[row] + at, first[row + 1])
            e1, e2 = digests(words, begin, np.minimum(begin + edges + k - 1, first[row + 1]), _CHECKS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(e1), pa.array(e2)], names=["source", "source_at", "e1", "e2"])

    return run


def _remove(k: int):
    """(doc_id, text, copy, spans) to counts and the digest of the words left."""

    def run(batches):
        for batch, data, offs in _text.chunks(batches):
            starts, ends, first = _text.word_bounds(data, offs)
            counts = np.diff(first)
            step = np.zeros(len(starts) + 1, np.int64)
            lists = batch.column(batch.schema.get_field_index("spans"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start, size, e1, e2 = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            begin = np.minimum(first[row] + start, first[row + 1])
            end = np.minimum(begin + size, first[row + 1])
            own1, own2 = digests(_text.word_hashes(data, starts, ends), begin, end, _CHECKS)
            same = (own1 == e1) & (own2 == e2)
            np.add.at(step, begin[same], 1)
            np.add.at(step, end[same], -1)
            gone = np.cumsum(step[:-1]) > 0
            copy = batch.column(batch.schema.get_field_index("copy")).to_numpy(zero_copy_only=False).astype(bool) & (counts >= k)
            gone |= np.repeat(copy, counts)
            kept = ~gone
            own = _text.owner(first)
            # bytes of kept words, and the separator before each but a text's first one
            edge = np.zeros(len(data) + 1, np.int8)
            s, e = starts[kept], ends[kept]
            later = np.zeros(len(s), bool)
            later[1:] = own[kept][1:] == own[kept][:-1]
            np.add.at(edge, s - later, 1)
            np.add.at(edge, e, -1)
            stay = np.cumsum(edge[:-1], dtype=np.int8) > 0
            out = data.copy()
            out[(s - later)[later]] = 0x20
            upto = np.concatenate([[0], np.cumsum(stay)])[offs]
            left = out[stay].tobytes()
            removed = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts),
                    pa.array(removed[first[1:]] - removed[first[:-1]]),
                    pa.array([hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(upto[:-1], upto[1:])]),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def _one_row_each(docs: DataFrame, read: DataFrame, stash: Stash) -> DataFrame:
    """``docs`` with one row an id, the least text where there are several."""
    several = read.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    several = stash.put(several, "several")
    if several.isEmpty():
        return docs
    least = docs.join(several, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(several, "doc_id", "left_anti").unionByName(least)


def repeated_spans(docs: DataFrame, k: int = K, anchor: int = ANCHOR, stash: Stash | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, spans): ids of exact copies of an earlier document, and repeated spans of the others.

    ``copies`` has doc_id and source; ``spans`` has doc_id, start, words, source and
    source_start, in words, with the digests e1 and e2 of the source's words.  Documents
    are ordered by doc_id; null ids take no part.
    """
    spark = docs.sparkSession
    stash = stash or Stash(spark, "debruijn")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    read = stash.put(docs.mapInArrow(_first_pass(k, anchor), "doc_id long, n_words long, d1 long, d2 long, anchors array<long>"), "read")
    docs = _one_row_each(docs, read, stash)
    long_ = read.filter(F.col("n_words") >= k)
    firsts = stash.put(long_.groupBy("n_words", "d1", "d2").agg(F.min("doc_id").alias("source"), F.count("*").alias("times")), "firsts")
    copies = spread_join(long_.select("doc_id", "n_words", "d1", "d2"), firsts, ["n_words", "d1", "d2"]).filter("doc_id <> source").select("doc_id", "source").distinct()
    copies = stash.put(copies, "copies")
    single = stash.put(long_.withColumn("source", F.col("doc_id")).join(firsts.drop("times"), ["n_words", "d1", "d2", "source"], "left_semi").select("doc_id", "anchors"), "single")
    stash.drop(read, firsts)
    found = single.select("doc_id", F.posexplode("anchors").alias("nth", "a"))
    twice = stash.put(found.groupBy("a").agg(F.count("*").alias("times")).filter("times > 1"), "twice")
    wanted = stash.put(spread_join(found, twice, ["a"]).groupBy("doc_id").agg(F.collect_set("nth").alias("repeated")), "wanted")
    stash.drop(single, twice)
    stash.release()
    visits = stash.put(docs.join(wanted, "doc_id").mapInArrow(_visits(k, anchor), "node long, before int, after int, doc_id long, at int"), "visits")
    stash.drop(wanted)
    stash.release()
    degree = lambda side: F.when(F.min(side) != F.max(side), 2).when(F.max(side) == 0, 0).otherwise(1)  # noqa: E731  2: more than one
    nodes = visits.groupBy("node").agg(F.count("*").alias("times"), degree("before").alias("into"), degree("after").alias("out"))
    junctions = stash.put(nodes.filter("times > 1 and (into <> 1 or out <> 1)").select("node", "times"), "junctions")
    stash.release()
    stops = stash.put(spread_join(visits.select("node", "after", "doc_id", "at"), junctions, ["node"]).drop("times"), "stops")
    stash.drop(visits, junctions)
    stash.release()
    following = F.lead("at").over(Window.partitionBy("doc_id").orderBy("at"))
    paths = stash.put(stops.withColumn("edges", following - F.col("at")).filter("edges is not null"), "paths")
    stash.drop(stops)
    firsts = paths.groupBy("node", "after").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "at", "edges")).alias("s")).filter("times > 1")
    firsts = stash.put(firsts.select("node", "after", "times", F.col("s.doc_id").alias("source"), F.col("s.at").alias("source_at"), F.col("s.edges").alias("source_edges")), "first-paths")
    told = firsts.groupBy(F.col("source").alias("doc_id")).agg(F.collect_list(F.struct("source_at", "source_edges")).alias("paths"))
    read = docs.join(told, "doc_id").mapInArrow(_read_sources(k), "source long, source_at int, e1 long, e2 long")
    sources = stash.put(firsts.join(read, ["source", "source_at"]), "sources")
    stash.drop(firsts)
    stash.release()
    spans = spread_join(paths, sources, ["node", "after"]).filter(((F.col("doc_id") != F.col("source")) | (F.col("at") != F.col("source_at"))) & (F.col("edges") == F.col("source_edges")))
    spans = spans.select("doc_id", F.col("at").cast("long").alias("start"), (F.col("edges") + (k - 1)).cast("long").alias("words"), "source", F.col("source_at").cast("long").alias("source_start"), "e1", "e2")
    spans = stash.put(spans, "spans")
    stash.drop(paths, sources)
    stash.release()
    return copies, spans


def dedup(docs: DataFrame, k: int = K, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id long, text).

    A word goes if a window of ``k`` words over it has a word sequence that also starts
    earlier: in a smaller doc_id, or before it in the same document.  Windows are judged
    on the input, whole texts of any length.  Null and short texts keep all they have; rows
    with a null doc_id have no place in the order and keep theirs.  Equal rows under one
    doc_id are one document, returned for each row; of different texts under one the least
    is compared with others.  Extra columns are ignored; an empty table gives an empty result.
    """
    stash = Stash(docs.sparkSession, "debruijn")
    copies, spans = repeated_spans(docs, k, anchor, stash)
    masks = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "words", "e1", "e2")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(masks, "doc_id", "left").join(copies.select("doc_id", F.lit(True).alias("copy")), "doc_id", "left")
    rows = rows.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    return rows.mapInArrow(_remove(k), "doc_id long, n_words long, n_removed long, kept_sha256 string")
