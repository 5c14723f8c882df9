"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

SuperMinHash (Ertl, 2017) lets each element claim signature positions through a
random permutation: at step j it offers j + r to the j-th position of its
permutation.  The ranks are correlated, so estimates vary less than with
independent hashes, and once every position holds a value below j + 1 no later
step can improve it: a text of several hundred shingles stops after two or three
steps instead of one per position.

Plan of ``near_duplicates``:

1. one Arrow pass: shingle sets, a 128-bit digest of the set, signature, bands;
2. equal sets collapse to their least id (partial aggregation, no pairs);
3. (band, value) buckets of at least two sets;
4. each bucket's hub (the set that shares most buckets with most others) is compared
   with its members on full sets: a star, never all pairs.  What a member lacks and
   adds against its hub is its delta;
5. two members of a bucket that do not both link to its hub can link only if their
   deltas overlap by a bound that is a sum of one term for each (see ``_bound``).
   A prefix-filtered join over delta elements, rarest first, finds every such pair:
   random edits of one template share hardly any rare element, so a large group of
   near copies stays near linear.  Components meet before their members do, so a group
   behind another's hub is not paired with itself.  Candidates are confirmed on full sets;
6. union-find over confirmed links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm import _text
from inkstream.llm._graph import components
from inkstream.llm._skew import HEAVY, spread_join
from inkstream.llm._stash import Stash

POSITIONS = 128
BANDS = 32
#: Pairs of sets turned into arrays at once.
PAIRS = 256
#: Classes of members by how many delta elements they miss a link to their hub:
#: none to speak of (linked to it, or joined with it), then from 0, 1, 2, 4 ... on.
CLASS_FLOORS = (0, 1, 2, 4, 8, 16, 32, 64)
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)
_FIRST = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SILVER = np.uint64(0xC2B2AE3D27D4EB4F)


def _steps(by: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(by) * n & 0xFFFFFFFFFFFFFFFF)


def superminhash(owner: np.ndarray, elements: np.ndarray, n: int, positions: int = POSITIONS) -> np.ndarray:
    """Signatures (n x positions) of n sets; ``owner[i]`` is the set of distinct element ``elements[i]``."""
    sig = np.full((n, positions), _FAR, dtype=np.uint64)
    flat = sig.reshape(-1)
    row, h = owner.astype(np.int64), elements
    swaps: list[np.ndarray] = []
    for j in range(positions):
        if not len(h):
            break
        draw = _text.mix(h + _steps(_GOLD, 2 * j + 1))
        k = (j + (_text.mix(h ^ _steps(_SILVER, j + 1)) % np.uint64(positions - j)).astype(np.int16)).astype(np.int16)
        at = k.copy()
        for i in range(j - 1, -1, -1):  # what the earlier swaps have put at position k
            was = swaps[i]
            at = np.where(at == was, np.int16(i), np.where(at == i, was, at))
        swaps.append(k)
        np.minimum.at(flat, row * positions + at, (np.uint64(j) << np.uint64(56)) | (draw >> np.uint64(8)))
        open_ = sig.max(axis=1) >= np.uint64((j + 1) << 56) if j + 1 < positions else np.zeros(n, bool)
        live = open_[row]
        if not live.all():
            row, h, swaps = row[live], h[live], [s[live] for s in swaps]
    return sig


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles, ordered by text and hash.  A shorter text is one shingle."""
    starts, ends, first = _text.word_bounds(data, offs)
    words = _text.word_hashes(data, starts, ends, lower=True)
    own = _text.owner(first)
    windows = _text.window_hashes(words, width)
    inside = own[: len(windows)] == own[width - 1 :] if len(windows) else np.zeros(0, bool)
    rows, hashes = [own[: len(windows)][inside]], [windows[inside]]
    counts = np.diff(first)
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            value = np.zeros(len(short), np.uint64)
            for i in range(n):
                value = _text.mix(value + words[first[short] + i] + np.uint64(n))
            hashes.append(value)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _first_pass(width: int, positions: int, bands: int):
    def run(batches):
        for batch, data, offs in _text.chunks(batches):
            n = batch.num_rows
            row, h = shingle_sets(data, offs, width)
            bounds = np.searchsorted(row, np.arange(n + 1))
            sizes = np.diff(bounds)
            sig = superminhash(row, h, n, positions)
            parts = sig.reshape(n, bands, positions // bands)
            value = np.zeros((n, bands), np.uint64)
            for i in range(parts.shape[2]):
                value = _text.mix(value + parts[:, :, i] + np.arange(1, bands + 1, dtype=np.uint64))
            some = sizes > 0
            ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(_sums(_text.mix(h + _GOLD), bounds).view(np.int64)),
                    pa.array(_sums(_text.mix(h ^ _SILVER), bounds).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(value[some].reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    return run


def _set_pass(width: int):
    def run(batches):
        for batch, data, offs in _text.chunks(batches):
            row, h = shingle_sets(data, offs, width)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(_sums(_text.mix(h + _GOLD), bounds).view(np.int64)),
                    pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                ],
                names=["id", "d1", "members"],
            )

    return run


def _stars(percent: int):
    """(hub, id, both sets) to whether they link and what the member lacks and adds."""

    def run(batches):
        for batch in _text.rows(batches, PAIRS):
            linked, lacks, adds, size, deltas = [], [], [], [], []
            for hub, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                c, x = np.frombuffer(hub, np.uint64), np.frombuffer(own, np.uint64)
                delta = np.setxor1d(c, x, assume_unique=True)
                both = (len(c) + len(x) - len(delta)) // 2
                linked.append(100 * both >= percent * (len(c) + len(x) - both))
                lacks.append(len(c) - both)
                adds.append(len(x) - both)
                size.append(len(c))
                deltas.append(delta.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(d) for d in deltas])]).astype(np.int32)
            flat = np.concatenate(deltas) if deltas else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), *(pa.array(n, pa.int64()) for n in (lacks, adds, size)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["hub", "id", "linked", "lacks", "adds", "size", "delta"],
            )

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in _text.rows(batches, PAIRS):
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, positions: int = POSITIONS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_links) for each row of ``docs`` (doc_id long, text).

    Texts link if their sets of ``width``-word shingles (A-Z in lower case) have at
    least ``percent`` hundredths of their union in common; a component is what links
    reach, named by its least id, and ``kept`` marks that id.  ``n_links`` counts the
    confirmed links by which a set's representative was joined; links inside an
    already joined component are not sought.

    Null or wordless texts have no shingles, stay alone and are kept.  A null doc_id
    links with nothing and has a null component.  Texts are read whole, however long.  Repeated rows each get a row; rows
    of one doc_id are the same document.  Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stash.put(docs.mapInArrow(_first_pass(width, positions, bands), _FIRST), "sets")
    full = sets.filter("n_shingles > 0 and doc_id is not null")
    reps = stash.put(full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times")), "representatives")
    nodes = full.withColumn("rep", F.col("doc_id")).join(reps, ["n_shingles", "d1", "d2", "rep"], "left_semi")
    buckets = nodes.select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "value")).distinct()
    shared = buckets.groupBy("band", "value").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stash.put(buckets.join(shared, ["band", "value"]), "buckets")
    # what shares most buckets with most others is the likeliest hub of a group
    weight = buckets.groupBy("id").agg((-F.sum("size")).alias("order"))
    near = stash.put(nodes.select(F.col("rep").alias("id"), "d1").join(weight, "id"), "near")
    ordered = stash.put(buckets.drop("size").join(near.select("id", "order"), "id"), "ordered")
    members = stash.put(
        docs.join(near.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        .mapInArrow(_set_pass(width), "id long, d1 long, members binary")
        .join(near.select("id", "d1"), ["id", "d1"])
        .select("id", "members")
        .dropDuplicates(["id"]),
        "members",
    )
    stash.drop(buckets)
    stash.release()
    hubs = ordered.groupBy("band", "value").agg(F.min(F.struct("order", "id")).alias("hub")).select("band", "value", F.col("hub.id").alias("hub"))
    star = ordered.join(hubs, ["band", "value"]).filter("id <> hub").select("hub", "id").distinct()
    star = stash.put(_with_sets(star, members, "hub", "id", stash).mapInArrow(_stars(percent), "hub long, id long, linked boolean, lacks long, adds long, size long, delta array<long>"), "star")
    links = star.filter("linked").select(F.col("hub").alias("v"), F.col("id").alias("u"))
    component = components(links, stash)
    more = stash.put(_candidates(star, component, percent, stash), "candidates")
    more = stash.put(_with_sets(more, members, "v", "u", stash).mapInArrow(_confirm(percent), "v long, u long"), "confirmed")
    links = links.unionByName(more)
    component = components(component.unionByName(more), stash)
    stash.drop(ordered, members)
    stash.release()
    degree = links.select(F.explode(F.array("v", "u")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    known = reps.join(component.select(F.col("v").alias("rep"), "u"), "rep", "left").join(degree, "rep", "left")
    known = stash.put(known.select("n_shingles", "d1", "d2", "times", F.coalesce("u", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")), "known")
    out = spread_join(full.select("doc_id", "n_shingles", "d1", "d2"), known, ["n_shingles", "d1", "d2"]).select("doc_id", "n_shingles", "component_id", "n_links")
    alone = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return out.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "n_links")


def _with_sets(pairs: DataFrame, members: DataFrame, a: str, b: str, stash: Stash) -> DataFrame:
    """``pairs`` with the sets of both sides.  A set with many pairs is copied once for each 1/HEAVY of all of them."""
    pairs = stash.put(pairs.select(a, b), "pairs")
    total, out = max(pairs.count(), 1), pairs
    for column, name in ((a, "set_a"), (b, "set_b")):
        counts = pairs.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") * HEAVY > total)
        salts = F.broadcast(counts.select(column, F.ceil(F.col("n") * HEAVY / F.lit(total)).cast("int").alias("salts")))
        left = out.join(salts, column, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(a, b), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
        right = members.toDF(column, name).join(salts, column, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        out = left.join(right.drop("salts"), [column, "salt"]).drop("salt")
    return out.select(a, b, "set_a", "set_b")


def _bound(percent: int):
    """Scaled lower bound of what a member asks of another's delta.

    With hub c, x lacking a and adding b of its elements, the intersection of x and y
    is |c| - |lacks of both| + |adds in common|, so they link exactly if their deltas
    share at least (bound(x) + bound(y)) / scale elements.  The hub itself has the least
    bound, -(100 - percent) |c|; a member links to it exactly if its own is at most the
    opposite of that.
    """
    scale = 2 * (100 + percent)
    edge = (100 - percent) * F.col("size")
    return scale, edge, 2 * (100 * F.col("lacks") + percent * F.col("adds")) - edge


def _candidates(star: DataFrame, component: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """(v, u): pairs of one hub's members, in different components, whose deltas may overlap enough."""
    scale, edge, bound = _bound(percent)
    of = lambda name: component.toDF(name, f"of_{name}")
    d = star.join(of("id"), "id", "left").join(of("hub"), "hub", "left")
    d = d.withColumn("of_id", F.coalesce("of_id", "id")).withColumn("apart", F.col("of_id") != F.coalesce("of_hub", "hub"))
    open_ = d.filter("apart").select("hub").distinct()
    d = d.join(open_, "hub", "left_semi").withColumn("bound", bound).withColumn("edge", edge)
    misses = F.floor((F.col("bound") - F.col("edge")) / scale)
    level = F.lit(1)
    for n, floor in enumerate(CLASS_FLOORS[1:], 2):
        level = F.when(misses >= floor, n).otherwise(level)
    d = stash.put(d.select("hub", "id", "of_id", "apart", "bound", "edge", F.size("delta").alias("n"), "delta", F.when(F.col("apart"), level).otherwise(0).alias("level")), "deltas")
    tokens = d.select("hub", "id", "apart", F.explode("delta").alias("e"))
    seen = tokens.groupBy("hub", "e").agg(F.count("*").alias("times")).filter("times > 1")
    ranked = tokens.join(seen, ["hub", "e"]).groupBy("hub", "id").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("shared"))
    # elements that one member alone has come first in every prefix and join nothing
    ranked = ranked.join(d.drop("delta"), ["hub", "id"]).select(
        "hub", "id", "of_id", "level", "apart", "bound", "edge", "n", (F.col("n") - F.size("shared")).alias("alone"), F.posexplode("shared").alias("k", "token")
    )
    floors = F.array(*(F.struct(F.lit(i).alias("other"), F.lit(f).alias("floor")) for i, f in enumerate((None, *CLASS_FLOORS))))
    t = ranked.select("*", F.explode(floors).alias("c")).filter("apart or c.other > 0")
    least = F.when(F.col("c.other") == 0, -F.col("edge")).otherwise(F.col("edge") + F.col("c.floor") * scale)
    rank = F.col("alone") + F.col("k") + 1
    t = t.filter(rank <= F.col("n") - F.ceil((F.col("bound") + least) / scale) + 1)
    t = stash.put(t.select("hub", F.col("token.e").alias("e"), "level", F.col("c.other").alias("other"), "id", "of_id", "bound", "n"), "tokens")
    key = ["hub", "e", "level", "other"]
    # components meet first, each with its least bound and largest delta, so that none is paired with itself
    whole = t.groupBy(*key, "of_id").agg(F.min("bound").alias("bound"), F.max("n").alias("n"))
    x = whole.filter("level > 0").toDF(*key, "of_v", "bound_v", "n_v")
    y = whole.toDF("hub", "e", "other", "level", "of_u", "bound_u", "n_u")
    fits = (F.col("bound_v") + F.col("bound_u")) <= scale * F.least("n_v", "n_u")
    apart = (F.col("of_v") != F.col("of_u")) & ((F.col("other") == 0) | (F.col("of_v") > F.col("of_u")))
    meet = stash.put(x.join(y, key).filter(apart & fits).select(*key, "of_v", "of_u"), "meet")
    v = t.select(*key, F.col("of_id").alias("of_v"), F.col("id").alias("v"), F.col("bound").alias("bound_v"), F.col("n").alias("n_v"))
    u = t.select("hub", "e", F.col("level").alias("other"), F.col("other").alias("level"), F.col("of_id").alias("of_u"), F.col("id").alias("u"), F.col("bound").alias("bound_u"), F.col("n").alias("n_u"))
    pairs = meet.join(v, [*key, "of_v"]).join(u, [*key, "of_u"]).filter(fits)
    return pairs.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct()
