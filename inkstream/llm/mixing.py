"""Mixing overlapping sources to target weights by min-cost flow.

Documents collapse to membership patterns (the set of sources a document belongs
to).  A flow routes token capacity from patterns to source quotas: the first
repetition of a pattern's words is free, each further one costs more (convex), so
text is repeated only where quotas force it.  Whole documents are then taken in a
seeded order until a pattern's flow is met.

Everything of the size of the data stays in Spark: pattern totals are partial
aggregates, and the seeded order is cut by refining a histogram of seeded hashes,
level by level, down to the one cell per pattern in which the flow ends.  The flow
itself sees one row per pattern and runs on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm._stash import Stash

WEIGHTS = (3, 1, 2)
OVERSAMPLE = 1.5
MAX_REPEATS = 2
#: Patterns whose plan is broadcast; a longer plan is joined by a shuffle.
BROADCAST_PATTERNS = 200_000
#: Cost of a pattern's k-th repetition of its words; increasing, so the flow is convex.
REPEAT_COSTS = (0, 10, 30, 60, 100)
#: The seeded order's bits, and those by which a level refines it.
HASH_BITS = 60
CELL_BITS = 12
SEED = 17


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: dict[str | None, int], share: float = OVERSAMPLE, most: float = MAX_REPEATS) -> dict[str | None, float]:
    """Targets of sources by code point, null last, weighing 3, 1, 2, repeating.

    They share ``share`` of all sizes; a target stops at ``most`` times its source's
    size and the excess is shared anew by weight among the others.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in names if s in open_ and unit * weight[s] > most * sizes[s]]
        if not over:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def min_cost_flow(capacity: dict, members: dict, quota: dict, repeats: int = MAX_REPEATS) -> dict:
    """{(pattern, source): words} of a cheapest largest flow.

    ``capacity[p]`` words may flow from pattern p once for each of ``repeats``
    repetitions at ``REPEAT_COSTS``; ``members[p]`` are its sources; ``quota[s]`` is what
    source s takes.

    Costs lie on the first arcs alone and rise with the repetition, so cheapest
    augmenting paths come repetition by repetition: a largest flow is extended with each
    one's capacities (Dinic's levels and blocking flows over pattern -> source).  Patterns
    of the same sources are one node, and one whose sources nobody shares needs no search.
    """
    sets = {p: frozenset(members[p]) for p in capacity}
    groups: dict = {}
    for p in sorted(capacity):
        if capacity[p] and sets[p]:
            groups.setdefault(sets[p], []).append(p)
    room = {g: 0 for g in groups}
    left = dict(quota)
    sent: dict = {g: dict.fromkeys(sorted(g, key=lambda s: (s is None, s)), 0) for g in groups}
    for _ in range(repeats):
        for g, ps in groups.items():
            room[g] += sum(capacity[p] for p in ps)
        _largest_flow(room, left, sent)
    # a group's words go to its patterns in order, each within what its repetitions hold
    out = {(p, s): 0 for p in capacity for s in members[p]}
    for g, ps in groups.items():
        shares = [[s, n] for s, n in sent[g].items() if n]
        total = sum(n for _, n in shares)
        whole, rest = divmod(total, sum(capacity[p] for p in ps))
        for p in ps:
            want = whole * capacity[p] + min(rest, capacity[p])
            rest -= min(rest, capacity[p])
            while want and shares:
                take = min(want, shares[0][1])
                out[p, shares[0][0]] += take
                want -= take
                shares[0][1] -= take
                if not shares[0][1]:
                    shares.pop(0)
    return out


def _largest_flow(room: dict, left: dict, sent: dict) -> None:
    """Extend ``sent`` (group -> source -> words) to a largest flow of ``room`` into ``left``, both of which it lowers."""
    for g in room:  # what needs no rerouting
        for s in sent[g]:
            n = min(room[g], left.get(s, 0))
            sent[g][s] += n
            room[g] -= n
            left[s] = left.get(s, 0) - n
    takers: dict = {}
    for g in sent:
        for s in sent[g]:
            takers.setdefault(s, []).append(g)
    while True:
        # levels: groups with room, their sources, the groups that sent there, and so on
        level = {("g", g): 0 for g in room if room[g] > 0}
        front, goal = list(level), False
        while front and not goal:
            found = []
            for kind, x in front:
                d = level[kind, x] + 1
                for y in [("s", s) for s in sent[x]] if kind == "g" else [("g", g) for g in takers[x] if sent[g][x] > 0]:
                    if y not in level:
                        level[y] = d
                        found.append(y)
                        goal |= y[0] == "s" and left[y[1]] > 0
            front = found
        if not goal:
            return
        at: dict = {}
        for start in [g for g in room if room[g] > 0]:
            while room[start] > 0:
                path = [("g", start)]
                while path and not (path[-1][0] == "s" and left[path[-1][1]] > 0):
                    kind, x = path[-1]
                    options = [("s", s) for s in sent[x]] if kind == "g" else [("g", g) for g in takers[x]]
                    k = at.get((kind, x), 0)
                    while k < len(options) and not (level.get(options[k]) == level[kind, x] + 1 and (kind == "g" or sent[options[k][1]][x] > 0)):
                        k += 1
                    at[kind, x] = k
                    if k < len(options):
                        path.append(options[k])
                    else:
                        path.pop()
                        if path:
                            at[path[-1]] += 1
                if not path:
                    break
                n = min([room[start], left[path[-1][1]]] + [sent[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"])
                for a, b in zip(path, path[1:]):
                    if a[0] == "g":
                        sent[a[1]][b[1]] += n
                    else:
                        sent[b[1]][a[1]] -= n
                room[start] -= n
                left[path[-1][1]] -= n


def _hash(seed: int) -> Column:
    """HASH_BITS of a digest of seed, id and text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), "text").cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _name(sources: Column) -> Column:
    """A pattern's text key: its sorted sources as JSON."""
    return F.to_json(F.sort_array(F.array_distinct(sources)))


def mix(docs: DataFrame, sources: Column | None = None, seed: int = SEED, share: float = OVERSAMPLE) -> DataFrame:
    """(doc_id, size, source_size, target, taken, pattern) for each row of ``docs`` (doc_id, text, source).

    ``sources`` is an array column of the sources a document belongs to; by default
    its single ``source``, null being a source of its own.  ``source_size`` and
    ``target`` sum over a pattern's sources (with one source: its own).

    ``taken`` is the document's words times the repetitions it gets, 0 to 2: whole
    repetitions that the flow gives its whole pattern, and one more if the document
    comes before the flow's end in the seeded order.  In the end one document per
    pattern is cut inside, so that the pattern's taken words meet its flow.  Equal
    rows tie in that order and then share the cut in equal parts, rounded down.

    Null texts have size 0 and are taken 0 times their words; texts count whole, however
    long; a document without sources is not taken.  An empty table gives
    an empty result; extra columns are ignored; reruns agree.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "mix")
    sources = F.array("source") if sources is None else sources
    base = stash.put(
        docs.select("doc_id", word_count(F.col("text")).alias("size"), _hash(seed).alias("h"), _name(sources).alias("pattern"), F.sort_array(F.array_distinct(sources)).alias("members")),
        "sizes",
    )
    totals = base.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).collect()
    sizes: dict = {}
    for r in totals:
        for s in r.members:
            sizes[s] = sizes.get(s, 0) + r.size
    words = sum(r.size for r in totals)
    # sizes of overlapping sources count shared documents once for each
    scale = words / sum(sizes.values()) if sum(sizes.values()) else 1.0
    target = source_targets(sizes, share * scale)
    flow = min_cost_flow({r.pattern: r.size for r in totals}, {r.pattern: list(r.members) for r in totals}, {s: int(t) for s, t in target.items()})
    rows = []
    for r in totals:
        routed = int(sum(flow[r.pattern, s] for s in r.members)) if r.members else 0
        times, rest = divmod(routed, r.size) if r.size else (0, 0)
        rows.append((r.pattern, float(sum(target[s] for s in r.members)), sum(sizes[s] for s in r.members), times, rest))
    plan = spark.createDataFrame(rows, "pattern string, target double, source_size long, times long, rest long")
    small = F.broadcast if len(rows) <= BROADCAST_PATTERNS else lambda df: df
    cut = _cuts(base, plan, stash, small)
    joined = base.join(small(plan), "pattern").join(small(cut), "pattern", "left")
    more = (
        F.when(F.col("h") < F.col("edge"), F.col("size"))
        .when(F.col("h") == F.col("edge"), F.floor(F.col("size") * F.col("inside") / F.greatest(F.col("edge_size"), F.lit(1))))
        .otherwise(F.lit(0))
    )
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size") + F.coalesce(more, F.lit(0))).cast("long").alias("taken"), "pattern"
    )


def _cuts(base: DataFrame, plan: DataFrame, stash: Stash, small) -> DataFrame:
    """(pattern, edge, inside, edge_size): the seeded hash at which each pattern's rest ends.

    Documents hashed below ``edge`` are taken whole; those at it share ``inside`` of
    their ``edge_size`` words.  Each level splits the current cell of hashes into
    2**CELL_BITS by partial-aggregated sums, so the work is a few scans of sizes and the
    tables between levels have at most that many rows a pattern.
    """
    state = plan.filter("rest > 0").select("pattern", F.col("rest").alias("room"))
    base = base.select("pattern", "h", "size")
    for shift in range(HASH_BITS - CELL_BITS, -1, -CELL_BITS):
        last = shift < CELL_BITS
        cells = base.join(small(state), "pattern").groupBy("pattern", "room", F.shiftright("h", 0 if last else shift).alias("cell")).agg(F.sum("size").alias("size"))
        lists = cells.groupBy("pattern", "room").agg(F.sort_array(F.collect_list(F.struct("cell", "size"))).alias("cells"))
        zero = F.struct(F.col("room").alias("room"), F.lit(None).cast("long").alias("cell"), F.lit(0).cast("long").alias("size"))
        walked = F.aggregate(
            "cells",
            zero,
            lambda acc, x: F.when(acc["cell"].isNotNull(), acc)
            .when(x["size"] > acc["room"], F.struct(acc["room"].alias("room"), x["cell"].alias("cell"), x["size"].alias("size")))
            .otherwise(F.struct((acc["room"] - x["size"]).alias("room"), acc["cell"].alias("cell"), acc["size"].alias("size"))),
        )
        found = stash.put(lists.select("pattern", walked.alias("w")).filter("w.cell is not null").select("pattern", "w.*"), f"level{shift}")
        if last:
            return found.select("pattern", F.col("cell").alias("edge"), F.col("room").alias("inside"), F.col("size").alias("edge_size"))
        state = found.select("pattern", "room")
        base = stash.put(base.join(small(found.select("pattern", "cell")), "pattern").filter(F.shiftright("h", shift) == F.col("cell")).drop("cell"), f"cell{shift}")
    raise AssertionError("the last level returns")
