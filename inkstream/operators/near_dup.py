"""Near-duplicate articles by fingerprint blocks, with a look-back in time."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.dates import HOUR_MS
from inkstream.functions.simhash import hamming

LOOKBACK_HOURS = 96
#: Blocks beyond the distance: so many of a fingerprint's blocks agree, and make a key together.
AGREEING = 3
#: The finest cell of time; cells double from there.
CELL_MS = 60_000


def block_keys(h: str, distance: int = 3) -> Column:
    """array of (k, value): every choice of ``AGREEING`` blocks of a fingerprint cut in ``distance + AGREEING``.

    Fingerprints at most ``distance`` bits apart agree on one choice, by pigeonhole; a
    choice has about 32 bits, so unrelated fingerprints hardly ever do.
    """
    n = distance + AGREEING
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = [signed(sum(masks[i] for i in c)) for c in combinations(range(n), AGREEING)]
    return F.array(*(F.struct(F.lit(k).alias("k"), F.col(h).bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(keys)))


def sorted_(side: DataFrame) -> DataFrame:
    """A side of a join of shuffled, sorted rows.

    Spark estimates the sides by the compressed size of the stored fingerprints, and an
    explode as no more than what it explodes: it would send tables of many times the
    broadcast threshold, which grow with the input, to the driver.
    """
    return side.hint("merge")


def neighbours(times: DataFrame, distance: int = 3, span_ms: int = LOOKBACK_HOURS * HOUR_MS) -> DataFrame:
    """(h, g): different non-zero fingerprints at most ``distance`` bits apart, g perhaps within ``span_ms`` before h.

    ``times`` has simhash and at.  Fingerprints meet inside one cell of ``span_ms`` or in
    neighbouring ones, so the join grows with what a look-back holds, not with all time.
    """
    one = times.select("simhash", F.floor(F.col("at") / span_ms).alias("cell")).filter("simhash <> 0").distinct()
    keyed = one.select("simhash", "cell", F.explode(block_keys("simhash", distance)).alias("b")).select("simhash", "cell", "b.k", "b.value")
    h = keyed.select(F.col("simhash").alias("h"), "k", "value", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"))
    pairs = h.join(sorted_(keyed.withColumnRenamed("simhash", "g")), ["k", "value", "cell"])
    return pairs.filter((F.col("h") != F.col("g")) & (hamming("h", "g") <= distance)).select("h", "g").distinct()


def _cells(low: Column, high: Column, levels: int) -> Column:
    """array of (level, cell): dyadic cells that make up the base cells from ``low`` to ``high``, at most two a level."""
    parts = []
    for k in range(levels):
        size = 1 << k
        left, right = F.ceil(low / size), F.floor((high + 1) / size)
        for take, cell in ((left % 2 != 0, left), (right % 2 != 0, right - 1)):
            parts.append(F.when((left < right) & take, F.struct(F.lit(k).alias("level"), cell.alias("cell"))))
    return F.array_compact(F.array(*parts))


def originals(articles: DataFrame, distance: int = 3, lookback_hours: int = LOOKBACK_HOURS) -> DataFrame:
    """(id, duplicate_of): each article's earliest near-duplicate among earlier ones in the look-back.

    ``articles`` has id, at (epoch millis) and simhash; earlier is by (at, id).  Articles
    of one fingerprint and time are one row until the end.  A look-back is a dozen or two
    dyadic cells of time, each of which knows its fingerprint's first article; only the
    minute that the look-back cuts is read by its single times.
    """
    a = articles.select("id", "at", "simhash").filter("simhash <> 0")
    times = a.groupBy("simhash", "at").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    span = lookback_hours * HOUR_MS
    several = times.groupBy("simhash").agg(F.sum("n").alias("n")).filter("n > 1").select(F.col("simhash").alias("h"), F.col("simhash").alias("g"))
    near = neighbours(times, distance, span).unionByName(several)
    probe = times.select(F.col("simhash").alias("h"), "at").join(sorted_(near), "h").withColumn("since", F.col("at") - span)
    base = lambda t: F.floor(F.col(t) / CELL_MS)
    levels = max(span // CELL_MS, 1).bit_length()
    own = times.select(F.col("simhash").alias("g"), "at", "id", base("at").alias("base"))
    firsts = own.select("g", "at", "id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.struct(k.alias("level"), F.floor(F.col("base") / F.pow(F.lit(2), k)).alias("cell")))).alias("c"))
    firsts = firsts.groupBy("g", "c.level", "c.cell").agg(F.min(F.struct("at", "id")).alias("f"))
    inside = probe.select("h", "at", "g", F.explode(_cells(base("since") + 1, base("at"), levels)).alias("c")).select("h", "at", "g", "c.level", "c.cell")
    whole = inside.join(sorted_(firsts), ["g", "level", "cell"]).select("h", "at", "f")
    cut = probe.select("h", "at", "since", "g", base("since").alias("base")).join(sorted_(own.select("g", "base", F.struct("at", "id").alias("f"))), ["g", "base"])
    # the articles of the probe's own base cell may be later ones: the least of all is asked, and compared at the end
    least = whole.unionByName(cut.filter("f.at >= since").select("h", "at", "f")).groupBy("h", "at").agg(F.min("f").alias("f"))
    found = a.join(sorted_(least.withColumnRenamed("h", "simhash")), ["simhash", "at"])
    return found.filter((F.col("f.at") < F.col("at")) | (F.col("f.at") == F.col("at")) & (F.col("f.id") < F.col("id"))).select("id", F.col("f.id").alias("duplicate_of"))
