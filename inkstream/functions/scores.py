"""Ranking, health, burst and clustering scores as built-in Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions.dates import HOUR_MS
from inkstream.functions.text import _col, jaccard

#: Fixed values of the scores.
HALF_LIFE_HOURS = 12.0
MAX_COVERAGE_SOURCES = 12
UNREAD_BOOST = 1.25
MIN_BASELINE_SAMPLES = 5
MIN_STDEV = 1.0
MIN_ABSOLUTE = 4
Z_THRESHOLD = 3.0
COOLDOWN_HOURS = 6
WEIGHTS = {"shingles": 0.60, "entities": 0.15, "title": 0.25}
JOIN_THRESHOLD = 0.17
CLUSTER_WINDOW_HOURS = 72
CENTROID_FREEZE_MEMBERS = 20
#: Largest Hamming distance of near-duplicates, by aggressiveness.
HAMMING = {"relaxed": 1, "standard": 3, "aggressive": 6}


def source_health(failures) -> Column:
    n = _col(failures)
    return F.when(n >= 3, "failing").when(n > 0, "degraded").otherwise("healthy")


def backoff_hours(failures) -> Column:
    """Hours to wait after that many failures: doubling, at most a day."""
    n = _col(failures).cast("int")
    return F.when(n <= 0, F.lit(0)).otherwise(F.least(F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), F.least(n, F.lit(8))), F.lit(24))).cast("long")


def rank_factors(published_at, source_count, topic_matches, is_read, now, half_life: float = HALF_LIFE_HOURS) -> Column:
    """(total, recency, coverage, topic, unread); total is the product of the others."""
    half = half_life if half_life > 0 else HALF_LIFE_HOURS
    age = F.greatest(_col(now) - _col(published_at), F.lit(0)) / F.lit(float(HOUR_MS))
    recency = F.pow(F.lit(0.5), age / half)
    coverage = 1 + F.log(F.least(F.greatest(_col(source_count), F.lit(1)), F.lit(MAX_COVERAGE_SOURCES)).cast("double"))
    topic = 1 + F.log(F.greatest(_col(topic_matches), F.lit(0)).cast("double") + 1)
    unread = F.when(_col(is_read), F.lit(1.0)).otherwise(F.lit(UNREAD_BOOST))
    return F.struct((recency * coverage * topic * unread).alias("total"), recency.alias("recency"), coverage.alias("coverage"), topic.alias("topic"), unread.alias("unread"))


def factors_hold(factors: Column) -> Column:
    """Whether the total is the product of its factors."""
    return F.abs(factors["recency"] * factors["coverage"] * factors["topic"] * factors["unread"] - factors["total"]) < 1e-9


def burst_verdict(count, samples, mean, stdev, last_fired, now, z_threshold: float = Z_THRESHOLD, min_absolute: int = MIN_ABSOLUTE, cooldown_hours: int = COOLDOWN_HOURS) -> Column:
    """(verdict, z, hours_remaining) of an hour's count against its baseline."""
    z = (_col(count) - _col(mean)) / F.greatest(_col(stdev), F.lit(MIN_STDEV))
    elapsed, cooldown = _col(now) - _col(last_fired), cooldown_hours * HOUR_MS
    cooling = _col(last_fired).isNotNull() & (elapsed < cooldown)
    verdict = (
        F.when(_col(samples) < MIN_BASELINE_SAMPLES, "not_enough_history")
        .when((z < z_threshold) | (_col(count) < min_absolute), "quiet")
        .when(cooling, "cooling")
        .otherwise("burst")
    )
    remaining = F.when(verdict == "cooling", F.ceil((cooldown - elapsed) / HOUR_MS).cast("long"))
    return F.struct(verdict.alias("verdict"), z.alias("z"), remaining.alias("hours_remaining"))


def cluster_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """(total, shingles, entities, title): weighted set similarities of an article and a story."""
    parts = {k: jaccard(a[k], b[k]) for k in WEIGHTS}
    return F.struct(weighted(parts).alias("total"), *(v.alias(k) for k, v in parts.items()))


def weighted(parts: dict[str, Column]) -> Column:
    """The weighted sum of set similarities."""
    return sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))
