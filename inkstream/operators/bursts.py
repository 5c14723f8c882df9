"""Topic bursts: an hour's matches against the same hour of the days before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.functions.dates import HOUR_MS, hour_of_day
from inkstream.functions.scores import COOLDOWN_HOURS, MIN_ABSOLUTE, MIN_STDEV, Z_THRESHOLD, burst_verdict

BASELINE_DAYS = 7


def baseline(matches: DataFrame, now: int, days: int = BASELINE_DAYS) -> DataFrame:
    """(topic_id, count, samples, mean, stdev): the last hour and the same hour of the days before.

    ``matches`` has topic_id and matched_at (millis).  A sample is the count within half
    an hour of now less whole days; zeros count.  One partial-aggregated pass.
    """
    at = F.col("matched_at")
    inside = lambda low, high: F.count(F.when((at >= low) & (at < high), 1))
    half, day = HOUR_MS // 2, 24 * HOUR_MS
    samples = [inside(now - d * day - half, now - d * day + half).alias(f"d{d}") for d in range(1, days + 1)]
    agg = matches.filter((at >= now - days * day - half) & (at < now)).groupBy("topic_id").agg(inside(now - HOUR_MS, now).alias("count"), *samples)
    values = F.array(*(F.col(f"d{d}") for d in range(1, days + 1)))
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / days
    return agg.select("topic_id", "count", values.alias("samples"), mean.alias("mean")).withColumn(
        "stdev", F.sqrt(F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + (x - F.col("mean")) * (x - F.col("mean"))) / days)
    )


def detect(matches: DataFrame, topics: DataFrame, last_bursts: DataFrame, now: int, z_threshold: float = Z_THRESHOLD, **limits) -> DataFrame:
    """Verdict of every topic; ``last_bursts`` has topic_id and detected_at."""
    last = last_bursts.groupBy("topic_id").agg(F.max("detected_at").alias("last_fired"))
    d = topics.select("topic_id").join(baseline(matches, now), "topic_id", "left").join(last, "topic_id", "left")
    d = d.withColumns({"count": F.coalesce("count", F.lit(0)), "mean": F.coalesce("mean", F.lit(0.0)), "stdev": F.coalesce("stdev", F.lit(0.0))})
    v = burst_verdict("count", F.lit(BASELINE_DAYS), "mean", "stdev", "last_fired", F.lit(now), z_threshold, **limits)
    return d.withColumn("v", v).select("topic_id", "count", "mean", "stdev", F.lit(now).alias("now"), F.col("v.*"), hour_of_day(F.lit(now)).alias("hour_of_day"))


def history(matches: DataFrame, z_threshold: float = Z_THRESHOLD, min_absolute: int = MIN_ABSOLUTE, cooldown_hours: int = COOLDOWN_HOURS) -> DataFrame:
    """(topic_id, hour, count, z): bursts of all whole hours, each cooled down by the one before.

    Hour counts are one aggregate; a topic's hours (bounded by the time covered) are
    folded in order, since a burst silences later ones.
    """
    hourly = matches.groupBy("topic_id", F.floor(F.col("matched_at") / HOUR_MS).alias("hour")).agg(F.count("*").alias("n"))
    # each count is a sample of the next seven days at its hour
    shifted = hourly.select("topic_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BASELINE_DAYS)), lambda d: F.struct((F.col("hour") + 24 * d).alias("hour"), d.alias("d")))).alias("x"), "n")
    own = F.sum(F.when(F.col("x.d") == 0, F.col("n")))
    s1, s2 = (F.sum(F.when(F.col("x.d") > 0, v)) for v in (F.col("n"), F.col("n") * F.col("n")))
    stats = shifted.groupBy("topic_id", F.col("x.hour").alias("hour")).agg(own.alias("count"), F.coalesce(s1, F.lit(0)).alias("s1"), F.coalesce(s2, F.lit(0)).alias("s2"))
    mean = F.col("s1") / BASELINE_DAYS
    stdev = F.sqrt(F.greatest(F.col("s2") / BASELINE_DAYS - mean * mean, F.lit(0.0)))
    z = (F.col("count") - mean) / F.greatest(stdev, F.lit(MIN_STDEV))
    hot = stats.filter(F.col("count").isNotNull()).withColumn("z", z).filter((F.col("z") >= z_threshold) & (F.col("count") >= min_absolute))
    listed = hot.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("hour", "count", "z"))).alias("hot"))
    zero = F.slice("hot", F.lit(1), F.lit(0))
    fired = F.aggregate("hot", zero, lambda acc, x: F.when((F.size(acc) == 0) | (x["hour"] - F.get(acc, F.size(acc) - 1)["hour"] >= cooldown_hours), F.array_append(acc, x)).otherwise(acc))
    return listed.select("topic_id", F.explode(fired).alias("b")).select("topic_id", "b.*")
