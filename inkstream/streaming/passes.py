"""The ingest pass as micro-batches, and stateful streams.

Batch operators carry the logic; a micro-batch calls them in the order ingest, cluster,
match, burst.  Publication times carry no watermark: late and future items count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkstream.functions.dates import HOUR_MS
from inkstream.functions.scores import COOLDOWN_HOURS, Z_THRESHOLD
from inkstream.functions.simhash import with_simhash
from inkstream.functions.urls import canonicalize
from inkstream.operators.bursts import detect
from inkstream.operators.clustering import PENDING, cluster_pass, features, fold_members
from inkstream.operators.near_dup import LOOKBACK_HOURS, originals
from inkstream.operators.store import events, grown_stories, insert_articles, insert_new, open_stories, record_bursts, recount
from inkstream.plans.reads import article_filter, newest, snapshot
from inkstream.plans.topics import Node, document, match_topics
from inkstream.sources.feeds import read_feeds


def ingest(bodies: DataFrame, stored: DataFrame, now: int, workspace: str = "default") -> DataFrame:
    """New articles of fetched bodies (feed_key, body): parsed, keyed, fingerprinted, deduplicated.

    ``stored`` has id, workspace_id, canonical_url, source_id, guid, fetched_at, simhash.
    Ids come from the keys, so a replay finds what it wrote.
    """
    items = read_feeds(bodies, now).filter("url is not null")
    keyed = items.select(
        F.lit(workspace).alias("workspace_id"), F.col("feed_key").alias("source_id"), "guid", "url", canonicalize("url").alias("canonical_url"), "title", "author", "summary", "content",
        "published_at", F.lit(now).cast("long").alias("fetched_at"), F.coalesce("content", "summary", F.lit("")).alias("body"),
    ).withColumn("id", F.concat(F.lit("ar_"), F.sha2(F.concat_ws("\n", "workspace_id", "canonical_url"), 256)))
    keep = [c for c in keyed.columns if c != "body"]
    marked = with_simhash(keyed.withColumn("__text", F.concat_ws(" ", "title", "body")), "__text", keep)
    fresh = insert_articles(marked, stored)
    both = fresh.select("id", F.col("fetched_at").alias("at"), "simhash").unionByName(stored.select("id", F.col("fetched_at").alias("at"), "simhash"))
    return fresh.join(originals(both, lookback_hours=LOOKBACK_HOURS), "id", "left")


MATCH_HOURS, MATCHED = 24, 500
ARTICLE = (
    "id string, workspace_id string, source_id string, story_id string, guid string, url string, canonical_url string, title string, author string, summary string, content string, published_at long, "
    "fetched_at long, simhash long, duplicate_of string, read_at long, saved_at long, archived_at long"
)
STORY = (
    "id string, workspace_id string, title string, summary string, centroid_shingles array<string>, centroid_member_count long, entities array<string>, article_count long, source_count long, "
    "notified_source_count long, followed boolean, first_seen_at long, last_seen_at long"
)
MATCH = "topic_id string, article_id string, workspace_id string, matched_at long"
BURST = (
    "id string, workspace_id string, topic_id string, z_score double, match_count long, baseline_mean double, baseline_stdev double, hour_of_day long, article_ids array<string>, detected_at long"
)


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, null where it has none."""
    fields = [f.split(" ") for f in schema.split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields))


def empty_tables(spark) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], s) for n, s in (("articles", ARTICLE), ("stories", STORY), ("matches", MATCH), ("bursts", BURST))}


def pending_features(articles: DataFrame, pending: int = PENDING) -> DataFrame:
    """Sets of the oldest unclustered articles of every workspace, with their originals' stories."""
    nth = F.row_number().over(Window.partitionBy("workspace_id").orderBy("published_at", "id"))
    first = articles.filter("story_id is null").withColumn("nth", nth).filter(F.col("nth") <= pending)
    theirs = articles.select(F.col("id").alias("duplicate_of"), F.col("story_id").alias("original_story"))
    p = first.select("workspace_id", "id", "source_id", "duplicate_of", "published_at", "fetched_at", "title", "content").join(theirs, "duplicate_of", "left")
    return features(p, body="content").drop("title", "content")


def cluster_pending(pending: DataFrame, stories: DataFrame, now: int) -> DataFrame:
    """Assignments of ``pending_features``; duplicates follow their original."""
    s = stories.select("workspace_id", "id", "last_seen_at", F.col("centroid_member_count").alias("member_count"), F.col("centroid_shingles").alias("shingles"), "entities", F.array().cast("array<string>").alias("title_tokens"))
    return cluster_pass(pending, s, now)


def settle(articles: DataFrame, stories: DataFrame, pending: DataFrame, assigned: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(articles, stories) after a clustering pass: new stories, folded centroids, counts; a follower is not counted yet."""
    told = assigned.select(F.col("article_id").alias("id"), "story_id", "opened", "inherited")
    placed = pending.join(told, "id")
    all_ = stories.unionByName(open_stories(placed.filter("opened"), now))
    joined = placed.filter("not opened and not inherited")
    after = articles.join(told.select("id", F.col("story_id").alias("__story")), "id", "left").withColumn("story_id", F.coalesce("story_id", "__story")).select(articles.columns)
    touched = joined.select(F.col("story_id").alias("id")).distinct()
    folded = fold_members(all_.join(touched, "id", "left_semi"), joined)
    return after, all_.join(touched, "id", "left_anti").unionByName(recount(after, folded))


def table_writer(spark, folder: str) -> Callable[[str, DataFrame], DataFrame]:
    """Stores the tables of one pass under a folder that all executors share, and reads them from there."""

    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return write


def match_pass(articles: DataFrame, topics: dict[str, Node], matches: DataFrame, now: int, workspace: str = "default") -> DataFrame:
    """New topic matches among the newest articles of the last day, archived ones and duplicates left out."""
    recent = newest(article_filter(articles, since=now - MATCH_HOURS * HOUR_MS, include_duplicates=False), MATCHED)
    docs = document(recent, title=F.col("title"), body=F.coalesce("content", "summary", F.lit("")), author=F.col("author"), url=F.col("url"))
    found = match_topics(docs, topics, ["id"]).select("topic_id", F.col("id").alias("article_id"), F.lit(workspace).alias("workspace_id"), F.lit(now).cast("long").alias("matched_at"))
    return insert_new(found, matches, ["topic_id", "article_id"], ["matched_at"])


def service_pass(tables: dict[str, DataFrame], bodies: DataFrame, topics: dict[str, Node], now: int, write: Callable[[str, DataFrame], DataFrame], names: dict[str, str] | None = None, workspace: str = "default", z_threshold: float = Z_THRESHOLD) -> dict[str, DataFrame]:
    """One pass over fetched bodies: ingest, cluster, match, burst, snapshot, developing stories.

    ``tables`` has articles, stories, matches and bursts as ``empty_tables`` shapes them;
    the result has them as they are afterwards, and ``new_articles``, ``assigned``, ``new_matches``,
    ``new_bursts``, ``snapshot``, ``events`` and ``report``.  ``write(name, df)`` stores a
    table between the steps and returns a reader of it (``table_writer``), so that no plan
    holds the steps before; a pass that is repeated finds its own rows and adds none.
    """
    put = write
    spark = bodies.sparkSession
    articles, stories, matches, bursts = (tables[n] for n in ("articles", "stories", "matches", "bursts"))
    fresh = put("new_articles", shaped(ingest(bodies, articles, now, workspace), ARTICLE))
    articles = articles.unionByName(fresh)
    pending = put("pending", pending_features(articles))
    assigned = put("assigned", cluster_pending(pending, stories, now))
    articles, stories = settle(articles, stories, pending, assigned, now)
    articles, stories = put("articles", articles), put("stories", stories)
    found = put("new_matches", match_pass(articles, topics, matches, now, workspace))
    matches = matches.unionByName(found)
    watched = spark.createDataFrame([(t, (names or {}).get(t, t)) for t in topics], "id string, name string")
    verdicts = detect(matches, watched.select(F.col("id").alias("topic_id")), bursts.select("topic_id", "detected_at"), now, z_threshold)
    fired = put("new_bursts", shaped(record_bursts(verdicts, matches, workspace, now), BURST))
    grown = grown_stories(stories)
    told = events(fired, watched, grown, spark.createDataFrame([], "id string, story_count long, article_count long, generated_at long"))
    counts = {
        "stories_opened": assigned.filter("opened"), "stories_joined": assigned.filter("not opened and not inherited"), "topic_matches": found, "bursts": fired, "articles_new": fresh,
        "duplicates": fresh.filter("duplicate_of is not null"),
    }
    report = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n") for name, df in counts.items()))
    announced = stories.withColumn("notified_source_count", F.when(F.col("followed"), F.greatest("notified_source_count", "source_count")).otherwise(F.col("notified_source_count")))
    return {
        "articles": articles, "stories": announced, "matches": matches, "bursts": bursts.unionByName(fired), "new_articles": fresh, "assigned": assigned, "new_matches": found, "new_bursts": fired,
        "snapshot": snapshot(articles, now), "events": told, "report": report,
    }


def refresh_source(tables: dict[str, DataFrame], body: DataFrame, topics: dict[str, Node], now: int, write: Callable[[str, DataFrame], DataFrame], workspace: str = "default") -> dict[str, DataFrame]:
    """One source's body: ingest, cluster and match alone."""
    articles = tables["articles"].unionByName(write("new_articles", shaped(ingest(body, tables["articles"], now, workspace), ARTICLE)))
    pending = write("pending", pending_features(articles))
    assigned = write("assigned", cluster_pending(pending, tables["stories"], now))
    articles, stories = settle(articles, tables["stories"], pending, assigned, now)
    articles, stories = write("articles", articles), write("stories", stories)
    return {**tables, "articles": articles, "stories": stories, "matches": tables["matches"].unionByName(match_pass(articles, topics, tables["matches"], now, workspace))}


def match_stream(articles: DataFrame, topics: dict[str, Node]) -> DataFrame:
    """Topic matches of a stream of articles (id, title, body); a match is kept once."""
    docs = document(articles, title=F.col("title"), body=F.col("body"))
    return match_topics(docs, topics, ["id"]).dropDuplicates(["id", "topic_id"])


def hourly_counts(matches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tumbling hour counts of matches (topic_id, ts) under a watermark."""
    return matches.withWatermark("ts", delay).groupBy("topic_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("topic_id", F.col("w.start").alias("hour"), "n")


def cooled(bursts: DataFrame, cooldown_hours: int = COOLDOWN_HOURS) -> DataFrame:
    """Bursts (topic_id, at millis) that are not within the cooldown of the topic's last one; state is one long a topic."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in sorted(a for b in batches for a in b["at"]):
            if last is None or at - last >= cooldown_hours * HOUR_MS:
                last = at
                out.append((key[0], at))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["topic_id", "at"])

    return bursts.groupBy("topic_id").applyInPandasWithState(fold, "topic_id string, at long", "last long", "append", GroupStateTimeout.NoTimeout)


def developing(stories: DataFrame) -> DataFrame:
    """Stories (id, source_count) at their first growth past what was reported; a story's birth is not growth."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        top = max(int(n) for b in batches for n in b["source_count"])
        state.update((max(top, seen or 0),))
        yield pd.DataFrame([(key[0], top)] if seen is not None and top > seen else [], columns=["id", "source_count"])

    return stories.groupBy("id").applyInPandasWithState(fold, "id string, source_count long", "reported long", "append", GroupStateTimeout.NoTimeout)


def run_passes(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds", once: bool = False):
    """Start the poll loop over a stream of fetched bodies; ``each`` gets a micro-batch and its number."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
