"""Composed reads over articles, stories, topics and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions.dates import HOUR_MS
from inkstream.functions.scores import HALF_LIFE_HOURS, rank_factors
from inkstream.functions.text import STOPWORDS, snapshot_tokens
from inkstream.operators.store import clamp_limit
from inkstream.plans.topics import Node, document, matches

SNAPSHOT_SIZE, SNAPSHOT_POOL, SNAPSHOT_HOURS, SNAPSHOT_TTL_S = 40, 400, 48, 3600
BRIEF_STORIES, BRIEF_HOURS = 12, 24
STORY_MEMBERS = 100
BRIEFS_LISTED = 30
#: Look-backs in hours that reads and agents may ask for, and what they get without asking.
READ_HOURS, AGENT_HOURS, DEFAULT_HOURS = (1, 24 * 365), (1, 2160), 168
EPOCH_MS = 1_704_067_200_000


def articles_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as articles: a minute apart by id, title to the first line break, marks from labels."""
    at = F.lit(EPOCH_MS) + F.col("doc_id") * 60_000
    label = labels.select("doc_id", "quality", "toxic")
    return documents.join(label, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.lit("default").alias("workspace_id"), F.col("source").alias("source_id"), F.concat_ws("-", "source", "lang").alias("story_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "lang", at.alias("published_at"), (at + 30_000).alias("fetched_at"),
        F.when(F.col("quality") == 1, at).alias("read_at"), F.when(F.col("quality") == 0, at).alias("saved_at"), F.when(F.col("toxic") == 1, at).alias("archived_at"),
    )


def article_filter(
    df: DataFrame, source_id: str | None = None, story_id: str | None = None, since: int | None = None, unread: bool | None = None,
    saved: bool | None = None, archived: bool | None = None, include_duplicates: bool = True,
) -> DataFrame:
    """The conjunctive article filter; archived ones only on request, as one predicate for Catalyst."""
    if source_id is not None:
        df = df.filter(F.col("source_id") == source_id)
    if story_id is not None:
        df = df.filter(F.col("story_id") == story_id)
    if since is not None:
        df = df.filter(F.col("published_at") >= since)
    if unread is not None:
        df = df.filter(F.col("read_at").isNull() if unread else F.col("read_at").isNotNull())
    if saved is not None:
        df = df.filter(F.col("saved_at").isNotNull() if saved else F.col("saved_at").isNull())
    df = df.filter(F.col("archived_at").isNotNull() if archived else F.col("archived_at").isNull())
    return df if include_duplicates else df.filter("duplicate_of is null")


def newest(df: DataFrame, limit: int | None = None) -> DataFrame:
    return df.orderBy(F.desc("published_at"), "id").limit(clamp_limit(limit))


def ranked(df: DataFrame, now: Column | int, half_life: float = HALF_LIFE_HOURS, source_count: Column | int = 1, topic_matches: Column | int = 0) -> DataFrame:
    """Adds the score struct ``rank`` and orders by its total, then id."""
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    rank = rank_factors(F.col("published_at"), lit(source_count), lit(topic_matches), F.col("read_at").isNotNull(), lit(now), half_life)
    return df.withColumn("rank", rank).orderBy(F.desc("rank.total"), "id")


def ranked_feed(df: DataFrame, now: int, limit: int | None = None, half_life: float = HALF_LIFE_HOURS, **filters) -> DataFrame:
    """The newest articles that pass the filter, ranked: the limit comes before the ranking."""
    return ranked(newest(article_filter(df, **filters), limit), now, half_life)


def search(df: DataFrame, node: Node, limit: int = 20, pool: int | None = None, **filters) -> DataFrame:
    """Matches among the newest ``pool`` articles; 500 unless all are asked for with ``pool=0``."""
    base = article_filter(df, **filters)
    base = base if pool == 0 else newest(base, pool or 500)
    docs = document(base, title=F.col("title"), body=F.col("body"))
    return docs.filter(matches(node)).select(df.columns).orderBy(F.desc("published_at"), "id").limit(clamp_limit(limit, 20, 100))


def topic_feed(log: DataFrame, articles: DataFrame, topic_id: str, since: int, limit: int = 100) -> DataFrame:
    """Articles of a topic's matches, latest match first."""
    hits = log.filter((F.col("topic_id") == topic_id) & (F.col("matched_at") >= since))
    return hits.join(articles, hits["article_id"] == articles["id"]).orderBy(F.desc("matched_at"), "id").limit(clamp_limit(limit, 100))


def window_start(now: int, hours: int | None, default: int | None = DEFAULT_HOURS, bounds: tuple[int, int] = READ_HOURS) -> int | None:
    """Start of a look-back of so many hours, clamped to ``bounds``; None asks for the default, of which None is no start."""
    hours = default if hours is None else min(max(hours, bounds[0]), bounds[1])
    return None if hours is None else now - hours * HOUR_MS


def by_id(df: DataFrame, id_: str) -> DataFrame:
    """Point lookup: a filter that reaches the scan."""
    return df.filter(F.col("id") == id_)


def unclustered(articles: DataFrame, limit: int) -> DataFrame:
    """The oldest articles without a story."""
    return articles.filter("story_id is null").orderBy("published_at", "id").limit(limit)


def candidate_stories(stories: DataFrame, since: int) -> DataFrame:
    """Stories still open to new members."""
    return stories.filter(F.col("last_seen_at") >= since).orderBy(F.desc("last_seen_at"), "id")


def stories_list(stories: DataFrame, since: int | None = None, limit: int | None = None) -> DataFrame:
    """The latest stories."""
    recent = stories if since is None else stories.filter(F.col("last_seen_at") >= since)
    return recent.orderBy(F.desc("last_seen_at"), "id").limit(clamp_limit(limit))


def match_times(log: DataFrame, topic_id: str, start: int, end: int) -> DataFrame:
    """Times of a topic's matches from ``start`` to before ``end``."""
    return log.filter((F.col("topic_id") == topic_id) & (F.col("matched_at") >= start) & (F.col("matched_at") < end)).select("matched_at").orderBy("matched_at")


def story_page(stories: DataFrame, articles: DataFrame, story_id: str) -> DataFrame:
    """A story's row beside each of its newest members, duplicates among them; members are null if it has none."""
    members = newest(article_filter(articles, story_id=story_id), STORY_MEMBERS)
    story = by_id(stories, story_id).select(F.struct("*").alias("story"))
    member = members.select(F.col("story_id").alias("__of"), F.struct(*articles.columns).alias("article"))
    return story.join(member, F.col("story.id") == F.col("__of"), "left").drop("__of").orderBy(F.desc("article.published_at"), "article.id")


def topic_page(log: DataFrame, articles: DataFrame, bursts: DataFrame, topic_id: str, now: int, hours: int | None = None, limit: int = 100) -> DataFrame:
    """A topic's latest matches, each beside its last burst (null without one)."""
    hits = log.filter((F.col("topic_id") == topic_id) & (F.col("matched_at") < now))
    found = topic_feed(hits, articles, topic_id, window_start(now, hours), limit)
    last = bursts.filter(F.col("topic_id") == topic_id).groupBy("topic_id").agg(F.max(F.struct("detected_at", *(c for c in bursts.columns if c not in ("topic_id", "detected_at")))).alias("last_burst"))
    return found.join(last, "topic_id", "left")


def agent_topics(topics: DataFrame) -> DataFrame:
    return topics.select(F.col("id").alias("topic_id"), "name", "query", "enabled").orderBy("name", "topic_id")


def briefs_list(briefs: DataFrame, limit: int | None = None) -> DataFrame:
    return briefs.orderBy(F.desc("generated_at"), "id").limit(clamp_limit(limit, BRIEFS_LISTED))


def latest_brief(briefs: DataFrame) -> DataFrame:
    return briefs_list(briefs, 1)


def stories_of(df: DataFrame) -> DataFrame:
    """Counts and times of every story."""
    return df.filter("story_id is not null").groupBy(F.col("story_id").alias("id")).agg(
        F.count("*").alias("article_count"), F.count_distinct("source_id").alias("source_count"), F.min("fetched_at").alias("first_seen_at"), F.max("fetched_at").alias("last_seen_at")
    )


def snapshot_items(df: DataFrame, now: int) -> DataFrame:
    """The best of the last two days' newest articles, with the tokens they are matched by."""
    pool = newest(article_filter(df, since=now - SNAPSHOT_HOURS * HOUR_MS), SNAPSHOT_POOL)
    return ranked(pool, now).limit(SNAPSHOT_SIZE).select(
        "id", "title", F.col("source_id").alias("source"), F.col("published_at").cast("string").alias("published_at"), "story_id", F.lit(1).alias("source_count"),
        snapshot_tokens("title").alias("tokens"), "rank",
    )


def snapshot(df: DataFrame, now: int) -> DataFrame:
    """One JSON document of the items; bounded by their number."""
    items = snapshot_items(df, now).withColumn("order", F.struct((-F.col("rank.total")).alias("t"), "id"))
    body = F.transform(F.sort_array(F.collect_list(F.struct("order", F.struct("id", "title", "source", "published_at", "story_id", "source_count", "tokens").alias("i")))), lambda x: x["i"])
    doc = F.struct(F.lit(1).alias("version"), F.lit(str(now)).alias("generated_at"), F.lit(SNAPSHOT_TTL_S).alias("ttl_secs"), F.lit(sorted(STOPWORDS)).alias("stopwords"), body.alias("items"))
    return items.agg(F.to_json(doc).alias("json"))


def brief(stories: DataFrame, prose: DataFrame, now: int) -> DataFrame:
    """Items of a brief: the latest stories with the prose written for their place (index from 1).

    ``prose`` has index, summary and why; an entry that was skipped stays with an empty summary.
    """
    from pyspark.sql.window import Window

    top = stories.filter(F.col("last_seen_at") >= now - BRIEF_HOURS * HOUR_MS).orderBy(F.desc("last_seen_at"), "id").limit(BRIEF_STORIES)
    numbered = top.withColumn("index", F.row_number().over(Window.orderBy(F.desc("last_seen_at"), "id")))
    text = F.concat_ws(" ", "summary", "why")
    return numbered.join(prose, "index", "left").select("index", F.col("id").alias("story_id"), F.coalesce("title", F.lit("(untitled)")).alias("title"), F.coalesce(text, F.lit("")).alias("summary"))


def load_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def clock(spark: SparkSession, sf_dir: str) -> int:
    """An hour after the last article: the fixed time of the registered queries."""
    last = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.max("doc_id")).first()[0]
    return EPOCH_MS + (last or 0) * 60_000 + HOUR_MS
