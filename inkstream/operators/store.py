"""Table semantics: idempotent inserts, marks, health, recounts, cascades, retention.

Tables are DataFrames; a write returns the rows to append or the table as it is
afterwards.  Uniqueness is first-writer-wins: a partial-aggregated minimum inside the
batch, then anti-joins against what is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstream.functions.dates import HOUR_MS
from inkstream.functions.scores import backoff_hours
from inkstream.functions.simhash import bands

MAX_LIMIT, DEFAULT_LIMIT = 500, 200
POLL_MS = HOUR_MS
MARKS = {"read": "read_at", "saved": "saved_at", "archived": "archived_at"}


def clamp_limit(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    return min(max(default if limit is None else limit, 1), most)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; rows with a null in the key all stay."""
    rest = [c for c in df.columns if c not in keys]
    named = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    first = named.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("r"))
    first = first.select(*keys, *(F.col(f"r.{c}").alias(c) if c not in keys else F.col(c) for c in rest)).select(df.columns)
    return first.unionByName(df.filter(" or ".join(f"`{k}` is null" for k in keys)))


def insert_new(batch: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is new, one each."""
    return first_of(batch, keys, order).join(stored.select(*keys), keys, "left_anti").select(batch.columns)


def insert_articles(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """New articles: neither their canonical URL nor their source's guid is known (null guids are all distinct)."""
    new = insert_new(batch, stored, ["workspace_id", "canonical_url"], ["fetched_at", "id"])
    return insert_new(new, stored.filter("guid is not null"), ["source_id", "guid"], ["fetched_at", "id"])


def article_bands(articles: DataFrame) -> DataFrame:
    return articles.select("workspace_id", F.col("id").alias("article_id"), F.explode(bands("simhash")).alias("b")).select("workspace_id", "article_id", "b.*")


def mark(articles: DataFrame, ids: DataFrame, kind: str, at: int | None) -> DataFrame:
    """Set a mark to ``at``, or clear it, on the articles in ``ids`` (id)."""
    hit = articles.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return hit.withColumn(MARKS[kind], F.when(F.col("__hit"), F.lit(at).cast("long")).otherwise(F.col(MARKS[kind]))).select(articles.columns)


def assign(articles: DataFrame, assigned: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` (story_id, duplicate_of) by what ``assigned`` (id, column) has."""
    a = assigned.select("id", F.col(column).alias("__new"))
    return articles.join(a, "id", "left").withColumn(column, F.coalesce("__new", column)).select(articles.columns)


def fetch_health(log: DataFrame) -> DataFrame:
    """Health of each source from its fetch log (source_id, at, ok): failures since the last success and the next fetch."""
    last = log.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"), F.max("at").alias("last_fetch_at"))
    since = log.join(last, "source_id").filter(~F.col("ok") & (F.col("last_success_at").isNull() | (F.col("at") > F.col("last_success_at"))))
    n = since.groupBy("source_id").agg(F.count("*").alias("consecutive_failures"))
    out = last.join(n, "source_id", "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))
    wait = F.when(F.col("consecutive_failures") > 0, backoff_hours("consecutive_failures") * HOUR_MS).otherwise(F.lit(POLL_MS))
    return out.withColumn("next_fetch_at", F.col("last_fetch_at") + wait)


def due_sources(sources: DataFrame, now: int, limit: int) -> DataFrame:
    due = sources.filter(F.col("enabled") & (F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= now)))
    return due.orderBy(F.coalesce("next_fetch_at", F.lit(0)), "id").limit(limit)


def recount(articles: DataFrame, stories: DataFrame, drop_empty: bool = False) -> DataFrame:
    """Stories with member counts, outlet counts and last-seen times as articles have them."""
    n = articles.filter("story_id is not null").groupBy(F.col("story_id").alias("id")).agg(
        F.count("*").alias("__n"), F.count_distinct("source_id").alias("__s"), F.max("fetched_at").alias("__at")
    )
    out = stories.join(n, "id", "inner" if drop_empty else "left")
    return out.withColumns(
        {"article_count": F.coalesce("__n", F.lit(0)), "source_count": F.coalesce("__s", F.lit(0)), "last_seen_at": F.coalesce("__at", "last_seen_at")}
    ).select(stories.columns)


def delete_source(tables: dict[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """Tables without a source, its articles, their bands and matches; stories recounted, empty ones gone."""
    gone = tables["articles"].filter(F.col("source_id") == source_id).select(F.col("id").alias("article_id"))
    articles = tables["articles"].filter(F.col("source_id").isNull() | (F.col("source_id") != source_id))
    touched = tables["articles"].filter(F.col("source_id") == source_id).select(F.col("story_id").alias("id")).filter("id is not null").distinct()
    kept = tables["stories"].join(touched, "id", "left_anti")
    changed = recount(articles, tables["stories"].join(touched, "id", "left_semi"), drop_empty=True)
    out = {k: tables[k].join(gone, "article_id", "left_anti") for k in ("matches", "bands") if k in tables}
    return {**tables, **out, "articles": articles, "stories": kept.unionByName(changed), "sources": tables["sources"].filter(F.col("id") != source_id)}


def delete_topic(tables: dict[str, DataFrame], topic_id: str) -> dict[str, DataFrame]:
    return {**tables, "topics": tables["topics"].filter(F.col("id") != topic_id), **{k: tables[k].filter(F.col("topic_id") != topic_id) for k in ("matches", "bursts") if k in tables}}


def purge(tables: dict[str, DataFrame], names: tuple[str, ...]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Empty the named tables; also their row counts, as one DataFrame (table, n)."""
    counts = None
    for name in names:
        n = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return {**tables, **{n: tables[n].limit(0) for n in names}}, counts


PURGE_ARTICLES = ("matches", "bursts", "bands", "articles", "stories", "briefs")
PURGE_SOURCES_AND_TOPICS = ("matches", "bursts", "topics", "sources")


def retained(articles: DataFrame, before: int) -> DataFrame:
    """Articles without those published before a time, saved ones excepted."""
    return articles.filter((F.col("published_at") >= before) | F.col("saved_at").isNotNull())


def grown_stories(stories: DataFrame) -> DataFrame:
    """Followed stories with more outlets than were reported."""
    return stories.filter(F.col("followed") & (F.col("source_count") > F.col("notified_source_count")))


def notified(stories: DataFrame, reported: Column) -> DataFrame:
    """The reported mark only rises."""
    return stories.withColumn("notified_source_count", F.greatest("notified_source_count", reported))


def latest_settings(log: DataFrame) -> DataFrame:
    """Last written settings of each workspace (workspace_id, at, json)."""
    return log.groupBy("workspace_id").agg(F.max_by("json", "at").alias("json"))


#: A workspace's settings, with their types and defaults.
SETTINGS = (
    ("poll_interval_secs", "long", 900), ("brief_time", "string", None), ("brief_timezone", "string", None), ("item_cap", "long", 25), ("dedupe", "string", "standard"),
    ("cluster_window_hours", "long", 72), ("join_threshold", "double", 0.42), ("centroid_k", "long", 20), ("rank_half_life_hours", "double", 12.0), ("burst_z_threshold", "double", 3.0),
    ("burst_min_absolute", "long", 4), ("burst_cooldown_secs", "long", 21600), ("retention_days", "long", 90),
)


def settings_of(blobs: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Every workspace's settings from ``blobs`` (workspace_id, json): a missing field is its default.

    A blob that does not parse, has a field of another type or an unknown ``dedupe``
    counts as absent; a field that is null counts as missing.
    """
    schema = ", ".join(f"{n} {t}" for n, t, _ in SETTINGS) + ", __bad string"
    known = F.coalesce(F.col("s.dedupe").isin("relaxed", "standard", "aggressive"), F.lit(True))
    whole = F.col("s").isNotNull() & F.col("s.__bad").isNull() & known & (F.coalesce("s.poll_interval_secs", F.lit(0)) >= 0) & (F.coalesce("s.item_cap", F.lit(0)) >= 0)
    parsed = blobs.select("workspace_id", F.from_json("json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("s"))
    parsed = parsed.select("workspace_id", F.when(whole, F.col("s")).alias("s"))
    all_ = workspaces.select(F.col("id").alias("workspace_id")).join(parsed, "workspace_id", "left")
    return all_.select("workspace_id", *(F.coalesce(f"s.{n}", F.lit(d).cast(t)).alias(n) for n, t, d in SETTINGS))


def ensure_workspace(workspaces: DataFrame, id_: str, name: str, now: int) -> DataFrame:
    """The workspaces, with the named one if it was not there."""
    one = workspaces.sparkSession.createDataFrame([(id_, name.strip(), now)], "id string, name string, created_at long")
    return workspaces.unionByName(one.join(workspaces.select("id"), "id", "left_anti").select("id", "name", "created_at"))


def create_sources(new: DataFrame, stored: DataFrame, now: int) -> DataFrame:
    """Sources whose feed is not subscribed to in their workspace yet, due at once."""
    due = new.withColumn("next_fetch_at", F.lit(now).cast("long"))
    return insert_new(due, stored, ["workspace_id", "feed_url"], ["title"])


def create_topics(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Topics whose name is free in their workspace."""
    return insert_new(new, stored, ["workspace_id", "name"], ["id"])


def open_stories(firsts: DataFrame, now: int) -> DataFrame:
    """A story around each first member (workspace_id, story_id, shingles, entities, source_id): born with its outlet reported."""
    return firsts.select(
        F.col("story_id").alias("id"), "workspace_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("summary"), F.sort_array("shingles").alias("centroid_shingles"),
        F.lit(1).cast("long").alias("centroid_member_count"), F.sort_array("entities").alias("entities"), F.lit(1).cast("long").alias("article_count"), F.lit(1).cast("long").alias("source_count"),
        F.lit(1).cast("long").alias("notified_source_count"), F.lit(False).alias("followed"), F.lit(now).cast("long").alias("first_seen_at"), F.lit(now).cast("long").alias("last_seen_at"),
    )


def set_prose(stories: DataFrame, prose: DataFrame) -> DataFrame:
    """Stories with the title and summary that ``prose`` (id, title, summary) has for them; its nulls change nothing."""
    new = prose.select("id", F.col("title").alias("__title"), F.col("summary").alias("__summary"))
    out = stories.join(new, "id", "left")
    return out.withColumns({"title": F.coalesce("__title", "title"), "summary": F.coalesce("__summary", "summary")}).select(stories.columns)


def set_followed(stories: DataFrame, ids: DataFrame, followed: bool) -> DataFrame:
    hit = stories.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return hit.withColumn("followed", F.when(F.col("__hit"), F.lit(followed)).otherwise(F.col("followed"))).select(stories.columns)


BURST_ARTICLES = 10


def record_bursts(verdicts: DataFrame, log: DataFrame, workspace: str, now: int) -> DataFrame:
    """Rows of the burst log for the verdicts that fired, each with its hour's latest articles."""
    fired = verdicts.filter("verdict = 'burst'")
    hour = log.filter((F.col("matched_at") >= now - HOUR_MS) & (F.col("matched_at") < now)).join(fired.select("topic_id"), "topic_id")
    nth = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("matched_at"), "article_id"))
    latest_ = hour.withColumn("n", nth).filter(F.col("n") <= BURST_ARTICLES).groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "article_id"))), lambda x: x["article_id"]).alias("article_ids"))
    return fired.join(latest_, "topic_id", "left").select(
        F.concat(F.lit("bst_"), F.sha2(F.concat_ws("\n", "topic_id", F.lit(str(now))), 256)).alias("id"), F.lit(workspace).alias("workspace_id"), "topic_id", F.col("z").alias("z_score"), F.col("count").alias("match_count"),
        F.col("mean").alias("baseline_mean"), F.col("stdev").alias("baseline_stdev"), "hour_of_day", "article_ids", F.lit(now).cast("long").alias("detected_at"),
    )


def record_brief(items: DataFrame, workspace: str, now: int, trigger: str = "manual") -> DataFrame:
    """The row of a brief from its items (index, story_id, title, summary, and sources if there are any); bounded by their number."""
    sources = "sources" if "sources" in items.columns else F.array().cast("array<struct<article_id:string,source:string,url:string>>").alias("sources")
    listed = items.select("index", F.struct("story_id", "title", "summary", sources).alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "i"))), lambda x: x["i"]).alias("items"))
    return listed.select(
        F.concat(F.lit("br_"), F.sha2(F.lit(f"{workspace}\n{now}"), 256)).alias("id"), F.lit(workspace).alias("workspace_id"), F.lit(now).cast("long").alias("generated_at"), F.lit(trigger).alias("trigger_kind"),
        F.size("items").cast("long").alias("story_count"), F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + F.size(x["sources"])).alias("article_count"), "items",
    )


def events(bursts: DataFrame, topics: DataFrame, grown: DataFrame, briefs: DataFrame) -> DataFrame:
    """(event, payload): what a pass has to tell, as a table to deliver from."""
    b = bursts.join(topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic")), "topic_id", "left")
    breaking = F.struct("topic_id", "topic", F.col("match_count").alias("count"), "z_score", "baseline_mean", "hour_of_day", "article_ids", F.col("id").alias("burst_id"), "detected_at")
    growing = F.struct(F.col("id").alias("story_id"), "title", "source_count", F.col("notified_source_count").alias("previous_source_count"), "article_count")
    ready = F.struct(F.col("id").alias("brief_id"), "story_count", "article_count", "generated_at")
    told = lambda df, name, payload: df.select(F.lit(name).alias("event"), F.to_json(payload).alias("payload"))
    return told(b, "topic.breaking", breaking).unionByName(told(grown, "story.developing", growing)).unionByName(told(briefs, "brief.ready", ready))


def rename(table: DataFrame, id_: str, **values) -> DataFrame:
    """Edit columns of one row."""
    return table.withColumns({k: F.when(F.col("id") == id_, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return purge(tables, tuple(sorted(tables)))[1]


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """Last row of each key, the smaller id at ties."""
    w = Window.partitionBy(key).orderBy(F.desc(at), "id")
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def brief_due(workspaces: DataFrame, briefs: DataFrame, now: int, due_at: Column) -> DataFrame:
    """Workspaces (id) whose brief time today has come and whose latest brief is older than it."""
    last = briefs.groupBy(F.col("workspace_id").alias("id")).agg(F.max("generated_at").alias("__last"))
    d = workspaces.join(last, "id", "left").withColumn("due_at", due_at)
    return d.filter((F.col("due_at") <= now) & (F.col("__last").isNull() | (F.col("__last") < F.col("due_at")))).drop("__last")


def ingest_report(log: DataFrame) -> DataFrame:
    """Counters of a pass from its log (source_id, ok, items, inserted, duplicates)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return log.agg(F.count("*").alias("polled"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), total("items"), total("inserted"), total("duplicates"))
