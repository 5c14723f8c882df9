"""Registered queries of the service's reads, writes, passes and formats, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.functions import dates, markup, scores, text
from inkstream.functions.dates import HOUR_MS
from inkstream.operators import bursts, clustering, store
from inkstream.plans import reads, topics
from inkstream.queries import _BASE, _DOCS, _HAS, _LOG, ARTICLES, TOKENS, TOPICS, _log, _log_now, _sources, query, stored, table
from inkstream.sources import feeds, opml
from inkstream.streaming import passes

NONE_ARRAY = "array<string>"
_STORIES = "st as (select story_id as id, count(*) as article_count, count(distinct source_id) as source_count, min(fetched_at) as first_seen_at, max(fetched_at) as last_seen_at from art group by story_id)"


# reads of stories, topics and briefs


@query(f"with {ARTICLES}, {_STORIES} select id, article_count, last_seen_at from st where last_seen_at >= (select now from clock) - 7200000 order by last_seen_at desc, id limit 200")
def stories_list(spark, d):
    a, now = reads.load_articles(spark, d), reads.clock(spark, d)
    return reads.stories_list(reads.stories_of(a), reads.window_start(now, 2)).select("id", "article_count", "last_seen_at")


@query(
    f"with {ARTICLES}, {_STORIES}, m as (select * from art where story_id = 'src1-en' and archived_at is null order by published_at desc, id limit 100) "
    "select st.id as story_id, article_count, source_count, m.id as article_id, title, published_at from st left join m on m.story_id = st.id where st.id = 'src1-en'"
)
def story_page(spark, d):
    a = reads.load_articles(spark, d)
    page = reads.story_page(reads.stories_of(a), a, "src1-en")
    return page.select(F.col("story.id").alias("story_id"), "story.article_count", "story.source_count", F.col("article.id").alias("article_id"), "article.title", "article.published_at")


_FIRED = "fired as (select topic_id, matched_at as detected_at, article_id::varchar as id, article_id % 7 / 2.0 as z_score from log where article_id % 50 = 0)"


def _fired(log: DataFrame) -> DataFrame:
    return log.filter("article_id % 50 = 0").select("topic_id", F.col("matched_at").alias("detected_at"), F.col("article_id").cast("string").alias("id"), (F.col("article_id") % 7 / 2.0).alias("z_score"))


@query(
    f"with {_LOG}, {ARTICLES.replace('clock as', 'unused as')}, {_FIRED}, last as (select topic_id, max(detected_at) as detected_at, arg_max(id, (detected_at, id)) as id, arg_max(z_score, (detected_at, id)) as z from fired group by topic_id), "
    "h as (select topic_id, article_id, matched_at from log join art on art.id = article_id where topic_id = 'click' and matched_at >= (select now from clock) - 31536000000 order by matched_at desc, article_id limit 100) "
    "select h.topic_id, article_id, matched_at, last.id as burst_id, detected_at, z as z_score from h left join last using (topic_id)"
)
def topic_page(spark, d):
    log = _log(spark, d)
    page = reads.topic_page(log, reads.load_articles(spark, d), _fired(log), "click", _log_now(log), 100_000)
    return page.select("topic_id", "article_id", "matched_at", F.col("last_burst.id").alias("burst_id"), "last_burst.detected_at", "last_burst.z_score")


@query("select unnest([1, 1, 168, 2160, 8760, 8760]) as hours, unnest(['low', 'zero', 'none', 'agent', 'year', 'high']) as asked")
def window_clamps(spark, d):
    asked = {"low": (-5, reads.READ_HOURS), "zero": (0, reads.READ_HOURS), "none": (None, reads.READ_HOURS), "agent": (9999, reads.AGENT_HOURS), "year": (8760, reads.READ_HOURS), "high": (100_000, reads.READ_HOURS)}
    rows = [(-reads.window_start(0, h, bounds=b) // HOUR_MS, name) for name, (h, b) in asked.items()]
    return spark.createDataFrame(rows, "hours int, asked string")


@query(f"with {ARTICLES} select id, published_at from (select *, case when lang = 'de' then null else story_id end as s from art) where s is null order by published_at, id limit 200")
def unclustered_scan(spark, d):
    a = reads.load_articles(spark, d).withColumn("story_id", F.when(F.col("lang") != "de", F.col("story_id")))
    return reads.unclustered(a, clustering.PENDING).select("id", "published_at")


@query(f"with {ARTICLES}, {_STORIES} select id, last_seen_at from st where last_seen_at >= (select now from clock) - 72 * 3600000")
def candidate_stories(spark, d):
    a, now = reads.load_articles(spark, d), reads.clock(spark, d)
    return reads.candidate_stories(reads.stories_of(a), now - scores.CLUSTER_WINDOW_HOURS * HOUR_MS).select("id", "last_seen_at")


@query(f"with {_LOG} select matched_at from log where topic_id = 'view' and matched_at >= (select now from clock) - 86400000 and matched_at < (select now from clock)")
def match_times(spark, d):
    log = _log(spark, d)
    now = _log_now(log)
    return reads.match_times(log, "view", now - 24 * HOUR_MS, now)


@query(f"with {ARTICLES} select id, title, lang from art where id = 7")
def point_lookup(spark, d):
    return reads.by_id(reads.load_articles(spark, d), 7).select("id", "title", "lang")


_BRIEFS = "br as (select source_id || '-' || lang as id, source_id as workspace_id, max(published_at) as generated_at from art group by source_id, lang)"


def _briefs(spark, d):
    a = reads.load_articles(spark, d)
    return a.groupBy(F.concat_ws("-", "source_id", "lang").alias("id"), F.col("source_id").alias("workspace_id")).agg(F.max("published_at").alias("generated_at"))


@query(f"with {ARTICLES}, {_BRIEFS} select id, generated_at from br order by generated_at desc, id limit 30")
def briefs_list(spark, d):
    return reads.briefs_list(_briefs(spark, d)).select("id", "generated_at")


@query(f"with {ARTICLES}, {_BRIEFS} select id, generated_at from br order by generated_at desc, id limit 1")
def brief_latest(spark, d):
    return reads.latest_brief(_briefs(spark, d)).select("id", "generated_at")


def _topics(spark, d) -> DataFrame:
    return spark.createDataFrame([(f"tp_{k}", "default", k, q, k != "quiet") for k, q in sorted(TOPICS.items())], "id string, workspace_id string, name string, query string, enabled boolean")


_TOPIC_ROWS = "tp as (select 'tp_' || unnest({0}) as id, unnest({0}) as name, unnest({1}) as query, unnest({0}) <> 'quiet' as enabled)".format(
    str(sorted(TOPICS)), "[" + ", ".join("'" + TOPICS[k].replace("'", "''") + "'" for k in sorted(TOPICS)) + "]"
)


@query(f"with {_TOPIC_ROWS} select id as topic_id, name, query, enabled from tp")
def agent_topics(spark, d):
    return reads.agent_topics(_topics(spark, d))


# writes


@query("select n_name as id, n_name as name, n_nationkey::bigint as created_at from nation where n_nationkey > 0 union all select 'mine', 'My news', 5 union all select min(n_name), 'again', 9 from nation where n_nationkey = 0")
def ensure_workspace(spark, d):
    have = table(spark, d, "nation").filter("n_nationkey > 0").select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("created_at"))
    first = table(spark, d, "nation").filter("n_nationkey = 0").select(F.min("n_name")).first()[0]
    known = have.orderBy("id").first().id
    out = store.ensure_workspace(have, "mine", " My news ", 5)
    return store.ensure_workspace(store.ensure_workspace(out, first, "again", 9), known, "known already", 9)


@query("select distinct 'https://' || source || '.test/rss' as feed_url, 'Feed ' || source as title, 77::bigint as next_fetch_at from documents where source not in (select min(source) from documents)")
def sources_create(spark, d):
    s = table(spark, d, "documents").select(F.lit("default").alias("workspace_id"), F.concat(F.lit("https://"), "source", F.lit(".test/rss")).alias("feed_url"), F.concat(F.lit("Feed "), "source").alias("title"))
    have = s.agg(F.min("feed_url").alias("feed_url")).withColumn("workspace_id", F.lit("default"))
    return store.create_sources(s, have, 77).select("feed_url", "title", "next_fetch_at")


@query(f"with {_TOPIC_ROWS} select id, name from tp where name <> 'german'")
def topics_create(spark, d):
    t = _topics(spark, d)
    twice = t.unionByName(t.withColumn("id", F.concat("id", F.lit("-again"))))
    return store.create_topics(twice, t.filter("name = 'german'")).select("id", "name")


@query(f"with {ARTICLES} select id, case when lang = 'fr' then 'st_french' else story_id end as story_id from art")
def assign_story(spark, d):
    a = reads.load_articles(spark, d)
    return store.assign(a, a.filter("lang = 'fr'").select("id", F.lit("st_french").alias("story_id")), "story_id").select("id", "story_id")


@query(f"with {ARTICLES} select a.id, coalesce(case when b.lang <> 'es' then b.story_id end, a.story_id) as story_id from art a left join art b on a.id % 3 = 0 and b.id = a.id - a.id % 9")
def duplicate_stories(spark, d):
    a = reads.load_articles(spark, d)
    a = a.withColumns({"duplicate_of": F.when(F.col("id") % 3 == 0, F.col("id") - F.col("id") % 9)})
    theirs = a.select(F.col("id").alias("duplicate_of"), F.when(F.col("lang") != "es", F.col("story_id")).alias("theirs"))
    own = a.select("id", "duplicate_of", "story_id")
    joined = own.join(theirs, "duplicate_of", "left").select("id", F.coalesce("theirs", "story_id").alias("story_id"))
    return joined


@query(f"with {ARTICLES}, {_STORIES} select id, greatest(3, article_count) as notified from st")
def notified_watermark(spark, d):
    s = reads.stories_of(reads.load_articles(spark, d)).withColumn("notified_source_count", F.lit(3).cast("long"))
    return store.notified(s, F.col("article_count")).select("id", F.col("notified_source_count").alias("notified"))


@query(f"with {_LOG} select topic_id, count(*) as n from log where topic_id <> 'click' group by topic_id")
def delete_topic(spark, d):
    log = _log(spark, d)
    left = store.delete_topic({"topics": log.select(F.col("topic_id").alias("id")).distinct(), "matches": log}, "click")
    return left["matches"].join(left["topics"], F.col("topic_id") == F.col("id"), "left_semi").groupBy("topic_id").agg(F.count("*").alias("n"))


@query("select 'articles' as \"table\", count(*) as n, 0::bigint as left from documents union all select 'matches', count(*), 0 from events union all select 'stories', count(distinct source || lang), 0 from documents")
def purge_articles(spark, d):
    a = reads.load_articles(spark, d)
    tables = {"articles": a, "matches": _log(spark, d), "stories": reads.stories_of(a)}
    after, counts = store.purge(tables, tuple(n for n in store.PURGE_ARTICLES if n in tables))
    left = reduce(DataFrame.unionByName, (after[n].agg(F.count("*").alias("left")).select(F.lit(n).alias("table"), "left") for n in tables))
    return counts.join(left, "table")


@query(f"with {_TOPIC_ROWS} select id, case when id = 'tp_apache' then 'Apache' else name end as name, case when id = 'tp_apache' then false else enabled end as enabled from tp")
def topic_edit(spark, d):
    return store.rename(_topics(spark, d), "tp_apache", name="Apache", enabled=False).select("id", "name", "enabled")


@query(
    f"with {ARTICLES}, f as (select source_id, min(id) as id from art group by source_id) select 'st_' || id as id, case when id % 2 = 0 then 'Story ' || id end as title, 1::bigint as source_count, 1::bigint as notified_source_count, "
    "source_id = 'src2' as followed, 5::bigint as last_seen_at, 2::bigint as members from f"
)
def stories_open(spark, d):
    a = reads.load_articles(spark, d)
    f = a.groupBy("source_id").agg(F.min("id").alias("id")).withColumns({"story_id": F.concat(F.lit("st_"), F.col("id").cast("string")), "workspace_id": F.lit("default")})
    f = f.withColumns({"shingles": F.array("source_id"), "entities": F.array().cast(NONE_ARRAY)})
    s = store.open_stories(f, 5)
    s = store.set_prose(s, f.filter("id % 2 = 0").select(F.col("story_id").alias("id"), F.concat(F.lit("Story "), F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("summary")))
    s = store.set_followed(s, f.filter("source_id = 'src2'").select(F.col("story_id").alias("id")), True)
    folded = clustering.fold_members(s, f.select("story_id", F.lit(1).cast("long").alias("published_at"), "id", "shingles", "entities"))
    return folded.select("id", "title", "source_count", "notified_source_count", "followed", "last_seen_at", F.col("centroid_member_count").alias("members"))


_SETTING = """case n_nationkey % 6 when 0 then '{"item_cap": ' || n_nationkey || '}' when 1 then 'broken{' when 2 then '{"dedupe": "aggressive", "join_threshold": 0.5, "else": 1}' when 3 then '{"dedupe": "wild", "item_cap": 3}' when 4 then '{"item_cap": "x"}' else '{}' end"""


@query(
    "select n_name as workspace_id, case when n_nationkey % 6 = 0 then n_nationkey::bigint else 25 end as item_cap, case when n_nationkey % 6 = 2 then 'aggressive' else 'standard' end as dedupe, "
    "case when n_nationkey % 6 = 2 then 0.5 else 0.42 end::double as join_threshold, 90::bigint as retention_days, null::varchar as brief_time from nation"
)
def settings_read(spark, d):
    n = table(spark, d, "nation")
    blobs = n.filter("n_nationkey < 20").select(F.col("n_name").alias("workspace_id"), F.expr(_SETTING).alias("json"))
    late = n.filter("n_nationkey >= 20").select(F.col("n_name").alias("workspace_id"), F.expr(_SETTING).alias("json"))
    s = store.settings_of(blobs.unionByName(late), n.select(F.col("n_name").alias("id")))
    return s.select("workspace_id", "item_cap", "dedupe", "join_threshold", "retention_days", "brief_time")


@query(
    f"with {_BASE}, v as (select topic_id, n, (n - mean) / greatest(stdev, 1.0) as z from s join h using (topic_id) where n >= 1), r as (select topic_id, article_id, row_number() over (partition by topic_id order by matched_at desc, article_id) as k "
    "from log, clock where matched_at >= now - 3600000 and matched_at < now) select v.topic_id, v.n as match_count, round(z, 9) as z_score, (select string_agg(article_id, ',' order by k) from r where r.topic_id = v.topic_id and k <= 10) as article_ids from v where z >= -9"
)
def burst_record(spark, d):
    log = _log(spark, d)
    now = _log_now(log)
    none = log.select("topic_id", F.col("matched_at").alias("detected_at")).limit(0)
    verdicts = bursts.detect(log, log.select("topic_id").distinct(), none, now, z_threshold=-9.0, min_absolute=1)
    b = store.record_bursts(verdicts, log, "default", now)
    return b.select("topic_id", "match_count", F.round("z_score", 9).alias("z_score"), F.array_join("article_ids", ",").alias("article_ids"))


@query(f"with {ARTICLES}, t as (select story_id, count(*) as n from art group by story_id order by story_id limit 12) select count(*) as story_count, sum(n)::bigint as article_count, min(story_id) as first_story from t")
def brief_record(spark, d):
    a = reads.load_articles(spark, d).groupBy("story_id").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("article_id"), F.col("source_id").alias("source"), F.lit("u").alias("url"))).alias("sources"))
    items = a.orderBy("story_id").limit(reads.BRIEF_STORIES).select(F.col("story_id").alias("index"), "story_id", F.lit("(untitled)").alias("title"), F.lit("").alias("summary"), "sources")
    b = store.record_brief(items, "default", 9)
    return b.select("story_count", "article_count", F.element_at("items", 1)["story_id"].alias("first_story"))


@query(
    f"with {_BASE}, {ARTICLES.replace('clock as', 'unused as')}, {_STORIES}, v as (select topic_id, n, (n - mean) / greatest(stdev, 1.0) as z from s join h using (topic_id) where n >= 1) "
    "select 'topic.breaking' as event, topic_id as id, n::varchar as count from v where z >= -9 union all select 'story.developing', id, article_count::varchar from st where source_count > 0 and article_count % 2 = 0"
)
def events_emitted(spark, d):
    log = _log(spark, d)
    now = _log_now(log)
    none = log.select("topic_id", F.col("matched_at").alias("detected_at")).limit(0)
    fired = store.record_bursts(bursts.detect(log, log.select("topic_id").distinct(), none, now, z_threshold=-9.0, min_absolute=1), log, "default", now)
    s = reads.stories_of(reads.load_articles(spark, d)).withColumns({"title": F.lit(None).cast("string"), "followed": F.col("article_count") % 2 == 0, "notified_source_count": F.lit(0)})
    briefs = spark.createDataFrame([], "id string, story_count long, article_count long, generated_at long")
    names = log.select(F.col("topic_id").alias("id"), F.col("topic_id").alias("name")).distinct()
    e = store.events(fired, names, store.grown_stories(s), briefs)
    get = lambda *paths: F.coalesce(*(F.get_json_object("payload", f"$.{p}") for p in paths))
    return e.select("event", get("topic_id", "story_id").alias("id"), get("count", "article_count").alias("count"))


# passes


@query(
    f"with {ARTICLES}, n as (select * from art where archived_at is null and published_at >= (select now from clock) - 86400000 and id % 5 <> 0 order by published_at desc, id limit 500), "
    f"docs as (select id, source_id, {TOKENS.format('title')} as t, {TOKENS.format('body')} as b from n), m as (select 'license' as topic_id, id from docs where {_HAS.format('license')} union all select 'quiet', id from docs where not {_HAS.format('the')}) "
    "select topic_id, id as article_id, (select now from clock) as matched_at from m where not (topic_id = 'license' and id % 2 = 0)"
)
def match_pass(spark, d):
    now = reads.clock(spark, d)
    a = reads.load_articles(spark, d).withColumns({"content": F.col("body"), "duplicate_of": F.when(F.col("id") % 5 == 0, 1), **{c: F.lit(None).cast("string") for c in ("summary", "author", "url")}})
    known = a.filter("id % 2 = 0").select(F.lit("license").alias("topic_id"), F.col("id").alias("article_id"))
    wanted = {"license": topics.parse("license"), "quiet": topics.parse("NOT the")}
    return passes.match_pass(a, wanted, known, now).select("topic_id", "article_id", "matched_at")


def _bodies(spark, d, kind: str = "rss") -> DataFrame:
    """A feed of each source's documents in one of the formats."""
    key, at = F.col("doc_id").cast("string"), dates.to_rfc3339(F.lit(reads.EPOCH_MS) + F.col("doc_id") * 60_000)
    t, link = F.concat(F.lit("t"), key), F.concat(F.lit("https://n.test/"), key)
    item = {
        "rss": F.concat(F.lit("<item><title>"), t, F.lit("</title><link>"), link, F.lit("</link><guid>g"), key, F.lit("</guid><pubDate>"), at, F.lit("</pubDate></item>")),
        "atom": F.concat(F.lit('<a:entry><a:title type="html">'), t, F.lit(' &amp;amp; &amp;#233;</a:title><a:link rel="self" href="x"/><a:link href="'), link, F.lit('"/><a:updated>'), at, F.lit("</a:updated><a:author><a:name>Jo</a:name></a:author></a:entry>")),
        "rdf": F.concat(F.lit('<item rdf:about="'), link, F.lit('"><title><![CDATA['), t, F.lit("]]></title><link>"), link, F.lit("</link><dc:date>"), at, F.lit("</dc:date><dc:creator>Jo</dc:creator></item>")),
        "json": F.to_json(F.struct(F.col("doc_id").alias("id"), link.alias("external_url"), t.alias("title"), F.lit("<p>a</p><p>b</p>").alias("content_html"), at.alias("date_modified"), F.array(F.struct(F.lit("Jo").alias("name"))).alias("authors"))),
    }[kind]
    head, tail, joint = {
        "rss": ("<?xml version='1.0'?><rss version='2.0'><channel><title>x</title>", "</channel></rss>", ""),
        "atom": ('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>x</a:title>', "</a:feed>", ""),
        "rdf": ("<rdf:RDF><channel><title>x</title></channel>", "</rdf:RDF>", ""),
        "json": ('﻿{"version":"1.1","title":"x","items":[', "]}", ","),
    }[kind]
    first = table(spark, d, "documents").select("source", "doc_id", item.alias("i"), F.row_number().over(_by_source()).alias("n")).filter(F.col("n") <= feeds.MAX_ITEMS)
    x = first.groupBy(F.col("source").alias("feed_key")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "i"))).alias("x"))
    return x.select("feed_key", F.concat(F.lit(head), F.array_join(F.transform("x", lambda v: v["i"]), joint), F.lit(tail)).alias("body"))


def _by_source():
    from pyspark.sql.window import Window

    return Window.partitionBy("source").orderBy(F.asc_nulls_last("doc_id"))


_ITEMS = "it as (select * from (select source, doc_id, row_number() over (partition by source order by doc_id) as n from documents) where n <= 500)"
_WANTED = "t3 OR t17 OR t101 OR t999 OR t150"


@query(
    f"with {_ITEMS}, clock as (select max(doc_id) as top from documents), c as (select (select count(*) from it) as n, (select count(*) from (select doc_id from it, clock where doc_id >= top - 1380 order by doc_id desc limit 500) where doc_id in (3, 17, 101, 999, 150)) as m) "
    "select 'stories_opened' as counter, least(n, 200) as n from c union all select 'stories_joined', 0 from c union all select 'topic_matches', m from c union all select 'bursts', 0 from c union all select 'articles_new', n from c union all select 'duplicates', 0 from c"
)
def service_pass(spark, d):
    """Counters of a whole pass over empty tables: every title is one token of its own, so nothing joins."""
    now = reads.clock(spark, d)
    out = passes.service_pass(passes.empty_tables(spark), _bodies(spark, d), {"some": topics.parse(_WANTED)}, now, stored(spark))
    return out["report"]


@query(f"with {_ITEMS}, one as (select * from it where source = 'src1'), c as (select count(*) as n from one) select 'articles' as name, n from c union all select 'stories', least(n, 200) from c union all select 'matches', count(*) from one, (select max(doc_id) as top from documents) where doc_id in (3, 17, 101, 999, 150) and doc_id >= top - 1380")
def source_refresh(spark, d):
    now = reads.clock(spark, d)
    body = _bodies(spark, d).filter("feed_key = 'src1'")
    out = passes.refresh_source(passes.empty_tables(spark), body, {"some": topics.parse(_WANTED)}, now, stored(spark))
    return reduce(DataFrame.unionByName, (out[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("articles", "stories", "matches")))


@query("select 0::bigint as added, count(*) as stored from (select source, row_number() over (partition by source order by doc_id) as n from documents) where n <= 500")
def ingest_replay(spark, d):
    """The same bodies again, an hour later, add nothing."""
    now = reads.clock(spark, d)
    first = stored(spark)("articles", passes.shaped(passes.ingest(_bodies(spark, d), passes.empty_tables(spark)["articles"], now), passes.ARTICLE))
    again = passes.ingest(_bodies(spark, d), first, now + HOUR_MS)
    both = again.select(F.lit(1).alias("added"), F.lit(0).alias("stored")).unionByName(first.select(F.lit(0).alias("added"), F.lit(1).alias("stored")))
    return both.agg(F.sum("added").alias("added"), F.sum("stored").alias("stored"))


@query("select doc_id as id, 1.0::double as recency from documents")
def rank_future_items(spark, d):
    """Items dated after now are as recent as can be."""
    a = reads.load_articles(spark, d)
    r = scores.rank_factors(F.col("published_at") + F.lit(10**12), F.lit(1), F.lit(0), F.lit(False), F.lit(reads.EPOCH_MS))
    return a.select("id", r["recency"].alias("recency"))


@query(f"with {ARTICLES} select count(*) as n, count(*) as holds from art")
def rank_factors_hold(spark, d):
    a, now = reads.load_articles(spark, d), reads.clock(spark, d)
    r = a.select(scores.rank_factors("published_at", F.lit(5), F.lit(2), F.col("read_at").isNotNull(), F.lit(now)).alias("r"))
    return r.agg(F.count("*").alias("n"), F.count_if(scores.factors_hold(F.col("r"))).alias("holds"))


# formats


def _feed_rows(kind: str):
    title = "'t' || doc_id || ' & é'" if kind == "atom" else "'t' || doc_id"
    named = {"atom": "atom", "rdf": "rss", "json": "json_feed"}[kind]
    content = "'a' || chr(10) || chr(10) || 'b'" if kind == "json" else "null::varchar"
    return (
        f"with {_ITEMS} select source as feed_key, '{named}' as kind, n - 1 as position, 'https://n.test/' || doc_id as url, {title} as title, 'Jo' as author, {content} as content, 1704067200000 + doc_id * 60000 as published_at, "
        "false as truncated, null::varchar as error from it"
    )


def _read(spark, d, kind: str) -> DataFrame:
    items = feeds.read_feeds(_bodies(spark, d, kind), 0)
    return items.select("feed_key", "kind", F.col("position").cast("long").alias("position"), "url", "title", "author", "content", "published_at", "truncated", "error")


@query(_feed_rows("atom"))
def feed_atom(spark, d):
    return _read(spark, d, "atom")


@query(_feed_rows("rdf"))
def feed_rdf(spark, d):
    return _read(spark, d, "rdf")


@query(_feed_rows("json"))
def feed_json(spark, d):
    return _read(spark, d, "json")


@query(
    f"with {_ITEMS}, k as (select source, max(n) as n, least(max(n), 3) as whole from it group by source) select source as feed_key, case when ends_with(source, '1') then 0 else whole end as items, "
    "case when ends_with(source, '1') then null else true end as truncated, case when ends_with(source, '1') then 'unknown_format' end as error from k"
)
def feed_truncated(spark, d):
    """Bodies cut in the fourth item keep three; those of an unknown root are errors."""
    cut = F.concat(F.substring_index("body", "<item>", 4), F.lit("<item><title>cut"))
    b = _bodies(spark, d).withColumn("body", F.when(F.col("feed_key").endswith("1"), F.replace("body", F.lit("rss"), F.lit("other"))).otherwise(cut))
    items = feeds.read_feeds(b, 0).filter("error is not null or url is not null")
    return items.groupBy("feed_key").agg(F.count("url").cast("long").alias("items"), F.max("truncated").alias("truncated"), F.max("error").alias("error"))


_BAD = {"empty": "﻿  ", "unknown_format": "<html></html>", "json": "{broken", "malformed": "<rss>" + "<a>" * 70, "cut": "<rss><channel><ti"}


@query("select unnest(['empty', 'unknown_format', 'json', 'malformed', 'cut']) as feed_key, unnest(['empty', 'unknown_format', 'json', 'malformed', 'malformed']) as error")
def feed_errors(spark, d):
    return feeds.read_feeds(spark.createDataFrame(list(_BAD.items()), "feed_key string, body string"), 0).select("feed_key", "error")


@query("select distinct 'https://' || source || '.test/rss?a=1&b=2' as feed_url, 'Feed & ' || source as title from documents where source <> 'src3'")
def opml_subscribe(spark, d):
    found = opml.outlines(opml.export(_sources(spark, d)))
    return opml.import_sources(found, _sources(spark, d).filter("id = 'src3'"), "default").select("feed_url", "title")


@query("select event_id, chr((event_id % 2000 + 65)::int) || chr((event_id % 2000 + 65)::int) || '&#xD800;&nope;€' as decoded from events where event_id % 2000 + 65 not between 127 and 160")
def decode_numbers(spark, d):
    e = table(spark, d, "events").withColumn("code", F.col("event_id") % 2000 + 65).filter("not code between 127 and 160")
    written = F.concat(F.lit("&#"), F.col("code").cast("string"), F.lit(";&#x"), F.hex("code"), F.lit(";&#xD800;&nope;&euro;"))
    return e.select("event_id", markup.decode_references_udf(written).alias("decoded"))


@query(
    "select event_id, case event_id % 4 when 3 then null else epoch_us(ts) // 1000000 * 1000 - case event_id % 4 when 0 then 7200000 else 0 end end as parsed from events"
)
def dates_mail(spark, d):
    """RFC 2822 dates with an offset, a zone's name and a comment; the last kind is none."""
    at = F.date_format("ts", "d MMM yyyy HH:mm:ss")
    written = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Mon, "), at, F.lit(" +0200"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Tue, "), at, F.lit(" GMT"))).when(F.col("event_id") % 4 == 2, F.concat(at, F.lit(" +0000 (comment)")))
    return table(spark, d, "events").select("event_id", dates.parse_date(F.coalesce(written, F.lit("no date"))).alias("parsed"))


@query("select unnest(['Europe/Berlin', 'UTC', 'UTC']) as zone, unnest(['Europe/Berlin', 'Mars/Base', 'none']) as asked")
def zones_resolved(spark, d):
    return spark.createDataFrame([(dates.resolve_tz(None if z == "none" else z), z) for z in ("Europe/Berlin", "Mars/Base", "none")], "zone string, asked string")


@query(f"with {_DOCS} select doc_id from docs where ({_HAS.format('license')} or {_HAS.format('token')}) and not {_HAS.format('der')}")
def query_ast_roundtrip(spark, d):
    import json

    from inkstream.queries import _documents

    node = topics.Node.from_dict(json.loads(json.dumps(topics.parse("(license OR token) -der").to_dict())))
    return _documents(spark, d).filter(topics.matches(node)).select("doc_id")


_WRONG = {"": 1, '"open': 1, "bad:x": 1, "(a OR b": 1, "a )": 3, "a OR": 5}


@query("select unnest([{}]) as written, true as refused".format(", ".join("'" + w + "'" for w in _WRONG)))
def query_errors(spark, d):
    def refused(q: str) -> bool:
        try:
            topics.parse(q)
        except topics.QueryParseError as e:
            return e.column >= 1
        return False

    return spark.createDataFrame([(q, refused(q)) for q in _WRONG], "written string, refused boolean")


_BOTH = "coalesce(title, '') || ' ' || coalesce(body, '')"


@query(
    f"with {ARTICLES}, x as (select id, {TOKENS.format(_BOTH)} as w, list_distinct({TOKENS.format('title')}) as t from art) "
    "select id, len(t) as n_title, case when len(w) < 3 then len(list_distinct(w)) else len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) end as n_shingles from x"
)
def cluster_features(spark, d):
    f = clustering.features(reads.load_articles(spark, d))
    return f.select("id", F.size("title_tokens").cast("long").alias("n_title"), F.size("shingles").cast("long").alias("n_shingles"))


@query(
    "select 'burst' as verdict, null::bigint as hours_remaining, 'fresh' as asked union all select 'cooling', 4, 'recent' union all select 'burst', null, 'expired' union all select 'not_enough_history', null, 'young' union all select 'quiet', null, 'small'"
)
def burst_verdicts_all(spark, d):
    hour = HOUR_MS
    rows = [("fresh", 9, 7, None), ("recent", 9, 7, 100 * hour - 2 * hour - 1), ("expired", 9, 7, 100 * hour - 6 * hour), ("young", 9, 4, None), ("small", 3, 7, None)]
    t = spark.createDataFrame(rows, "asked string, n long, samples int, last long")
    v = scores.burst_verdict("n", F.col("samples"), F.lit(0.0), F.lit(0.0), "last", F.lit(100 * hour))
    return t.select(v.alias("v"), "asked").select("v.verdict", "v.hours_remaining", "asked")


@query(
    f"with {ARTICLES}, x as (select id, source_id, published_at, lang, list_distinct({TOKENS.format('title')}) as t, row_number() over (partition by source_id order by published_at, id) - 1 as nth from art), "
    "u as (select source_id, unnest(t) as e from x where nth < 20), s as (select source_id, count(distinct e) as n, md5(string_agg(distinct e, '|' order by e)) as digest from u group by source_id) "
    "select 'st_' || x.source_id as id, any_value(coalesce(s.n, 0)) as n_shingles, any_value(coalesce(digest, md5(''))) as digest, string_agg(distinct lang, ',' order by lang) as entities, count(*) as members from x left join s using (source_id) group by x.source_id"
)
def centroid_fold(spark, d):
    """Stories around each source's first article after all its others have joined: shingles freeze, entities do not."""
    from pyspark.sql.window import Window

    a = reads.load_articles(spark, d).withColumn("nth", F.row_number().over(Window.partitionBy("source_id").orderBy("published_at", "id")))
    a = a.select("workspace_id", F.concat(F.lit("st_"), "source_id").alias("story_id"), "source_id", "id", "published_at", "nth", F.array_distinct(text.tokens_norm("title")).alias("shingles"), F.array("lang").alias("entities"))
    s = clustering.fold_members(store.open_stories(a.filter("nth = 1"), 5), a.filter("nth > 1"))
    digest = F.md5(F.array_join("centroid_shingles", "|").cast("binary"))
    return s.select("id", F.size("centroid_shingles").cast("long").alias("n_shingles"), digest.alias("digest"), F.array_join("entities", ",").alias("entities"), F.col("centroid_member_count").alias("members"))


@query(f"with {ARTICLES}, s as (select min(id) as first, source_id from art group by source_id) select 'st_' || s.first as id, count(*) filter (where art.id <> s.first) as joined, count(*) as members from art join s using (source_id) group by s.first having count(*) > 1")
def clusters_of_copies(spark, d):
    """A clustering pass over articles of one text for each source: the first opens a story and the others join it."""
    same = F.concat_ws(" ", *(F.concat(F.col("source_id"), F.lit(w)) for w in ("alpha", "beta", "gamma", "delta", "epsilon")))
    a = reads.load_articles(spark, d).select(F.format_string("%012d", "id").alias("id"), F.col("source_id").alias("workspace_id"), "published_at", "fetched_at", F.lit(None).cast("string").alias("title"), same.alias("body"))
    a = clustering.features(a)
    none = a.select("workspace_id", "id", F.col("fetched_at").alias("last_seen_at"), F.lit(1).cast("long").alias("member_count"), "shingles", "entities", "title_tokens").limit(0)
    c = clustering.cluster_pass(a, none, reads.clock(spark, d), window_hours=None, pending=None)
    out = c.groupBy("story_id").agg(F.count_if(~F.col("opened")).alias("joined"), F.count("*").alias("members"))
    return out.filter("members > 1").select(F.concat(F.lit("st_"), F.substring("story_id", 4, 12).cast("long").cast("string")).alias("id"), "joined", "members")
