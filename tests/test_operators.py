import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkstream import queries, queries_service
from inkstream.functions.dates import HOUR_MS
from inkstream.operators import bursts, clustering, near_dup, store
from inkstream.streaming import passes

SF = "/root/testdata/sf0.001"
QUICK = ["text_words", "url_canonicalize", "rank_factors", "ranked_feed", "topic_match_fanout", "burst_verdict", "burst_history", "cluster_best_story", "story_recount", "feed_items", "insert_dedupe", "story_page", "topic_page", "settings_read", "stories_open", "burst_record", "match_pass", "feed_atom", "feed_json", "feed_errors", "events_emitted"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "events", "customer", "nation"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = df.toPandas()[sorted(df.columns)]
    want = con.execute(queries.ORACLE_SQL[name]).df()[sorted(df.columns)]
    key = lambda x: x.astype(str).sort_values(list(x.columns)).reset_index(drop=True)
    for c in got.columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype(float).round(6), want[c].astype(float).round(6)
    pd.testing.assert_frame_equal(key(got), key(want))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_feed_rdf_against_sql(spark, tmp_path, zone):
    """More documents than a feed may have, one without a key, dated over a change of the clocks."""
    first = 99_300  # 2024-03-09 23:00 UTC; three hours later New York's clocks skip an hour
    docs = [(i, "a") for i in (None, *range(first, first + 510))] + [(1, None), (first + 190, "b")]
    spark.createDataFrame(docs, "doc_id long, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(queries.ORACLE_SQL["feed_rdf"])
    names, want = [c[0] for c in result.description], result.fetchall()
    session = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [tuple(r) for r in queries.QUERIES["feed_rdf"](spark, str(tmp_path)).select(*names).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", session)
    assert len(want) == 502 and sorted(got, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and queries_service.service_pass
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_originals(spark):
    m = 60_000
    rows = [("a", 0, 7), ("b", m, 7), ("c", 2 * m, 7 ^ (1 << 60) ^ 3), ("d", 97 * HOUR_MS, 7), ("e", 96 * HOUR_MS, 7), ("z", m, 0), ("y", 2 * m, 0), ("f", 98 * HOUR_MS, -8)]
    rows += [(f"n{i:03d}", 200 * HOUR_MS + i * m, 12345) for i in range(300)]
    got = {r.id: r.duplicate_of for r in near_dup.originals(spark.createDataFrame(rows, "id string, at long, simhash long")).collect()}

    def brute(i, at, h):
        c = [(t, j) for j, t, g in rows if g and h and (t, j) < (at, i) and t >= at - 96 * HOUR_MS and bin((g ^ h) & (2**64 - 1)).count("1") <= 3]
        return min(c)[1] if c else None

    assert got == {i: b for i, at, h in rows if (b := brute(i, at, h))} and got["c"] == "a" and got["e"] == "a" and "z" not in got


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_originals_stay_off_the_driver(spark, tmp_path):
    """Stored fingerprints look small, but what is made of them grows with the input: no join broadcasts it."""
    spark.range(4000).selectExpr("id", "id * 60000 as at", "xxhash64(id div 4) as simhash").write.parquet(str(tmp_path / "h"))
    out = near_dup.originals(spark.read.parquet(str(tmp_path / "h")))
    assert "Join" in plan(out) and "Broadcast" not in plan(out)
    assert out.count() == 3000 and out.filter("duplicate_of <> id - id % 4").count() == 0


def test_cluster_pass(spark):
    base = "central bank raises interest rates again amid inflation worries in the region"
    rows = [("w", "a1", 1, 1, "Rates up", base), ("w", "a2", 2, 2, "Rates", base + " today"), ("w", "a3", 3, 3, "Cup", "team wins the final match after extra time drama"), ("w", "a4", 4, 4, None, None)]
    a = clustering.features(spark.createDataFrame(rows, "workspace_id string, id string, published_at long, fetched_at long, title string, body string"))
    none = a.select("workspace_id", "id", F.col("fetched_at").alias("last_seen_at"), F.lit(1).cast("long").alias("member_count"), "shingles", "entities", "title_tokens").limit(0)
    got = {r.article_id: (r.story_id, r.opened) for r in clustering.cluster_pass(a, none, 10).collect()}
    assert got == {"a1": ("st_a1", True), "a2": ("st_a1", False), "a3": ("st_a3", True), "a4": ("st_a4", True)}
    old = a.filter("id = 'a1'").select("workspace_id", F.lit("old").alias("id"), F.lit(0).cast("long").alias("last_seen_at"), F.lit(25).cast("long").alias("member_count"), "shingles", "entities", "title_tokens")
    assert {r.article_id: r.story_id for r in clustering.cluster_pass(a, old, 10).collect()}["a2"] == "old"
    assert {r.article_id: r.story_id for r in clustering.cluster_pass(a, old, 73 * HOUR_MS).collect()}["a2"] == "st_a2"
    best = clustering.best_story(a, old.withColumn("id", F.lit("old")), 10).collect()
    assert {r.article_id for r in best} == {"a1", "a2"}


def test_clusters_of_copies_of_several_years(spark, tmp_path):
    """The whole table is clustered, however long ago its first articles came."""
    year = 366 * 24 * 60
    spark.createDataFrame([(i * year, f"s{i % 2}", "en", "x") for i in range(6)], "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(tuple(r) for r in queries.QUERIES["clusters_of_copies"](spark, str(tmp_path)).select("id", "joined", "members").collect())
    assert got == [("st_0", 2, 3), (f"st_{year}", 2, 3)]


def test_original_at_the_edges(spark):
    """Look-backs cut at any millisecond, copies of one time, and pairs across cells, against all pairs."""
    import random

    rng = random.Random(5)
    day = 24 * HOUR_MS
    base = [rng.getrandbits(64) - 2**63 for _ in range(4)]
    flip = lambda h: ((h ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4)))) & (2**64 - 1))
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    rows = [(f"r{i:03d}", rng.choice([rng.randrange(9 * day), 4 * day, 8 * day, 8 * day + 1, 60_000 * rng.randrange(12_000)]), signed(flip(rng.choice(base)))) for i in range(400)]

    def brute(i, at, h):
        c = [(t, j) for j, t, g in rows if (t, j) < (at, i) and t >= at - 96 * HOUR_MS and bin((g ^ h) & (2**64 - 1)).count("1") <= 3]
        return min(c)[1] if c else None

    got = {r.id: r.duplicate_of for r in near_dup.originals(spark.createDataFrame(rows, "id string, at long, simhash long")).collect()}
    assert got == {i: b for i, at, h in rows if (b := brute(i, at, h))}


def test_service_pass(spark, tmp_path):
    """Two passes: a copy follows its original, an article joins a story, growth is told once, a replay adds nothing."""
    text = "central bank raises interest rates again amid inflation worries in the region as markets fall"
    feed = lambda *items: "<rss><channel>" + "".join(f"<item><title>{t}</title><link>https://x.test/{u}</link><description>{b}</description></item>" for t, u, b in items) + "</channel></rss>"
    bodies = lambda *rows: spark.createDataFrame(list(rows), "feed_key string, body string")
    topics_ = {"rates": queries.topics.parse("rates")}
    run = lambda tables, b, now, n: passes.service_pass(tables, b, topics_, now, passes.table_writer(spark, f"{tmp_path}/{n}"))
    one = run(passes.empty_tables(spark), bodies(("s1", feed(("Rates up", "a", text), ("Cup", "b", "team wins the final match after extra time drama"))), ("s2", feed(("Rates up", "c", text))), ("s3", "broken")), 10 * HOUR_MS, 1)
    assert {r.counter: r.n for r in one["report"].collect()} == {"stories_opened": 2, "stories_joined": 0, "topic_matches": 1, "bursts": 0, "articles_new": 3, "duplicates": 1}
    arts = {r.url[-1]: r for r in one["articles"].collect()}
    assert arts["a"].story_id == arts["c"].story_id != arts["b"].story_id and one["snapshot"].count() == 1
    followed = one["stories"].withColumn("followed", F.lit(True))
    two = run({**one, "stories": followed}, bodies(("s1", feed(("Rates up", "a", text))), ("s2", feed(("More rates", "d", text + " today")))), 11 * HOUR_MS, 2)
    assert {r.counter: r.n for r in two["report"].collect()}["articles_new"] == 1
    grown = two["events"].filter("event = 'story.developing'").count()
    joined = {r.url[-1]: r.story_id for r in two["articles"].collect()}
    assert joined["d"] == joined["a"] and grown == 1
    three = run(two, bodies(("s2", feed(("More rates", "d", text + " today")))), 12 * HOUR_MS, 3)
    assert {r.n for r in three["report"].collect()} == {0} and three["events"].count() == 0


def test_duplicates_by_source_stays_off_the_driver(spark):
    out = queries.duplicates_by_source(spark, SF)
    assert "Join" in plan(out) and "Broadcast" not in plan(out)
    assert sum(r.n for r in out.collect()) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_ingest_report_stays_off_the_driver(spark):
    out = queries.ingest_report(spark, SF)
    assert "Join" in plan(out) and "Broadcast" not in plan(out)
    r = out.first()
    assert r["items"] == r.inserted + r.duplicates == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_developing_stream(spark, tmp_path):
    for n, rows in enumerate([[("a", 1), ("b", 2)], [("a", 3), ("b", 2), ("c", 9)], [("a", 3)]]):
        spark.createDataFrame(rows, "id string, source_count long").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/batch={n}"))
    src = spark.readStream.schema("id string, source_count long").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/batch=*"))
    out = str(tmp_path / "out")
    passes.developing(src).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert got == [("a", 3)]


def test_bursts(spark):
    now = 1000 * HOUR_MS
    rows = [("t", now - 1 - i) for i in range(9)] + [("t", now - 24 * HOUR_MS)] + [("t", now), ("q", now - 5)]
    m = spark.createDataFrame(rows, "topic_id string, matched_at long")
    base = {r.topic_id: r for r in bursts.baseline(m, now).collect()}
    assert base["t"]["count"] == 9 and base["t"].samples == [1, 0, 0, 0, 0, 0, 0]
    none = spark.createDataFrame([("t", now - 3 * HOUR_MS)], "topic_id string, detected_at long")
    topics_ = spark.createDataFrame([("t",), ("q",), ("u",)], "topic_id string")
    v = {r.topic_id: r for r in bursts.detect(m, topics_, none, now).collect()}
    assert (v["t"].verdict, v["t"].hours_remaining, v["q"].verdict, v["u"].verdict) == ("cooling", 3, "quiet", "quiet")
    surge = spark.createDataFrame([("t", (200 + h) * HOUR_MS) for h in (0, 3, 7) for _ in range(9)], "topic_id string, matched_at long")
    assert [r.hour for r in bursts.history(surge).orderBy("hour").collect()] == [200, 207]


def articles(spark):
    rows = [("1", "w", "s1", "g1", "u1", "st1", 5, 10, None), ("2", "w", "s1", None, "u2", "st1", 6, 11, 3), ("3", "w", "s2", None, "u3", "st1", 7, 12, None), ("4", "w", "s2", "g1", "u4", "st2", 8, 13, None)]
    return spark.createDataFrame(rows, "id string, workspace_id string, source_id string, guid string, canonical_url string, story_id string, published_at long, fetched_at long, saved_at long")


def stories(spark):
    return spark.createDataFrame([("st1", 9, 9, 1), ("st2", 9, 9, 1), ("st3", 1, 1, 4)], "id string, article_count long, source_count long, last_seen_at long")


def test_store(spark):
    a = articles(spark)
    batch = spark.createDataFrame(
        [("n1", "w", "s1", "g1", "new", None, 1, 1, None), ("n2", "w", "s9", None, "u1", None, 1, 1, None), ("n3", "w", "s9", None, "x", None, 1, 2, None), ("n4", "w", "s9", None, "x", None, 1, 1, None), ("n5", "w", "s9", "k", "y", None, 1, 1, None), ("n6", "w", "s9", "k", "z", None, 1, 2, None)], a.schema
    )
    assert {r.id for r in store.insert_articles(batch, a).collect()} == {"n4", "n5"}
    assert [(r.id, r.article_count, r.source_count, r.last_seen_at) for r in store.recount(a, stories(spark)).orderBy("id").collect()] == [("st1", 3, 2, 12), ("st2", 1, 1, 13), ("st3", 0, 0, 4)]
    assert {r.id for r in store.retained(a, 7).collect()} == {"2", "3", "4"}
    left = store.delete_source({"articles": a, "stories": stories(spark), "sources": a.select(F.col("source_id").alias("id")).distinct(), "matches": a.select(F.col("id").alias("article_id"))}, "s2")
    assert {r.id for r in left["articles"].collect()} == {"1", "2"} and {r.article_id for r in left["matches"].collect()} == {"1", "2"}
    assert [(r.id, r.article_count) for r in left["stories"].orderBy("id").collect()] == [("st1", 2), ("st3", 1)] and left["sources"].count() == 1
    log = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 4, False), ("c", 5, False), ("c", 6, True)], "source_id string, at long, ok boolean")
    h = {r.source_id: (r.consecutive_failures, r.next_fetch_at) for r in store.fetch_health(log).collect()}
    assert h == {"a": (2, 3 + 4 * HOUR_MS), "b": (1, 4 + 2 * HOUR_MS), "c": (0, 6 + HOUR_MS)}
    assert [store.clamp_limit(x) for x in (None, 0, 900, 7)] == [200, 1, 500, 7]
    marked = store.mark(a, a.filter("id = '1'").select("id"), "saved", 77)
    assert {r.id: r.saved_at for r in marked.collect()} == {"1": 77, "2": 3, "3": None, "4": None}
    assert store.purge({"x": a}, ("x",))[1].first().n == 4 and store.purge({"x": a}, ("x",))[0]["x"].count() == 0
    assert clustering.inherit_stories(a.withColumn("duplicate_of", F.when(F.col("id") == "4", "1"))).filter("id = '4'").first().story_id == "st1"
    edited = store.rename(stories(spark), "st1", article_count=4)
    assert {r.id: r.article_count for r in edited.collect()}["st1"] == 4
    up = store.notified(stories(spark).withColumn("notified_source_count", F.lit(5)), F.lit(3))
    assert {r.notified_source_count for r in up.collect()} == {5}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("t", 0), ("t", HOUR_MS), ("t", 6 * HOUR_MS), ("u", 5)], "topic_id string, at long").coalesce(1).write.parquet(src)
    read = lambda schema, path: spark.readStream.schema(schema).parquet(path)

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted((r.topic_id, r.at) for r in drain(passes.cooled(read("topic_id string, at long", src)), "cooled")) == [("t", 0), ("t", 6 * HOUR_MS), ("u", 5)]
    done = []
    passes.run_passes(read("topic_id string, at long", src), lambda df, n: done.append(df.count()), str(tmp_path / "p"), once=True).awaitTermination(120)
    assert sum(done) == 4
