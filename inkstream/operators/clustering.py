"""Articles to stories by weighted overlap of shingles, entities and title tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.functions.dates import HOUR_MS
from inkstream.functions.scores import CENTROID_FREEZE_MEMBERS, CLUSTER_WINDOW_HOURS, JOIN_THRESHOLD, WEIGHTS, weighted
from inkstream.functions.text import entities, shingle_set, tokens_norm

PENDING = 200
SETS = tuple(WEIGHTS)


def features(articles: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Adds the three sets that clustering compares."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    return articles.withColumns({"shingles": shingle_set(F.concat_ws(" ", t, b)), "entities": entities(t, b), "title_tokens": F.sort_array(F.array_distinct(tokens_norm(t)))})


def best_story(articles: DataFrame, stories: DataFrame, now: int, window_hours: int = CLUSTER_WINDOW_HOURS, threshold: float = JOIN_THRESHOLD, pending: int | None = PENDING) -> DataFrame:
    """(article_id, story_id, score): each pending article's best story as stories are now.

    ``pending`` bounds the articles to the first by (published_at, id), None takes all.
    Sets meet by an equi-join of their elements, whose counts are the intersections; the
    best per article is a partial-aggregated minimum.
    """
    a = articles if pending is None else articles.orderBy("published_at", "id").limit(pending)
    s = stories.filter(F.col("last_seen_at") >= now - window_hours * HOUR_MS)
    kinds = {"shingles": "shingles", "entities": "entities", "title": "title_tokens"}

    def elements(df: DataFrame, key: str) -> DataFrame:
        sets = F.array(*(F.struct(F.lit(k).alias("kind"), F.array_distinct(F.col(c)).alias("e")) for k, c in kinds.items()))
        each = df.select(F.col("id").alias(key), F.explode(sets).alias("s"))
        return each.select(key, F.col("s.kind").alias("kind"), F.size("s.e").alias(f"n_{key}"), F.explode("s.e").alias("e"))

    both = elements(a, "article_id").join(elements(s, "story_id"), ["kind", "e"])
    common = both.groupBy("article_id", "story_id", "kind").agg(F.count("*").alias("n"), F.first("n_article_id").alias("x"), F.first("n_story_id").alias("y"))
    share = F.col("n") / (F.col("x") + F.col("y") - F.col("n"))
    parts = common.groupBy("article_id", "story_id").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, share)), F.lit(0.0)).alias(k) for k in kinds))
    scored = parts.select("article_id", "story_id", F.struct(weighted({k: F.col(k) for k in kinds}).alias("total"), *kinds).alias("score")).filter(F.col("score.total") >= threshold)
    best = scored.groupBy("article_id").agg(F.min(F.struct((-F.col("score.total")).alias("t"), "story_id", "score")).alias("b"))
    return best.select("article_id", F.col("b.story_id").alias("story_id"), F.col("b.score").alias("score"))


def _overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def replay(pending: pd.DataFrame, stories: pd.DataFrame, now: int, window_hours: int | None, threshold: float, freeze: int, use_titles: bool) -> pd.DataFrame:
    """One pass in order: each article joins the best story as earlier ones have left it, or opens one.

    A duplicate takes its original's story, from ``original_story`` or this pass, and changes nothing in it.
    """
    live = {
        r.id: {"shingles": set(r.shingles), "entities": set(r.entities), "title": set(r.title_tokens) if use_titles else set(), "n": r.member_count, "seen": r.last_seen_at}
        for r in stories.itertuples()
    }
    since = float("-inf") if window_hours is None else now - window_hours * HOUR_MS
    out, placed = [], {}
    for a in pending.sort_values(["published_at", "id"]).itertuples():
        given = next((x for x in (a.original_story, placed.get(a.duplicate_of)) if isinstance(x, str)), None)
        if given:
            placed[a.id] = given
            out.append((a.workspace_id, a.id, given, False, True, 0.0))
            continue
        own = {"shingles": set(a.shingles), "entities": set(a.entities), "title": set(a.title_tokens)}
        rated = []
        for sid, s in live.items():
            if s["seen"] >= since:
                total = sum(w * _overlap(own[k], s[k]) for k, w in WEIGHTS.items())
                if total >= threshold:
                    rated.append((-total, sid))
        if rated:
            total, sid = min(rated)
            s = live[sid]
            s["entities"] |= own["entities"]
            if s["n"] < freeze:
                s["shingles"] |= own["shingles"]
            s["n"] += 1
            s["seen"] = max(s["seen"], a.fetched_at)
            out.append((a.workspace_id, a.id, sid, False, False, -total))
        else:
            sid = f"st_{a.id}"
            live[sid] = {"shingles": own["shingles"], "entities": own["entities"], "title": set(), "n": 1, "seen": a.fetched_at}
            out.append((a.workspace_id, a.id, sid, True, False, 0.0))
        placed[a.id] = sid
    return pd.DataFrame(out, columns=["workspace_id", "article_id", "story_id", "opened", "inherited", "score"])


def cluster_pass(
    articles: DataFrame, stories: DataFrame, now: int, window_hours: int | None = CLUSTER_WINDOW_HOURS, threshold: float = JOIN_THRESHOLD,
    freeze: int = CENTROID_FREEZE_MEMBERS, pending: int | None = PENDING, use_titles: bool = False,
) -> DataFrame:
    """Exact sequential assignment of the first ``pending`` unclustered articles of each workspace.

    None for ``pending`` takes all articles, None for ``window_hours`` stories of any age.
    Each assignment depends on the ones before it, so a workspace is one task: of at most
    ``pending`` articles and the stories that can be joined, which are those that share a
    shingle with one of them (other overlap alone stays under the threshold), or with
    ``use_titles`` any element.  Stories have no title of their own unless ``use_titles``.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("workspace_id").orderBy("published_at", "id")
    p = articles if pending is None else articles.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= pending).drop("nth")
    given = [F.col(c) if c in articles.columns else F.lit(None).cast("string").alias(c) for c in ("duplicate_of", "original_story")]
    p = p.select("workspace_id", "id", "published_at", "fetched_at", "shingles", "entities", "title_tokens", *given)
    shared = F.concat("shingles", "entities", "title_tokens") if use_titles or WEIGHTS["entities"] >= threshold else F.col("shingles")
    wanted = p.select("workspace_id", F.explode(shared).alias("e")).distinct()
    s = stories.toDF(*stories.columns)
    s = s if window_hours is None else s.filter(F.col("last_seen_at") >= now - window_hours * HOUR_MS)
    has = s.select("workspace_id", "id", F.explode(shared).alias("e"))
    s = s.join(has.join(wanted, ["workspace_id", "e"]).select("workspace_id", "id").distinct(), ["workspace_id", "id"], "left_semi")
    s = s.select("workspace_id", "id", "last_seen_at", "member_count", "shingles", "entities", "title_tokens")

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        return replay(mine, theirs, now, window_hours, threshold, freeze, use_titles)

    p, s = p.toDF(*p.columns), s.toDF(*s.columns)  # the two may share a source
    return p.groupBy("workspace_id").cogroup(s.groupBy("workspace_id")).applyInPandas(run, "workspace_id string, article_id string, story_id string, opened boolean, inherited boolean, score double")


def inherit_stories(articles: DataFrame) -> DataFrame:
    """Duplicates take their original's story where it has one: (id, story_id)."""
    o = articles.select(F.col("id").alias("duplicate_of"), F.col("story_id").alias("theirs"))
    return articles.select("id", "duplicate_of", "story_id").join(o, "duplicate_of", "left").select("id", F.coalesce("theirs", "story_id").alias("story_id"))


def fold_members(stories: DataFrame, joined: DataFrame, freeze: int = CENTROID_FREEZE_MEMBERS) -> DataFrame:
    """Stories after a pass: entities of all members that ``joined`` (story_id, published_at, id, shingles, entities), shingles of those before the freeze."""
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("story_id").orderBy("published_at", "id"))
    j = joined.withColumn("nth", nth).join(stories.select(F.col("id").alias("story_id"), "centroid_member_count"), "story_id")
    each = F.concat(
        F.transform("entities", lambda e: F.struct(F.lit("entities").alias("kind"), e.alias("e"))),
        F.transform(F.when(F.col("centroid_member_count") + F.col("nth") - 1 < freeze, F.col("shingles")).otherwise(F.array().cast("array<string>")), lambda e: F.struct(F.lit("shingles").alias("kind"), e.alias("e"))),
    )
    sets = j.select("story_id", F.explode_outer(each).alias("x")).groupBy("story_id").agg(*(F.collect_set(F.when(F.col("x.kind") == k, F.col("x.e"))).alias(f"__{k}") for k in ("shingles", "entities")))
    count = j.groupBy("story_id").agg(F.count("*").alias("__n"))
    out = stories.join(sets.join(count, "story_id").withColumnRenamed("story_id", "id"), "id", "left")
    union = lambda old, new: F.when(F.col(new).isNull(), F.col(old)).otherwise(F.sort_array(F.array_union(old, new)))
    return out.withColumns(
        {"centroid_shingles": union("centroid_shingles", "__shingles"), "entities": union("entities", "__entities"), "centroid_member_count": F.col("centroid_member_count") + F.coalesce("__n", F.lit(0))}
    ).select(stories.columns)


def fold_centroid(centroid, ents, features_shingles, features_entities, members, freeze: int = CENTROID_FREEZE_MEMBERS):
    """(shingles, entities) of a story after one more member."""
    c, e = F.col(centroid), F.col(ents)
    grown = F.sort_array(F.array_union(c, F.col(features_shingles)))
    return F.struct(F.when(F.col(members) >= freeze, c).otherwise(grown).alias("shingles"), F.sort_array(F.array_union(e, F.col(features_entities))).alias("entities"))
