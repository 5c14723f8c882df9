"""OPML subscription lists as built-in Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.text import _col, xml_escape
from inkstream.functions.urls import is_http_url


def _attribute(fragment: Column, name: str) -> Column:
    value = F.btrim(F.regexp_extract(fragment, rf'(?s){name}="([^"]*)"', 1))
    for safe, raw in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):  # the ampersand last
        value = F.replace(value, F.lit(safe), F.lit(raw))
    return F.nullif(value, F.lit(""))


def outlines(docs: DataFrame, text: str = "opml", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per outline: position, title, feed_url, site_url, importable."""
    cut = F.slice(F.split(_col(text), "<outline"), F.lit(2), F.lit(1 << 30))
    rows = docs.select(*keep, F.posexplode(cut).alias("position", "o"))
    url = _attribute(F.col("o"), "xmlUrl")
    title = F.coalesce(_attribute(F.col("o"), "[ \\n\\t]title"), _attribute(F.col("o"), "text"), url)
    return rows.select(*keep, "position", title.alias("title"), url.alias("feed_url"), _attribute(F.col("o"), "htmlUrl").alias("site_url"), is_http_url(F.coalesce(url, F.lit(""))).alias("importable"))


def import_sources(found: DataFrame, existing: DataFrame, workspace: str) -> DataFrame:
    """New sources of importable outlines: first of each feed_url that is not subscribed yet."""
    first = found.filter("importable").groupBy("feed_url").agg(F.min(F.struct("position", "title", "site_url")).alias("o"))
    new = first.select(F.lit(workspace).alias("workspace_id"), "feed_url", F.col("o.title").alias("title"), F.col("o.site_url").alias("site_url"), F.lit("rss").alias("kind"))
    return new.join(existing.select("workspace_id", "feed_url"), ["workspace_id", "feed_url"], "left_anti")


def outline(title, feed_url, site_url) -> Column:
    site = F.when(_col(site_url).isNotNull(), F.concat(F.lit(' htmlUrl="'), xml_escape(site_url), F.lit('"'))).otherwise(F.lit(""))
    name = xml_escape(title)
    return F.concat(F.lit('    <outline type="rss" text="'), name, F.lit('" title="'), name, F.lit('" xmlUrl="'), xml_escape(feed_url), F.lit('"'), site, F.lit(" />\n"))


def export(sources: DataFrame, heading: str = "Subscriptions") -> DataFrame:
    """(workspace_id, opml): a document per workspace, sources by title, then id."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("title", "id", outline("title", "feed_url", "site_url").alias("o")))), lambda x: x["o"])
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head><title>{heading}</title></head>\n  <body>\n'
    return sources.groupBy("workspace_id").agg(F.concat(F.lit(head), F.array_join(lines, ""), F.lit("  </body>\n</opml>\n")).alias("opml"))
