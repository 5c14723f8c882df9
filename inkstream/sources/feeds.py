"""RSS, RDF, Atom and JSON feeds to item rows.

``read_feeds`` maps bodies to items in Arrow batches.  A body that cannot be read
gives one row with ``error`` and no item, so one bad feed never fails a task.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.dates import parse_date
from inkstream.functions.markup import TOKEN, attribute, decode_references, html_to_text, local_name

MAX_ITEMS = 500
MAX_DEPTH = 64
#: Element names to item fields.
FIELDS = {
    "title": "title", "link": "link", "guid": "guid", "id": "guid", "description": "summary", "summary": "summary", "encoded": "content", "content": "content",
    "author": "author", "creator": "author", "pubdate": "published", "published": "published", "updated": "updated", "date": "updated", "modified": "updated",
}
FLATTENED = ("title", "summary", "content")
ROOTS = {"rss": "rss", "rdf": "rss", "feed": "atom"}
_ITEM = "guid string, url string, title string, author string, summary string, content string, published string, updated string"
_RAW = "feed_key string, kind string, feed_title string, site_url string, truncated boolean, error string, position int, " + _ITEM


class FeedError(Exception):
    """Why a body is no feed: empty, unknown_format, malformed or json."""


def _finished(item: dict) -> dict | None:
    guid = item.get("guid")
    url = item.get("link") or (guid if guid and guid.startswith(("http://", "https://")) else None)
    if not url:
        return None
    return {**{k: item.get(k) for k in ("guid", "author", "summary", "content", "published", "updated")}, "url": url, "title": item.get("title") or url}


def parse_xml(body: str) -> dict:
    """Items of an RSS, RDF or Atom document, as far as it can be read.

    It is truncated if it ends early or has more than ``MAX_ITEMS`` items, of which the first are returned.
    """
    feed: dict = {"kind": None, "title": None, "site_url": None, "items": [], "truncated": False}
    path: list[str] = []
    item: dict | None = None
    base = 0
    field: tuple[str, int] | None = None
    text: list[str] = []
    for m in TOKEN.finditer(body):
        kind = m.lastgroup
        if kind == "cut" or kind in ("comment", "declared", "cdata") and m.end() == len(body) and not m[0].endswith(">"):
            feed["truncated"] = True
        if kind in ("text", "cdata"):
            if field:
                text.append(decode_references(m["text"]) if kind == "text" else m["cdata"])
            continue
        if kind != "close":
            continue
        name, alone = local_name(m["name"]), m["attrs"].rstrip().endswith("/")
        if not m["end"]:
            if feed["kind"] is None:
                feed["kind"] = ROOTS.get(name)
                if feed["kind"] is None:
                    raise FeedError("unknown_format")
            elif len(path) >= MAX_DEPTH:
                if len(feed["items"]) >= MAX_ITEMS:
                    break
                raise FeedError("malformed")
            elif item is None and name in ("item", "entry"):
                item, base, field = {}, len(path), None
            elif field is None:
                href = attribute(m["attrs"], "href") if name == "link" else None
                if href is not None:
                    if (attribute(m["attrs"], "rel") or "alternate").lower() == "alternate":
                        href = decode_references(href).strip()
                        if item is None:
                            feed["site_url"] = feed["site_url"] or href or None
                        elif href:
                            item.setdefault("link", href)
                elif name in FIELDS and not alone and (item is not None or FIELDS[name] in ("title", "link")):
                    field, text = (FIELDS[name], len(path)), []
            if not alone:
                path.append(name)
            continue
        if name not in path:
            continue
        while path.pop() != name:
            pass
        if field and len(path) <= field[1]:
            value = "".join(text)
            value = (html_to_text(value) if field[0] in FLATTENED else value).strip()
            if value and item is not None:
                item.setdefault(field[0], value)
            elif value and field[0] in ("title", "link"):
                slot = "title" if field[0] == "title" else "site_url"
                feed[slot] = feed[slot] or value
            field = None
        if item is not None and len(path) <= base:
            done, item = _finished(item), None
            if done and len(feed["items"]) >= MAX_ITEMS:
                feed["truncated"] = True
                break
            if done:
                feed["items"].append(done)
    if item is not None and len(feed["items"]) < MAX_ITEMS and (done := _finished(item)):
        feed["items"].append(done)
    if feed["kind"] is None:
        raise FeedError("unknown_format")
    feed["truncated"] |= bool(path)
    if feed["truncated"] and not feed["items"]:
        raise FeedError("malformed")
    return feed


def _string(value) -> str | None:
    if isinstance(value, bool) or value is None:
        return None
    return value if isinstance(value, str) else json.dumps(value) if isinstance(value, (int, float)) else None


def _name(value) -> str | None:
    return (_string(value.get("name")) if isinstance(value, dict) else None) or _string(value)


def parse_json(body: str) -> dict:
    """Items of a JSON feed."""
    try:
        doc = json.loads(body)
    except ValueError:
        raise FeedError("json") from None
    listed = doc.get("items") if isinstance(doc, dict) else None
    if not isinstance(listed, list):
        raise FeedError("unknown_format")
    items = []
    for raw in listed[:MAX_ITEMS]:
        raw = raw if isinstance(raw, dict) else {}
        get = lambda k: _string(raw.get(k))  # noqa: B023, E731
        url = get("url") if get("url") is not None else get("external_url")
        if url is None:
            continue
        content = get("content_text")
        if content is None and get("content_html") is not None:
            content = html_to_text(get("content_html"))
        authors = raw.get("authors")
        author = _name(authors[0]) if isinstance(authors, list) and authors else None
        items.append(
            {
                "guid": get("id"), "url": url, "title": html_to_text(get("title") or "") or url, "author": author or _name(raw.get("author")),
                "summary": html_to_text(get("summary") or "") or None, "content": content or None, "published": get("date_published"), "updated": get("date_modified"),
            }
        )
    return {"kind": "json_feed", "title": _string(doc.get("title")) or None, "site_url": _string(doc.get("home_page_url")) or None, "items": items, "truncated": False}


def parse_feed(body: str | None) -> dict:
    """Parse a body of any supported format; dates stay text.  Raises FeedError."""
    body = (body or "").lstrip("﻿").lstrip()
    if not body:
        raise FeedError("empty")
    return parse_json(body) if body[0] in "{[" else parse_xml(body)


def _parse_batches(batches):
    schema = None
    names = [f.split()[0] for f in _RAW.split(", ")]
    for batch in batches:
        rows = []
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                feed = parse_feed(body)
            except FeedError as e:
                rows.append({"feed_key": key, "error": str(e)})
                continue
            head = {"feed_key": key, "kind": feed["kind"], "feed_title": feed["title"], "site_url": feed["site_url"], "truncated": feed["truncated"]}
            rows += [head | {"position": i} | item for i, item in enumerate(feed["items"])] or [head]
        types = {"truncated": pa.bool_(), "position": pa.int32()}
        schema = schema or pa.schema([(n, types.get(n, pa.string())) for n in names])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_feeds(bodies: DataFrame, now: int | Column, key: str = "feed_key", body: str = "body") -> DataFrame:
    """One row per item of each body, or one row with ``error`` or without an item.

    ``published_at`` is the item's date, else its update, else ``now``.
    """
    now = F.lit(now) if isinstance(now, int) else now
    raw = bodies.select(F.col(key).cast("string").alias("feed_key"), F.col(body).alias("body")).mapInArrow(_parse_batches, _RAW)
    at = F.when(F.col("url").isNotNull(), F.coalesce(parse_date("published"), parse_date("updated"), now))
    return raw.withColumn("published_at", at).drop("published", "updated")
