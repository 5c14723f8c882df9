import json

import pytest

from inkstream.plans import topics
from inkstream.plans.topics import QueryParseError, parse
from inkstream.sources import feeds, opml

NOW = 1_700_000_000_000
RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Feed &amp; Co</title><link>https://site.test</link>
<item><title><![CDATA[One <b>bold</b>]]></title><link>https://site.test/1</link><guid>g1</guid><description>&lt;p&gt;Hi&lt;/p&gt;</description>
<pubDate>Tue, 10 Aug 2027 09:12:00 GMT</pubDate><dc:creator>Ann</dc:creator><content:encoded>Body</content:encoded></item>
<item><title>No link</title></item><item><guid>https://site.test/2</guid></item></channel></rss>"""
ATOM = """<a:feed xmlns:a="x"><a:title>T</a:title><a:link rel="self" href="https://s/self"/><a:link href="https://s"/>
<a:entry><a:title>E</a:title><a:link rel="enclosure" href="https://s/mp3"/><a:link href="https://s/1?a=1&amp;b=2"/><a:id>urn:1</a:id>
<a:updated>2027-08-10T09:12:00Z</a:updated><a:content type="xhtml"><p>a</p><p>b</p></a:content></a:entry></a:feed>"""
RDF = """<rdf:RDF><channel><title>R</title></channel><item><title>I</title><link>https://r/1</link><dc:date>2027-08-10</dc:date></item></rdf:RDF>"""
JSON = json.dumps({"title": "J", "home_page_url": "", "items": [{"id": 7, "url": "https://j/1", "content_html": "<p>x</p>", "authors": [{"name": "Z"}]}, {"external_url": "https://j/2", "content_text": "", "content_html": "y", "author": "B"}, {"title": "none"}]})


def test_feeds(spark):
    bodies = [("rss", RSS), ("atom", ATOM), ("rdf", RDF), ("json", JSON), ("empty", "  "), ("null", None), ("html", "<html></html>"), ("bad", "{"), ("cut", RSS[: RSS.index("g1") + 2])]
    rows = feeds.read_feeds(spark.createDataFrame(bodies, "feed_key string, body string"), NOW).collect()
    by = {k: [r for r in rows if r.feed_key == k] for k, _ in bodies}
    one, two = sorted(by["rss"], key=lambda r: r.position)
    assert (one.title, one.summary, one.content, one.author, one.guid, one.published_at) == ("One bold", "Hi", "Body", "Ann", "g1", 1817889120000)
    assert (two.url, two.title, two.published_at) == ("https://site.test/2", "https://site.test/2", NOW) and one.feed_title == "Feed & Co"
    (e,) = by["atom"]
    assert (e.kind, e.url, e.content, e.guid, e.site_url, e.published_at) == ("atom", "https://s/1?a=1&b=2", "ab", "urn:1", "https://s", 1817889120000)
    assert by["rdf"][0].published_at == 1817856000000 and by["rdf"][0].kind == "rss"
    j = {r.url: r for r in by["json"]}
    assert j["https://j/1"].content == "x" and j["https://j/1"].guid == "7" and j["https://j/1"].author == "Z"
    assert j["https://j/2"].content is None and j["https://j/2"].author == "B" and len(j) == 2
    assert [by[k][0].error for k in ("empty", "null", "html", "bad")] == ["empty", "empty", "unknown_format", "json"]
    assert by["cut"][0].truncated and by["cut"][0].url == "https://site.test/1"


def test_feed_limits():
    item = "<item><link>https://x/{}</link></item>"
    many = "<rss><channel>" + "".join(item.format(i) for i in range(550)) + "</channel></rss>"
    feed = feeds.parse_feed(many)
    assert len(feed["items"]) == 500 and feed["truncated"]
    with pytest.raises(feeds.FeedError, match="malformed"):
        feeds.parse_feed("<rss>" + "<a>" * 50_000)


def full_feed(head, entry, tail, n):
    return head + "".join(entry.format(i) for i in range(n)) + tail


def check_full_feed(head, entry, tail):
    """A complete feed of as many items as may be is not truncated; one that ends early or has more is."""
    whole, more = full_feed(head, entry, tail, 500), full_feed(head, entry, tail, 501)
    assert not feeds.parse_feed(whole)["truncated"] and len(feeds.parse_feed(whole)["items"]) == 500
    extra = entry.format("last").index("last") + 6
    for body in (more, whole[: -len(tail)], whole[: -len(tail)] + entry.format("last")[:extra], full_feed(head, entry, tail, 499)[:-3]):
        feed = feeds.parse_feed(body)
        assert feed["truncated"] and len(feed["items"]) == min(500, body.count("https://x/")) and feed["items"][-1]["url"] == f"https://x/{len(feed['items']) - 1}"
    deep = feeds.parse_feed(whole[: -len(tail)] + "<a>" * 70)
    assert deep["truncated"] and len(deep["items"]) == 500


def test_full_atom():
    check_full_feed('<a:feed xmlns:a="x"><a:title>T</a:title>', '<a:entry><a:title>t</a:title><a:link href="https://x/{}"/></a:entry>', "</a:feed>")


def test_full_rdf():
    check_full_feed("<rdf:RDF><channel><title>T</title></channel>", "<item><title>t</title><link>https://x/{}</link></item>", "</rdf:RDF>")


def test_opml(spark):
    s = spark.createDataFrame([("w", "1", 'A "x" & b', "https://a/?p=1&q=2", None), ("w", "2", "B", "https://b", "https://site")], "workspace_id string, id string, title string, feed_url string, site_url string")
    doc = opml.export(s)
    back = opml.outlines(doc).orderBy("position").collect()
    assert [(r.title, r.feed_url, r.site_url, r.importable) for r in back] == [('A "x" & b', "https://a/?p=1&q=2", None, True), ("B", "https://b", "https://site", True)]
    more = spark.createDataFrame([('<opml><outline text="folder"><outline xmlUrl="https://b"/><outline xmlUrl="ftp://c"/><outline text="T" xmlUrl="https://d"/><outline title="again" xmlUrl="https://d"/></opml>',)], "opml string")
    new = opml.import_sources(opml.outlines(more), s, "w").collect()
    assert [(r.feed_url, r.title) for r in new] == [("https://d", "T")]


@pytest.mark.parametrize(
    "query,column,part",
    [
        ('a "b', 3, "unterminated"), ("body:", 6, "must follow"), ("foo:x", 1, "unknown field"), ("(a", 3, "closing"), ("a )", 3, "not part"), ("", 1, "empty"),
        ("a OR", 5, "missing"), ('"..."', 1, "searchable"), ("https://x", 1, "unknown field"), ("x" * 2049, 1, "bytes"), ("(" * 32 + "a" + ")" * 32, 33, "deeper"),
    ],
)
def test_query_errors(query, column, part):
    with pytest.raises(QueryParseError) as e:
        parse(query)
    assert e.value.column == column and part in e.value.message


def test_query_shapes():
    assert parse("(" * 31 + "a" + ")" * 31) == parse("A")
    assert parse("a b OR c").kind == "or" and parse("a AND b") == parse("a b") and parse("a or b").kind == "and"
    assert parse("covid-19").words == ("covid", "19") and parse("-a") == parse("NOT a") and parse("NOT -a").parts[0].kind == "not"
    tree = parse('title:"x y" -(b OR url:c)')
    assert topics.loads(topics.dumps(tree)) == tree and topics.loads("{") is None and topics.loads(None) is None


def test_query_matching(spark):
    rows = [(1, "Big Apple News", "the apple pie", "bbc"), (2, None, "apple tart news", None), (3, "", None, "cnn")]
    df = spark.createDataFrame(rows, "id int, title string, body string, source string")
    docs = topics.document(df, **{c: df[c] for c in ("title", "body", "source")})
    found = lambda q: [r.id for r in docs.filter(topics.matches(parse(q))).orderBy("id").collect()]
    assert found("apple") == [1, 2] and found("app") == [] and found('"apple pie"') == [1] and found('"news the"') == []
    assert found("title:news") == [1] and found("NOT apple") == [3] and found("source:bbc OR tart") == [1, 2] and found("-author:x") == [1, 2, 3]
    hits = topics.match_topics(docs, {"a": parse("apple"), "n": parse("NOT apple")}, ["id"]).orderBy("id", "topic_id").collect()
    assert [(r.id, r.topic_id) for r in hits] == [(1, "a"), (2, "a"), (3, "n")]
