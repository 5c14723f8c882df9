import re

import pytest
from pyspark.sql import functions as F

from inkstream.functions import dates, markup, scores, simhash, text, urls


def column(spark, values, col, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").repartition(2)
    return [r[1] for r in df.select("i", col.alias("y")).orderBy("i").collect()]


def test_text(spark):
    assert column(spark, ["  A\t b\n\nC ", None, ""], text.normalize("x")) == ["a b c", None, ""]
    assert column(spark, ["İstanbul COVID-19 ß", None, "..."], text.tokens_raw("x"))[0][1:] == ["covid", "19", "ß"]
    assert [len(t) for t in column(spark, ["İstanbul"], text.tokens_raw("x"))] == [1]
    assert [len(t) for t in column(spark, ["İstanbul"], text.tokens_norm("x"))] == [2]
    assert column(spark, ["The the Cat sat on a cat mat", None], text.snapshot_tokens("x")) == [["cat", "sat", "mat"], []]
    assert column(spark, ["a b c d", "a b", ""], text.shingle_set("x")) == [["a b c", "b c d"], ["a", "b"], []]
    assert column(spark, ['<a href="x">&'], text.xml_escape("x")) == ["&lt;a href=&quot;x&quot;&gt;&amp;"]


def entity_runs(s):
    """Brute force for one text."""
    out, run = set(), []

    def flush():
        if run:
            out.add(" ".join(run[-3:]))
            run.clear()

    stop = {*text.STOPWORDS, *text.ENTITY_STOPWORDS}
    for raw in s.split():
        word = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
        if word and (word[0].isupper() or word[0].isnumeric()) and word.lower() not in stop:
            run.append(word.lower())
        else:
            flush()
        if raw[-1] in ".!?;:":
            flush()
    flush()
    return sorted(out)


def test_entities(spark):
    cases = ["The Big Red Old Dog met Bob. Alice, in Paris; and On January 6 2021", "", "lower only", "A B C D E", "X. Y"]
    assert column(spark, cases, text.entities("x")) == [entity_runs(c) for c in cases]
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert column(spark, docs, text.entities("x")) == [entity_runs(c) for c in docs]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTPS://User@Example.COM:443/a/?b=1&utm_source=x&A=2#frag", "https://User@example.com/a?A=2&b=1"),
        ("http://x.test", "http://x.test"), ("http://x.test/", "http://x.test"), ("http://x.test:8080/p//", "http://x.test:8080/p/"),
        ("http://[::1]:80/q?ref=1&&k", "http://[::1]/q?k"), ("Not a  URL", "not a url"), ("mailto:a@b", "mailto:a@b"),
        ("http://a@b@h.test/?B=1&a=2&a=1&b=0", "http://a@b@h.test?a=1&a=2&B=1&b=0"), ("http://:80/", "http://:80/"), ("http://h.test:/x", "http://h.test/x"),
    ],
)
def test_canonicalize(spark, raw, want):
    assert column(spark, [raw], urls.canonicalize("x")) == [want]


def test_http(spark):
    assert column(spark, ["http://a", "ftp://a", "HTTPS://b/c", "x", None, "http://"], urls.is_http_url("x")) == [True, False, True, False, False, False]


def test_dates(spark):
    cases = {
        "Tue, 10 Aug 2027 09:12:00 GMT": 1817889120000, "10 Aug 2027 09:12:00 +0200": 1817881920000, "Tue, 10 Aug 2027 09:12:00 +0000 (UTC)": 1817889120000,
        "2027-08-10T09:12:00Z": 1817889120000, "2027-08-10T09:12:00+02:00": 1817881920000, "2027-08-10 09:12:00": 1817889120000, "2027/08/10 09:12:00": 1817889120000,
        "2027-08-10": 1817856000000, "soon": None, "": None, "Tue, 10 Aug 2027 09:12:00 EST": 1817907120000,
    }
    assert column(spark, list(cases), dates.parse_date("x")) == list(cases.values())
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert column(spark, list(cases), dates.parse_date("x")) == list(cases.values())
        assert column(spark, [0], dates.to_rfc3339("x"), "long") == ["1970-01-01T00:00:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rfc3339_in_a_gap(spark):
    """02:07 UTC on the day New York has no such local time."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert column(spark, [1710036420123, -1, None], dates.to_rfc3339("x"), "long") == ["2024-03-10T02:07:00Z", "1969-12-31T23:59:59Z", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_local_time(spark):
    noon = 1772971200000  # 2026-03-08 12:00 UTC, the day New York springs forward
    due = column(spark, ["02:30", "07:05", "24:00", "x"], dates.local_time_today_ms("America/New_York", "x", F.lit(noon)))
    assert due == [1772955000000, 1772967900000, None, None]
    assert column(spark, ["02:30"], dates.local_time_today_ms("Nowhere/None", "x", F.lit(noon))) == [1772937000000]
    autumn = 1793534400000  # 2026-11-01 12:00 UTC: 01:30 happens twice
    assert column(spark, ["01:30"], dates.local_time_today_ms("America/New_York", "x", F.lit(autumn))) == [1793511000000]


def test_scores(spark):
    assert column(spark, [0, 1, 2, 3, 5], scores.backoff_hours("x"), "int") == [0, 2, 4, 8, 24]
    assert column(spark, [0, 1, 3], scores.source_health("x"), "int") == ["healthy", "degraded", "failing"]
    hour = dates.HOUR_MS
    f = scores.rank_factors("x", F.lit(99), F.lit(1), F.lit(False), F.lit(24 * hour))
    got = column(spark, [12 * hour, 24 * hour, 30 * hour], f, "long")
    assert [r.recency for r in got] == [0.5, 1.0, 1.0] and all(r.unread == 1.25 for r in got)
    assert all(column(spark, [0, 5], scores.factors_hold(f), "long"))

    def verdict(count, samples=7, mean=1.0, stdev=0.0, last=None, now=100 * hour):
        v = scores.burst_verdict(F.col("x"), F.lit(samples), F.lit(mean), F.lit(stdev), F.lit(last).cast("long"), F.lit(now))
        return column(spark, [count], v, "int")[0]

    assert verdict(9).verdict == "burst" and verdict(9, samples=4).verdict == "not_enough_history"
    assert verdict(3).verdict == "quiet" and verdict(9, mean=8.0).verdict == "quiet"
    cooling = verdict(9, last=95 * hour + 1)
    assert (cooling.verdict, cooling.hours_remaining) == ("cooling", 2) and verdict(9, last=94 * hour).verdict == "burst"


def reference_simhash(s):
    words = [w.lower() for w in re.findall(r"[^\W_]+", s)]
    grams = words if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = [0] * 64
    for g in grams:
        h = 0xCBF29CE484222325
        for b in g.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        for i in range(64):
            counts[i] += 1 if h >> i & 1 else -1
    out = sum(1 << i for i in range(64) if counts[i] > 0)
    return out - 2**64 if out >= 2**63 else out


def test_simhash(spark):
    cases = ["", "one", "one two", "The quick brown fox jumps", "THE quick, brown fox jumps!", "a " * 1000, "é ü ñ ß z", None]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string")
    got = [r.simhash for r in simhash.with_simhash(df, "x", ["i"]).orderBy("i").collect()]
    assert got == [reference_simhash(c or "") for c in cases] and got[3] == got[4]
    assert sum(simhash.band_sizes(3)) == sum(simhash.band_sizes(6)) == 64 and len(simhash.band_sizes(6)) == 7
    row = spark.range(1).select(simhash.hamming(F.lit(-1), F.lit(0)).alias("h"), simhash.bands(F.lit(-1)).alias("b")).first()
    assert row.h == 64 and [b["value"] for b in row.b] == [65535] * 4


def test_markup():
    assert markup.decode_references("&amp;lt; &#65;&#x42; &hearts; &#xD800; & &nbsp;|") == "&lt; AB &hearts; &#xD800; & \u00a0|"
    assert markup.html_to_text("<p>a</p><p>b<br>c</p><script>x<p></script> d&amp;e") == "a\n\nb\nc\nd&e"
    assert markup.html_to_text("<ul><li>x<li>y</ul>") == "x\ny"
    assert markup.html_to_text("plain < text") and markup.html_to_text("<div>" * 50_000 + "deep") == "deep"
    assert markup.html_to_text("a\r\nb") == "a\n\nb" and markup.html_to_text("<style>p{}") == "" and markup.html_to_text(None) is None
    body = "word " * 100
    assert markup.main_text(f"<nav>{'<a>x</a>' * 20}</nav><div><article><p>{body}</p></article></div>") == body.strip()
    assert markup.main_text("<div>short</div>") == "short"
    assert markup.extract_json('so {"a": "}", "b": {"c": [1]}} end') == '{"a":"}","b":{"c":[1]}}' and markup.extract_json("no {x}") is None
