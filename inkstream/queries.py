"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import dates, markup, scores, simhash, text, urls
from inkstream.functions.dates import HOUR_MS
from inkstream.operators import bursts, clustering, near_dup, store
from inkstream.plans import reads, topics
from inkstream.sources import feeds, opml
from inkstream.streaming import passes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Q9 = 9

ARTICLES = """art as (select d.doc_id as id, d.source as source_id, d.source || '-' || d.lang as story_id, split_part(d.text, chr(10), 1) as title, d.text as body, d.lang,
 1704067200000 + d.doc_id * 60000 as published_at, 1704067230000 + d.doc_id * 60000 as fetched_at,
 case when l.quality = 1 then 1704067200000 + d.doc_id * 60000 end as read_at, case when l.quality = 0 then 1704067200000 + d.doc_id * 60000 end as saved_at,
 case when l.toxic = 1 then 1704067200000 + d.doc_id * 60000 end as archived_at from documents d left join labels l on l.doc_id = d.doc_id),
 clock as (select 1704067200000 + max(doc_id) * 60000 + 3600000 as now from documents)"""
TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
FACTORS = """pow(0.5, greatest(now - published_at, 0) / 3600000.0 / 12.0) as recency, case when read_at is null then 1.25 else 1.0 end as unread"""
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch millis of a timestamp without a zone, read as UTC."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")


def _laid_sql(html: str) -> str:
    """Raw text of markup whose dropped elements do not nest, with its line breaks."""
    blocks, lines, dropped = ("|".join(sorted(x)) for x in (markup.BLOCKS - markup.LINES, markup.LINES, markup.DROPPED))
    x = f"regexp_replace({html}, '<!--.*?-->', '', 'gs')"
    x = f"regexp_replace(regexp_replace({x}, '<({dropped})(\\s[^>]*)?>.*?</({dropped})>', '', 'gs'), '<![^>]*>', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '</?({blocks})(\\s[^>]*)?>', chr(10), 'g'), '<({lines})(\\s[^>]*)?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*(>|$)', '', 'g')"
    for name in sorted(markup.NAMED, key=lambda n: (n in ("amp", "AMP"), n)):  # the ampersand last
        x = f"replace({x}, '&{name};', chr({ord(markup.NAMED[name])}))"
    return x


def _tidy_sql(raw: str) -> str:
    """White space as ``tidy`` leaves it."""
    x = f"replace(replace({raw}, chr(160), ' '), chr(13), chr(10))"
    x = f"regexp_replace({x}, '[ \\t\\f\\v]*\\n[ \\t\\f\\v]*\\n\\s*', chr(1) || chr(1), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '\\s*\\n\\s*', chr(1), 'g'), '[ \\t\\f\\v]+', ' ', 'g')"
    return f"trim(replace({x}, chr(1), chr(10)), ' ' || chr(10))"


# text


@query(r"select doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as digest, length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as n from documents")
def text_normalize(spark, d):
    n = text.normalize("text")
    return table(spark, d, "documents").select("doc_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).cast("long").alias("n"))


@query(
    r"with t as (select doc_id, list_transform(list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: lower(x)) as w from documents) "
    "select doc_id, len(w) as n, len(list_distinct(w)) as n_distinct, md5(array_to_string(w, ' ')) as digest from t"
)
def text_words(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.tokens_raw("text").alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(f"with t as (select doc_id, {TOKENS.format('text')} as w from documents) select doc_id, len(w) as n, md5(array_to_string(w, ' ')) as digest from t")
def text_query_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.tokens_norm("text").alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(
    f"with t as (select doc_id, {TOKENS.format('split_part(text, chr(10), 1)')} as w from documents), u as (select doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) as w from t) "
    f"select doc_id, array_to_string(list_filter(w, lambda x: length(x) >= 3 and not list_contains({STOP}, x)), ' ') as tokens from u"
)
def text_snapshot_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.snapshot_tokens(F.substring_index("text", "\n", 1)), " ").alias("tokens"))


@query(
    f"with t as (select source, unnest({TOKENS.format('text')}) as w from documents) select source, count(*) as n, count(*) filter (where list_contains({STOP}, w)) as n_stop from t group by source"
)
def text_stopword_share(spark, d):
    t = table(spark, d, "documents").select("source", F.explode(text.tokens_norm("text")).alias("w"))
    return t.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(text.is_stopword("w"), 1)).alias("n_stop"))


@query(
    f"with t as (select doc_id, {TOKENS.format('text')} as w from documents), s as (select doc_id, case when len(w) < 3 then list_distinct(w) else "
    "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from t) "
    "select doc_id, len(s) as n, md5(array_to_string(list_sort(s), '|')) as digest from s"
)
def text_shingle_set(spark, d):
    s = table(spark, d, "documents").select("doc_id", text.shingle_set("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


_WORD = r"regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"


@query(
    rf"""with t as (select doc_id, 0 as part, split_part(text, chr(10), 1) as x from documents union all select doc_id, 1, text from documents),
 w as (select doc_id, part, unnest(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) as w, generate_subscripts(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''), 1) as i from t),
 c as (select doc_id, part, i, lower({_WORD}) as low, regexp_matches({_WORD}, '^[\p{{Lu}}\p{{N}}]') and not list_contains({list(text.STOPWORDS + text.ENTITY_STOPWORDS)}, lower({_WORD})) as named, regexp_matches(w, '[.!?;:]$') as ends from w),
 r as (select *, coalesce(sum((not named)::int) over (partition by doc_id, part order by i), 0) + coalesce(sum(ends::int) over (partition by doc_id, part order by i rows between unbounded preceding and 1 preceding), 0) as run from c),
 n as (select *, row_number() over (partition by doc_id, part, run order by i desc) as back from r where named),
 e as (select distinct doc_id, string_agg(low, ' ' order by i) as e from n where back <= {text.MAX_ENTITY_WORDS} group by doc_id, part, run)
 select d.doc_id, count(e) as n, coalesce(string_agg(e, '|' order by e), '') as entities from documents d left join e using (doc_id) group by d.doc_id"""
)
def text_entities(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.entities(F.substring_index("text", "\n", 1), F.col("text")).alias("e"))
    return t.select("doc_id", F.size("e").cast("long").alias("n"), F.array_join("e", "|").alias("entities"))


@query(
    f"with t as (select doc_id, list_distinct({TOKENS.format('split_part(text, chr(10), 1)')}) as a, list_distinct({TOKENS.format('text')}) as b from documents) "
    "select doc_id, round(case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double end, 9) as j from t"
)
def set_jaccard(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.array_distinct(text.tokens_norm(F.substring_index("text", "\n", 1))).alias("a"), F.array_distinct(text.tokens_norm("text")).alias("b"))
    return t.select("doc_id", F.round(text.jaccard(F.col("a"), F.col("b")), 9).alias("j"))


@query("select page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as escaped from pages")
def text_xml_escape(spark, d):
    return table(spark, d, "pages").select("page_id", text.xml_escape("url").alias("escaped"))


# URLs

_CANON = r"""u as (select page_id, url, lower(regexp_extract(url, '^([A-Za-z0-9+.-]+)://', 1)) as scheme, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) as authority,
 regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query from pages),
 q as (select *, list_sort(list_filter(list_transform(string_split(query, '&'), lambda p: lower(split_part(p, '=', 1)) || chr(1) || p), lambda k: not (k = chr(1) or starts_with(k, 'utm_') or
 list_contains(['at_campaign', 'at_medium', 'fbclid', 'gclid', 'igshid', 'mc_eid', 'ref', 'ref_src', 's', 'spm'], split_part(k, chr(1), 1))))) as pairs from u),
 c as (select page_id, url, scheme || '://' || lower(case when (scheme = 'http' and ends_with(authority, ':80')) or (scheme = 'https' and ends_with(authority, ':443')) then regexp_replace(authority, ':[0-9]+$', '') else authority end)
 || regexp_replace(path, '/$', '') || case when len(pairs) > 0 then '?' || array_to_string(list_transform(pairs, lambda k: split_part(k, chr(1), 2)), '&') else '' end as canonical, len(pairs) as n_params from q)"""


@query(f"with {_CANON} select page_id, canonical from c")
def url_canonicalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonicalize("url").alias("canonical"))


@query(
    r"select page_id, regexp_extract(url, '^([A-Za-z0-9+.-]+)://', 1) as scheme, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) as path, "
    r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment from pages"
)
def url_parse(spark, d):
    u = table(spark, d, "pages").select("page_id", urls.parse("url").alias("u"))
    return u.select("page_id", "u.scheme", "u.host", "u.path", "u.query", "u.fragment")


@query(f"with {_CANON} select canonical, count(*) as n, min(page_id) as first_page from c group by canonical having count(*) > 1")
def url_duplicates(spark, d):
    c = table(spark, d, "pages").select("page_id", urls.canonicalize("url").alias("canonical"))
    return c.groupBy("canonical").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).filter("n > 1")


@query(r"select page_id, regexp_matches(url, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]') as ok from pages")
def url_is_http(spark, d):
    return table(spark, d, "pages").select("page_id", urls.is_http_url("url").alias("ok"))


# fingerprints

_SIMHASH = f"""t as (select doc_id, {TOKENS.format('text')} as w from documents),
 s as (select doc_id, unnest(case when len(w) < 3 then w else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from t),
 v as (select s, list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(1, length(hex(encode(s))) // 2 + 1), lambda i: (('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::int)::uhugeint)),
 lambda a, x: (xor(a, x) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) as h from (select distinct s from s)),
 m as (select doc_id, h, count(*) as n from s join v using (s) group by all),
 b as (select doc_id, i, sum(case when (h // (2::uhugeint ** i)::uhugeint) % 2 = 1 then n else -n end) as c from m, range(0, 64) r(i) group by all),
 f as (select doc_id, sum(case when c > 0 then (1::hugeint << i::hugeint) else 0 end)::hugeint as u from b group by doc_id),
 sh as (select d.doc_id, coalesce(case when u >= 9223372036854775808 then u - 18446744073709551616 else u end, 0)::bigint as simhash from documents d left join f using (doc_id))"""
# a power of two of an integer as double is exact up to 2^63
_SIMHASH = _SIMHASH.replace("(h // (2::uhugeint ** i)::uhugeint) % 2 = 1", "(h // p) % 2 = 1").replace(
    "range(0, 64) r(i)", "(select i, list_reduce(list_prepend(1::uhugeint, list_transform(range(0, i), lambda k: 2::uhugeint)), lambda a, x: a * x) as p from range(0, 64) r(i))"
)


def _hashed(spark, d):
    return simhash.with_simhash(table(spark, d, "documents"), "text", ["doc_id"])


@query(f"with {_SIMHASH} select doc_id, simhash from sh")
def simhash_fingerprint(spark, d):
    return _hashed(spark, d)


@query(f"with {_SIMHASH} select doc_id, band, (case when simhash < 0 then simhash::hugeint + 18446744073709551616 else simhash end // [1, 65536, 4294967296, 281474976710656][band + 1]) % 65536 as value from sh, range(0, 4) r(band)")
def simhash_bands(spark, d):
    return _hashed(spark, d).select("doc_id", F.explode(simhash.bands("simhash")).alias("b")).select("doc_id", F.col("b.band").cast("long").alias("band"), F.col("b.value").alias("value"))


_DUPES = f"""{_SIMHASH}, p as (select a.doc_id as id, min(b.doc_id) as duplicate_of from sh a join sh b on b.doc_id < a.doc_id and b.doc_id >= a.doc_id - 5760 and a.simhash <> 0 and b.simhash <> 0
 and bit_count(xor(a.simhash, b.simhash)) <= 3 group by a.doc_id)"""


def stored(spark: SparkSession):
    """Writes tables to the session's shared folder and reads them back; a local session without one gets a temporary folder."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return passes.table_writer(spark, f"{shared.rstrip('/')}/pass-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="inkstream-pass-"))


def _originals(spark, d):
    h = _hashed(spark, d).select(F.col("doc_id").alias("id"), (F.lit(reads.EPOCH_MS) + F.col("doc_id") * 60_000).alias("at"), "simhash")
    # fingerprints are read several times, and hashed once
    return near_dup.originals(stored(spark)("hashes", h))


@query(f"with {_DUPES} select id, duplicate_of from p")
def near_duplicates(spark, d):
    return _originals(spark, d)


@query(f"with {_DUPES} select source, count(*) as n, count(duplicate_of) as n_duplicates from documents left join p on id = doc_id group by source")
def duplicates_by_source(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source").join(near_dup.sorted_(_originals(spark, d)), "id", "left")
    return t.groupBy("source").agg(F.count("*").alias("n"), F.count("duplicate_of").alias("n_duplicates"))


# articles and ranking


@query(f"with {ARTICLES} select id, published_at from art where archived_at is null and read_at is null and published_at >= (select now from clock) - 86400000 order by published_at desc, id limit 200")
def articles_unread(spark, d):
    a, now = reads.load_articles(spark, d), reads.clock(spark, d)
    return reads.newest(reads.article_filter(a, unread=True, since=now - 24 * HOUR_MS)).select("id", "published_at")


@query(f"with {ARTICLES} select id, saved_at from art where saved_at is not null and archived_at is null order by published_at desc, id limit 500")
def articles_saved(spark, d):
    return reads.newest(reads.article_filter(reads.load_articles(spark, d), saved=True), 500).select("id", "saved_at")


@query(f"with {ARTICLES} select id, source_id, story_id from art where story_id = 'src0-en' and archived_at is null order by published_at desc, id limit 100")
def story_members(spark, d):
    return reads.newest(reads.article_filter(reads.load_articles(spark, d), story_id="src0-en"), reads.STORY_MEMBERS).select("id", "source_id", "story_id")


@query(f"with {ARTICLES} select id, round(recency, 9) as recency, 1.0 as coverage, 1.0 as topic, unread, round(recency * unread, 9) as total from (select id, {FACTORS} from art, clock)")
def rank_factors(spark, d):
    a, now = reads.load_articles(spark, d), reads.clock(spark, d)
    r = a.select("id", scores.rank_factors("published_at", F.lit(1), F.lit(0), F.col("read_at").isNotNull(), F.lit(now)).alias("r"))
    return r.select("id", F.round("r.recency", 9).alias("recency"), "r.coverage", "r.topic", "r.unread", F.round("r.total", 9).alias("total"))


@query(
    f"with {ARTICLES}, n as (select * from art where archived_at is null order by published_at desc, id limit 200), r as (select id, title, {FACTORS} from n, clock) "
    "select id, title, round(recency * unread, 9) as score from r order by recency * unread desc, id"
)
def ranked_feed(spark, d):
    a, now = reads.load_articles(spark, d), reads.clock(spark, d)
    return reads.ranked_feed(a, now).select("id", "title", F.round("rank.total", 9).alias("score"))


@query(
    f"with {ARTICLES}, s as (select story_id, count(distinct lang) as k, count(*) as n from art group by story_id), r as (select id, {FACTORS}, 1 + ln(least(n, 12)) as coverage from art join s using (story_id), clock) "
    "select id, round(recency * unread * coverage, 9) as score from r order by recency * unread * coverage desc, id limit 40"
)
def rank_topk(spark, d):
    a, now = reads.load_articles(spark, d), reads.clock(spark, d)
    n = a.groupBy("story_id").agg(F.count("*").alias("n"))
    return reads.ranked(a.join(n, "story_id"), now, source_count=F.col("n")).limit(40).select("id", F.round("rank.total", 9).alias("score"))


@query(
    f"with {ARTICLES}, n as (select * from art where archived_at is null and published_at >= (select now from clock) - 172800000 order by published_at desc, id limit 400), r as (select *, {FACTORS} from n, clock), "
    f"k as (select * from r order by recency * unread desc, id limit 40), t as (select id, title, source_id, {TOKENS.format('title')} as w from k) "
    f"select id, title, source_id as source, array_to_string(list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: length(x) >= 3 and not list_contains({STOP}, x)), ' ') as tokens from t"
)
def headline_snapshot(spark, d):
    items = reads.snapshot_items(reads.load_articles(spark, d), reads.clock(spark, d))
    return items.select("id", "title", "source", F.array_join("tokens", " ").alias("tokens"))


@query(
    f"with {ARTICLES}, n as (select * from art where archived_at is null and published_at >= (select now from clock) - 172800000 order by published_at desc, id limit 400), r as (select *, {FACTORS} from n, clock), "
    f"k as (select * from r order by recency * unread desc, id limit 40), t as (select *, {TOKENS.format('title')} as w from k), "
    f"i as (select recency * unread as score, id, to_json({{'id': id, 'title': title, 'source': source_id, 'published_at': published_at::varchar, 'story_id': story_id, 'source_count': 1, 'tokens': list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: length(x) >= 3 and not list_contains({STOP}, x))}})::varchar as j from t) "
    f"select '{{\"version\":1,\"generated_at\":\"' || (select now from clock) || '\",\"ttl_secs\":3600,\"stopwords\":' || to_json(list_sort({STOP}))::varchar || ',\"items\":[' || string_agg(j, ',' order by score desc, id) || ']}}' as json from i"
)
def headline_snapshot_json(spark, d):
    return reads.snapshot(reads.load_articles(spark, d), reads.clock(spark, d))


# topic queries


def _documents(spark, d):
    t = table(spark, d, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    return topics.document(t, title=F.col("title"), body=F.col("text"), source=F.col("source"))


_DOCS = f"docs as (select doc_id, source, {TOKENS.format('split_part(text, chr(10), 1)')} as t, {TOKENS.format('text')} as b from documents)"
_HAS = "(list_contains(t, '{0}') or list_contains(b, '{0}'))"
_PHRASE = "(contains(' ' || array_to_string(t, ' ') || ' ', ' {0} ') or contains(' ' || array_to_string(b, ' ') || ' ', ' {0} '))"


@query(f"with {_DOCS} select doc_id from docs where {_HAS.format('license')}")
def query_term(spark, d):
    return _documents(spark, d).filter(topics.matches(topics.parse("License"))).select("doc_id")


@query(f"with {_DOCS} select doc_id from docs where {_PHRASE.format('apache license version 2')}")
def query_phrase(spark, d):
    return _documents(spark, d).filter(topics.matches(topics.parse('"Apache License, Version 2"'))).select("doc_id")


@query(f"with {_DOCS} select doc_id from docs where list_contains(t, 'licensed') and not list_contains(b, 'mit')")
def query_fields(spark, d):
    return _documents(spark, d).filter(topics.matches(topics.parse("title:licensed -body:MIT"))).select("doc_id")


@query(f"with {_DOCS} select doc_id from docs where ({_HAS.format('license')} or {_PHRASE.format('rights reserved')}) and not ({_HAS.format('der')} and {_HAS.format('und')}) or {_HAS.format('token')}")
def query_boolean(spark, d):
    return _documents(spark, d).filter(topics.matches(topics.parse('(license OR "rights reserved") NOT (der AND und) OR token'))).select("doc_id")


TOPICS = {"apache": "apache license", "rights": '"all rights reserved"', "secrets": "token OR password OR secret", "german": "der die und -la", "quiet": "NOT the"}
_TOPIC_SQL = {
    "apache": f"{_HAS.format('apache')} and {_HAS.format('license')}", "rights": _PHRASE.format("all rights reserved"),
    "secrets": f"({_HAS.format('token')} or {_HAS.format('password')} or {_HAS.format('secret')})",
    "german": f"{_HAS.format('der')} and {_HAS.format('die')} and {_HAS.format('und')} and not {_HAS.format('la')}", "quiet": f"not {_HAS.format('the')}",
}
_FAN = f"with {_DOCS} " + " union all ".join(f"select doc_id, '{k}' as topic_id from docs where {v}" for k, v in _TOPIC_SQL.items())


def _fanout(spark, d):
    return topics.match_topics(_documents(spark, d), {k: topics.parse(v) for k, v in TOPICS.items()}, ["doc_id"])


@query(_FAN)
def topic_match_fanout(spark, d):
    return _fanout(spark, d)


@query(f"with m as ({_FAN}) select topic_id, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from m group by topic_id")
def topic_match_counts(spark, d):
    return _fanout(spark, d).groupBy("topic_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query(
    f"with {ARTICLES}, n as (select * from art where archived_at is null order by published_at desc, id limit 500), docs as (select id, published_at, {TOKENS.format('title')} as t, {TOKENS.format('body')} as b from n) "
    f"select id from docs where {_HAS.format('license')} order by published_at desc, id limit 20"
)
def agent_search(spark, d):
    return reads.search(reads.load_articles(spark, d), topics.parse("license")).select("id")


# topic log and bursts

_LOG = "log as (select event_type as topic_id, event_id as article_id, epoch_us(ts) // 1000 as matched_at from events), clock as (select max(matched_at) + 1 as now from log)"


def _log(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("topic_id"), F.col("event_id").alias("article_id"), millis("ts").alias("matched_at"))


def _log_now(log):
    return log.agg(F.max("matched_at")).first()[0] + 1


@query(f"with {_LOG} select topic_id, matched_at // 3600000 as hour, count(*) as n from log group by all")
def burst_hourly(spark, d):
    return _log(spark, d).groupBy("topic_id", F.floor(F.col("matched_at") / HOUR_MS).alias("hour")).agg(F.count("*").alias("n"))


_BASE = f"""{_LOG}, c as (select topic_id, d, count(*) filter (where matched_at >= now - d * 86400000 - 1800000 and matched_at < now - d * 86400000 + 1800000) as n from log, clock, range(1, 8) r(d) group by all),
 s as (select topic_id, avg(n) as mean, stddev_pop(n) as stdev from c group by topic_id), h as (select topic_id, count(*) filter (where matched_at >= now - 3600000 and matched_at < now) as n from log, clock group by topic_id)"""


@query(f"with {_BASE} select topic_id, n, round(mean, 9) as mean, round(stdev, 9) as stdev from s join h using (topic_id)")
def burst_baseline(spark, d):
    log = _log(spark, d)
    return bursts.baseline(log, _log_now(log)).select("topic_id", F.col("count").alias("n"), F.round("mean", 9).alias("mean"), F.round("stdev", 9).alias("stdev"))


@query(
    f"with {_BASE}, z as (select topic_id, n, (n - mean) / greatest(stdev, 1.0) as z from s join h using (topic_id)) select topic_id, n, round(z, 9) as z, case when z < 3 or n < 4 then 'quiet' else 'burst' end as verdict, "
    "(select (now // 3600000) % 24 from clock) as hour_of_day from z"
)
def burst_verdict(spark, d):
    log = _log(spark, d)
    none = log.select("topic_id", F.col("matched_at").alias("detected_at")).limit(0)
    v = bursts.detect(log, log.select("topic_id").distinct(), none, _log_now(log))
    return v.select("topic_id", F.col("count").alias("n"), F.round("z", 9).alias("z"), "verdict", "hour_of_day")


@query(
    f"""with recursive {_LOG}, h as (select topic_id, matched_at // 3600000 as hour, count(*) as n from log group by all),
 s as (select a.topic_id, a.hour, a.n, (select coalesce(sum(b.n), 0) from h b where b.topic_id = a.topic_id and a.hour - b.hour in (24, 48, 72, 96, 120, 144, 168)) as s1,
 (select coalesce(sum(b.n * b.n), 0) from h b where b.topic_id = a.topic_id and a.hour - b.hour in (24, 48, 72, 96, 120, 144, 168)) as s2 from h a),
 z as (select topic_id, hour, n, (n - s1 / 7.0) / greatest(sqrt(greatest(s2 / 7.0 - (s1 / 7.0) * (s1 / 7.0), 0)), 1.0) as z from s),
 hot as (select * from z where z >= 1.5 and n >= 4),
 fired as (select topic_id, min(hour) as hour from hot group by topic_id union all select f.topic_id, (select min(x.hour) from hot x where x.topic_id = f.topic_id and x.hour >= f.hour + 6) from fired f where f.hour is not null)
 select topic_id, hour, n as count, round(z, 9) as z from fired join hot using (topic_id, hour)"""
)
def burst_history(spark, d):
    return bursts.history(_log(spark, d), z_threshold=1.5).select("topic_id", "hour", "count", F.round("z", 9).alias("z"))


@query(
    f"with {_LOG}, {ARTICLES.replace('clock as', 'unused as')} select article_id, topic_id, title, matched_at from log join art on art.id = article_id where topic_id = 'purchase' and matched_at >= (select now from clock) - 2592000000 order by matched_at desc, article_id limit 100"
)
def topic_matches_recent(spark, d):
    log = _log(spark, d)
    hits = reads.topic_feed(log, reads.load_articles(spark, d), "purchase", _log_now(log) - 30 * 24 * HOUR_MS)
    return hits.select("article_id", "topic_id", "title", "matched_at")


@query(f"with {_LOG} select topic_id, max(matched_at) as matched_at, arg_max(article_id, (matched_at, -article_id)) as article_id from log group by topic_id")
def latest_match(spark, d):
    return store.latest(_log(spark, d).withColumnRenamed("article_id", "id"), "topic_id", "matched_at").select("topic_id", "matched_at", F.col("id").alias("article_id"))


# clustering

_SETS = "list_distinct({0}) as w"
_FEAT = f"""{ARTICLES}, x as (select id, published_at, source_id, {TOKENS.format('body')} as w, list_distinct({TOKENS.format('title')}) as t from art),
 g as (select id, published_at, source_id, t, case when len(w) < 3 then list_distinct(w) else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from x),
 st as (select id as sid, s as ss, t as ts from g where id in (select min(id) from g group by source_id)), p as (select * from g),
 sc as (select id, sid, case when len(s) = 0 or len(ss) = 0 then 0 else len(list_intersect(s, ss)) / (len(s) + len(ss) - len(list_intersect(s, ss)))::double end as a,
 case when len(t) = 0 or len(ts) = 0 then 0 else len(list_intersect(t, ts)) / (len(t) + len(ts) - len(list_intersect(t, ts)))::double end as b from p, st)"""


def _with_sets(a: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    f = a.select("id", "workspace_id", "source_id", "published_at", "fetched_at", "title", "body")
    return f.withColumns({"shingles": text.shingle_set("body"), "title_tokens": F.sort_array(F.array_distinct(text.tokens_norm("title"))), "entities": none})


def _seeds(spark, d):
    """All articles, and a story per source."""
    a = reads.load_articles(spark, d)
    first = a.groupBy("source_id").agg(F.min("id").alias("id")).select("id")
    return _with_sets(a), _with_sets(a.join(first, "id", "left_semi")).withColumn("last_seen_at", F.col("fetched_at"))


@query(f"with {_FEAT} select id as article_id, sid as story_id, round(total, 9) as score from (select id, sid, 0.6 * a + 0.25 * b as total, row_number() over (partition by id order by 0.6 * a + 0.25 * b desc, sid) as r from sc where 0.6 * a + 0.25 * b >= 0.17) where r = 1")
def cluster_best_story(spark, d):
    f, stories = _seeds(spark, d)
    best = clustering.best_story(f, stories, 0, pending=None)
    return best.select("article_id", "story_id", F.round("score.total", 9).alias("score"))


@query()
def cluster_sequential(spark, d):
    a = clustering.features(reads.load_articles(spark, d).select("id", "workspace_id", "published_at", "fetched_at", "title", "body"))
    a = a.withColumn("id", F.format_string("%012d", "id"))
    empty = a.select("workspace_id", "id", F.col("fetched_at").alias("last_seen_at"), F.lit(1).cast("long").alias("member_count"), "shingles", "entities", "title_tokens").limit(0)
    return clustering.cluster_pass(a, empty, reads.clock(spark, d), window_hours=24 * 365)


# stories and store semantics


@query(f"with {ARTICLES} select story_id as id, count(*) as article_count, count(distinct source_id) as source_count, min(fetched_at) as first_seen_at, max(fetched_at) as last_seen_at from art group by story_id")
def story_recount(spark, d):
    return reads.stories_of(reads.load_articles(spark, d))


@query(f"with {ARTICLES} select lang as id, count(distinct source_id) as source_count from art where archived_at is null group by lang having count(distinct source_id) > 10")
def stories_grown(spark, d):
    s = reads.stories_of(reads.article_filter(reads.load_articles(spark, d)).withColumn("story_id", F.col("lang")))
    s = s.withColumns({"followed": F.lit(True), "notified_source_count": F.lit(10)})
    return store.grown_stories(s).select("id", "source_count")


@query(
    f"with {_CANON}, k as (select canonical, page_id from c where url like 'https://%'), n as (select canonical, min(page_id) as page_id from c group by canonical) "
    "select page_id, canonical from n where canonical not in (select canonical from k where page_id in (select page_id from k where page_id >= (select max(page_id) / 2 from pages)))"
)
def insert_dedupe(spark, d):
    c = table(spark, d, "pages").select("page_id", "url", urls.canonicalize("url").alias("canonical"))
    half = c.agg(F.max("page_id") / 2).first()[0]
    stored = c.filter(F.col("url").startswith("https://") & (F.col("page_id") >= half))
    return store.insert_new(c.select("page_id", "canonical"), stored, ["canonical"], ["page_id"]).select("page_id", "canonical")


@query(f"with {ARTICLES} select source_id, count(*) as n, count(saved_at) as n_saved from art where published_at >= (select now from clock) - 7200000 or saved_at is not null group by source_id")
def retention_prune(spark, d):
    a, now = reads.load_articles(spark, d), reads.clock(spark, d)
    return store.retained(a, now - 2 * HOUR_MS).groupBy("source_id").agg(F.count("*").alias("n"), F.count("saved_at").alias("n_saved"))


_HEALTH = f"""{ARTICLES}, lg as (select source_id, fetched_at as moment, saved_at is null as ok from art), l as (select source_id, max(moment) filter (where ok) as last_success_at, max(moment) as last_fetch_at from lg group by source_id),
 f as (select l.source_id, last_fetch_at, count(moment) filter (where not ok and (last_success_at is null or moment > last_success_at)) as n from l join lg using (source_id) group by all),
 hl as (select source_id, n, case when n >= 3 then 'failing' when n > 0 then 'degraded' else 'healthy' end as health, last_fetch_at + 3600000 * case when n <= 0 then 1 else least(pow(2, least(n, 8)), 24) end as next_fetch_at from f)"""


def _health(spark, d):
    a = reads.load_articles(spark, d)
    return store.fetch_health(a.select("source_id", F.col("fetched_at").alias("at"), F.col("saved_at").isNull().alias("ok")))


@query(f"with {_HEALTH} select source_id, n as failures, health, next_fetch_at::bigint as next_fetch_at from hl")
def source_health(spark, d):
    h = _health(spark, d)
    return h.select("source_id", F.col("consecutive_failures").alias("failures"), scores.source_health("consecutive_failures").alias("health"), "next_fetch_at")


@query(f"with {_HEALTH} select source_id as id, next_fetch_at::bigint as next_fetch_at from hl where next_fetch_at <= (select now from clock) + 3000000 order by next_fetch_at, id limit 50")
def due_sources(spark, d):
    s = _health(spark, d).select(F.col("source_id").alias("id"), F.lit(True).alias("enabled"), "next_fetch_at")
    return store.due_sources(s, reads.clock(spark, d) + 3_000_000, 50).select("id", "next_fetch_at")


@query("select n as failures, case when n <= 0 then 0 else least(pow(2, least(n, 8)), 24) end::bigint as hours from (select distinct c_nationkey - 5 as n from customer)")
def backoff_schedule(spark, d):
    n = table(spark, d, "customer").select((F.col("c_nationkey") - 5).alias("failures")).distinct()
    return n.select(F.col("failures").cast("long").alias("failures"), scores.backoff_hours("failures").alias("hours"))


@query("select 'documents' as \"table\", count(*) as n from documents union all select 'events', count(*) from events union all select 'pages', count(*) from pages")
def table_counts(spark, d):
    return store.table_counts({t: table(spark, d, t) for t in ("documents", "events", "pages")})


@query(f"with {ARTICLES} select source_id, count(read_at) as n_read, count(*) as n from (select source_id, case when lang = 'fr' then 1 else read_at end as read_at from art) group by source_id")
def mark_read(spark, d):
    a = reads.load_articles(spark, d)
    return store.mark(a, a.filter("lang = 'fr'").select("id"), "read", 1).groupBy("source_id").agg(F.count("read_at").alias("n_read"), F.count("*").alias("n"))


@query(f"with {ARTICLES} select story_id, count(*) as article_count, max(fetched_at) as last_seen_at from art where source_id <> 'src0' group by story_id")
def delete_source(spark, d):
    a = reads.load_articles(spark, d)
    s = reads.stories_of(a)
    sources = a.select(F.col("source_id").alias("id")).distinct()
    left = store.delete_source({"articles": a, "stories": s, "sources": sources}, "src0")["stories"]
    return left.select(F.col("id").alias("story_id"), "article_count", "last_seen_at")


@query("select user_id as workspace_id, arg_max(props, (ts, event_id)) as json from events group by user_id")
def settings_latest(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("workspace_id"), F.struct("ts", "event_id").alias("at"), F.col("props").alias("json"))
    return store.latest_settings(e)


@query(
    f"with {ARTICLES}, s as (select story_id as id, max(fetched_at) as last_seen_at from art group by story_id), t as (select *, row_number() over (order by last_seen_at desc, id) as index from s where last_seen_at >= (select now from clock) - 86400000) "
    "select index, id as story_id, '(untitled)' as title, case when index = 1 then 'first. lead' else '' end as summary from t where index <= 12"
)
def brief_items(spark, d):
    s = reads.stories_of(reads.load_articles(spark, d)).withColumn("title", F.lit(None).cast("string"))
    prose = spark.createDataFrame([(1, "first.", "lead")], "index int, summary string, why string")
    return reads.brief(s, prose, reads.clock(spark, d)).withColumn("index", F.col("index").cast("long"))


# dates


@query("select event_id, epoch_us(ts) // 1000000 * 1000 as parsed, (epoch_us(ts) // 3600000000) % 24 as hour, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') as rfc3339 from events")
def dates_roundtrip(spark, d):
    ms = millis("ts")
    e = table(spark, d, "events").select("event_id", ms.alias("ms"), dates.to_rfc3339(ms).alias("rfc3339"))
    return e.select("event_id", dates.parse_date("rfc3339").alias("parsed"), dates.hour_of_day("ms").alias("hour"), "rfc3339")


@query("select event_id, epoch_ms(timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', ts))) + interval 7 hour + interval 30 minute)) as due from events")
def dates_local_due(spark, d):
    e = table(spark, d, "events").select("event_id", millis("ts").alias("ms"))
    return e.select("event_id", dates.local_time_today_ms("America/New_York", F.lit("07:30"), "ms").alias("due"))


# markup and formats


@query(f"with t as (select page_id, {_tidy_sql(_laid_sql('html'))} as text from pages) select page_id, length(text) as n, md5(text) as digest from t")
def page_text(spark, d):
    p = table(spark, d, "pages").select("page_id", markup.html_to_text_udf("html").alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _main_sql() -> str:
    """The container with most bytes a tag of pages with one body, article and div; ``k`` orders those of equal score."""
    parts = {"body": "regexp_extract(html, '<body[^>]*>(.*?)(</body>|$)', 1, 's')", "article": "regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's')", "div": "regexp_extract(html, '<div[^>]*>(.*?)</div>', 1, 's')"}
    union = " union all ".join(f"select page_id, html, {p} as part, {k} as k from pages" for k, p in enumerate(parts.values()))
    return (
        f"with c as ({union}), l as (select page_id, html, k, {_laid_sql('part')} as raw, len(regexp_extract_all(regexp_replace(part, '<!--.*?-->', '', 'gs'), '<[A-Za-z]')) as tags from c), "
        f"s as (select *, strlen(trim(replace(raw, chr(160), ' '), ' ' || chr(10) || chr(13) || chr(9))) as size from l), b as (select page_id, arg_max(raw, (size / (1 + tags), size, -k)) as raw from s where size >= {markup.MIN_MAIN_TEXT_BYTES} group by page_id), "
        f"t as (select page_id, {_tidy_sql('coalesce(raw, ' + _laid_sql('html') + ')')} as text from pages left join b using (page_id)) select page_id, length(text) as n, md5(text) as digest from t"
    )


@query(_main_sql())
def page_main_text(spark, d):
    p = table(spark, d, "pages").select("page_id", markup.main_text_udf("html").alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("select page_id, replace(url, '&amp;', '&') as decoded from pages")
def decode_references(spark, d):
    return table(spark, d, "pages").select("page_id", markup.decode_references_udf(text.xml_escape("url")).alias("decoded"))


@query("select event_id, '{\"k\":' || regexp_extract(props, '([0-9]+)', 1) || '}' as json from events")
def extract_json(spark, d):
    return table(spark, d, "events").select("event_id", markup.extract_json_udf(F.concat(F.lit("Answer: "), "props", F.lit(" done."))).alias("json"))


def _feed_bodies(spark, d):
    """An RSS document of each source's first documents, one more than a feed may have: a rendering to read back."""
    item = F.concat(
        F.lit("<item><title>"), text.xml_escape(F.concat(F.lit("t"), F.col("doc_id").cast("string"))), F.lit("</title><link>https://n.test/"), F.col("doc_id").cast("string"),
        F.lit("</link><pubDate>"), dates.to_rfc3339(F.lit(reads.EPOCH_MS) + F.col("doc_id") * 60_000), F.lit("</pubDate></item>"),
    )
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    docs = table(spark, d, "documents").select("source", "doc_id", nth.alias("nth")).filter(F.col("nth") <= feeds.MAX_ITEMS + 1)
    docs = docs.groupBy(F.col("source").alias("feed_key")).agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("i")))).alias("x"))
    body = F.concat(F.lit("<?xml version='1.0'?><rss version='2.0'><channel><title>"), "feed_key", F.lit("</title>"), F.array_join(F.transform("x", lambda v: v["i"]), ""), F.lit("</channel></rss>"))
    return docs.select("feed_key", body.alias("body"))


@query(
    "with r as (select source, doc_id, row_number() over (partition by source order by doc_id) as n from documents) select source as feed_key, 'rss' as kind, n - 1 as position, 'https://n.test/' || doc_id as url, "
    "'t' || doc_id as title, 1704067200000 + doc_id * 60000 as published_at from r where n <= 500"
)
def feed_items(spark, d):
    items = feeds.read_feeds(_feed_bodies(spark, d), 0)
    return items.select("feed_key", "kind", F.col("position").cast("long").alias("position"), "url", "title", "published_at")


def _sources(spark, d):
    s = table(spark, d, "documents").select(F.col("source").alias("id")).distinct()
    return s.select(F.lit("default").alias("workspace_id"), "id", F.concat(F.lit("Feed & "), "id").alias("title"), F.concat(F.lit("https://"), "id", F.lit(".test/rss?a=1&b=2")).alias("feed_url"), F.lit(None).cast("string").alias("site_url"))


@query(
    "with s as (select distinct source from documents) select 'default' as workspace_id, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<opml version=\"2.0\">' || chr(10) || '  <head><title>Subscriptions</title></head>' || chr(10) || '  <body>' || chr(10) || "
    "string_agg('    <outline type=\"rss\" text=\"Feed &amp; ' || source || '\" title=\"Feed &amp; ' || source || '\" xmlUrl=\"https://' || source || '.test/rss?a=1&amp;b=2\" />' || chr(10), '' order by source) || '  </body>' || chr(10) || '</opml>' || chr(10) as opml from s"
)
def opml_export(spark, d):
    return opml.export(_sources(spark, d))


@query("select distinct 'Feed & ' || source as title, 'https://' || source || '.test/rss?a=1&b=2' as feed_url, true as importable from documents")
def opml_import(spark, d):
    return opml.outlines(opml.export(_sources(spark, d))).select("title", "feed_url", "importable")


@query("select count(*) as n, count(distinct source_id) as n_sources from (select source as source_id, row_number() over (partition by source order by doc_id) as r from documents) where r <= 500")
def ingest_pass(spark, d):
    none = spark.createDataFrame([], "id string, workspace_id string, canonical_url string, source_id string, guid string, fetched_at long, simhash long")
    fresh = passes.ingest(_feed_bodies(spark, d), none, reads.clock(spark, d))
    return fresh.agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("n_sources"))


# logs, schedules and streams


@query("select event_type as topic_id, user_id as article_id, min(epoch_us(ts) // 1000) as matched_at from events group by all")
def match_record(spark, d):
    m = table(spark, d, "events").select(F.col("event_type").alias("topic_id"), F.col("user_id").alias("article_id"), millis("ts").alias("matched_at"))
    return store.insert_new(m, m.limit(0), ["topic_id", "article_id"], ["matched_at"])


@query("select distinct source as id, 'Feed ' || source as title from documents order by title, id limit 200")
def sources_list(spark, d):
    s = table(spark, d, "documents").select(F.col("source").alias("id")).distinct().withColumn("title", F.concat(F.lit("Feed "), "id"))
    return s.orderBy("title", "id").limit(store.clamp_limit(None))


@query(
    f"with {ARTICLES}, b as (select source_id as id, max(published_at) as last from art where saved_at is not null group by source_id), w as (select distinct source_id as id from art), "
    "t as (select w.id, last, (select now // 86400000 * 86400000 from clock) as due_at from w left join b using (id)) select id, due_at from t, clock where due_at <= now and (last is null or last < due_at)"
)
def brief_due(spark, d):
    a, now = reads.load_articles(spark, d), reads.clock(spark, d)
    briefs = a.filter("saved_at is not null").select(F.col("source_id").alias("workspace_id"), F.col("published_at").alias("generated_at"))
    due = dates.local_time_today_ms("UTC", F.lit("00:00"), F.lit(now))
    return store.brief_due(a.select(F.col("source_id").alias("id")).distinct(), briefs, now, due)


@query(f"with {_DUPES} select count(distinct source) as polled, 0 as failed, count(*) as items, count(*) - count(duplicate_of) as inserted, count(duplicate_of) as duplicates from documents left join p on id = doc_id")
def ingest_report(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source").join(near_dup.sorted_(_originals(spark, d)), "id", "left")
    log = t.groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("items"), F.count("duplicate_of").alias("duplicates"))
    log = log.withColumns({"ok": F.lit(True), "inserted": F.col("items") - F.col("duplicates")})
    r = store.ingest_report(log)
    return r.select("polled", F.col("failed").cast("long").alias("failed"), "items", "inserted", "duplicates")


@query("select event_type as topic_id, (epoch_us(ts) // 3600000000)::bigint as hour, count(*) as n from events group by all")
def stream_hourly_counts(spark, d):
    """The events as a stream, counted by hour; every batch replaces the table of counts."""
    import tempfile
    import uuid

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    counts = passes.hourly_counts(stream.select(F.col("event_type").alias("topic_id"), F.col("ts").cast("timestamp").alias("ts")))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{shared.rstrip('/')}/hourly-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="inkstream-hourly-")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/counts")
    counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/counts").select("topic_id", F.floor(F.unix_seconds("hour") / 3600).alias("hour"), "n")
