"""URL canonicalisation as built-in Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions.text import _col, let, normalize

#: Query parameters that only track, besides every utm_*.
TRACKING = ("at_campaign", "at_medium", "fbclid", "gclid", "igshid", "mc_eid", "ref", "ref_src", "s", "spm")
_URL = r"^([A-Za-z0-9+.-]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_TRIM = r"(?U)^\s+|\s+$"
_HOSTPORT = r"(?s)^(.*@)?(\[?[^@]*)$"


def parse(url) -> Column:
    """(scheme, userinfo, host, port, path, query, fragment) of an absolute URL; null if it is none.

    Userinfo ends at the last ``@``; the port follows a closing bracket or the first
    colon; an empty port is none.
    """
    raw = F.regexp_replace(_col(url), _TRIM, "")
    part = lambda n: F.regexp_extract(raw, "(?s)" + _URL, n)

    def build(authority: Column) -> Column:
        hostport = F.regexp_extract(authority, _HOSTPORT, 2)
        bracket = r"^(.*\])(?::(.*))?$"
        is6 = hostport.rlike(r"\]")
        host = F.when(is6, F.when(hostport.rlike(bracket), F.regexp_extract(hostport, bracket, 1)).otherwise(hostport)).otherwise(F.regexp_extract(hostport, "^([^:]*)", 1))
        port = F.when(is6, F.regexp_extract(hostport, bracket, 2)).otherwise(F.regexp_extract(hostport, "^[^:]*:(.*)$", 1))
        return F.when(
            raw.rlike("(?s)" + _URL) & (host != ""),
            F.struct(
                part(1).alias("scheme"), F.regexp_extract(authority, _HOSTPORT, 1).alias("userinfo"), host.alias("host"), F.nullif(port, F.lit("")).alias("port"),
                part(3).alias("path"), F.substring(part(4), 2, 1 << 30).alias("query"), F.substring(part(5), 2, 1 << 30).alias("fragment"),
            ),
        )

    return let(part(2), build)


def is_tracking_param(key) -> Column:
    low = F.lower(_col(key))
    return low.startswith("utm_") | low.isin(*TRACKING)


def canonicalize(url) -> Column:
    """The dedupe key of a URL; what is no URL is normalised text.

    Scheme and host lowered, default port, fragment, tracking and empty parameters and
    one trailing slash dropped, parameters sorted by lowered key, then as written.
    """

    def build(u: Column) -> Column:
        scheme = F.lower(u["scheme"])
        default = F.when(scheme == "http", F.lit("80")).when(scheme == "https", F.lit("443")).otherwise(F.lit(""))
        port = F.when(u["port"].isNotNull() & (u["port"] != default), F.concat(F.lit(":"), u["port"])).otherwise(F.lit(""))
        pairs = F.filter(F.split(u["query"], "&"), lambda p: (p != "") & ~is_tracking_param(F.substring_index(p, "=", 1)))
        ordered = F.sort_array(F.transform(pairs, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), p.alias("p"))))
        query = F.array_join(F.transform(ordered, lambda x: x["p"]), "&")
        return F.concat(scheme, F.lit("://"), u["userinfo"], F.lower(u["host"]), port, F.regexp_replace(u["path"], "/$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))

    return F.coalesce(let(parse(url), build), normalize(url))


def is_http_url(url) -> Column:
    return F.coalesce(let(parse(url), lambda u: F.lower(u["scheme"]).isin("http", "https")), F.lit(False))
