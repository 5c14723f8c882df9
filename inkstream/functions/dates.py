"""Dates of feeds and local clock times, as built-in Columns; times are epoch millis."""

from __future__ import annotations

from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions.text import _col

HOUR_MS = 3_600_000
#: Formats without an offset, read as UTC.
NAIVE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "d MMM yyyy HH:mm:ss")


def parse_date(text) -> Column:
    """Epoch millis of an RFC 2822, RFC 3339, naive or plain date; null for anything else."""
    t = F.btrim(F.regexp_replace(F.btrim(_col(text)), r"\s*\([^()]*\)$", ""))
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UT|UTC|Z)$", " +0000")
    zones = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
    for name, offset in zones.items():
        mail = F.regexp_replace(mail, rf"\s+{name}$", f" {offset}")
    stamped = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(F.upper(t)))
    tries = [F.try_to_timestamp(mail, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")] + [stamped]
    naive = [F.try_to_timestamp(t, F.lit(f)) for f in (*NAIVE_FORMATS, "yyyy-MM-dd")]
    # naive forms are read in the session's zone, so shift them to UTC
    zone = F.current_timezone()
    return F.unix_millis(F.coalesce(*tries, *(F.from_utc_timestamp(n, zone) for n in naive)))


def hour_of_day(ms) -> Column:
    """UTC hour of epoch millis."""
    return F.pmod(F.floor(_col(ms) / HOUR_MS), F.lit(24)).cast("long")


def to_rfc3339(ms) -> Column:
    """Seconds-precision UTC text of epoch millis."""
    seconds = F.unix_seconds(F.timestamp_millis(_col(ms)))
    # without the session's zone, whose gaps have UTC times that it cannot show
    at = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(days=F.floor(seconds / 86_400).cast("int"), secs=F.pmod(seconds, F.lit(86_400)))
    return F.concat(F.translate(at.cast("string"), " ", "T"), F.lit("Z"))


def resolve_tz(name: str | None) -> str:
    """``name`` if it is an IANA zone, else UTC."""
    try:
        ZoneInfo(name or "")
        return name
    except (ZoneInfoNotFoundError, ValueError):
        return "UTC"


def local_time_today_ms(zone: str | None, hhmm, now) -> Column:
    """Epoch millis of HH:MM on the local day of ``now``; null if that is no time.

    A time in a gap moves on by an hour, an ambiguous one is the earlier.
    """
    zone = resolve_tz(zone)
    pattern = r"^\s*(\d{1,2})\s*:\s*(\d{1,2})\s*$"
    text = _col(hhmm)
    hours, minutes = (F.regexp_extract(text, pattern, n).try_cast("int") for n in (1, 2))
    ok = text.rlike(pattern) & (hours <= 23) & (minutes <= 59)
    utc = F.to_utc_timestamp(F.timestamp_millis(_col(now)), F.current_timezone())
    day = F.date_format(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd")
    local = F.to_timestamp(F.concat(day, F.format_string(" %02d:%02d:00", hours, minutes)))
    return F.when(ok, F.unix_millis(F.from_utc_timestamp(F.to_utc_timestamp(local, zone), F.current_timezone())))
