"""Text functions as built-in Columns: normalisation, tokens, shingles, entities, sets.

Two token orders exist on purpose.  ``tokens_raw`` splits first and lowers each token
(fingerprints, snapshots); ``tokens_norm`` lowers and squeezes white space first
(queries, clustering).  They differ where lowering creates a mark, as for U+0130.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOPWORDS = (
    "a about after again against all also am an and any are as at back be because been before being below between both but by can cannot could "
    "did do does doing down during each few for from further get give had has have having he her here hers herself him himself his how i if in into "
    "is it its itself just latest like make many me more most my myself new news no nor not now of off on once one only or other others ought our "
    "ours ourselves out over own please report reports said same say says she should so some such take tell than thanks that the their theirs them "
    "themselves then there these they this those through to too under until up us very was we were what whats when where which while who whom why "
    "will with would you your yours yourself"
).split()
#: Capitalised words that name nothing.
ENTITY_STOPWORDS = (
    "april august december february friday january july june march may monday november october saturday september sunday thursday tuesday wednesday"
).split()
MIN_SNAPSHOT_TOKEN = 3
MAX_ENTITY_WORDS = 3
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"
EDGES = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strings() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text) -> Column:
    """Lower case, runs of white space to one space, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(_col(text)), r"(?U)\s+", " "))


def tokens_raw(text) -> Column:
    """Runs of letters and numbers, lowered one by one; none for null."""
    parts = F.filter(F.split(F.coalesce(_col(text), F.lit("")), NOT_WORD), lambda t: t != "")
    return F.transform(parts, F.lower)


def tokens_norm(text) -> Column:
    """Runs of letters and numbers of the normalised text; none for null."""
    return F.filter(F.split(F.coalesce(normalize(text), F.lit("")), NOT_WORD), lambda t: t != "")


def is_stopword(word) -> Column:
    return _col(word).isin(STOPWORDS)


def is_entity_stopword(word) -> Column:
    return _col(word).isin(STOPWORDS + ENTITY_STOPWORDS)


def snapshot_tokens(text) -> Column:
    """Distinct raw tokens in order of appearance, of three characters or more, without stopwords."""
    long_ = F.filter(F.array_distinct(tokens_raw(text)), lambda t: F.length(t) >= MIN_SNAPSHOT_TOKEN)
    return F.filter(long_, lambda t: ~t.isin(STOPWORDS))


def shingles(tokens: Column, width: int = 3) -> Column:
    """Runs of ``width`` tokens joined by spaces, repeats kept; fewer tokens give the tokens."""

    def join(t: Column) -> Column:
        runs = F.slice(F.transform(t, lambda _, i: F.array_join(F.slice(t, i + 1, F.lit(width)), " ")), F.lit(1), F.greatest(F.size(t) - (width - 1), F.lit(0)))
        return F.when(F.size(t) < width, t).otherwise(runs)

    return let(tokens, join)


def shingle_set(text) -> Column:
    """Distinct three-token shingles of the normalised text, sorted."""
    return F.sort_array(F.array_distinct(shingles(tokens_norm(text))))


def entities(*texts) -> Column:
    """Sorted distinct runs of capitalised words, lowered, at most the last three words of a run.

    A run ends at a word that is not capitalised or is a stopword, after a word that
    ends in one of ``. ! ? ; :``, and with its text.
    """
    found = [_entity_runs(_col(t)) for t in texts]
    return F.sort_array(F.array_distinct(F.concat(*found)))


def _entity_runs(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    zero = F.struct(_strings().alias("run"), _strings().alias("out"))

    def flush(run: Column, out: Column) -> Column:
        return F.when(F.size(run) > 0, F.array_append(out, F.array_join(run, " "))).otherwise(out)

    def step(acc: Column, raw: Column) -> Column:
        def classify(word: Column) -> Column:
            low = F.lower(word)
            named = word.rlike(r"^[\p{Lu}\p{N}]") & ~is_entity_stopword(low)
            grown = F.slice(F.array_append(acc["run"], low), F.greatest(F.size(acc["run"]) + 2 - MAX_ENTITY_WORDS, F.lit(1)), F.lit(MAX_ENTITY_WORDS))
            run = F.when(named, grown).otherwise(_strings())
            out = F.when(named, acc["out"]).otherwise(flush(acc["run"], acc["out"]))
            ends = raw.rlike(r"[.!?;:]$")
            return F.struct(F.when(ends, _strings()).otherwise(run).alias("run"), F.when(ends, flush(run, out)).otherwise(out).alias("out"))

        return let(F.regexp_replace(raw, EDGES, ""), classify)

    return F.aggregate(words, zero, step, lambda acc: flush(acc["run"], acc["out"]))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def xml_escape(text) -> Column:
    out = _col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
