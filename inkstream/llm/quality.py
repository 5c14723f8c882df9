"""Quality rules by distribution divergence, in built-in functions only.

Each text's character-class and common-word histograms are compared with those of
language references by Jensen-Shannon distance (square root of the divergence in
bits).  The nearest language counts.  A histogram over few characters or words
says little, so each distance has a minimum length below which it is not used, and a
text most of whose characters are in no class of the references (another script) is not
compared with them.

One projection over the scan: no shuffle, no Python.  Intermediate columns are
used at least twice by the next projection, which keeps Catalyst from inlining
them into lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Character classes in the order they are taken out of a text; what is left over is "other".
CLASSES = (
    ("consonants", "[b-df-hj-np-tv-z]+"),
    ("vowels", "[aeiou]+"),
    ("upper", "[A-Z]+"),
    ("symbols", SYMBOLS),
    ("digits", "[0-9]+"),
    ("punctuation", r"[.,;:!?'\"()\[\]{}/_+=@~^`\\-]+"),
)

#: Shares of those classes and of "other" in running prose, by language.
CLASS_SHARES = {
    "en": (0.570, 0.370, 0.025, 0.0005, 0.004, 0.030, 0.0005),
    "de": (0.560, 0.340, 0.050, 0.0005, 0.004, 0.025, 0.0205),
    "fr": (0.490, 0.410, 0.025, 0.0005, 0.004, 0.035, 0.0355),
    "es": (0.480, 0.430, 0.025, 0.0005, 0.004, 0.030, 0.0305),
}

#: Shares of the commonest words in running prose, by language.
COMMON_WORDS = {
    "en": {"the": 0.061, "of": 0.033, "and": 0.028, "to": 0.026, "a": 0.021, "in": 0.021, "is": 0.011, "that": 0.011, "it": 0.009, "was": 0.009, "for": 0.009, "on": 0.007},
    "de": {"der": 0.033, "die": 0.032, "und": 0.028, "in": 0.017, "den": 0.013, "das": 0.012, "nicht": 0.010, "von": 0.010, "zu": 0.010, "ist": 0.009, "mit": 0.009, "des": 0.008},
    "fr": {"de": 0.050, "la": 0.032, "le": 0.025, "et": 0.024, "les": 0.021, "des": 0.018, "en": 0.014, "un": 0.013, "du": 0.012, "une": 0.011, "que": 0.011, "est": 0.010},
    "es": {"de": 0.060, "la": 0.040, "que": 0.030, "el": 0.029, "en": 0.027, "y": 0.025, "a": 0.020, "los": 0.017, "se": 0.011, "del": 0.011, "las": 0.010, "un": 0.010},
}

MIN_CHARS = 200
MIN_WORDS = 100
#: Character classes alone reject beyond this distance, both histograms by their mean distance.
CLASS_LIMIT = 0.30
MEAN_LIMIT = 0.255


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    bare = F.btrim(text, F.lit(SEPARATORS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))


def _distance(counts: Column, total: Column, shares: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance of counts/total from shares, which sum to 1."""

    def term(count: Column, q: Column) -> Column:
        p = count / total
        mid = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / mid)).otherwise(0.0) + q * F.log2(q / mid)

    terms = F.zip_with(counts, F.array(*map(F.lit, shares)), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(0.0)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and the two distances of each row (doc_id, text)."""
    listed = sorted({w for lang in COMMON_WORDS.values() for w in lang})
    longest = max(map(len, listed))
    d = docs.select("doc_id", "text", words(F.col("text")).alias("w"))
    n = F.size("w")
    # one hash a window; a window's hash with its place sorts equal windows together
    d = d.select(
        "doc_id",
        "w",
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.array_join("w", "").alias("s"),
        F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0))).alias("t"),
        F.filter("w", lambda x: (F.length(x) <= longest) & F.lower(x).isin(listed)).alias("common"),
    )
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "s",
        "t",
        F.sort_array("t").alias("ts"),
        # each word between two spaces of its own
        F.concat(F.lit(" "), F.array_join(F.transform("common", F.lower), "  "), F.lit(" ")).alias("common"),
    )
    # windows found twice: neighbours in hash order; without any, places are not needed
    some = F.size(F.array_distinct("ts")) < F.size("ts")
    ordered = F.sort_array(F.transform("t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("so", F.when(some, ordered))
    last = F.size("so") - 1
    twice = F.filter(
        F.transform(
            "so",
            lambda x, k: F.when((x["h"] == F.get("so", k - 1)["h"]) | (x["h"] == F.get("so", F.least(k + 1, last))["h"]) & (k < last), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    d = d.withColumn("at", F.when(F.size("so") > 0, F.sort_array(twice)))
    # a window covers three words, less those of the next window found twice
    covered = F.aggregate(
        F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.size("at") > 0, covered), F.lit(0).cast("long")))
    d = d.withColumn("word_chars", F.length("s").cast("long"))
    names, before = [], F.col("s")
    for name, pattern in CLASSES:
        d = d.withColumn(f"r_{name}", F.regexp_replace(before, pattern, ""))
        d = d.withColumn(f"c_{name}", (F.length(before) - F.length(f"r_{name}")).cast("long"))
        before = F.col(f"r_{name}")
        names.append(f"c_{name}")
    d = d.withColumn("c_other", F.length(before).cast("long"))
    names.append("c_other")
    d = d.select(
        "doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", *names,
        *(F.expr(f"(octet_length(common) - octet_length(replace(common, ' {w} ', ''))) div {len(w) + 2}").alias(f"w_{w}") for w in listed),
    )
    d = d.withColumn("classes", F.array(*names))
    for lang, own in COMMON_WORDS.items():
        hits = F.array(*(F.col(f"w_{w}").cast("long") for w in own))
        d = d.withColumn(f"h_{lang}", hits).withColumn(
            f"h_{lang}", F.concat(f"h_{lang}", F.array(F.col("n_words") - F.aggregate(f"h_{lang}", F.lit(0).cast("long"), lambda acc, x: acc + x)))
        )
    by_class = [_distance(F.col("classes"), F.col("word_chars"), shares) for shares in CLASS_SHARES.values()]
    by_word = [
        _distance(F.col(f"h_{lang}"), F.col("n_words"), (*own.values(), 1 - sum(own.values()))) for lang, own in COMMON_WORDS.items()
    ]
    return d.select(
        "doc_id", "n_words", "word_chars", F.col("c_symbols").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.when((F.col("word_chars") >= MIN_CHARS) & (2 * F.col("c_other") <= F.col("word_chars")), F.least(*by_class)).alias("class_distance"),
        F.when((F.col("n_words") >= MIN_WORDS) & (2 * F.col("c_other") <= F.col("word_chars")), F.least(*by_word)).alias("word_distance"),
    )


def judge(docs: DataFrame, class_limit: float = CLASS_LIMIT, mean_limit: float = MEAN_LIMIT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text) with base counts, distances and verdicts.

    ``base_failed``: under 50 words, or over half the words in repeated 3-word windows.
    ``kept``: neither that, nor too far from every language reference: by character
    classes beyond ``class_limit``, or by the mean of both distances beyond
    ``mean_limit``.  A null distance (text too short for its histogram, or in a script
    without references) rejects nothing.  Whole texts of any length are counted.
    Null and wordless texts have zero counts and fail the base rule.  Repeated rows,
    null ids and extra columns change nothing; an empty table gives an empty result.
    """
    d = features(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    mean = (F.col("class_distance") + F.col("word_distance")) / 2
    far = F.coalesce(F.col("class_distance") > class_limit, F.lit(False)) | F.coalesce(mean > mean_limit, F.lit(False))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "word_distance",
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns and no shuffle.

    The whole row rides along in place of the id.  The row number keeps Catalyst from
    pushing the filter, and with it a copy of every feature, down to the scan.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    return judge(rows).withColumn("row", F.monotonically_increasing_id()).filter("kept and row >= 0").select("doc_id.*")
