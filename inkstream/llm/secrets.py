"""Secret scan: fixed patterns plus sliding-window entropy, in built-in functions only.

Each pattern's leftmost non-overlapping matches come from ``regexp_extract_all``;
their code-point positions are running sums of the lengths of the matches and of
the pieces that ``split`` leaves between them.  Cheap guards keep the position work
to the few texts that can match.

High-entropy spans: candidate runs of secret-like characters, = only at their end so
that a name before it is not part of the value, are walked with the counts of the last
``WINDOW`` characters kept up to date, one character in and one out; the window's
Shannon entropy follows from the running sum of c*log2(c).  The limit depends on the
run's character class: hexadecimal, letters of one case, base32, letters, others.  A
span is what windows over the limit cover without a gap.

The walk goes by blocks of ``BLOCK`` windows, each a fold whose state is a few longs
(counts packed in five bits, verdicts as bits), so its time is linear in the run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{18,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

WINDOW = 20
#: Bits a character of a window must hold, by class of the run.
HEX_BITS = 3.0
ONE_CASE_BITS = 3.2
BASE32_BITS = 3.3
LETTER_BITS = 3.55
MIXED_BITS = 3.6
CLASSES = {"^(?:[0-9a-f]+|[0-9A-F]+)$": HEX_BITS, "^(?:[a-z]+|[A-Z]+)=*$": ONE_CASE_BITS, "^(?:[A-Z2-7]+|[a-z2-7]+)=*$": BASE32_BITS, "^[A-Za-z]+=*$": LETTER_BITS}
#: Windows whose verdicts one long holds, and counts of five bits that one does.
BLOCK = 62
PACKED = 12
#: Runs that look random but are public or plainly not secret.
ALLOWED = (
    r"^[0-9+/_=-]+$",  # numbers, dates, phone numbers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)(?:^|[^A-Za-z0-9])(?:example|placeholder|changeme|dummy|sample|test)(?:[^A-Za-z]|$)",
    r"(?i)0123456789|abcdefgh|x{6}",
)
#: Paths and names of several words are allowed too: parts between these, each a word.
JOINTS = r"[+/_=-]+"
WORD = r"^(?:[A-Z]?[a-z]{1,18}|[A-Z]{1,19})$"

_SPANS = "array<struct<s:bigint,e:bigint,v:string>>"


def _running(lengths: Column) -> Column:
    """Inclusive running sums of an array<bigint>, in log2(n) passes over it."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths) + 1)).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        shifted = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.pow(F.lit(2), k).cast("int")), acc)
        return F.slice(F.zip_with(acc, shifted, lambda a, b: F.coalesce(a, F.lit(0).cast("bigint")) + b), F.lit(1), F.size(acc))

    return F.aggregate(steps, lengths, step)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, pattern: str, group: int, guard: Column) -> Column:
    """array of (start, end, captured value) of the pattern's matches; empty where the guard is false."""
    pattern_ = F.lit(pattern)

    def place(found: Column) -> Column:
        # found: matches m, pieces p, values v of one text
        lengths = F.zip_with(found["p"], found["m"], lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
        # p has one piece more than m has matches; its last sum is not used
        return _let(
            _running(lengths),
            lambda ends: F.transform(
                found["m"],
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), F.get(found["v"], i).alias("v")
                ),
            ),
        )

    found = F.struct(
        F.regexp_extract_all(text, pattern_, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pattern_, F.lit(group)).alias("v"),
        F.split(text, pattern, -1).alias("p"),
    )
    return F.when(guard, _let(found, place)).otherwise(F.array()).cast(_SPANS)


def _allowed(value: Column) -> Column:
    """Whether a run is not a secret.  Parts are tested one by one: a pattern over all of them recurses in Java."""
    parts = lambda p: (F.size(p) > 1) & F.forall(p, lambda x: x.rlike(WORD))
    names = _let(F.filter(F.split(value, JOINTS, -1), lambda x: x != ""), parts)
    return value.rlike("|".join(f"(?:{p})" for p in ALLOWED)) | names


def _limit(value: Column) -> Column:
    """Bits that a window of a run must hold."""
    limit = F.lit(MIXED_BITS)
    for pattern, bits in reversed(CLASSES.items()):
        limit = F.when(value.rlike(pattern), F.lit(bits)).otherwise(limit)
    return limit


def _shift(kind: str, x: Column, by: Column) -> Column:
    return F.call_function(kind, x, by)


def _hot(value: Column) -> Column:
    """array of (first, last): starts of the first and last window of each span of windows over the limit."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    logs = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)))
    cells = -(-len(ALPHABET) // PACKED)
    slot = lambda code: (code / PACKED).cast("int")
    place = lambda code: (code % PACKED * 5).cast("int")
    count = lambda counts, code: F.coalesce(_shift("shiftrightunsigned", F.get(counts, slot(code)), place(code)).bitwiseAND(F.lit(31)).cast("int"), F.lit(0))

    def block(codes: Column, limit: Column, first: Column, windows: Column) -> Column:
        """Verdicts of at most BLOCK windows from ``first`` on, as bits."""
        last = F.least(first + BLOCK, windows) + (WINDOW - 2)

        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.when(i - WINDOW >= first, F.get(codes, i - WINDOW))
            c_in = count(acc["counts"], new)
            c_out = F.when(old.isNotNull(), count(acc["counts"], old) + F.when(old == new, 1).otherwise(0)).otherwise(F.lit(0))
            total = acc["sum"] + F.get(logs, c_in + 1) - F.get(logs, c_in) + F.get(logs, F.greatest(c_out - 1, F.lit(0))) - F.get(logs, c_out)
            at = i - (WINDOW - 1) - first
            hot = (at >= 0) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= limit)
            unit = lambda code, k: F.when(slot(code) == k, _shift("shiftleft", one, place(code))).otherwise(zero)
            return F.struct(
                F.transform(acc["counts"], lambda c, k: c + unit(new, k) - unit(old, k)).alias("counts"),
                total.alias("sum"),
                F.when(hot, acc["bits"].bitwiseOR(_shift("shiftleft", one, at))).otherwise(acc["bits"]).alias("bits"),
            )

        start = F.struct(F.array_repeat(zero, cells).alias("counts"), F.lit(0.0).alias("sum"), zero.alias("bits"))
        return F.aggregate(F.sequence(first, last), start, step, lambda acc: acc["bits"])

    def spans(bits: Column, windows: Column) -> Column:
        hot = lambda i: _shift("shiftrightunsigned", F.get(bits, (i / BLOCK).cast("int")), (i % BLOCK).cast("int")).bitwiseAND(one) == 1
        all_ = F.sequence(F.lit(0), windows - 1)
        ends = F.struct(
            F.filter(all_, lambda i: hot(i) & ((i == 0) | ~hot(F.greatest(i - 1, F.lit(0))))).alias("s"),
            F.filter(all_, lambda i: hot(i) & ((i == windows - 1) | ~hot(F.least(i + 1, windows - 1)))).alias("e"),
        )
        # runs of windows that overlap or touch are one span
        apart = lambda x: F.struct(
            F.filter(x["s"], lambda s, k: (k == 0) | (s > F.get(x["e"], F.greatest(k - 1, F.lit(0))) + WINDOW)).alias("s"),
            F.filter(x["e"], lambda e, k: (k == F.size(x["e"]) - 1) | (F.get(x["s"], k + 1) > e + WINDOW)).alias("e"),
        )
        return _let(ends, lambda x: _let(apart(x), lambda y: F.zip_with(y["s"], y["e"], lambda s, e: F.struct(s.alias("first"), e.alias("last")))))

    def walk(v: Column) -> Column:
        windows = F.size(v["codes"]) - (WINDOW - 1)
        bits = F.transform(F.sequence(F.lit(0), windows - 1, F.lit(BLOCK)), lambda first: block(v["codes"], v["limit"], first, windows))
        return _let(bits, lambda b: spans(b, windows))

    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return _let(F.struct(codes.alias("codes"), _limit(value).alias("limit")), walk)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts and spans of secrets.

    Null and empty texts have no spans; a text is scanned whole in time linear in its length.  Spans are ``kind:start:end`` in code points
    with the end excluded, ordered by start, then kind.  ``base_sha256`` is over the
    base kinds alone; entropy spans are added unless a base span covers them.
    Repeated rows, null ids and extra columns change nothing; an empty table gives an
    empty result.
    """
    text = F.col("t")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.select(
        "doc_id",
        F.filter(_spans(text, ASSIGN, 1, (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN)), lambda x: F.length(x["v"]) >= 6).alias("assign"),
        F.filter(_spans(text, ACCESS, 0, F.contains(text, F.lit("AKIA"))), lambda x: F.length(x["v"]) >= 20).alias("access"),
        _spans(text, HEX, 0, text.rlike(HEX)).alias("hex"),
        F.filter(
            _spans(text, CANDIDATE, 0, text.rlike(CANDIDATE)),
            lambda x: (F.length(x["v"]) >= WINDOW) & ~_allowed(x["v"]),
        ).alias("runs"),
    )
    rank = {k: i for i, k in enumerate(KINDS)}
    tagged = lambda name: F.transform(name, lambda x: F.struct(x["s"].alias("s"), F.lit(rank[name]).alias("k"), x["e"].alias("e")))
    d = d.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sort_array(F.concat(*(tagged(k) for k in KINDS[:3]))).alias("base"),
        F.flatten(
            F.transform(
                "runs", lambda x: F.transform(_hot(x["v"]), lambda h: F.struct((x["s"] + h["first"]).alias("s"), F.lit(rank["entropy"]).alias("k"), (x["s"] + h["last"] + WINDOW).alias("e")))
            )
        ).alias("entropy"),
    )
    d = d.withColumn("added", F.filter("entropy", lambda x: ~F.exists("base", lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"]))))
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return d.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
