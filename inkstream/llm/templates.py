"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other
parameters has the same template as the benchmark's.  Windows of template tokens are
hash-joined with the benchmark's; matches on one diagonal (same offset between text
and item) form runs, and a run counts if its placeholders are filled consistently:
one value of the item always stands for one value of the text and the other way
round.  Verbatim passages are the identity filling.

Windows with more placeholders than literal tokens say little as templates.  They are
hashed with their values, so that they match verbatim, and with other values they only
continue a run from a literal window beside them, token by token: a literal window
carries the placeholder-heavy tokens next to it (at most an item's length).

The documents are read once.  Tasks get a bitmap of the benchmark's window hashes, of
``BITS_EACH`` bits a hash and at most ``MOST_BITS``, and emit the windows that it lets pass;
the hash join then settles which match.  Items of one template are told apart by their
values: each is compared with a text on its own, and only equal ones are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm import _text
from inkstream.llm._stash import Stash

WIDTH = 8
#: A run of this many tokens, or all of a shorter item but one, is a leak.
RUN = 13
#: Bits of the bitmap that are set together.
CELL_BITS = 17
SHORTEST = 3
#: Bits of the bitmap for each of the benchmark's window hashes, and of the whole (128 MB).
BITS_EACH = 16
MOST_BITS = 30
#: Diagonals turned into Python objects at once.
JUDGED = 32
#: Units that follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons "
    "s ms min h hr hrs sec second seconds minute minutes hour hours day days week weeks month months year years "
    "percent % usd eur gbp dollar dollars cent cents euro euros mph kph c f k degrees degree v w kw hz khz mhz ghz b kb mb gb tb"
).split()

_CORE = np.zeros(256, bool)
_CORE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), 0x25]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x4E554D, 0x554E4954, 0x4E414D45))
_unit_hashes: np.ndarray | None = None


def _units() -> np.ndarray:
    global _unit_hashes
    if _unit_hashes is None:
        raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        s, e, _ = _text.word_bounds(raw, np.array([0, len(raw)]))
        _unit_hashes = np.sort(_text.word_hashes(raw, s, e))
    return _unit_hashes


def template_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template, value, slot, first): per token its template and, for placeholders, a hash of its value (else 0) and whether it surely is one.

    A token is a word without punctuation around it, A-Z in lower case; words of
    punctuation alone are left out.  A name is a capitalised word, at a sentence's start
    too: where it is "The", its value is the same in a copy, and where it is "Tom", it is
    the name that stands inside the sentence.  It is not surely one there.
    """
    starts, ends, first = _text.word_bounds(data, offs)
    core = np.flatnonzero(_CORE[data])
    if not len(core) or not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(offs), np.int64)
    low, high = np.searchsorted(core, starts), np.searchsorted(core, ends)
    some = high > low
    begin, end = core[np.minimum(low, len(core) - 1)], core[np.maximum(high - 1, 0)] + 1
    # a sentence starts with a text, after a stop or on a new line
    fresh = np.ones(len(starts), bool)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    fresh[1:] = _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[starts[:-1]])
    fresh[first[:-1][first[:-1] < len(starts)]] = True
    own = _text.owner(first)
    begin, end, fresh, own = begin[some], end[some], fresh[some], own[some]
    value = _text.word_hashes(data, begin, end, lower=True)
    template = value.copy()
    number = _DIGIT[data[begin]]
    after = np.zeros(len(begin), bool)
    after[1:] = number[:-1] & (own[1:] == own[:-1])
    unit = after & np.isin(value, _units())
    accent = (data[begin] == 0xC3) & (data[np.minimum(begin + 1, len(data) - 1)] < 0x9F)
    name = (_UPPER[data[begin]] | accent) & ~number & ~unit
    template[number], template[unit], template[name] = NUMBER, UNIT, NAME
    value[~(number | unit | name)] = 0
    return template, value, number | unit | name & ~fresh, np.searchsorted(own, np.arange(len(offs)))


def _windows(template: np.ndarray, value: np.ndarray, slot: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens and hashes of windows in one text, and of all first tokens whether the window is mostly placeholders.

    Those windows are hashed with their values, the others as templates.
    """
    n = len(template) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    slots = np.concatenate([[0], np.cumsum(slot)])
    inside = own[:n] == own[width - 1 :]
    heavy = inside & (2 * (slots[width:] - slots[:n]) > width)
    h = _text.window_hashes(template, width)
    if heavy.any():
        filled = np.where(value != 0, _text.mix(template + _text.mix(value)), template)
        h[heavy] = _text.mix(_text.window_hashes(filled, width)[heavy])
    at = np.flatnonzero(inside)
    return at, h[at], heavy


def _beside(heavy: np.ndarray, at: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the heavy windows before and after each literal window, at most ``reach``; 0 for heavy ones."""
    stops = np.concatenate([[-1], np.flatnonzero(~heavy), [len(heavy)]])
    before = at - 1 - stops[np.searchsorted(stops, at) - 1]
    after = stops[np.searchsorted(stops, at, "right")] - 1 - at
    literal = ~heavy[at]
    return np.where(literal, np.minimum(before, reach), 0), np.where(literal, np.minimum(after, reach), 0)


def _lists(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    place = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[place].view(np.int64)))


def _bitmap(bits: int):
    """Window hashes, sorted by their first bits, to rows of (cell, its bits set)."""

    def run(batches):
        cell, hit = None, None
        for batch in batches:
            slot = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            cells = (slot >> np.uint64(CELL_BITS)).astype(np.int64)
            for c in np.unique(cells).tolist():
                if c != cell and cell is not None:
                    yield pa.RecordBatch.from_pydict({"cell": [cell], "bits": [np.packbits(hit, bitorder="little").tobytes()]})
                if c != cell:
                    cell, hit = c, np.zeros(1 << CELL_BITS, bool)
                hit[(slot[cells == c] & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)] = True
        if cell is not None:
            yield pa.RecordBatch.from_pydict({"cell": [cell], "bits": [np.packbits(hit, bitorder="little").tobytes()]})

    return run


def known_hashes(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of a table of hashes ``h``: bit i is set if a hash starts with the bits of i."""
    bits = min(max((hashes.count() * BITS_EACH).bit_length(), CELL_BITS + 1), MOST_BITS)
    cell = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - bits + CELL_BITS))
    rows = hashes.repartition(cell).sortWithinPartitions(cell).mapInArrow(_bitmap(bits), "cell long, bits binary").collect()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows:
        at = r.cell << CELL_BITS >> 3
        out[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return bits, out


def _emit(widths: tuple[int, ...], known, whole: bool, reach: int):
    """(id, text) to (h, id, at, values, tokens, lead, t, v); ``known`` broadcasts the bitmap of hashes to keep.

    ``t`` and ``v`` are templates and values of a literal window with the heavy tokens
    beside it, ``lead`` of them before it; empty if there are none.

    ``whole`` emits for each text its windows of ``WIDTH``, or itself if it is shorter.
    """

    def run(batches):
        keep = known.value if known is not None else None
        for batch, data, offs in _text.chunks(batches):
            template, value, slot, first = template_tokens(data, offs)
            own, counts = _text.owner(first), np.diff(first)
            for width in widths:
                at, h, heavy = _windows(template, value, slot, own, width)
                if whole:
                    hit = (counts[own[at]] == width) | (width == WIDTH)
                else:
                    bit = (h >> np.uint64(64 - keep[0])).astype(np.int64)
                    hit = (keep[1][bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                at, h = at[hit], h[hit]
                if len(at):
                    before, after = _beside(heavy, at, width, reach)
                    wide = np.where(before + after > 0, before + width + after, 0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h.view(np.int64)),
                            batch.column(0).take(pa.array(own[at])),
                            pa.array((at - first[own[at]]).astype(np.int32)),
                            _lists(value, at, np.full(len(at), width)),
                            pa.array(counts[own[at]].astype(np.int32)),
                            pa.array(before.astype(np.int32)),
                            _lists(template, at - before, wide),
                            _lists(value, at - before, wide),
                        ],
                        names=["h", "id", "at", "vals", "tokens", "lead", "t", "v"],
                    )

    return run


def _cells(matches: list[dict]) -> dict[int, tuple[int, int]]:
    """{place in the text: (item's value, text's value)} of all tokens that match on one diagonal."""
    cells = {}
    for m in matches:
        for k, pair in enumerate(zip(m["b"], m["d"])):
            cells.setdefault(m["at"] + k, pair)
        here, there = m["ours"], m["theirs"]
        if not here:
            continue
        for step, k in ((-1, -1), (1, len(m["d"]))):
            while True:
                i, j = here["lead"] + k, there["lead"] + k
                if not (0 <= i < len(here["t"]) and 0 <= j < len(there["t"]) and here["t"][i] == there["t"][j]):
                    break
                cells.setdefault(m["at"] + k, (there["v"][j], here["v"][i]))
                k += step
    return cells


def _longest(matches: list[dict]) -> tuple[int, int]:
    """(tokens, -changed values) of the longest consistent run around a matched window of one diagonal."""
    cells = _cells(matches)
    windows = sorted((m["at"], m["at"] + len(m["d"])) for m in matches)
    best, begin, last, inside = (0, 0), 0, None, 0
    there, back, uses = {}, {}, {}
    for at in sorted(cells):
        if last is None or at != last + 1:
            begin, there, back, uses = at, {}, {}, {}
        last = at
        a, b = cells[at]
        if a or b:
            # after a clash the run begins behind the older of the two
            while there.get(a, b) != b or back.get(b, a) != a:
                x, y = cells[begin]
                begin += 1
                if x or y:
                    uses[x] -= 1
                    if not uses[x]:
                        del uses[x], there[x], back[y]
            there[a], back[b] = b, a
            uses[a] = uses.get(a, 0) + 1
        while inside < len(windows) and windows[inside][0] < begin:
            inside += 1
        if inside < len(windows) and windows[inside][1] <= at + 1:
            best = max(best, (at + 1 - begin, -sum(x != y for x, y in there.items())))
    return best


def _judge(run_tokens: int):
    """Matches of one text, item and diagonal to its longest consistent run."""

    def run(batches):
        for batch in _text.rows(batches, JUDGED):
            out = []
            for doc, item, tokens, matches in zip(*(batch.column(i).to_pylist() for i in range(4))):
                best, changed = _longest(matches)
                if best >= max(SHORTEST, min(run_tokens, tokens - 1)):
                    out.append((doc, item, best, -changed))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "run_tokens", "changed_slots"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, run_tokens: int = RUN) -> DataFrame:
    """(doc_id, item_id, run_tokens, changed_slots): documents with a passage of a benchmark item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  Every item of a template
    is compared on its own, so a document is linked to all that its passage fits.  Passages
    with other values are found if they have a window that is at least half literal,
    verbatim ones always.  ``run_tokens`` is the longest run and ``changed_slots`` how many
    of its values differ from the item's (0: verbatim).  Whole texts of any length are read.
    Null and empty texts match nothing, nor do items of fewer than three tokens; null
    ids are left out; repeated rows give one row; extra columns are ignored; an empty
    table on either side gives an empty result.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "leaks")
    kind = "h long, id long, at int, vals array<long>, tokens int, lead int, t array<long>, v array<long>"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    widths = tuple(range(SHORTEST, WIDTH + 1))
    windows = items.mapInArrow(_emit(widths, None, True, 1 << 30), kind)
    windows = windows.groupBy("id", "tokens").agg(F.sort_array(F.collect_list(F.struct("at", "h", "vals", "lead", "t", "v"))).alias("w"))
    # items with the same windows and values are one, named by their least id
    words = F.sha2(F.to_json(F.transform("w", lambda x: F.struct(x["at"], x["h"], x["vals"]))), 256)
    windows = stash.put(windows.withColumn("words", words), "items")
    one = windows.groupBy("words", "tokens").agg(F.min(F.struct("id", "w")).alias("r"))
    equal = windows.select("words", F.col("id").alias("item_id")).join(one.select("words", F.col("r.id").alias("first")), "words").select("first", "item_id").distinct()
    wide = lambda x: F.struct(*(x[k].alias(k) for k in ("lead", "t", "v")))
    items = stash.put(
        one.select(F.explode("r.w").alias("x"), F.col("r.id").alias("item_id"), "tokens").select(
            F.col("x.h").alias("h"), F.col("x.at").alias("item_at"), F.col("x.vals").alias("b"), wide(F.col("x")).alias("theirs"), "item_id", "tokens"
        ),
        "windows",
    )
    used = tuple(sorted(r[0] for r in items.select(F.size("b")).distinct().collect())) or (WIDTH,)
    # no run is longer than its item
    reach = items.agg(F.max("tokens")).first()[0] or 0
    known = spark.sparkContext.broadcast(known_hashes(items.select("h").distinct()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    found = texts.mapInArrow(_emit(used, known, False, reach), kind)
    found = found.select("h", F.col("id").alias("doc_id"), "at", F.col("vals").alias("d"), F.struct("lead", "t", "v").alias("ours")).join(items, "h").filter(F.size("d") == F.size("b"))
    both = (F.size("ours.t") > 0) & (F.size("theirs.t") > 0)
    # what a run of one diagonal holds is bounded by the item's length
    runs = found.groupBy("doc_id", "item_id", "tokens", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(
        F.sort_array(F.collect_set(F.struct("at", "b", "d", F.when(both, F.col("ours")).alias("ours"), F.when(both, F.col("theirs")).alias("theirs")))).alias("matches")
    )
    judged = runs.select("doc_id", "item_id", "tokens", "matches").mapInArrow(_judge(run_tokens), "doc_id long, item_id long, run_tokens long, changed_slots long")
    best = judged.groupBy("doc_id", F.col("item_id").alias("first")).agg(F.max(F.struct("run_tokens", -F.col("changed_slots"))).alias("m"))
    return best.join(equal, "first").select("doc_id", "item_id", F.col("m.run_tokens").alias("run_tokens"), (-F.col("m.col2")).alias("changed_slots"))
