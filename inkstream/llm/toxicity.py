"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Words, windows of words and whole texts are bags of character n-grams, each with an
embedding; a bag's mean goes into a two-class softmax, and both layers are trained
together by mini-batch gradient steps in numpy.  Misspellings share most n-grams with the
word they stand for, so they share its vectors.

A text's score weighs three means of the softmax: of its worst word, which keeps a single
one visible in a long text, of its worst window, in which milder words add up, and of the
whole text.  Training alternates: the current worst word of each labelled text is its
example.  Texts are scored in one Arrow pass; after training an n-gram's part in
the softmax is one number, so the table that tasks get is of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm import _text

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSIONS = 16
#: Words of the windows of which a text's worst counts.
WINDOWS = (1, 8)
#: Windows whose worst are the examples.  Longer ones among them cost accuracy on held-out labels: most of their words are clean.
LEARNT = (1,)
#: Bound of the labelled sample, by label, taken in order of a hash of the id.
SAMPLE = {1: 1000, 0: 1500}
#: Longer texts are not learnt from; the sample goes to the driver.  All texts are scored.
FIT_BYTES = 1 << 16
ROUNDS = 4
#: Share of clean texts whose worst word a toxic text must exceed to be learnt from in a round.
#: Labels of texts without any toxic wording are left out by it; ``train`` says how many.
SURE = 0.99
EPOCHS = 3
RATE = 0.5
DECAY = 0.2
#: The mean of a text without words, and the bound of all means.
EMPTY = -20.0
THRESHOLD = 0.7


def held_out(doc_id: str) -> Column:
    """Whether a row's label is not to be learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _grams(data: np.ndarray, offs: np.ndarray):
    """Word count limits and, for each n, the n-grams: (bucket, word).

    N-grams run over the lower-case bytes of a word with a separator on either side.
    """
    starts, ends, first = _text.word_bounds(data, offs)
    n = len(starts)
    # words laid out one after the other with one separator between them
    sizes = ends - starts
    begin = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
    buf = np.full(begin[-1] if n else 1, 0x20, np.uint8)
    place = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.zeros(0, np.int64), sizes) + np.arange(sizes.sum())
    src = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.zeros(0, np.int64), sizes) + np.arange(sizes.sum())
    buf[place] = _text._LOWER[data[src]]
    of = np.full(len(buf), -1, np.int64)
    of[place] = np.repeat(np.arange(n), sizes)
    codes = _text._BYTE[buf]
    out = []
    for g in GRAMS:
        m = len(buf) - g + 1
        if m <= 0:
            continue
        # inside one word, apart from its two separators
        ok = (of[1 : m + 1] >= 0) & (of[g - 2 : m + g - 2] == of[1 : m + 1])
        at = np.flatnonzero(ok)
        h = np.full(len(at), g, np.uint64)
        for k in range(g):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[at + k]
        out.append(((_text.mix(h) >> np.uint64(47)).astype(np.int64), of[at + 1]))
    bucket = np.concatenate([b for b, _ in out]) if out else np.zeros(0, np.int64)
    word = np.concatenate([w for _, w in out]) if out else np.zeros(0, np.int64)
    return bucket, word, first


def _worst(parts: np.ndarray, counts: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the highest mean over its windows and the first word of that window, the first at ties (-1: no word)."""
    n = len(parts)
    top, at = np.zeros(len(first) - 1), np.full(len(first) - 1, -1)
    if not n:
        return top, at
    s, c = np.concatenate([[0], np.cumsum(parts)]), np.concatenate([[0], np.cumsum(counts)])
    last = np.minimum(np.arange(n) + window, np.repeat(first[1:], np.diff(first)))
    mean = (s[last] - s[:-1]) / np.maximum(c[last] - c[:-1], 1)
    some = np.flatnonzero(np.diff(first) > 0)
    top[some] = np.maximum.reduceat(mean, first[some])
    hit = mean >= np.repeat(top, np.diff(first))
    places = np.where(hit, np.arange(n), n)
    at[some] = np.minimum.reduceat(places, first[some])
    return top, at


def _features(parts: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the means of its worst word and window and of the whole; EMPTY each without a word."""
    sums, sizes = np.concatenate([[0], np.cumsum(parts)]), np.concatenate([[0], np.cumsum(counts)])
    columns, some = [], np.diff(first) > 0
    for window in WINDOWS:
        columns.append(np.where(some, _worst(parts, counts, first, window)[0], EMPTY))
    columns.append(np.where(some, (sums[first[1:]] - sums[first[:-1]]) / np.maximum(sizes[first[1:]] - sizes[first[:-1]], 1), EMPTY))
    return np.clip(np.stack(columns, axis=1), EMPTY, -EMPTY)


class Model:
    """Scalar weight of each n-gram bucket, and the calibration of a text's means."""

    def __init__(self, weights: np.ndarray, slopes: np.ndarray, shift: float, left_out: int = 0):
        self.weights, self.slopes, self.shift, self.left_out = weights, slopes, shift, left_out

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        bucket, word, first = _grams(data, offs)
        n = first[-1]
        z = _features(np.bincount(word, self.weights[bucket], n), np.bincount(word, minlength=n), first) @ self.slopes + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _telling(top: np.ndarray, worst: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Clean texts, and toxic ones whose worst window is worse than nearly all clean ones' (all if none is).

    A label without any toxic wording in its text teaches nothing but its accidents.
    """
    clean = top[(labels == 0) & (worst >= 0)]
    limit = np.quantile(clean, SURE) if len(clean) else -np.inf
    toxic = (labels == 1) & (top > limit)
    return (labels == 0) | (toxic if toxic.any() else labels == 1)


def train(texts: list[str | None], labels: np.ndarray, seed: int = 5) -> Model:
    """Fit on a bounded list of texts.  With one label only, every score is that label's share."""
    labels = np.asarray(labels)
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS), np.zeros(len(WINDOWS) + 1), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rng = np.random.default_rng(seed)
    data, offs = _text.text_buffer(pa.array(texts, pa.large_string()))
    # n-grams in order of their words, and how many texts of either label hold each
    held, edges, firsts, total, words = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0, 0
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for lot in np.array_split(np.arange(len(labels)), max(1, len(data) >> 19)):
        part = offs[lot[0] : lot[-1] + 2]
        bucket, word, first = _grams(data[part[0] : part[-1]], part - part[0])
        order = np.argsort(word, kind="stable")
        bucket, word = bucket[order].astype(np.int32), word[order]
        seen = np.unique(bucket.astype(np.int64) * len(lot) + np.repeat(np.arange(len(lot)), np.diff(first))[word])
        pos += np.bincount(seen // len(lot), labels[lot][seen % len(lot)], BUCKETS)
        neg += np.bincount(seen // len(lot), 1 - labels[lot][seen % len(lot)], BUCKETS)
        edges.append(np.searchsorted(word, np.arange(1, first[-1] + 1)) + total)
        firsts.append(first[1:] + words)
        held.append(bucket)
        total, words = total + len(bucket), words + int(first[-1])
    bucket, edge, first = np.concatenate(held), np.concatenate(edges), np.concatenate(firsts)
    counts = np.diff(edge)
    some = np.flatnonzero(counts)

    def parts_of(weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(counts))
        if len(some):
            out[some] = np.add.reduceat(weights.astype(np.float32)[bucket], edge[some])
        return out

    weights = np.log((pos + 0.5) / (labels.sum() + 1)) - np.log((neg + 0.5) / ((1 - labels).sum() + 1))
    vectors = rng.normal(0, 1e-3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    hard: list[tuple[int, int, int]] = []
    for _ in range(ROUNDS):
        parts = parts_of(weights)
        ids, begin, goal, picks = [], [0], [], []
        for window in LEARNT:
            top, worst = _worst(parts, counts, first, window)
            if window == LEARNT[0]:
                telling = _telling(top, worst, labels)
            picks += [(d, w, window) for d, w in enumerate(worst.tolist()) if w >= 0 and telling[d]]
        # clean texts' worst windows of all rounds stay, and some of their words at random
        hard += [x for x in picks if labels[x[0]] == 0]
        spare = [(d, int(rng.integers(first[d], first[d + 1])), 1) for d, w in enumerate(worst.tolist()) if w >= 0 and labels[d] == 0 for _ in range(3)]
        for d, w, window in [x for x in picks if labels[x[0]] == 1] + hard + spare:
            own = bucket[edge[w] : edge[min(w + window, first[d + 1])]]
            if len(own):
                ids.append(own)
                begin.append(begin[-1] + len(own))
                goal.append(labels[d])
        flat, begin, goal = np.concatenate(ids), np.array(begin), np.array(goal)
        balance = np.where(goal == 1, len(goal) / 2 / max(goal.sum(), 1), len(goal) / 2 / max((1 - goal).sum(), 1))
        for _epoch in range(EPOCHS):
            perm = rng.permutation(len(goal))
            for lot in np.array_split(perm, max(1, len(perm) // 64)):
                sizes = begin[lot + 1] - begin[lot]
                ends = np.cumsum(sizes)
                at = np.repeat(begin[lot] - ends + sizes, sizes) + np.arange(ends[-1])
                g = flat[at]
                mean = np.add.reduceat(vectors[g], ends - sizes) / sizes[:, None]
                z = mean @ softmax + bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(lot)), goal[lot]] -= 1
                p *= balance[lot][:, None] / len(lot)
                back = (p @ softmax.T) / sizes[:, None]
                softmax -= RATE * (mean.T @ p)
                bias -= RATE * p.sum(0)
                np.subtract.at(vectors, g, RATE * len(lot) / 4 * np.repeat(back, sizes, axis=0).astype(np.float32))
        weights = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64) + float(bias[1] - bias[0])
    # calibration of the means on the sample, classes weighing alike; no mean speaks against a text
    parts = parts_of(weights)
    use = _telling(*_worst(parts, counts, first, WINDOWS[0]), labels)
    x, labels, left_out = _features(parts, counts, first)[use], labels[use], int((~use).sum())
    slopes, shift = np.full(x.shape[1], 1.0 / x.shape[1]), 0.0
    w = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    ridge = np.diag([DECAY * 1e-2] * x.shape[1] + [1e-4])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(200):
        theta = np.append(slopes, shift)
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        h = (design * (w * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        theta = theta - 0.5 * np.linalg.solve(h, design.T @ (w * (p - labels)) + ridge @ theta)
        slopes, shift = np.maximum(theta[:-1], 0.0), theta[-1]
    return Model(weights, slopes, float(shift), left_out)


def _score(model):
    def run(batches):
        m = model.value
        for batch, data, offs in _text.chunks(batches):
            score = m.score(data, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return run


def score(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, toxic 0/1) of rows that are not held out, at most
    ``sample`` texts of either label, none beyond ``FIT_BYTES``; one labelled both ways is an
    example of both.  Whole texts of any length are scored; equal texts have equal scores.  Null labels teach nothing; null and empty texts
    get the least score; rows with a null id are scored and not held out; repeated rows
    each get a row; extra columns are ignored; without labels all scores are low.
    """
    spark = docs.sparkSession
    sample = sample or SAMPLE
    learn = labels.filter(~held_out("doc_id") & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = None
    for label, n in sorted(sample.items()):
        part = learn.filter(F.col("toxic") == label).orderBy(*order).limit(n)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES).orderBy(*order, "text").limit(2 * sum(sample.values())).collect()
    model = spark.sparkContext.broadcast(train([r.text for r in rows], np.array([r.toxic for r in rows], dtype=np.int64)))
    return docs.select("doc_id", "text", held_out("doc_id").alias("held_out")).mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
