"""Language identification by segmentation-marginalised unigrams.

Every language gives each piece of a fixed public vocabulary a probability.  A letter
run's probability in a language is the sum over all its segmentations into pieces,
which the forward algorithm computes in one sweep; expectation maximisation with
forward-backward counts fits the pieces.  A text goes to the language in which its
runs, weighed by how often they occur, are likeliest.

Runs are swept together, one byte position at a time for all runs of a chunk and all
languages; equal runs of a chunk are scored once.  A run of any length is summed over
whole: the sweep keeps as many positions as the longest piece has bytes, and scales them
so that nothing underflows.  The fit alone cuts runs (``FIT_BYTES``, between letters).
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstream.llm import _text
from inkstream.llm._stash import Stash
from inkstream.llm.toxicity import held_out

#: The fit: texts of each language, in order of a hash of the id; of their runs the commonest of each language, a longer one in parts.
SAMPLE = 600
FIT_RUNS = 50_000
FIT_BYTES = 64
#: A run beyond this many bytes is swept alone.
ALONE_BYTES = 2048
#: Positions between two scalings.
SCALED = 16
ROUNDS = 3
SMOOTH = 0.1
#: Rows of the sample that are broadcast; a larger sample is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_SLOT_BITS = 21

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def vocabulary(path: str) -> list[bytes]:
    """All pieces of lower-case letters, and every single letter byte, in byte order."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    ok = set(np.flatnonzero(_LETTER & (_text._LOWER == np.arange(256))).tolist())
    return sorted({p for p in pieces if len(p) > 1 and set(p) <= ok} | {bytes([b]) for b in ok})


def _hashes(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return _text.mix((sums[at + size] - sums[at]) * _text.powers(_text._BASE_INV, len(sums))[at] + np.uint64(size))


class Pieces:
    """Finds pieces by hash: two direct tables, the second for hashes that clash in the first."""

    def __init__(self, pieces: list[bytes]):
        self.count = len(pieces)
        self.lengths = sorted({len(p) for p in pieces})
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        h = _text.word_hashes(flat, np.concatenate([[0], ends[:-1]]), ends)
        self.tables = []
        left = np.arange(len(pieces))
        for shift in (64 - _SLOT_BITS, 64 - 2 * _SLOT_BITS, 64 - 3 * _SLOT_BITS):
            slot = ((h >> np.uint64(shift)) & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)
            ids = np.full(1 << _SLOT_BITS, -1, np.int32)
            ids[slot[left]] = left
            self.tables.append((shift, ids))
            left = left[ids[slot[left]] != left]
            if not len(left):
                break
        assert not len(left)
        self.hashes = h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes; ``count`` where there is none."""
        out = np.full(len(h), self.count, np.int32)
        for shift, ids in self.tables:
            got = ids[((h >> np.uint64(shift)) & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)]
            hit = got >= 0
            hit[hit] = self.hashes[got[hit]] == h[hit]
            out[hit] = got[hit]
        return out


class Runs:
    """The distinct letter runs of some texts, longest first; ``cut`` splits longer ones between letters."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, pieces: Pieces, cut: int | None = None):
        self.pieces = pieces
        low = _text._LOWER[data]
        # capital letters of the two-byte Latin block
        wide = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) if len(low) else np.zeros(0, np.int64)
        low[wide + 1] += 0x20
        n = len(low)
        letter = _LETTER[low]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        starts = np.flatnonzero(letter & (np.concatenate([[True], ~letter[:-1]]) | edge[:-1])) if n else np.zeros(0, np.int64)
        ends = np.flatnonzero(letter & (np.concatenate([~letter[1:], [True]]) | edge[1:])) + 1 if n else np.zeros(0, np.int64)
        if cut and len(starts):
            parts = (ends - starts + cut - 1) // cut
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, last = np.repeat(starts, parts) + nth * cut, np.repeat(ends, parts)
            for _ in range(3):  # back to the first byte of a letter
                begin = np.where((nth > 0) & (low[begin] >= 0x80) & (low[begin] < 0xC0), begin - 1, begin)
            starts, ends = begin, np.where(np.append(nth[1:], 0) > 0, np.append(begin[1:], 0), last)
        self.text = np.searchsorted(offs, starts, "right") - 1
        self.counts = len(offs) - 1
        _, which, back = np.unique(_text.word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        size = (ends - starts)[which]
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.back = place[back]
        self.size, self.begin = size[order], starts[which][order]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_text._BYTE[low] * _text.powers(_text._BASE, n) if n else np.zeros(0, np.uint64), out=self.sums[1:])
        self.longest = int(self.size[0]) if len(self.size) else 0
        self.low = low

    def words(self) -> list[bytes]:
        raw = self.low.tobytes()
        return [raw[a : a + n] for a, n in zip(self.begin.tolist(), self.size.tolist())]

    def ending(self, j: int, first: int = 0) -> list[tuple[int, np.ndarray]]:
        """(bytes, ids) of the pieces that end after j bytes, for the runs from ``first`` on that are that long."""
        last = int(np.searchsorted(-self.size, -j, "right"))
        at = self.begin[first:last] + j
        found = ((s, self.pieces.find(_hashes(self.sums, at - s, s))) for s in self.pieces.lengths if s <= j)
        return [(s, ids) for s, ids in found if s == 1 or (ids < self.pieces.count).any()]

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Sums over segmentations (position x run x language) of short runs; ``prob`` has a row of zeros last."""
        alpha = np.zeros((self.longest + 1, len(self.size), prob.shape[1]))
        alpha[0] = 1
        for j in range(1, self.longest + 1):
            for s, ids in self.ending(j):
                alpha[j, : len(ids)] += alpha[j - s, : len(ids)] * prob[ids]
        return alpha

    def likelihood(self, prob: np.ndarray) -> np.ndarray:
        """Log probability of each distinct run in each language."""
        out = np.zeros((len(self.size), prob.shape[1]))
        alone = int(np.searchsorted(-self.size, -ALONE_BYTES, "left"))
        for r in range(alone):
            out[r] = self._alone(r, prob)
        ring, scale = [np.ones((len(self.size) - alone, prob.shape[1]))], np.zeros((len(self.size) - alone, prob.shape[1]))
        rest = out[alone:]
        for j in range(1, int(self.size[alone]) + 1 if alone < len(self.size) else 1):
            found = self.ending(j, alone)
            m = len(found[0][1])
            now = np.zeros((m, prob.shape[1]))
            for s, ids in found:
                now += ring[-s][:m] * prob[ids]
            ring = (ring + [now])[-self.pieces.lengths[-1] :]
            last = int(np.searchsorted(-self.size, -j - 1, "right")) - alone
            rest[last:m] = np.log(np.maximum(now[last:m], 1e-300)) + scale[last:m]
            if j % SCALED == 0:
                top = np.maximum(np.max([x[:m] for x in ring], axis=0), 1e-300)
                ring = [x[:m] / top for x in ring]
                scale = scale[:m] + np.log(top)
        return out

    def _alone(self, r: int, prob: np.ndarray) -> np.ndarray:
        """Log probability of one long run: its pieces are looked up by length, then summed position by position."""
        begin, n, most = int(self.begin[r]), int(self.size[r]), self.pieces.lengths[-1]
        ring, scale = np.zeros((most, prob.shape[1])), np.zeros(prob.shape[1])
        ring[0] = 1
        for a in range(0, n, 1 << 14):
            ends = np.arange(a + 1, min(a + (1 << 14), n) + 1)
            hits = []
            for s in self.pieces.lengths:
                at = ends[ends >= s]
                ids = self.pieces.find(_hashes(self.sums, begin + at - s, s))
                some = ids < self.pieces.count
                hits.append((at[some], np.full(some.sum(), s), ids[some]))
            at, size, ids = (np.concatenate(x) for x in zip(*hits))
            order = np.argsort(at, kind="stable")
            size, ids, bounds = size[order], ids[order], np.searchsorted(at[order], np.append(ends, ends[-1] + 1)).tolist()
            p, back = prob[ids], (at[order] - size) % most
            for i, j in enumerate(range(a + 1, a + len(ends) + 1)):
                low, high = bounds[i], bounds[i + 1]
                ring[j % most] = np.einsum("ij,ij->j", ring[back[low:high]], p[low:high])
                if j % SCALED == 0:
                    top = np.maximum(ring.max(axis=0), 1e-300)
                    ring /= top
                    scale += np.log(top)
        return np.log(np.maximum(ring[n % most], 1e-300)) + scale

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, for one language's column; ``weight`` of each run."""
        alpha = self.forward(prob)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[self.size, np.arange(len(self.size))] = 1
        total = alpha[self.size, np.arange(len(self.size))]
        share = np.where(total > 0, weight / np.maximum(total, 1e-300), 0)
        out = np.zeros(len(prob))
        for j in range(self.longest, 0, -1):
            for s, ids in self.ending(j):
                step = prob[ids, 0] * beta[j, : len(ids)]
                out += np.bincount(ids, alpha[j - s, : len(ids)] * step * share[: len(ids)], len(prob))
                beta[j - s, : len(ids)] += step
        return out


def fit(runs: dict[str, dict[bytes, int]], pieces: Pieces, names: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and (pieces + 1) x languages probabilities, from each language's counts of runs."""
    order = sorted(runs)
    prob = np.zeros((pieces.count + 1, len(order)))
    length = np.array([len(p) for p in names])
    for k, lang in enumerate(order):
        words = sorted(runs[lang])
        data, offs = _text.text_buffer(pa.array([w.decode(errors="replace") for w in words], pa.large_string()))
        own = Runs(data, offs, pieces, FIT_BYTES)
        weight = np.bincount(own.back, np.array([runs[lang][w] for w in words], float)[own.text], len(own.size))
        # longer pieces start rarer, as random letters would be
        p = np.append(0.25 ** length, 0)[:, None]
        p /= p.sum()
        for _ in range(ROUNDS):
            uses = own.expected(p, weight)[:-1] + SMOOTH * np.append(0.25 ** length, 0)[:-1] * 4
            p = np.append(uses / uses.sum(), 0)[:, None]
        prob[:, k] = p[:, 0]
    return order, prob


def _count_runs(names: list[str]):
    """(lang, text) to the runs of each language and how often a batch has them."""

    def run(batches):
        pieces = Pieces(names)
        for batch, data, offs in _text.chunks(batches):
            own, langs = Runs(data, offs, pieces, FIT_BYTES), batch.column(0).to_pylist()
            order = {g: k for k, g in enumerate(sorted(set(langs)))}
            lang = np.array([order[g] for g in langs], np.int64)[own.text]
            key, n = np.unique(lang * max(len(own.size), 1) + own.back, return_counts=True)
            words, named = own.words(), list(order)
            yield pa.RecordBatch.from_pydict(
                {"lang": [named[x] for x in (key // max(len(words), 1)).tolist()], "run": pa.array([words[x] for x in (key % max(len(words), 1)).tolist()], pa.binary()), "n": pa.array(n, pa.int64())},
            )

    return run


def _predict(model):
    def run(batches):
        names, order, prob = model.value
        pieces = Pieces(names)
        for batch, data, offs in _text.chunks(batches):
            runs = Runs(data, offs, pieces)
            each = runs.likelihood(prob)[runs.back] if len(runs.size) else np.zeros((0, len(order)))
            total = np.stack([np.bincount(runs.text, each[:, k], batch.num_rows) for k in range(len(order))], axis=1) if order else np.zeros((batch.num_rows, 0))
            some = np.bincount(runs.text, minlength=batch.num_rows) > 0
            ascii_ = _LETTER[:128][np.minimum(data, 127)] & (data < 128)
            plain = np.add.reduceat(np.append(ascii_, False), np.minimum(offs[:-1], len(data))) * (np.diff(offs) > 0) if len(data) else np.zeros(batch.num_rows)
            for i in np.flatnonzero(some & (plain == 0)).tolist():  # other bytes above 127 need not be letters
                some[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode())
            if order:
                best = total.argmax(axis=1)
                z = np.exp(total - total.max(axis=1, keepdims=True))
                score = np.where(some, z[np.arange(len(z)), best] / z.sum(axis=1), 0.0)
                lang = [order[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())]
            else:
                score, lang = np.zeros(batch.num_rows), ["und"] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, vocabulary_path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang).

    Learns from at most ``sample`` texts of each language among rows that are not held
    out and have a language, from the ``FIT_RUNS`` commonest runs of each; ``score`` is the posterior of the prediction under equal
    priors.  Null and letterless texts are ``und`` with score 0, and so is everything if
    nothing can be learnt; rows with a null id are predicted and not held out; repeated
    rows each get a row; extra columns are ignored.  Ties go to the first language.  Whole
    texts are scored, whatever their length and that of their runs.
    """
    spark = docs.sparkSession
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    names = vocabulary(vocabulary_path)
    pieces = Pieces(names)
    learn = docs.filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # the ids first, the least hashes of each language, so that texts of the sample alone are moved
    stash = Stash(spark, "languages")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = stash.put(learn.select("doc_id", "lang").withColumn("nth", nth).filter(F.col("nth") <= sample).select("doc_id", "lang").distinct(), "picked")
    few = picked.count() <= BROADCAST_ROWS
    chosen = learn.join(F.broadcast(picked) if few else picked, ["doc_id", "lang"]).select("lang", "text")
    counts = chosen.mapInArrow(_count_runs(names), "lang string, run binary, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "run"))
    runs: dict[str, dict[bytes, int]] = {}
    for r in counts.withColumn("nth", nth).filter(F.col("nth") <= FIT_RUNS).select("lang", "run", "n").toLocalIterator():
        runs.setdefault(r.lang, {})[bytes(r.run)] = r.n
    order, prob = fit(runs, pieces, names)
    model = spark.sparkContext.broadcast((names, order, prob))
    return docs.select("doc_id", "text", held_out("doc_id").alias("held_out")).mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
