"""Operators that compare documents, and the pipeline, against brute force."""

import collections
import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkstream.llm import debruijn, superminhash
from inkstream.llm._graph import components
from inkstream.llm._skew import spread_join
from inkstream.llm._stash import Stash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_components(rows, width):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, seen = collections.defaultdict(list), set()
    for i, s in sets.items():
        both = collections.Counter(j for g in s for j in holders[g])
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
        seen.add(i)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def near_rows(seed=3):
    """A template with copies at all distances, chains, exact copies, truncations and singles."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    pick = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    base, rows = pick(150), []
    for _ in range(150):
        w = list(base)
        for k in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            w[k] = str(rng.choice(vocabulary))
        rows.append(" ".join(w))
    chain = list(base[:80])
    for step in range(12):
        chain = chain[:]
        chain[6 * step + 2] = f"c{step}"
        rows.append(" ".join(chain))
    rows += [" ".join(base[:n]) for n in range(60, 150, 6)] + [" ".join(pick(40)) for _ in range(60)]
    rows += ["same text here twice over"] * 30 + ["a b", "A B", "a b c d", "a b c e", "", None, "  ", "x " * 300, "x " * 200, "one"]
    ids = rng.permutation(len(rows)) * 3 + 5
    return [(int(i), t) for i, t in zip(ids, rows)]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rows = near_rows()
    d = spark.createDataFrame(rows + [(None, "a b c d e f"), rows[0]], "doc_id long, text string").withColumns({"rep": F.lit(1), "u": F.lit("x"), "d1": F.lit(2)}).repartition(5)
    out = superminhash.near_duplicates(d, width=width).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows) + 2 and got.pop(None)[1:] == (None, True)
    assert got == brute_components(rows, width)
    assert superminhash.near_duplicates(d.limit(0)).count() == 0


def test_related_groups_of_near_copies(spark):
    """Two large groups whose members share a bucket but no link: time grows with the groups, not their square."""
    rng = np.random.default_rng(10)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    other = base[:160] + [f"x{i}" for i in range(40)]
    rows = []
    for i in range(12_000):
        w = list(base if i % 2 else other)
        w[int(rng.integers(0, 150))] = f"e{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    out = superminhash.near_duplicates(d, width=5).groupBy("component_id").count().collect()
    assert {tuple(r) for r in out} == {(0, 6000), (1, 6000)} and time.time() - began < 120


def test_near_duplicates_of_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in superminhash.near_duplicates(d, width=4).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in d.collect()], 4)


def test_signature_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 62, 200).astype(np.uint64)])
    errors = []
    for salt in range(40):
        mixed = [superminhash._text.mix(x + np.uint64(salt)) for x in (a, b)]
        sig = superminhash.superminhash(np.repeat([0, 1], 1000), np.concatenate(mixed), 2)
        errors.append((sig[0] == sig[1]).mean() - 800 / 1200)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    one = superminhash.superminhash(np.zeros(1, int), np.array([7], np.uint64), 1)
    assert len(set((one[0] >> np.uint64(56)).tolist())) == superminhash.POSITIONS  # one element claims each position once


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)] + [(3, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.v: r.u for r in components(spark.createDataFrame(edges, "v long, u long").repartition(6), Stash(spark, "t")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "v long, u long"), Stash(spark, "t")).count() == 0


def brute_dedup(rows, k=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            if g in seen:
                gone[p : p + k] = [True] * k
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def span_rows():
    rng = np.random.default_rng(4)
    pick = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    shared, long_ = pick(60), pick(300)
    rows = [" ".join(pick(int(rng.integers(0, 120)))) for _ in range(40)]
    for n in (19, 20, 21, 40, 60):
        rows += [" ".join(pick(15) + shared[:n] + pick(15)), " ".join(shared[60 - n :] + pick(30)), " ".join(pick(5) + shared[10:n] + long_[50 : 50 + n])]
    rows += [" ".join(long_)] * 3 + [" ".join(long_[:150] + ["new"] + long_[150:]), "a " * 100, "a " * 30, "x y z " * 40 + "é", "\t q " + "a " * 19, "b c" * 200, "", "one\ntwo\x0bthree", "Ü ü " * 15]
    rows = [(int(i) * 2, t) for i, t in zip(rng.permutation(len(rows)), rows)]
    return rows + [(9999, None)]


def test_dedup(spark):
    rows = span_rows()
    d = spark.createDataFrame(rows + [(None, "a " * 50), rows[3]], "doc_id long, text string").withColumns({"spans": F.lit(1), "copy": F.lit(2), "h": F.lit(3)}).repartition(4)
    out = debruijn.dedup(d).collect()
    got = {r.doc_id: tuple(r)[1:] for r in out}
    assert len(out) == len(rows) + 2 and got.pop(None)[1] == 0 and got == brute_dedup(rows)
    assert debruijn.dedup(d.limit(0)).count() == 0


def test_dedup_of_tangled_texts(spark):
    """Few words and short windows: branches, loops, overlaps and ends of texts everywhere."""
    rng = np.random.default_rng(6)
    for k, anchor, words in ((4, 2, 3), (5, 3, 6), (3, 1, 12)):
        pool = [" ".join(f"w{i}" for i in rng.integers(0, words, int(rng.integers(0, 40)))) for _ in range(30)]
        rows = [(i, " ".join(pool[j] for j in rng.integers(0, len(pool), int(rng.integers(1, 3))))) for i in range(80)]
        got = {r.doc_id: tuple(r)[1:] for r in debruijn.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, anchor).collect()}
        assert got == brute_dedup(rows, k)


def test_dedup_of_one_long_text(spark):
    """Half a million words in one text, the second half repeating the first but for every hundredth word."""
    rng = np.random.default_rng(7)
    half = [f"w{i}" for i in rng.integers(0, 10_000, 250_000)]
    rows = [(1, " ".join(half + [f"n{i}" if i % 100 == 0 else w for i, w in enumerate(half)])), (2, " ".join(half[1000:1100]))]
    assert {r.doc_id: tuple(r)[1:] for r in debruijn.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute_dedup(rows)


def test_spread_join(spark):
    left = spark.createDataFrame([(min(i % 7, 2) if i < 900 else i, i) for i in range(1000)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("times"))
    for heavy in (1, 3, 2000):
        assert sorted(spread_join(left, right, ["k"], heavy).select("k", "v").collect()) == sorted(left.collect())


def test_span_sources(spark):
    """A span's source coordinates name the same words, earlier."""
    rows = span_rows()
    text = {i: WORD.findall(t or "") for i, t in rows}
    copies, spans = debruijn.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    found = spans.collect()
    assert found and copies.count() == 2
    for r in found:
        assert text[r.doc_id][r.start : r.start + r.words] == text[r.source][r.source_start : r.source_start + r.words]
        assert (r.source, r.source_start) < (r.doc_id, r.start)


def test_dedup_of_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id: tuple(r)[1:] for r in debruijn.dedup(d).collect()} == brute_dedup([(r.doc_id, r.text) for r in d.collect()])


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "benchmark decontamination", "mixing", "token shards"]
    columns, left, stash = docs.columns, {r.doc_id for r in docs.collect()}, Stash(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stash.put(stage(spark, docs, sf), name.replace(" ", ""))
        assert docs.columns == columns
        now = [r.doc_id for r in docs.collect()]
        assert set(now) <= left
        left = set(now)
        if name == "near-dedup":
            assert left == {i for i, (_, _, kept) in brute_components(list(before.items()), 5).items() if kept}
        if name == "mixing":
            words = {i: len(WORD.findall(t)) for i, t in before.items()}
            assert max(collections.Counter(now).values()) == 2 and sum(words[i] for i in now) == pytest.approx(1.5 * sum(words.values()), rel=0.15)
        else:
            assert len(now) == len(left)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_stages_on_odd_tables(spark):
    """Every stage on an empty table, on null and empty texts, repeated rows, and extra columns of clashing names."""
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = "the quick brown fox jumps over the lazy dog and then it runs to the river in the old town for a long time "
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, None, None, None, None), (3, prose * 1, "en", "s", 9), (4, " ".join(f"{w}{i}" for i in range(40) for w in ("alpha", "beta")), "en", None, 9)]
    rows += [(5, "word " * 50_000, "en", "t", 1), (6, rows[5][1], "en", "t", 9), (6, rows[5][1], "en", "t", 9)]
    whole = spark.createDataFrame(rows, schema).withColumns({"kept": F.lit("x"), "size": F.lit(1), "taken": F.lit(None).cast("string"), "h": F.lit(2), "spans": F.lit(3), "start": F.lit(4)})
    for docs in (whole, whole.limit(0)):
        before = collections.Counter((r.doc_id, r.text) for r in docs.collect())
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            now = out.collect()
            assert name == "token shards" or out.columns == docs.columns
            if not before:
                assert now == []
            elif name == "quality rules":
                assert {r.doc_id for r in now} == {4, 6} or {r.doc_id for r in now} <= {4, 6}
            elif name == "near-dedup":  # the repeated row and the copy of 4 go, what has no words stays
                assert sorted(str(r.doc_id) for r in now) == ["1", "2", "3", "4", "5", "None"]
            elif name == "benchmark decontamination":
                assert collections.Counter((r.doc_id, r.text) for r in now) == before
            elif name == "mixing":
                assert {r.doc_id for r in now} <= {3, 4, 5, 6} and max(collections.Counter(r.doc_id for r in now).values()) <= 4
            else:
                assert len(now) == len(rows) and min(r.n_tokens for r in now) == 1


def test_pipeline_without_ids(spark):
    sf = "/root/testdata/sf0.001"
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 3000, 100))
    both, twice, leak = text(), text(), f"{text()} {spark.read.parquet(f'{sf}/benchmark.parquet').first().text}"
    rows = [(5, both), (None, both + " more"), (None, twice), (None, twice), (None, leak)] + [(i if i % 3 else None, text()) for i in range(30, 90)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left, stash = dict.fromkeys(rows, 1), Stash(spark, "t")
    for gone, (name, stage) in zip([(None, both + " more"), (None, leak)], corpus_pipeline.STAGES[1:3]):
        docs = stash.put(stage(spark, docs, sf), name.replace(" ", ""))
        del left[gone]
        assert collections.Counter((r.doc_id, r.text) for r in docs.collect()) == collections.Counter(left)
    mixed = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.mixture(spark, docs, sf).collect())
    assert set(mixed) <= set(left) and sum(mixed.values()) == pytest.approx(1.5 * len(left), abs=1)
    assert sum(n for (i, _), n in mixed.items() if i is None) >= sum(i is None for i, _ in left)
