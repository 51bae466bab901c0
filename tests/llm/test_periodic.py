"""Operator 13 against runs found period by period, and its defined cases."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobatlas.llm import periodic, queries

SMOKE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, min_words=6, min_times=4):
    """All runs, by trying every period up to a quarter of the words."""
    out = {}
    for q in range(1, len(words) // min_times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_times * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def fast(*texts):
    sizes = [len(t) for t in texts]
    words = np.array([1000 * i + w for i, t in enumerate(texts) for w in t], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = np.cumsum([0, *sizes])
    found = periodic.runs(words, ends).tolist()
    return [sorted(((s - starts[i], n, q) for s, n, q in found if starts[i] <= s < starts[i + 1]), key=lambda r: (r[0], r[2]))
            for i in range(len(texts))]


piece = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)).map(lambda x: x[0] * x[1])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(piece, max_size=4).map(lambda x: sum(x, [])), min_size=1, max_size=4))
def test_runs_of_periodic_pieces(texts):
    assert fast(*texts) == [slow_runs(t) for t in texts]


@pytest.mark.parametrize("text", [[], [1], [1] * 6, [1] * 5, [1, 2] * 4, [1, 2] * 3, [1, 2, 3] * 50 + [1], [5] + [1, 1, 2] * 4 + [1, 1], [0] * 1000])
def test_single_runs(text):
    assert fast(text) == [slow_runs(text)]


def test_wavelet_queries():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = periodic.Wavelet(values)
        lo = rng.integers(0, n, 200)
        hi = lo + 1 + rng.integers(0, n, 200) % (n - lo)
        x = rng.integers(0, n, 200)
        assert tree.below(lo, hi, x).tolist() == [(values[a:b] < v).sum() for a, b, v in zip(lo, hi, x)]
        k = rng.integers(0, 1 << 30, 200) % (hi - lo)
        assert tree.nth(lo, hi, k).tolist() == [np.sort(values[a:b])[j] for a, b, j in zip(lo, hi, k)]


def test_a_long_text_with_long_periods():
    rng = np.random.default_rng(5)
    part = rng.integers(0, 50, 30_000).tolist()
    text = part[:500] + part * 5 + [99]
    assert (500, 150_000, 30_000) in fast(text)[0]


def test_the_documents(spark):
    corpus = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_periodic_runs"](spark, SMOKE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(corpus)
    long = 0
    for r in rows:
        words = WORD.findall(corpus[r.doc_id] or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000:  # the slow way takes n * n / 4 steps
            long += 1
            continue
        want = slow_runs(words)
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(collapsed(words, want)).encode()).hexdigest()
    assert long < 20 and sum(r.n_runs > 0 for r in rows) > 10


def test_defined_cases(spark):
    ddl = "doc_id long, text string, runs string, collapsed int, start int"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 4), (4, "a b " * 4), (None, "x\u00a0y " * 6), (5, "ha " * 200_000), (6, "né à " * 3)]
    t = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], ddl)
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find(t).collect())
    assert got == [(0, [(0, 6, 1)], "x\u00a0y"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 8, 2)], "a b"), (4, [(0, 8, 2)], "a b"),
                   (5, [(0, 200_000, 1)], "ha"), (6, [], "né à né à né à")]
    assert periodic.find(t.limit(0)).collect() == []
