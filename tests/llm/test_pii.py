"""Operator 12 against the base rules in plain Python, EM by hand, and cases for the added spans."""

import math
import random
import re

import pytest

from jobatlas.llm import pii, queries

SMOKE = "/root/testdata/sf0.001"
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, span):
    d = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def slow_base(text):
    return [(k, m.start(), m.end()) for k, rule in enumerate(RULES.values()) for m in re.finditer(rule, text or "")
            if passes(list(RULES)[k], m[0])]


def found(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s)[:3] for s in r[column]] for r in pii.find(df).collect()}
    return [got[i] for i in range(len(texts))]


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(8)
    card = "4111111111111111"
    parts = ["a", "é", "@", ".", "b.co", "x@y.z", "_", "-", " ", "  ", "1", "12", "1.2.3.4", "256", ".0.0", "+", "+1", "(", ")", "555", card,
             card[:8] + " " + card[8:], "4111-1111-1111-1111", "𝒳", "\n", "007", "378282246310005", "0" * 20]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(700)]
    texts += ["x@y.z_@a.b c@d..e", "1.2.3.4.5.6.7.8", "+1 (234) 567-8901, +12", "a@b.c@d.e", "1" * 3000 + " " + card, "", None]
    texts += [f"{card} me@there.org " * 700]  # more matches than a block of the running sums
    for got, text in zip(found(spark, texts, "base"), texts):
        assert got == slow_base(text), text


def test_the_documents(spark):
    import hashlib
    corpus = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_pii"](spark, SMOKE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(corpus)
    for r in rows:
        want = slow_base(corpus[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in range(4)]
        assert r.spans == text  # numbers and tokens without any sign of personal data add nothing


def slow_em(patterns, sweeps):
    """Likelihoods of ``{votes: n}``, by the textbook."""
    truth = {v: 1 / (1 + math.exp(-sum(v))) for v in patterns}
    for _ in range(sweeps):
        yes, no = (sum(n * (truth[v] if side else 1 - truth[v]) for v, n in patterns.items()) for side in (1, 0))
        odds = {}
        for j in range(len(pii.LABELERS)):
            for vote in (-1, 0, 1):
                a, b = (sum(n * (truth[v] if side else 1 - truth[v]) for v, n in patterns.items() if v[j] == vote) for side in (1, 0))
                odds[j, vote] = (math.log((a + (pii.TRUST if vote == 1 else 1)) / (yes + pii.TRUST + 2))
                                 - math.log((b + (pii.TRUST if vote == -1 else 1)) / (no + pii.TRUST + 2)))
        prior = math.log((yes + 1) / (no + 1))
        truth = {v: 1 / (1 + math.exp(-max(-30, min(30, prior + sum(odds[j, x] for j, x in enumerate(v)))))) for v in patterns}
    return truth


def test_reliabilities_by_expectation_maximisation(spark):
    rng = random.Random(2)
    hidden = {}
    for _ in range(4000):
        true = rng.random() < 0.3
        sure = (0.9, 0.8, 0.75, 0.6, 0.55)
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < p) == true else -1) for p in sure)
        n = hidden.setdefault(votes, [0, 0])
        n[true] += 1
    rows = [(k, list(v), sum(n)) for k in (0, 2) for v, n in hidden.items()]
    got = pii.estimate(spark.createDataFrame(rows, "kind int, votes array<int>, n long"), sweeps=12).collect()
    want = slow_em({v: sum(n) for v, n in hidden.items()}, 12)
    assert len(got) == 2 * len(want)
    assert all(r.truth == pytest.approx(want[tuple(r.votes)], abs=1e-9) and r.n == sum(hidden[tuple(r.votes)]) for r in got)
    right = sum(n[int(want[v] > 0.5)] for v, n in hidden.items())
    assert right / 4000 > 0.88  # the best labeler alone is right on 0.72 of all and silent on 0.2


def test_added_spans_need_a_sign(spark):
    plain = ["write to ann@mail.org or +1 (425) 555-9684", "from 10.2.3.4 and card 4111 1111 1111 1111"] * 30
    odd = ["mail jane (at) mail (dot) org today", "call (425) 555-9684 at noon", "my visa 3782 822463 10005 please",
           "server 2001:db8:0:0:0:0:0:1 answers", "carol dot lee at example dot com"]
    clean = ["they met at noon.", "the years 2019 2020 and order 3782 822463 10005", "std::vector at 10:20:30", "version 1.2.3.400",
             "a sum of 4254255559684 words", "we stay at home.", "isbn 978 3 16 148410 0"]
    got = found(spark, plain + odd + clean, "spans")
    for text, spans in zip(odd, got[60:65]):
        assert [k for k, *_ in spans] == [{"mail": 0, "call": 3, "my": 2, "server": 1, "carol": 0}[text.split()[0]]], text
    assert [odd[i][a:b] for i, spans in enumerate(got[60:65]) for _, a, b in spans] == [
        "jane (at) mail (dot) org", "(425) 555-9684", "3782 822463 10005", "2001:db8:0:0:0:0:0:1", "lee at example dot com"]
    assert got[65:] == [[]] * len(clean)
    for text, spans in zip(plain, got):
        assert spans == slow_base(text)


def test_defined_cases(spark):
    ddl = "doc_id long, text string, base string, spans int, kind int, votes int, weights double"
    rows = [(1, None), (2, ""), (None, "x@y.zz"), (3, "a@b.cc"), (3, "a@b.cc"), (4, "1." * 200_000 + "+" * 1000 + "a" * 100_000 + "@"), (5, "9" * 300_000)]
    t = spark.createDataFrame([(*r, "b", 1, 1, 1, 1.0) for r in rows], ddl)
    got = sorted((r.doc_id or 0, [tuple(s)[:3] for s in r.base]) for r in pii.find(t).collect() if r.doc_id != 4)
    assert got == [(0, [(0, 0, 6)]), (1, []), (2, []), (3, [(0, 0, 6)]), (3, [(0, 0, 6)]), (5, [])]
    long = next(r for r in pii.find(t).collect() if r.doc_id == 4)
    assert len(long.base) == 50_000 and tuple(long.base[-1])[:3] == (1, 399_992, 399_999)
    empty = pii.find(t.limit(0))
    assert empty.columns == ["doc_id", "base", "spans"] and empty.collect() == []
