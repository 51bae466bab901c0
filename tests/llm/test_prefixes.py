"""Operator 11 against a trie built node by node, and its defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from jobatlas.llm import prefixes

TURNS = "conv_id long, turn long, role string, text string"


def slow_trie(convs):
    """Nodes of ``{conv_id: [(role, text), ...]}``, by walking every path."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = set()
    for p, cs in members.items():
        tree, todo = [], [p]
        while todo:
            q = todo.pop()
            tree.append(q)
            todo += kids[q]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(p)))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), sum(not kids[q] for q in tree),
                 sum((len(members[q]) - 1) * len(q[-1][1]) for q in tree if q), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def found(nodes):
    rows = nodes.drop("turn_id", "n_ends").collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def table(spark, convs):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TURNS).repartition(4)


@pytest.mark.parametrize("width", [1, 3, 8])
def test_trie_of_shared_prefixes(spark, width):
    rng = random.Random(width)
    convs = {}
    for c in range(250):
        start = convs[rng.choice(list(convs))][:rng.randint(0, 9)] if convs and rng.random() < 0.7 else []
        convs[c] = start + [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "", "ccc ü"])) for _ in range(rng.randint(1, 5))]
    convs[900] = convs[3] + [("user", "x")] * 40  # several blocks on
    convs[901] = convs[900][:-1]
    nodes = prefixes.trie(prefixes.ordered(table(spark, convs)), width=width)
    assert found(nodes) == slow_trie(convs)
    assert nodes.agg({"n_ends": "sum"}).first()[0] == len(convs)


def test_rebuilt_conversations_and_those_left_without_turns(spark):
    rng = random.Random(4)
    convs = {c: [(rng.choice("ua"), rng.choice(["q", "rr"])) for _ in range(rng.randint(1, 8))]
             for c in [*range(0, 40), *range(100, 130), *range(205, 240)]}  # 200 is absent
    want = rebuilt(convs)
    assert any(not t for t in want.values())
    seqs, names = prefixes.grafted(prefixes.ordered(table(spark, convs)))
    assert found(prefixes.trie(seqs, names)) == slow_trie(want)


def test_copies_in_more_than_one_piece(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE_BITS", 3)
    convs = {c: [("user", "same"), ("assistant", "words")] for c in range(5, 60)} | {7: [("user", "same")], -3: [("user", "same")]}
    assert found(prefixes.trie(prefixes.ordered(table(spark, convs)))) == slow_trie(convs)


def test_defined_cases(spark):
    ddl = TURNS + ", pos long, depth long, t1 string, block int"
    rows = [(1, None, None, None, 9, 9, "x", 9), (1, 0, "user", "a", 9, 9, "x", 9), (2, None, "", "", 9, 9, "x", 9),
            (None, 0, "user", "of no conversation", 9, 9, "x", 9), (3, 0, "user", "same", 9, 9, "x", 9), (3, 0, "user", "same", 9, 9, "x", 9),
            (4, 2, "we:ird", "\n", 9, 9, "x", 9), (5, 2, "we", "ird:\n", 9, 9, "x", 9), (6, 0, "assistant", "long " * 50_000, 9, 9, "x", 9)]
    t = spark.createDataFrame(rows, ddl)
    want = {1: [("", ""), ("user", "a")], 2: [("", "")], 3: [("user", "same")] * 2, 4: [("we:ird", "\n")], 5: [("we", "ird:\n")],
            6: [("assistant", "long " * 50_000)]}
    nodes = prefixes.trie(prefixes.ordered(t))
    assert found(nodes) == slow_trie(want)
    texts = nodes.join(prefixes.turn_texts(t), "turn_id").where("depth = 1").select("conv_id", "role", "text").collect()
    assert {(r.conv_id, r.role, r.text) for r in texts} == {(min(1, c) if c < 3 else c, *w[0]) for c, w in want.items()} - {(2, "", "")}
    assert prefixes.trie(prefixes.ordered(t.limit(0))).collect() == []
    # Turns that tie keep one order whatever the partitioning.
    tied = spark.createDataFrame([(c, 1, "user", x) for c in (1, 2) for x in ("ba" if c == 1 else "ab")], TURNS)
    assert {(r.depth, r.n_convs) for r in prefixes.trie(prefixes.ordered(tied)).collect()} == {(0, 2), (1, 2), (2, 2)}
