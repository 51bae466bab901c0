"""Operator 8: exact substring dedup over prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document.  A word goes if some window over
it also starts in a document with a smaller id.  The suffixes that matter are the windows
themselves, a suffix tree cut off at depth ``WINDOW``.

1. Filing.  Each window is filed under the smallest hash of its inner runs of ``PREFIX`` words.
   Equal windows hold the same runs, so they meet under one prefix; neighbouring windows
   mostly share theirs and travel together as one span (about one row per 19 words, and of
   text that repeats itself one row per ``SPAN_WINDOWS``).
2. Equal spans collapse under a partial minimum of the document id, which settles the inside
   of every copy, however many copies there are.
3. A prefix under which different spans of different documents remain is one group.  With up to
   ``GROUP_SPANS`` different spans it fits in memory; the spans of a larger group are filed anew under
   prefixes longer by ``PREFIX`` words, and so on up to the whole window, where a group is one node.
4. Each group's suffix tree (suffix array and common prefixes, all words compared) gives the
   internal nodes of at least ``WINDOW`` words.  A suffix takes the deepest such node that a document
   with a smaller id has too, and of these only the maximal repeats, which do not extend to the left.

Of rows with the same span and id one enters the tree, and its repeats hold for all of them, so a
group is never larger than its number of different spans, however often a text repeats itself.

Defined cases: null text has no words; a null id is larger than every id (its words go if
any document has them, and it takes none away); rows that repeat an id are judged each on
their own text and never against each other; texts shorter than a window stay whole; an
empty table gives an empty result; columns of the input come back beside the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobatlas.session import cut_lineage, spread

WINDOW = 50
#: Longer than usual one-line boilerplate, so that a common line does not bring its documents together.
PREFIX = 14
GROUP_SPANS = 2000
SPAN_WINDOWS = 64
#: Words of groups whose trees are built together.
TREE_WORDS = 1 << 18
#: Words looked at together; a longer text goes in parts that overlap by a window.
PART = 1 << 18

_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)
_M = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


class Runs:
    """Hashes of runs of words: ``of(starts, ends)`` in constant time each."""

    def __init__(self, words: list[bytes]):
        w = np.fromiter((xxhash.xxh64_intdigest(x) for x in words), np.uint64, len(words))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * _powers(_B, max(1, len(w)))[:len(w)])])
        self.back = _powers(_BINV, len(w) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, m = 1, x
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    if done < width:
        m = np.minimum(m[:len(x) - width + 1], m[width - done:])
    return m


def _spans(words: list[bytes], ends: np.ndarray, window: int, prefix: int):
    """Spans of the texts laid end to end: text number, first window (word place in the whole),
    number of windows, prefix hash, hash of the span's words."""
    n = len(words)
    if n < window:
        return (np.empty(0, np.int64),) * 5
    runs = Runs(words)
    at = np.arange(n - prefix + 1)
    filed = _sliding_min(runs.of(at, at + prefix), window - prefix + 1)
    p = np.arange(len(filed))
    doc = np.searchsorted(ends, p, side="right")
    p = p[p + window <= ends[doc]]
    if not len(p):
        return (np.empty(0, np.int64),) * 5
    doc, filed = doc[p], filed[p]
    turn = np.concatenate([[True], (filed[1:] != filed[:-1]) | (doc[1:] != doc[:-1])])
    i = np.arange(len(p))
    since = i - np.maximum.accumulate(np.where(turn, i, 0))
    new = np.flatnonzero(since % SPAN_WINDOWS == 0)
    stop = np.concatenate([new[1:], [len(p)]]) - 1
    first, last = p[new], p[stop]
    return (doc[new], first, last - first + 1, filed[new].view(np.int64), runs.of(first, last + window).view(np.int64))


_SPAN = "id long, tag int, first long, n int, key long, sig long"


class _Filing:
    """Parts of texts, laid end to end and filed together every ``PART`` words."""

    def __init__(self, window: int, prefix: int):
        self.window, self.prefix, self.parts, self.held = window, prefix, [], 0

    def add(self, ident: int, tag: int, offset: int, words: list[bytes]) -> None:
        if len(words) >= self.window:
            self.parts.append((ident, tag, offset, words))
            self.held += len(words)

    def flush(self) -> list[pa.Array]:
        words = [w for *_, part in self.parts for w in part]
        ids, tags, offsets, sizes = (np.array(c, np.int64) for c in zip(*((i, t, o, len(p)) for i, t, o, p in self.parts)))
        ends = np.cumsum(sizes)
        doc, first, n, key, sig = _spans(words, ends, self.window, self.prefix)
        self.parts, self.held = [], 0
        return [pa.array(ids[doc]), pa.array(tags[doc].astype(np.int32)),
                pa.array((first + (offsets - (ends - sizes))[doc]).astype(np.int64)),
                pa.array(n.astype(np.int32)), pa.array(key), pa.array(sig)]


def _file(window: int, prefix: int):
    names = ["id", "tag", "first", "n", "key", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())
            filing = _Filing(window, prefix)
            for r in range(b.num_rows):
                words = texts[r].as_py().split()
                for o in range(0, max(1, len(words) - window + 1), PART):
                    filing.add(ids[r], tags[r], o, words[o:o + PART + window - 1] if len(words) > PART else words)
                    if filing.held >= PART:
                        yield pa.RecordBatch.from_arrays(filing.flush(), names=names)
            if filing.parts:
                yield pa.RecordBatch.from_arrays(filing.flush(), names=names)
    return run


_PIECE = pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("first", pa.int64()), ("n", pa.int32()),
                    ("key", pa.int64()), ("sig", pa.int64()), ("words", pa.binary())])


def _cut_out(window: int, longer: int, batch_bytes: int = 4 << 20):
    """Words of the spans asked for, as one string, and the spans of crowded groups filed under prefixes of
    ``longer`` words; given out every few MB, however many spans a batch of documents has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple] = []
        held, filing = 0, _Filing(window, longer)

        def refiled():
            cols = filing.flush()
            return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(cols[0]), pa.binary())], schema=_PIECE)

        def cut():
            cols = [pa.array(c, f.type) for c, f in zip(zip(*spans), _PIECE)]
            spans.clear()
            return pa.RecordBatch.from_arrays(cols, schema=_PIECE)

        for b in batches:
            ids, tags = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts, asked = b.column(2).cast(pa.binary()), b.column(3)
            for r in range(b.num_rows):
                words = texts[r].as_py().split()
                for a in asked[r].as_py():
                    part = words[a["first"]:a["first"] + a["n"] - 1 + window]
                    if a["crowded"]:
                        filing.add(ids[r], tags[r], a["first"], part)
                    else:
                        spans.append((ids[r], tags[r], a["first"], a["n"], a["key"], a["sig"], b" ".join(part)))
                        held += len(spans[-1][-1]) + 200
                    if filing.held >= PART:
                        yield refiled()
                    if held >= batch_bytes:
                        held = 0
                        yield cut()
        if filing.parts:
            yield refiled()
        if spans:
            yield cut()
    return run


def _suffix_tree(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``symbols`` and the common prefix of each suffix with the one before it.  No symbol
    run of over ``longest`` may repeat (every text ends in a symbol of its own)."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    turn = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(turn, np.arange(n), 0))
    ranks = [rank]
    while 1 << (len(ranks) - 1) <= longest:  # doubling; only suffixes with equal ranks are sorted on
        h = 1 << (len(ranks) - 1)
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        after = rank[np.minimum(tied + h, n - 1)]
        s = np.lexsort((after, rank[tied]))
        old, after, i = rank[tied][s], after[s], np.arange(len(tied))
        whole = np.concatenate([[True], old[1:] != old[:-1]])
        part = whole | np.concatenate([[True], after[1:] != after[:-1]])
        rank = rank.copy()
        rank[tied[s]] = old + np.maximum.accumulate(np.where(part, i, 0)) - np.maximum.accumulate(np.where(whole, i, 0))
        ranks.append(rank)
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    one, two = array[:-1].copy(), array[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        equal = ranks[k][np.minimum(one, n - 1)] == ranks[k][np.minimum(two, n - 1)]
        equal &= (one < n) & (two < n)
        common[1:] += equal.astype(np.int64) << k
        one += equal.astype(np.int64) << k
        two += equal.astype(np.int64) << k
    return array, common


def _maximal_repeats(groups: list[list[tuple[int, int, bytes]]], window: int) -> list[tuple[int, int, int, int]]:
    """(group, span, place in the span, windows) of the repeats that a smaller id also has: every group
    is a list of (id, sig, words); the groups' trees are built side by side."""
    numbers: dict[tuple[int, bytes], int] = {}
    symbols: list[int] = []
    spans: list[tuple[int, int, int]] = []  # group, span, id
    sizes: list[int] = []
    for g, group in enumerate(groups):
        for i, (ident, _, blob) in enumerate(group):
            words = blob.split(b" ")
            symbols += [numbers.setdefault((g, w), len(numbers)) for w in words]
            symbols.append(-1 - len(spans))
            spans.append((g, i, ident))
            sizes.append(len(words) + 1)
    array, common = _suffix_tree(np.array(symbols, np.int64), max(sizes))
    of = np.repeat(np.arange(len(spans)), sizes)
    deep = np.flatnonzero(common >= window)
    if not len(deep):
        return []
    inside = np.union1d(deep, deep - 1)  # suffixes below nodes at least a window deep
    suffix, depth = array[inside], np.where(np.concatenate([[False], np.diff(inside) == 1]), common[inside], 0)
    ids = np.array([x for *_, x in spans], np.int64)[of[suffix]]
    best = np.zeros(len(suffix), np.int64)
    for d in np.unique(depth[depth >= window])[::-1]:
        starts = np.flatnonzero(depth < d)
        least = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.concatenate([starts, [len(ids)]])))
        best[(best == 0) & (ids > least)] = d
    length = np.zeros(len(symbols) + 1, np.int64)  # by place; [-1] stays 0
    length[suffix] = best
    at = np.flatnonzero((length[:-1] > 0) & (np.roll(length, 1)[:-1] <= length[:-1]))
    begins = np.cumsum(sizes) - sizes
    return [(*spans[of[p]][:2], int(p - begins[of[p]]), int(length[p] - window + 1)) for p in at]


def _trees(window: int):
    """Rows of whole groups, sorted by key, sig and id, to the groups' repeats."""
    schema = pa.schema([("key", pa.int64()), ("sig", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer():
            rows = [(ready[g][0], ready[g][1][i][1], ready[g][1][i][0], at, n)
                    for g, i, at, n in _maximal_repeats([group for _, group in ready], window)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                              [pa.array([], f.type) for f in schema], schema=schema)

        key, group, ready, held = None, [], [], 0
        for b in batches:
            for k, sig, ident, words in zip(*(b.column(c).to_pylist() for c in range(4))):
                if k != key:
                    if len(group) > 1:
                        ready.append((key, group))
                        held += sum(w.count(b" ") + 2 for *_, w in group)
                    key, group = k, []
                    if held >= TREE_WORDS:
                        yield answer()
                        ready, held = [], 0
                if not group or group[-1][:2] != (ident, sig):  # a table may hold the same row often
                    group.append((ident, sig, words))
        if len(group) > 1:
            ready.append((key, group))
        if ready:
            yield answer()
    return run


def _keep(schema: pa.Schema, n_columns: int, text_at: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, repeats = b.column(text_at).cast(pa.binary()), b.column(n_columns)
            total, gone, kept = [], [], []
            for r in range(b.num_rows):
                words = (texts[r].as_py() or b"").split()
                cuts = repeats[r].as_py()
                total.append(len(words))
                if cuts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [c["first"] for c in cuts], 1)
                    np.add.at(edge, [c["first"] + c["n"] - 1 + window for c in cuts], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in range(n_columns)] +
                [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                schema=pa.schema([b.schema.field(c) for c in range(n_columns)] + list(schema)))
    return run


def _met(spans: DataFrame) -> DataFrame:
    """Spans that some other document may repeat: ``settled`` if one with a smaller id has the same span,
    else with the number of different ``spans`` of their prefix."""
    # Most prefixes stand in one document only: they go before anything wider moves.  The prefixes are written
    # first: a join that reads them back can be split at a common one, a join on the aggregation's own rows cannot.
    common = spans.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    common = cut_lineage(common.select("key"), "substring-prefixes")
    spans = cut_lineage(spans.join(common, "key", "left_semi"), "substring-common")
    least = spans.groupBy("key", "sig").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    groups = least.groupBy("key").agg(F.count(F.lit(1)).alias("spans"), F.min("least").alias("lo"),
                                      F.max("least").alias("hi")).where("lo < hi")
    groups = cut_lineage(groups.select("key", "spans"), "substring-groups")
    shared = least.join(groups, "key", "left").where("least < most OR spans IS NOT NULL")
    shared = shared.select("key", "sig", "least", "spans")
    return cut_lineage(spans.join(shared, ["key", "sig"]).select(
        "id", "tag", "first", "n", "key", "sig", "spans", (F.col("id") > F.col("least")).alias("settled"))
        .where("settled OR spans IS NOT NULL"), "substring-met")


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_spans: int = GROUP_SPANS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by a space)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    # Rows that repeat an id with another text are told apart by the tag.
    keyed = docs.select(ident.alias("id"), F.hash(text).alias("tag"), text.alias("text"))

    spans = cut_lineage(spread(keyed).mapInArrow(_file(window, prefix), _SPAN), "substring-spans")
    found = []
    lengths = [*range(prefix, window, prefix), window]
    for longer in [*lengths[1:], None]:
        met = _met(spans)
        # The whole window is the longest prefix: its groups hold equal windows only.
        crowded = F.lit(False) if longer is None else F.col("spans") > group_spans
        found.append(met.where("settled").select("id", "tag", "first", "n"))
        left = met.where("NOT settled").withColumn("crowded", crowded)
        split = longer is not None and not left.where("crowded").isEmpty()
        members = left.where("NOT crowded").groupBy("key", "sig", "id").agg(F.min(F.struct("tag", "first", "n")).alias("m"))
        wanted = members.select("id", "m.tag", "m.first", "m.n", "key", "sig", F.lit(False).alias("crowded"))
        if split:
            wanted = wanted.unionByName(left.where("crowded").select(wanted.columns))
        asked = wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("first", "n", "key", "sig", "crowded")).alias("asked"))
        pieces = cut_lineage(keyed.join(asked, ["id", "tag"]).select("id", "tag", "text", "asked").mapInArrow(
            _cut_out(window, longer or window), _SPAN + ", words binary"), "substring-pieces")
        trees = (pieces.where("words IS NOT NULL").select("key", "sig", "id", "words").repartition("key")
                 .sortWithinPartitions("key", "sig", "id")
                 .mapInArrow(_trees(window), "key long, sig long, id long, at long, n int"))
        rows = left.where("NOT crowded").select("key", "sig", "id", "tag", "first")
        found.append(rows.join(trees, ["key", "sig", "id"]).select("id", "tag", (F.col("first") + F.col("at")).alias("first"), "n"))
        if not split:
            break
        spans = pieces.where("words IS NULL").drop("words")

    repeats = reduce(DataFrame.unionByName, found).groupBy("id", "tag").agg(
        F.collect_list(F.struct("first", "n")).alias("repeats"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # by place: input names may clash with ours
    text_at = docs.columns.index(text_col)
    whole = docs.toDF(*names)
    whole = whole.withColumns({"id": F.coalesce(F.col(names[docs.columns.index(id_col)]).cast("long"), F.lit((1 << 63) - 1)),
                               "tag": F.hash(F.coalesce(F.col(names[text_at]).cast("string"), F.lit("")))})
    whole = whole.join(repeats, ["id", "tag"], "left")
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
             T.StructField("kept_text", T.StringType())]
    out_schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)] + added)
    arrow = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    out = whole.select(*names, "repeats").mapInArrow(_keep(arrow, len(names), text_at, window), out_schema)
    return out.toDF(*docs.columns, *arrow.names)
