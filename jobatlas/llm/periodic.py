"""Operator 13: periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q that is at least ``MIN_WORDS`` words and ``MIN_TIMES`` x q
long and that no neighbouring word extends.  Such a run holds an aligned block of B = 2^k words,
q <= B < 2q, with q more words of the run to its right or left; there the block occurs again, and the
distance to that occurrence is q itself (two periods that long leave only their common divisor).  So each
aligned block of each length asks for its next occurrence in the windows of B words beside it: its
occurrences are an interval of the suffix array, and a wavelet tree over the array gives the
interval's successor and predecessor of the block's place.  The progressions that this finds are
extended to both sides by the names of all stretches of 2^k words, which the suffix array's prefix doubling
leaves behind; of equal stretches the smallest period stays.

Texts never meet each other: tasks work through their rows in groups of about ``GROUP_WORDS`` words (one text at
least), all queries of a group at once.  A group takes some 60 bytes and 4 bytes a level of doubling
for each word, levels growing with the logarithm of the longest repeat.

Defined cases: null text has no words; repeated rows get a row each; a null ``doc_id`` is kept; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.session import spread

MIN_WORDS = 6
MIN_TIMES = 4
GROUP_WORDS = 1 << 16

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def names(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per level k the names of all stretches of 2^k words (shorter at the end of a text): the place in the suffix
    array where the suffixes that start with the stretch begin.  The last level's names are all distinct."""
    order = np.argsort(words, kind="stable")
    n = len(words)
    fresh = np.append(True, words[order][1:] != words[order][:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    name = np.empty(n, np.int32)
    name[order] = first
    levels = [name]
    open_ = order[np.bincount(first, minlength=n)[first] > 1]  # in order of their names
    size = 1
    while len(open_):
        # Only stretches that occur twice are told further apart, by what follows them.
        ahead = np.minimum(open_ + size, n - 1)
        second = np.where(open_ + size < ends[open_], name[ahead].astype(np.int64) + 1, 0)
        key = name[open_] * np.int64(n + 1) + second
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        at = np.arange(len(key))
        old = name[open_]
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        part = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), at, 0))
        name = name.copy()
        name[open_] = old + (part - group)
        levels.append(name)
        open_ = open_[np.bincount(part, minlength=len(part))[part] > 1]
        size *= 2
    return levels


class Wavelet:
    """A wavelet tree (as a matrix of bits, high ones first) over a permutation; queries come as vectors."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, (len(values) - 1).bit_length())
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.append(0, np.cumsum(~one)).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at [lo, hi) are less than x."""
        out = np.zeros(len(x), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            zl, zh, one = zeros[lo], zeros[hi], (x >> b & 1).astype(bool)
            out += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, zeros[-1] + lo - zl, zl), np.where(one, zeros[-1] + hi - zh, zh)
        return out

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values at [lo, hi)."""
        out = np.zeros(len(k), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            zl, zh = zeros[lo], zeros[hi]
            one = k >= zh - zl
            out |= one.astype(np.int64) << b
            k = np.where(one, k - (zh - zl), k)
            lo, hi = np.where(one, zeros[-1] + lo - zl, zl), np.where(one, zeros[-1] + hi - zh, zh)
        return out


def progressions(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(place, distance)``: an aligned block or its neighbour, and how far on the block occurs again."""
    n = len(levels[0])
    at, size, lo, hi = [], [], [], []
    for k, name in enumerate(levels[:-1]):
        block = np.arange(0, n, 1 << k)
        first = name[block]
        many = np.bincount(name, minlength=n)[first]
        some = many > 1
        at.append(block[some])
        size.append(np.full(some.sum(), 1 << k))
        lo.append(first[some])
        hi.append(first[some] + many[some])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, size, lo, hi = map(np.concatenate, (at, size, lo, hi))
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    tree = Wavelet(suffixes)
    rank = tree.below(lo, hi, at)  # the block's own place among its occurrences
    out = []
    for step in (1, -1):
        there = (rank + step >= 0) & (rank + step < hi - lo)
        other = tree.nth(lo[there], hi[there], rank[there] + step)
        gap, b = np.abs(other - at[there]), size[there]
        near = (gap <= b) & (2 * gap > b)  # other distances are found by blocks of other lengths
        out.append((np.minimum(other, at[there])[near], gap[near]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def runs(words: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs.  ``words`` are numbers that no two texts share,
    ``ends`` is the end of each word's text."""
    if len(words) < 2:
        return np.empty((0, 3), np.int64)
    levels = names(words, ends)
    place, gap = progressions(levels)
    n = len(words)
    left, right = place.copy(), place + gap  # the run's first word and, so far, the end of its equal pairs
    far = place + gap
    for k in range(len(levels) - 2, -1, -1):
        name, step = levels[k], 1 << k
        on = right < n
        on[on] = name[right[on] - gap[on]] == name[right[on]]
        right[on] += step
        back = left >= step
        back[back] = name[left[back] - step] == name[far[back] - step]
        left[back] -= step
        far[back] -= step
    length = right - left
    whole = length >= np.maximum(min_words, min_times * gap)
    found = np.stack([left, length, gap], axis=1)[whole]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    same = (found[1:, :2] == found[:-1, :2]).all(axis=1) if len(found) else np.empty(0, bool)
    found = found[np.append(True, ~same)] if len(found) else found
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _texts(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each text."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split])
    bounds = np.append(0, np.cumsum(sizes))
    coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    owner = np.repeat(np.arange(len(split)), sizes)
    found = runs(owner * np.int64(max(1, len(coded.dictionary))) + coded.indices.to_numpy(zero_copy_only=False), bounds[1:][owner])
    change = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    cuts = np.searchsorted(found[:, 0], bounds)
    out = []
    for i, words in enumerate(split):
        own = found[cuts[i]:cuts[i + 1]] - (bounds[i], 0, 0)
        if len(own):
            words = [w for w, k in zip(words, kept[bounds[i]:bounds[i + 1]].tolist()) if k]
        out.append((own.tolist(), b" ".join(words)))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, runs, collapsed)`` per row: all runs (start, length, period; in words from 0) by start and period, and
    the text's words, joined by one space, without those that a run holds beyond its first period."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            first, held = 0, 0
            for i in range(b.num_rows):
                held += len(texts[i].as_py()) // 6  # about its words
                if held >= GROUP_WORDS or i == b.num_rows - 1:
                    got = _texts(texts[first:i + 1].to_pylist())
                    cells = [[dict(zip(("start", "length", "period"), r)) for r in rows] for rows, _ in got]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0)[first:i + 1], pa.array(cells, kind), pa.array([t for _, t in got], pa.binary()).cast(pa.string())],
                        names=["doc_id", "runs", "collapsed"])
                    first, held = i + 1, 0

    src = spread(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed string")
