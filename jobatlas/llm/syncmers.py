"""Operator 9: document fingerprints from closed syncmers.

A k-mer of code points is kept if the smallest of its inner s-mers lies at its first or
last place.  The choice looks at the k-mer alone, so the anchors of a text are those of
any text that contains it, at shifted places.  A fingerprint is the anchors' hashes in
text order, eight hex digits each; two fingerprints are matched by position: the longest
run of common anchors in the same order in both, over their mean number.

Any ``2 * K - S - 1`` code points in a row hold an anchor.  Texts under ``SHORT``, whose halves may hold
none, also have all their runs of ``GRAM`` code points as anchors, and under twice ``GRAM`` each code point.

Defined cases: null text counts as empty; an empty text has its hash as its one anchor; rows that repeat an id
follow each other in text order; a null id sorts first; a single row is its own successor;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 16
S = 8
SHORT = 2 * (2 * K - S - 1)
GRAM = 3
#: Code points hashed at once; longer texts go in blocks that overlap by K - 1.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
NONE = np.empty(0, np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, m = 1, x
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    if done < width:
        m = np.minimum(m[:len(x) - width + 1], m[width - done:])
    return m


def _anchors(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of one run of code points."""
    if len(points) < k:
        return NONE, np.empty(0, np.uint32)
    c = points.astype(np.uint64) + np.uint64(1)
    h = c[:len(c) - s + 1].copy()
    for j in range(1, s):
        h *= _BASE
        h += c[j:len(c) - s + 1 + j]
    h = _mixed(h)
    low = _sliding_min(h, k - s + 1)
    at = np.flatnonzero((h[:len(low)] == low) | (h[k - s:] == low))
    whole = np.zeros(len(at), np.uint64)
    for j in range(k):
        whole *= _BASE
        whole += c[at + j]
    return at, (_mixed(whole) >> np.uint64(32)).astype(np.uint32)


def anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(places, hashes)`` of every text; short texts are hashed together."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    group: list[np.ndarray] = []

    def flush() -> None:
        if not group:
            return
        sizes = np.array([len(g) for g in group])
        ends = np.cumsum(sizes)
        at, hashes = _anchors(np.concatenate(group), k, s)
        doc = np.searchsorted(ends, at, side="right")
        inside = at + k <= ends[doc] if len(at) else np.empty(0, bool)  # k-mers across two texts go
        at, hashes, doc = at[inside], hashes[inside], doc[inside]
        cut = np.searchsorted(doc, np.arange(len(group) + 1))
        for i in range(len(group)):
            part = slice(cut[i], cut[i + 1])
            out.append((at[part] - (ends[i] - sizes[i]), hashes[part]))
        group.clear()

    held = 0
    for t in texts:
        p = _points(t)
        if len(p) > BLOCK:
            flush()
            parts = [(b, _anchors(p[b:b + BLOCK + k - 1], k, s)) for b in range(0, len(p), BLOCK)]
            out.append((np.concatenate([a + b for b, (a, _) in parts]), np.concatenate([h for _, (_, h) in parts])))
            held = 0
            continue
        if held + len(p) > BLOCK:
            flush()
            held = 0
        group.append(p)
        held += len(p)
    flush()
    return out


def _or_whole(hashes: np.ndarray, text: str) -> np.ndarray:
    """The anchors of a text with the syncmers ``hashes``; a short one has its runs of code points before them."""
    if len(text) >= SHORT and len(hashes):
        return hashes
    found = [hashes]
    if len(text) < SHORT:
        for n in (GRAM, 1) if len(text) < 2 * GRAM else (GRAM,):
            found.insert(0, np.array([xxhash.xxh32_intdigest(text[i:i + n].encode("utf-8", "surrogatepass"))
                                      for i in range(len(text) - n + 1)], np.uint32))
    whole = np.concatenate(found)
    return whole if len(whole) else np.array([xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint32)


def to_hex(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the longest common anchor run in order (i-th occurrence to i-th occurrence), over both numbers."""
    if np.array_equal(a, b):
        return 1.0
    where: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for i, x in enumerate(b.tolist()):
        n = seen[x] = seen.get(x, 0) + 1
        where[x, n] = i
    tails: list[int] = []
    nth: dict[int, int] = {}
    for x in a.tolist():
        if x in seen:
            n = nth[x] = nth.get(x, 0) + 1
            p = where.get((x, n))
            if p is not None:
                j = bisect_left(tails, p)
                tails[j:j + 1] = [p]
    return 2.0 * len(tails) / (len(a) + len(b))


def edited(text: str, nxt: str, own: tuple, other: tuple, k: int = K, s: int = S) -> tuple[str, np.ndarray]:
    """The edited text and its anchors: those of both parts, which need no second look, and
    those of the k-mers across the seam."""
    h = len(text) // 2
    keep, new = text[:len(text) - h], nxt[:h]
    seam = keep[-(k - 1):] + new[:k - 1]
    hashes = np.concatenate([own[1][own[0] + k <= len(keep)], _anchors(_points(seam), k, s)[1] if h else own[1][:0],
                             other[1][other[0] + k <= len(new)]])
    return keep + new, hashes


def _row(doc_id, text: str, own, nxt: str, other) -> tuple:
    changed, hashes = edited(text, nxt, own, other)
    a, b, c = _or_whole(own[1], text), _or_whole(hashes, changed), _or_whole(other[1], nxt)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, to_hex(a), to_hex(b), likeness(a, b), likeness(a, c)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprint_pairs(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text (see the module text of ``queries``).

    The texts move once: documents are dealt into ranges of ids, and the first document of
    each range is also sent to the range before it, as the successor of its last document.
    The driver holds one number per range.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = src.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n).alias("m")).first()["m"] if n > 1 else []
    splits = np.array(sorted(set(marks or [])), np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, key.to_numpy(np.int64), side="right").astype(np.int32))

    heads = src.select("key").withColumn("bucket", bucket("key")).groupBy("bucket").agg(F.min("key").alias("k")).collect()
    heads = sorted((r["bucket"], r["k"]) for r in heads)
    guests = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]  # the first range follows the last
    placed = src.withColumn("bucket", bucket("key"))
    if guests:
        to = spark.createDataFrame(guests, "key long, before int")  # one row per range
        guest = src.join(F.broadcast(to), "key").select("doc_id", "text", "key", F.col("before").alias("bucket"),
                                                        F.lit(True).alias("guest"))
        placed = placed.withColumn("guest", F.lit(False)).unionByName(guest)
    else:
        placed = placed.withColumn("guest", F.lit(False))
    placed = placed.repartition("bucket").sortWithinPartitions("bucket", "guest", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, doc_id, text, anchors) still without successor
        for b in batches:
            ids, texts, bs, gs = (b.column(i).to_pylist() for i in range(4))
            start = 0
            while start < len(ids):  # a few MB of text at a time
                stop, held = start, 0
                while stop < len(ids) and held < 4 * BLOCK:
                    held += len(texts[stop])
                    stop += 1
                rows = []
                for i, own in zip(range(start, stop), anchors(texts[start:stop])):
                    if last and last[0] == bs[i]:
                        rows.append(_row(last[1], last[2], last[3], texts[i], own))
                        last = None
                    if not gs[i]:
                        last = (bs[i], ids[i], texts[i], own)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], RESULT.types[c])
                                                  for c in range(len(RESULT))], schema=RESULT)
                start = stop

    return placed.select("doc_id", "text", "bucket", "guest").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
