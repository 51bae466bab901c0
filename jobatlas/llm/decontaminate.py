"""Operator 3: benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores, lower-cased; scripts that are written without spaces
(``UNSPACED``) count by the character.  A seed is the hash of ``MIN_MATCH`` words in
a row.  Documents and benchmark items are joined on shared seeds, the item's rarest ones first; pairs whose
shared seeds touch too few words of the item cannot reach the threshold and go.  Each remaining pair is tiled:
the longest match that overlaps no marked word, found by running the seed hashes side by
side (Karp-Rabin, seed by seed), is marked, again and again, while matches of ``MIN_MATCH`` words are left.
An item is leaked in a document if its tiles cover at least ``COVERAGE`` of its words, in
whatever order the document has them.

Every tile consists of shared seeds, so the seed places stand for the texts after the join
and no text is shuffled.  Document seeds that no item has are dropped at the scan while the
benchmark's distinct seeds are at most ``LOCAL_SEEDS`` (16 bytes each, counted first); beyond that
the seed join does it.

An item of fewer than ``MIN_MATCH`` words is one seed, its whole sequence, and is leaked wherever that occurs: a
benchmark with very short items flags every text that quotes one.

Defined cases: null text has no words; items without a word match nothing; rows that repeat a document id count as parts of one document,
and rows that repeat an item id as items of their own (the best covered one is reported); a null id is an id; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.session import cut_lineage, spread

MIN_MATCH = 5
COVERAGE = 0.8
LOCAL_SEEDS = 1_000_000

# Kana, Han, Thai, Lao, Tibetan, Myanmar, Khmer.
UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff"

_WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


def words(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall((text or "").lower())]


def grams(found: list[bytes], k: int) -> list[int]:
    """The hash of every k words in a row."""
    return [xxhash.xxh64_intdigest(b" ".join(x)) - (1 << 63) for x in zip(*(found[i:] for i in range(k)))]


def seeds(text: str | None, k: int = MIN_MATCH) -> tuple[int, list[int]]:
    """Number of words and the seed at each place."""
    found = words(text)
    return len(found), grams(found, k)


def item_seeds_of(text: str | None, k: int = MIN_MATCH) -> tuple[int, list[int]]:
    """Number of words and seeds of an item; a short one is a single seed."""
    found = words(text)
    return len(found), grams(found, min(k, len(found))) if found else []


def tiles(doc: dict[int, int], item: list[int], k: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of a document's seeds (place -> seed) with an item's: ``(document place,
    item place, words)``, longest first, leftmost in the document, then in the item, on ties."""
    places = defaultdict(list)
    for q, s in enumerate(item):
        places[s].append(q)
    starts = [(p, q) for p, s in doc.items() for q in places.get(s, ())]
    out, doc_marked, item_marked = [], set(), set()

    def run(p: int, q: int) -> int:
        """Words from here on that match and are unmarked on both sides."""
        n = 0
        while (doc.get(p + n) == item[q + n] if q + n < len(item) else False):
            n += 1
        n = n + k - 1 if n else 0
        return next((i for i in range(n) if p + i in doc_marked or q + i in item_marked), n)

    def head(p: int, q: int) -> bool:
        return not (q and doc.get(p - 1) == item[q - 1]) or p - 1 in doc_marked or q - 1 in item_marked

    while True:
        found = sorted(((n, -p, -q) for p, q in starts if head(p, q) and (n := run(p, q)) >= k), reverse=True)
        if not found:
            return out
        longest = found[0][0]
        for n, p, q in found:
            p, q = -p, -q
            if n < longest or run(p, q) < n:
                continue
            out.append((p, q, n))
            doc_marked.update(range(p, p + n))
            item_marked.update(range(q, q + n))
        starts = [(p, q) for p, q in starts if p not in doc_marked and q not in item_marked]


def _doc_seeds(kept: np.ndarray | None, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, found = [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                s = np.array(seeds(t, k)[1], np.int64)
                at = np.arange(len(s))
                if kept is not None and len(s):
                    near = np.searchsorted(kept, s)
                    near[near == len(kept)] = 0
                    at = np.flatnonzero(kept[near] == s) if len(kept) else at[:0]
                rows.append(np.full(len(at), r))
                places.append(at)
                found.append(s[at])
            whole = (lambda x: np.concatenate(x) if x else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(whole(rows), pa.int64())), b.column(2).take(pa.array(whole(rows), pa.int64())),
                 pa.array(whole(places), pa.int64()), pa.array(whole(found), pa.int64())], names=["doc", "part", "p", "seed"])
    return run


def _short_leaks(docs: DataFrame, short: DataFrame, k: int, local_seeds: int) -> DataFrame:
    """Leaks of items of fewer than ``k`` words: the documents that hold their whole sequence."""
    sizes = sorted(r["n"] for r in short.select("n").distinct().collect())  # less than k numbers
    seeds_ = short.select(F.col("seeds")[0].alias("seed")).distinct()
    kept = None
    if seeds_.count() <= local_seeds:
        kept = {r["seed"] for r in seeds_.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, found = [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                own = words(t)
                for size in sizes:
                    first = {}  # the first place of each sequence
                    for p, s in enumerate(grams(own, size)):
                        if kept is None or s in kept:
                            first.setdefault(s, p)
                    rows += [r] * len(first)
                    places += first.values()
                    found += first
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(places, pa.int64()),
                                              pa.array(found, pa.int64())], names=["doc", "part", "p", "seed"])

    hits = spread(docs).select("doc", "t", F.hash("t").alias("part")).mapInArrow(run, "doc long, part int, p long, seed long")
    first = hits.groupBy("doc", "seed").agg(F.min(F.struct("part", "p")).alias("at"))
    met = first.join(short.select("item_id", "n", F.col("seeds")[0].alias("seed")), "seed")
    tile = F.struct(F.col("at.part").alias("part"), F.col("at.p").alias("doc_start"), F.lit(0).alias("item_start"), F.col("n").alias("length"))
    return met.select(F.col("doc").alias("doc_id"), "item_id", F.col("n").alias("n_words"), F.col("n").alias("n_covered"),
                      F.lit(1.0).alias("coverage"), F.array(tile).alias("tiles"))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, coverage: float = COVERAGE,
          local_seeds: int = LOCAL_SEEDS) -> DataFrame:
    """``(doc_id, item_id, n_words, n_covered, coverage, tiles)`` of every leaked item."""
    @F.pandas_udf("n int, seeds array<long>")
    def of_item(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([item_seeds_of(t, k) for t in texts], columns=["n", "seeds"])

    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("t")).distinct()
    items = items.withColumn("s", of_item("t")).select(
        "item_id", F.xxhash64("item_id", "t").alias("item"), "s.n", "s.seeds").where("size(seeds) > 0")
    items = cut_lineage(items, "tiling-items")
    short, items = items.where(F.col("n") < k), items.where(F.col("n") >= k)
    item_seeds = items.select("item", "n", F.posexplode("seeds").alias("q", "seed"))

    distinct = item_seeds.select("seed").distinct()
    kept = None
    if distinct.count() <= local_seeds:
        kept = np.sort(np.array([r["seed"] for r in distinct.collect()], np.int64))
    ddl = "doc long, part int, p long, seed long"
    src = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("t"))
    hits = spread(src).select("doc", "t", F.hash("t").alias("part")).mapInArrow(_doc_seeds(kept, k), ddl)
    if kept is None:
        hits = hits.join(distinct, "seed", "left_semi").select("doc", "part", "p", "seed")
    hits = cut_lineage(hits, "tiling-hits")

    # A leak shares at least ``need`` of its item's distinct seeds, so it shares one of the rarest when the need - 1
    # most frequent are set aside: phrases that many items and documents have bring no pair about.
    own = hits.select("doc", "seed").distinct()
    spread_of = own.groupBy("seed").agg(F.count(F.lit(1)).alias("docs"))
    distinct_seeds = item_seeds.groupBy("item", "n", "seed").agg(F.count(F.lit(1)).alias("times"))
    ranked = distinct_seeds.join(spread_of, "seed", "left").groupBy("item", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "seed"))).alias("seeds"),
        F.max("times").alias("times"))
    need = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * coverage - 1e-9) / (k * F.col("times")))).cast("int")
    rare = ranked.select("item", F.explode(F.slice("seeds", F.lit(1), F.size("seeds") - need + 1)).alias("s"))
    rare = rare.where("s.docs > 0").select("item", "s.seed")
    candidates = cut_lineage(own.join(rare, "seed").select("doc", "item").distinct(), "tiling-candidates")

    # How much of the item shared seeds touch bounds what tiles can cover.
    touched = candidates.join(item_seeds, "item").join(own.withColumnRenamed("doc", "d").withColumnRenamed("seed", "s"),
                                                       F.expr("doc <=> d AND seed = s"))
    words = F.flatten(F.transform(F.collect_set("q"), lambda q: F.sequence(q, q + k - 1)))
    pairs = touched.groupBy("doc", "item", "n").agg(F.size(F.array_distinct(words)).alias("bound"))
    pairs = pairs.where(F.col("bound") >= F.ceil(F.col("n") * coverage - 1e-9)).select("doc", "item")

    # Seeds of one document, only those that the pair's item has; parts lie apart so that no tile spans two.
    wanted = pairs.join(item_seeds.select("item", F.col("seed").alias("s")).distinct(), "item")
    mine = wanted.join(hits.withColumnRenamed("doc", "d"), F.expr("doc <=> d AND s = seed"))
    mine = mine.groupBy("doc", "item").agg(F.collect_set(F.struct("part", "p", "seed")).alias("hits"))
    mine = mine.join(items, "item")

    @F.pandas_udf("array<struct<part: int, doc_start: long, item_start: int, length: int>>")
    def tile(found: pd.Series, item: pd.Series) -> pd.Series:
        out = []
        for rows, wanted in zip(found, item):
            parts = {x: i for i, x in enumerate(sorted({r["part"] for r in rows}))}
            far = max(r["p"] for r in rows) + len(wanted) + 2 * k
            place = {parts[r["part"]] * far + r["p"]: r["seed"] for r in sorted(rows, key=lambda r: (r["part"], r["p"]))}
            names = sorted(parts)
            out.append([(names[p // far], p % far, q, n) for p, q, n in tiles(place, list(wanted), k)])
        return pd.Series(out)

    tiled = mine.withColumn("tiles", tile("hits", "seeds")).withColumn(
        "n_covered", F.aggregate("tiles", F.lit(0), lambda a, t: a + t["length"]))
    tiled = tiled.where(F.col("n_covered") >= F.ceil(F.col("n") * coverage - 1e-9)).select(
        F.col("doc").alias("doc_id"), "item_id", F.col("n").alias("n_words"), "n_covered",
        (F.col("n_covered") / F.col("n")).alias("coverage"), "tiles")
    if not short.isEmpty():
        tiled = tiled.unionByName(_short_leaks(src, short, k, local_seeds))
    best = F.max_by(F.struct("n_words", "n_covered", "coverage", "tiles"), F.struct("coverage", "n_words", "n_covered"))
    return tiled.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` in which no item is leaked."""
    bad = leaks(docs, benchmark, **params).select(F.col("doc_id").alias("leaked")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident = F.col(names[docs.columns.index("doc_id")]).cast("long")
    return docs.toDF(*names).join(bad, ident.eqNullSafe(F.col("leaked")), "left_anti").toDF(*docs.columns)
