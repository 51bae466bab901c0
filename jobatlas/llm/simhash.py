"""Operator 5: SimHash near-duplicate links by multi-index hashing.

Fingerprints of word shingles are cut into segments.  Two fingerprints at most
``max_bits`` apart differ in few bits of some segment (pigeonhole), so each fingerprint
probes the segment tables with every value in a small Hamming ball round its own segment
value; matches are verified on the complete distance.  Components of the links come from
:mod:`jobatlas.llm.components`.

Defined cases: null or blank text has fingerprint 0 and links like any other; texts with
fewer words than the shingle length hash the whole word sequence; repeated rows and equal
texts share one fingerprint and one component; a null ``doc_id`` never becomes a
component id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.session import cut_lineage, spread

from .components import connected_components

SEED = 42
BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 2
#: A probe bucket with more fingerprints than this is linked through masked keys instead of pairs.
DENSE_BUCKET = 256

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def simhash(text: bytes | None, k: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one UTF-8 text as an unsigned 64-bit int."""
    words = text.lower().split() if text else []  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    if len(words) < k:
        return _hash(b" ".join(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
    n = len(words) - k + 1
    octets = np.fromiter(map(_hash, shingles), np.uint64, n).astype("<u8").view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BIT_OF_BYTE for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id, tag, fp bigint)`` of every row; ``fp`` holds the 64 bits as a signed long, ``tag`` tells rows apart
    that repeat an id with another text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = np.fromiter((simhash(t.as_py(), shingle_words) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             names=["id", "tag", "fp"])

    src = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.hash(F.col(text_col)).alias("tag"),
                             F.col(text_col).cast("string").alias("text")))
    return src.mapInArrow(run, "id long, tag int, fp bigint")


def segments(max_bits: int, count: int) -> list[tuple[int, int, int, int]]:
    """``(segment, first bit, width, radius)``: with r = q * count + a, some one of the first
    a + 1 segments differs in at most q bits or some later one in at most q - 1."""
    q, a = divmod(max_bits, count)
    edges = [round(i * BITS / count) for i in range(count + 1)]
    out = [(s, edges[s], edges[s + 1] - edges[s], q if s <= a else q - 1) for s in range(count)]
    return [x for x in out if x[3] >= 0]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _value(seg: tuple[int, int, int, int], fp="fp"):
    _, first, width, _ = seg
    part = F.shiftrightunsigned(F.col(fp), first)
    return part if width == BITS else part.bitwiseAND(F.lit((1 << width) - 1))


def _probes(seg: tuple[int, int, int, int]):
    balls = F.array(*[F.lit(_signed(m)).cast("long") for m in _ball(seg[2], seg[3])])
    return F.transform(balls, lambda m: F.struct(F.lit(seg[0]).alias("seg"), _value(seg).bitwiseXOR(m).alias("key")))


def links(fps: DataFrame, max_bits: int = MAX_BITS, n_segments: int = 2,
          dense_bucket: int = DENSE_BUCKET) -> DataFrame:
    """Edges ``(a, b)`` among distinct fingerprints ``fp`` whose transitive closure is that of
    all pairs at most ``max_bits`` apart.

    Buckets of up to ``dense_bucket`` fingerprints are matched pair by pair.  In a fuller
    bucket pairs would grow with its square; there every member is filed under each of its
    values with ``max_bits`` bits blanked -- two fingerprints share such a value exactly if
    they are at most ``max_bits`` apart -- and joins the smallest member filed with it.
    """
    segs = segments(max_bits, n_segments)
    table = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s[0]).alias("seg"), _value(s).alias("key")) for s in segs])).alias("e")).select("fp", "e.*")
    full = table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense_bucket)
    full = cut_lineage(full.select("seg", "key"), "simhash-dense")
    probe = fps.select("fp", F.explode(F.concat(*[_probes(s) for s in segs])).alias("e")).select("fp", "e.*")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    sparse = table.join(full, ["seg", "key"], "left_anti").withColumnRenamed("fp", "other")
    near = probe.join(sparse, ["seg", "key"]).where(F.col("fp") != F.col("other")).where(apart)
    near = near.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))

    # Fuller buckets: all that probe them, members and neighbours alike, filed under blanked values.
    blanks = ",".join(f"{_signed((1 << BITS) - 1 - sum(1 << b for b in bits))}L"
                      for bits in combinations(range(BITS), max_bits))
    filed = (probe.join(full, ["seg", "key"]).select("fp").distinct()
             .select("fp", F.posexplode(F.expr(f"array({blanks})")).alias("i", "mask"))
             .select("fp", "i", F.col("fp").bitwiseAND(F.col("mask")).alias("blank")))
    first = filed.groupBy("i", "blank").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    dense_near = filed.join(first, ["i", "blank"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    return near.union(dense_near).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tag, fp, root, component_id)`` per row: the smallest id reachable over links, itself included."""
    rows = cut_lineage(fingerprints(docs, shingle_words, id_col, text_col), "simhash-rows")
    # Copies collapse here, before any linking: one node per fingerprint.
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-nodes")
    comps = connected_components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(least, "root"), "fp")




def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate component of ``docs (doc_id, text, ...)``: that with the smallest
    ``doc_id`` (rows without any id come last); of rows that repeat it, that with the smallest
    text hash, and of rows that repeat the text as well, any one."""
    found = near_duplicates(docs, shingle_words, max_bits)
    order = F.struct(F.col("id").isNull(), "id", "tag", "fp")
    # By root, not by component id: an id that two rows with other texts repeat may name two components.
    first = found.groupBy("root").agg(F.min(order).alias("first"))
    first = first.select(F.struct("first.id").alias("key"), F.col("first.tag").alias("tag")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    rows = docs.toDF(*names).withColumns({"key": F.struct(F.col(ident).cast("long").alias("id")), "tag": F.hash(text)})
    # Partitioned alike by join and deduplication: the texts move once.
    return rows.join(first, ["key", "tag"]).dropDuplicates(["key", "tag"]).select(*names).toDF(*docs.columns)
