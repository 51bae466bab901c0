"""Operator 7: mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic) that carry word tokens.  Raking scales
the cells' rates to one marginal after the other until the token shares of all marginals meet
their targets; a document is then drawn with its cell's rate, scaled so that the highest rate
is one, but never below a mix of ``TOKEN_SHARE`` of the input's tokens: a rare cell must not decide
how much of the others stays.  Where that takes a rate above one the document is drawn for certain
and its ``weight`` is the rate (how often it is to be repeated); all other weights are one, and the
targets hold for tokens x weight.  ``gap`` is the largest distance of a level's share of the rates'
tokens from its target.  The draw is a hash of id and text: the same rows are drawn on every run,
whatever the partitioning.

A table without a ``topic`` column gets one from its words: the leading bits of a similarity
hash over the distinct longer words, so that like vocabularies share a topic.

Targets are tables ``(level, share)``; levels without tokens in the data are left out and the rest
scaled to one, and levels without a target are not drawn.  Without a table a marginal's target is its
own share to the power ``TEMPER``: large levels are toned down, small ones raised.

Defined cases: null levels form a level of their own; null text has no tokens; cells
without tokens follow their levels' rates up to one and have no part in the scale; rows that repeat id and text are drawn together; if
the targets contradict each other the last sweep's rates hold and ``gap`` tells; target rows of one level add up; an empty
table gives an empty result; extra columns come back untouched, but for those named ``tokens``, ``probability``,
``weight`` or ``gap``, which give way to the operator's own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobatlas.session import cut_lineage, spread

MARGINS = ("source", "lang", "topic")
TEMPER = 0.5
#: Least size of the mix (tokens x weight) as a share of the input's tokens.
TOKEN_SHARE = 0.4
TOLERANCE = 1e-6
SWEEPS = 50
TOPIC_BITS = 3
LONG_WORD = 5
#: A sweep that leaves more than this of the distance from the targets is the last.
STALL = 0.999
SEED = 17
BROADCAST_BYTES = 32 << 20

_RATED = [T.StructField("rate", T.DoubleType()), T.StructField("gap", T.DoubleType())]

_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def describe(text: str | None, bits: int = TOPIC_BITS) -> tuple[int, int]:
    """Number of words and topic of a text (topic 0 if it has no longer word)."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    longer = [w for w in set(words) if len(w) >= LONG_WORD]
    heads = np.fromiter((xxhash.xxh32_intdigest(w) >> 24 for w in longer), np.uint8, len(longer))
    votes = np.bincount(heads, minlength=256) @ _BIT[:, :bits] * 2 > len(longer)
    return len(words), int("0" + "".join("01"[v] for v in votes.tolist()), 2)


def tempered(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    return cells.groupBy(F.col(margin).alias("level")).agg(F.pow(F.sum("tokens").cast("double"), power).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS,
         local_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``cells`` (levels, tokens; read several times) with a ``rate`` that brings tokens x rate to the targets' shares, and
    the ``gap`` left.

    A rate is the product of its levels' factors, and a sweep refits one margin's factors after the
    other.  Cells of at most ``local_bytes`` (measured) are swept as vectors in the driver, more of
    them as tables of factors; both ways stop alike: within ``tolerance``, after ``sweeps``, or when
    a sweep no longer brings the marginals nearer.
    """
    goals = {}
    for m, t in targets.items():
        levels = cells.groupBy(F.col(m).alias("level")).agg(F.sum("tokens").alias("tokens")).alias("a")
        shares = t.groupBy("level").agg(F.sum("share").alias("share")).alias("b")
        goals[m] = levels.join(shares, F.expr("a.level <=> b.level"), "left").select(
            "a.level", F.when(F.col("tokens") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("share"))
    # In memory a row takes its level names and a few numbers; files are smaller than that.
    names = [F.coalesce(F.octet_length(F.col(m).cast("string")), F.lit(0)) for m in goals]
    size = cells.agg(F.sum(sum(names, F.lit(64)))).first()[0] or 0
    return (_rake_local if size <= local_bytes else _rake_tables)(cells, goals, tolerance, sweeps)


def _goes_on(worst: float, before: float, tolerance: float) -> bool:
    return worst > tolerance and worst < before * STALL


def _rake_local(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float, sweeps: int) -> DataFrame:
    table = cells.toArrow()
    tokens = table["tokens"].cast("float64").fill_null(0.0).to_numpy()
    codes, shares = {}, {}
    for m, goal in goals.items():
        coded = table[m].combine_chunks().dictionary_encode(null_encoding="encode")
        codes[m] = coded.indices.to_numpy()
        wanted = dict(zip(*goal.toArrow().select(["level", "share"]).to_pydict().values()))
        share = np.array([wanted.get(v, 0.0) for v in coded.dictionary.to_pylist()])
        shares[m] = share / (share.sum() or 1.0)

    def mass(m: str) -> np.ndarray:
        return np.bincount(codes[m], tokens * rate, len(shares[m]))

    rate, before = np.ones(len(tokens)), np.inf
    for _ in range(sweeps):
        worst = 0.0
        for m in goals:
            now = mass(m)
            worst = max(worst, np.abs(now - shares[m])[now > 0].max(initial=0.0))
            rate *= np.divide(shares[m], now, out=np.ones(len(now)), where=now > 0)[codes[m]]
        if not _goes_on(worst, before, tolerance):
            break
        before = worst
    total = (tokens * rate).sum() or 1.0
    gap = max((np.abs(mass(m) / total - shares[m]).max(initial=0.0) for m in goals), default=0.0)
    out = table.append_column("rate", pa.array(rate)).append_column("gap", pa.array(np.full(len(rate), gap)))
    return cells.sparkSession.createDataFrame(out, T.StructType([*cells.schema, *_RATED]))


def _rake_tables(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float, sweeps: int) -> DataFrame:
    def tabled(m: str, t: DataFrame) -> DataFrame:
        return cut_lineage(t.select("level", "share", "factor", "off"), f"rake-{m}")

    def rated() -> DataFrame:
        out = cells.withColumn("rate", F.lit(1.0))
        for m, t in factors.items():
            f = t.select(F.col("level").alias("__level"), F.col("factor").alias("__factor"))
            out = out.join(f, F.expr(f"{m} <=> __level")).withColumn("rate", F.col("rate") * F.col("__factor"))
            out = out.drop("__level", "__factor")
        return out

    def masses(m: str) -> DataFrame:
        # Marginal sums are partial per task, so a level with a third of the cells moves one row a task.
        return rated().groupBy(F.col(m).alias("at")).agg(F.sum(F.col("tokens") * F.col("rate")).alias("mass"))

    def worst_of(column: str) -> float:
        # A few numbers per margin; the tables are read as they were written, so no plan grows.
        return max((t.agg(F.max(column)).first()[0] or 0.0 for t in factors.values()), default=0.0)

    factors = {}
    for m, goal in goals.items():
        total = goal.agg(F.sum("share")).first()[0] or 1.0
        factors[m] = tabled(m, goal.select("level", (F.col("share") / total).alias("share"), F.lit(1.0).alias("factor"),
                                           F.lit(0.0).alias("off")))
    before = float("inf")
    for _ in range(sweeps):
        for m in goals:
            met = factors[m].join(masses(m), F.expr("level <=> at"))
            some = F.col("mass") > 0
            factors[m] = tabled(m, met.select(
                "level", "share", F.when(some, F.col("factor") * F.col("share") / F.col("mass")).otherwise(F.col("factor")).alias("factor"),
                F.when(some, F.abs(F.col("mass") - F.col("share"))).alias("off")))
        worst = worst_of("off")
        if not _goes_on(worst, before, tolerance):
            break
        before = worst
    total = rated().agg(F.sum(F.col("tokens") * F.col("rate"))).first()[0] or 1.0
    gap = max((masses(m).join(t, F.expr("level <=> at")).agg(F.max(F.abs(F.col("mass") / total - F.col("share")))).first()[0] or 0.0
               for m, t in factors.items()), default=0.0)
    return rated().withColumn("gap", F.lit(gap))


def with_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` and, if it has none, ``topic``."""
    @F.pandas_udf("tokens long, topic string")
    def about(texts: pd.Series) -> pd.DataFrame:
        found = [describe(t) for t in texts]
        return pd.DataFrame({"tokens": [n for n, _ in found], "topic": [f"t{k}" for _, k in found]})

    d = docs.withColumn("__about", about(F.col(text_col).cast("string")))
    d = d.withColumn("tokens", F.col("__about")["tokens"])
    return (d if "topic" in map(str.lower, docs.columns) else d.withColumn("topic", F.col("__about")["topic"])).drop("__about")


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, token_share: float = TOKEN_SHARE) -> DataFrame:
    """``docs`` with tokens and topic, with the ``probability`` to draw each row, its ``weight`` and the marginals' ``gap``."""
    docs = docs.drop("probability", "weight", "gap")
    cells = cut_lineage(docs.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "mixing-cells")
    rates = rake(cells, {m: (targets or {}).get(m) or tempered(cells, m) for m in MARGINS})
    top, mass, tokens, size = rates.agg(
        F.max(F.when(F.col("tokens") > 0, F.col("rate"))), F.sum(F.col("tokens") * F.col("rate")), F.sum("tokens"),
        F.sum(sum((F.coalesce(F.octet_length(F.col(m).cast("string")), F.lit(0)) for m in MARGINS), F.lit(64)))).first()
    least = token_share * tokens / mass if mass else 0.0
    rate = F.col("rate") * least if top and least * top > 1 else F.col("rate") / (top or 1.0)
    rates = rates.select(*[F.col(m).alias(f"__rated_{m}") for m in MARGINS],  # sums differ in their last bits
                         F.round(F.least(rate, F.lit(1.0)), 12).alias("probability"),
                         F.when(F.col("tokens") > 0, F.round(F.greatest(rate, F.lit(1.0)), 6)).otherwise(1.0).alias("weight"),
                         F.round("gap", 9).alias("gap"))
    if (size or 0) <= BROADCAST_BYTES:  # measured; beyond it AQE splits a hot cell's side
        rates = F.broadcast(rates)
    met = " AND ".join(f"{m} <=> __rated_{m}" for m in MARGINS)
    return docs.join(rates, F.expr(met)).drop(*[f"__rated_{m}" for m in MARGINS])


def drawn(ident: Column, text: Column, probability: Column, seed: int = SEED) -> Column:
    spot = F.pmod(F.xxhash64(ident, text, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return spot < probability


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs (doc_id, text, source, lang, ...)`` with ``tokens``, ``topic``, ``probability``, ``weight``, ``gap``."""
    described = with_cells(spread(docs))
    return probabilities(described, targets).where(drawn(F.col("doc_id"), F.col("text"), F.col("probability"), seed))
