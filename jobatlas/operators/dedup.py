"""In-batch dedup by fingerprint.

"Keep the first record per fingerprint in feed order" is an ordered fold per key.
It is written as ``min(struct(order..., payload...))`` per key rather than a
``row_number`` window: ``min`` is a partial aggregate, so each task collapses its
share of a hot fingerprint before the shuffle and a key holding a third of all
rows moves one row per task instead of a third of the data into one window.
Rows without a fingerprint are always kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ORDER = ("source_ord", "query_ord", "pos")


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row (by ``order``, then remaining columns) of every key group."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest]).alias("_first")
    return (df.groupBy(*keys).agg(F.min(packed).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in list(order) + rest])
            .select(*df.columns))


def dedup_batch(df: DataFrame, hash_col: str = "dedup_hash",
                order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """First record per non-blank fingerprint, plus every record without one.

    A record without a fingerprint is a group of its own, so that one pass does: with the two kinds apart, the
    plan below (a whole normalisation) would be computed for each, and the fingerprint once more to tell them."""
    blank = F.coalesce(F.col(hash_col), F.lit("")) == ""
    own = df.withColumn("_own", F.when(blank, F.monotonically_increasing_id()))
    return first_per_key(own, [hash_col, "_own"], order).drop("_own")
