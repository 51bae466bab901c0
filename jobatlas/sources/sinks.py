"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERNAL_COLUMNS = ("dedup_hash",)


def public_projection(df: DataFrame) -> DataFrame:
    """Results never expose the internal fingerprint."""
    return df.drop(*[c for c in INTERNAL_COLUMNS if c in df.columns])


def write_json_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line per result row."""
    public_projection(df).write.mode(mode).json(path)


def envelope(result: DataFrame, name: str, order: Sequence[Column], value: str | None = None, count: bool = False) -> DataFrame:
    """One row, column ``value``: a JSON object with the rows of ``result`` under ``name``, ascending by
    ``order``, and their number under ``count`` if asked for.

    Rows are objects without their NULL fields, or the column ``value`` alone.  No rows give an empty list.
    The list is one response, so ``result`` must be a limited one (top-k pins, facets, a page of companies).
    """
    public = public_projection(result)
    row = F.col(value) if value else F.struct(*public.columns)
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], row.alias("row"))
    rows = public.agg(F.array_sort(F.collect_list(keyed)).alias("rows"))
    fields = [F.transform("rows", lambda r: r["row"]).alias(name)]
    if count:
        fields.insert(0, F.size("rows").cast("long").alias("count"))
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))


def write_envelope(response: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The response as a text file of one line."""
    response.write.mode(mode).text(path)
