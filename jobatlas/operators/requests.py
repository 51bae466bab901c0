"""Request parameters as columns (F13, F16): the rules of ``PinFilter.from_params`` for a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .pins import FLOAT, INT

PARAMETERS = ("keyword", "skills", "work_type", "experience", "salary_min", "salary_max", "source", "company", "limit", "bbox")


def lenient_int(c: Column) -> Column:
    """A plain decimal that fits in 64 bits; NULL otherwise."""
    s = X.utrim(X.null_to_blank(c))
    return F.when(s.rlike(f"^(?:{INT.pattern})$"), s).try_cast("bigint")


def lenient_box(c: Column) -> Column:
    """``minLng,minLat,maxLng,maxLat`` as an array of four finite doubles; NULL if it is anything else."""
    parts = X.csv_list(c)
    numbers = F.transform(parts, lambda s: F.when(s.rlike(f"^(?:{FLOAT.pattern})$"), s).try_cast("double"))
    finite = F.forall(numbers, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    return F.when((F.size(parts) == 4) & finite, numbers)


def coerce_requests(requests: DataFrame) -> DataFrame:
    """``requests`` with its parameters (strings, all of ``PARAMETERS``; NULL is absent) replaced by their values.

    Adds ``row_limit``, ``has_viewport``, the box's edges (0 without one) and ``n_active``: the filters that the
    sidebar counts, which leave out the salary ceiling and the viewport.
    """
    plain = {p: X.utrim(X.null_to_blank(F.col(p))) for p in ("keyword", "experience", "source", "company")}
    out = requests.withColumns({
        **plain, "skills": X.csv_list(F.col("skills")), "work_type": X.csv_list(F.col("work_type")),
        "salary_min": lenient_int(F.col("salary_min")), "salary_max": lenient_int(F.col("salary_max")),
        "row_limit": F.coalesce(lenient_int(F.col("limit")), F.lit(0).cast("long")), "_box": lenient_box(F.col("bbox"))})
    edges = {n: F.coalesce(F.try_element_at("_box", F.lit(i + 1)), F.lit(0.0))
             for i, n in enumerate(("min_lng", "min_lat", "max_lng", "max_lat"))}
    given = [F.when(F.col(p) != "", 1).otherwise(0) for p in plain]
    n_active = sum(given, F.size("skills") + F.size("work_type")) + F.when(F.col("salary_min").isNotNull(), 1).otherwise(0)
    return out.withColumns({"has_viewport": F.col("_box").isNotNull(), **edges, "n_active": n_active}).drop("_box", "limit", "bbox")
