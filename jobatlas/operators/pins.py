"""Map pins and office detail over the companies / offices / jobs tables.

Plan shape (pins):

    jobs --filter(job predicates)--> partial+final count by office_id   (one shuffle, map-side combine)
         join offices (viewport predicate pushed into the scan)
         join companies (company predicate)
         top-k by (job_count desc, office_id)                            (TakeOrderedAndProject)

Aggregating before the joins keeps the join input at most one row per office,
so a single office holding a third of all jobs costs nothing extra: the partial
count collapses it on the map side.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import in_viewport, in_viewport_geodesic
from ..functions.text import null_to_blank, parse_csv_list
from ..session import staged

DEFAULT_PIN_LIMIT = 2000

# Number grammar of request parameters.
INT = re.compile(r"[+-]?[0-9]+")
FLOAT = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


@dataclass(frozen=True)
class PinFilter:
    """Optional constraints of a pin/detail request.  Zero values add no predicate."""

    min_lng: float = 0.0
    min_lat: float = 0.0
    max_lng: float = 0.0
    max_lat: float = 0.0
    has_viewport: bool = False
    keyword: str = ""
    skills: tuple[str, ...] = field(default_factory=tuple)
    work_types: tuple[str, ...] = field(default_factory=tuple)
    experience_level: str = ""
    salary_min: int | None = None
    salary_max: int | None = None
    source: str = ""
    company: str = ""
    limit: int = 0
    edges: str = "planar"           # or "geodesic": great-circle top/bottom edges

    # -- predicates ---------------------------------------------------------
    def job_predicates(self, jobs: DataFrame | None = None) -> list[Column]:
        """F1-F7 on job columns (title, skills, work_type, experience_level, salary_*, source)."""
        col = (lambda c: jobs[c]) if jobs is not None else F.col
        preds: list[Column] = []
        kw = self.keyword.strip()
        if kw:
            preds.append(col("title").ilike(f"%{kw}%"))
        if self.skills:
            wanted = [s.strip().lower() for s in self.skills]
            preds.append(reduce(lambda a, b: a & b,
                                [F.array_contains(col("skills"), F.lit(s)) for s in wanted]))
        if self.work_types:
            preds.append(col("work_type").isin(list(self.work_types)))
        exp = self.experience_level.strip()
        if exp:
            preds.append(col("experience_level").ilike(f"%{exp}%"))
        if self.salary_min is not None:
            preds.append(col("salary_max").isNull() | (col("salary_max") >= F.lit(self.salary_min)))
        if self.salary_max is not None:
            preds.append(col("salary_min").isNull() | (col("salary_min") <= F.lit(self.salary_max)))
        src = self.source.strip()
        if src:
            preds.append(col("source") == F.lit(src))
        return preds

    def company_predicate(self, name_col: Column) -> Column | None:
        co = self.company.strip()
        return name_col.ilike(f"%{co}%") if co else None

    def viewport_predicate(self, lat: Column, lng: Column) -> Column | None:
        if not self.has_viewport:
            return None
        test = in_viewport_geodesic if self.edges == "geodesic" else in_viewport
        return test(lat, lng, self.min_lng, self.min_lat, self.max_lng, self.max_lat)

    def effective_limit(self) -> int:
        return self.limit if self.limit > 0 else DEFAULT_PIN_LIMIT

    def active_count(self) -> int:
        """F16: filters counted by the sidebar badge (salary ceiling is not counted)."""
        return ((1 if self.keyword else 0) + len(self.skills) + len(self.work_types)
                + (1 if self.experience_level else 0) + (1 if self.source else 0)
                + (1 if self.company else 0) + (1 if self.salary_min is not None else 0))

    # -- request parameters (F13) -------------------------------------------
    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> "PinFilter":
        """Lenient coercion of request-style string parameters.

        Unparsable numbers count as absent; ``bbox`` must hold exactly four
        numbers ``minLng,minLat,maxLng,maxLat`` or it is ignored.  Numbers are plain
        ASCII decimals (an integer fits in 64 bits); a request's viewport has
        great-circle edges, as a geography test has.
        """
        def s(k: str) -> str:
            return (params.get(k) or "").strip()

        def as_int(k: str) -> int | None:
            n = int(s(k)) if INT.fullmatch(s(k)) else None
            return n if n is not None and -(1 << 63) <= n < 1 << 63 else None

        kw: dict = dict(keyword=s("keyword"), experience_level=s("experience"),
                        source=s("source"), company=s("company"),
                        skills=tuple(parse_csv_list(s("skills"))),
                        work_types=tuple(parse_csv_list(s("work_type"))),
                        salary_min=as_int("salary_min"), salary_max=as_int("salary_max"),
                        limit=as_int("limit") or 0)
        box = parse_csv_list(s("bbox"))
        # A number that overflows a double is no number: the whole box is ignored.
        if len(box) == 4 and all(FLOAT.fullmatch(x) and math.isfinite(float(x)) for x in box):
            mn_lng, mn_lat, mx_lng, mx_lat = (float(x) for x in box)
            kw.update(min_lng=mn_lng, min_lat=mn_lat, max_lng=mx_lng, max_lat=mx_lat,
                      has_viewport=True, edges="geodesic")
        return cls(**kw)


def _and_all(preds: Iterable[Column | None]) -> Column | None:
    ps = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, ps) if ps else None


def _where(df: DataFrame, pred: Column | None) -> DataFrame:
    return df if pred is None else df.where(pred)


def _head_columns(o: DataFrame, c: DataFrame) -> list[Column]:
    """Office and company columns of a pin; absent addresses and logos read as ''."""
    return [o.id.alias("office_id"), o.lat, o.lng, o.city, o.country, null_to_blank(o.address).alias("address"),
            c.id.alias("company_id"), c.name.alias("company_name"), null_to_blank(c.logo_url).alias("company_logo")]


def result_count(result: DataFrame) -> DataFrame:
    """One row with the number of result rows."""
    return result.agg(F.count(F.lit(1)).alias("count"))


def pins(companies: DataFrame, offices: DataFrame, jobs: DataFrame, flt: PinFilter = PinFilter(),
         limit: bool = True) -> DataFrame:
    """Offices with at least one matching job, with the matching-job count."""
    counts = (_where(jobs, _and_all(flt.job_predicates(jobs)))
              .groupBy("office_id").agg(F.count(F.lit(1)).alias("job_count")))
    o = _where(offices, flt.viewport_predicate(offices["lat"], offices["lng"]))
    c = _where(companies, flt.company_predicate(companies["name"]))
    out = (counts.join(o, counts.office_id == o.id)
           .join(c, o.company_id == c.id)
           .select(*_head_columns(o, c), counts.job_count))
    if limit:
        out = out.orderBy(F.col("job_count").desc(), F.col("office_id")).limit(flt.effective_limit())
    return out


JOB_COLUMNS = ("id", "title", "skills", "experience_level", "work_type", "salary_min", "salary_max",
               "salary_currency", "posted_date", "source", "source_url", "created_at", "updated_at")
# Absent values of these read as ''.
JOB_BLANK_COLUMNS = ("experience_level", "salary_currency", "source_url")


def office_detail(companies: DataFrame, offices: DataFrame, jobs: DataFrame,
                  flt: PinFilter = PinFilter(), office_ids: list[int] | None = None,
                  job_columns: tuple[str, ...] = JOB_COLUMNS) -> DataFrame:
    """Office header with its number of matching jobs, and those jobs as flat rows; an office
    with no match keeps one row with NULL job columns (J2, J3, L5).

    Flat rows rather than a nested ``collect_list`` so no office's job list is ever
    gathered into one row.  One partial count per office gives ``job_count`` and tells the
    offices without a match, so the left-outer join becomes an inner join, which AQE can
    split when one office is hot, and the rows with a count of 0.  The matching jobs and the
    header rows are written once and read by both.
    """
    o = offices if office_ids is None else offices.where(offices.id.isin(office_ids))
    head = o.join(companies, o.company_id == companies.id).select(*_head_columns(o, companies))
    head = _where(head, flt.company_predicate(F.col("company_name")))
    j = _where(jobs, _and_all(flt.job_predicates(jobs)))
    if office_ids is not None:
        j = j.where(j.office_id.isin(office_ids))
    read = [null_to_blank(c).alias(c) if c in JOB_BLANK_COLUMNS else F.col(c) for c in job_columns]
    j = staged(j.select("office_id", *read), "detail-jobs")
    counts = j.groupBy("office_id").agg(F.count(F.lit(1)).alias("job_count"))
    head = head.join(counts, "office_id", "left").withColumn("job_count", F.coalesce("job_count", F.lit(0).cast("long")))
    head = staged(head, "detail-head")
    matched = head.where("job_count > 0").join(j, "office_id")
    return matched.unionByName(head.where("job_count = 0"), allowMissingColumns=True)


def _newest_first(ties: Iterable[str]) -> list[Column]:
    return [F.col("posted_date").desc_nulls_last(), F.col("created_at").desc_nulls_last(), *[F.col(t) for t in ties]]


def order_detail(detail: DataFrame, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """L5 ordering: office, newest posting first (NULL dates last), newest creation, then the job's key."""
    return detail.orderBy(F.col("office_id"), *_newest_first(ties))


def rank_detail(detail: DataFrame, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """L5 as a column: the place of each job in its office's list, from 1.

    A window over the office would put a hot office's jobs into one task.  Instead the rows are
    range-partitioned by office and list order and written; a row's place is its place among its office's
    rows of the same range, plus the office's rows in the ranges before.  Those counts are one row per
    office and range that meet.  ``ties`` must end in the job's key, or equal rows stay in one range.
    """
    order = [F.col("office_id"), *_newest_first(ties)]
    ranged = detail.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = staged(ranged, "detail-ranges")
    counts = ranged.groupBy("office_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("office_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("office_id").alias("_office"), F.col("_range").alias("_at"),
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("office_id", "_range").orderBy(*_newest_first(ties))
    placed = ranged.withColumn("_inside", F.row_number().over(inside)).join(
        before, F.expr("office_id <=> _office AND _range = _at"))
    return placed.select(*detail.columns, (F.col("_before") + F.col("_inside")).cast("int").alias("place"))
