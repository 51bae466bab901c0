"""Registered map/read queries over the companies / offices / jobs views (E1, E3, facets)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facets
from ..operators.pins import JOB_COLUMNS, PinFilter, office_detail, pins, rank_detail, result_count
from ..sources import tables as T
from .registry import register

V3 = ("companies", "offices", "jobs")


def _views(spark: SparkSession, sf_dir: str):
    return T.companies(spark, sf_dir), T.offices(spark, sf_dir), T.jobs(spark, sf_dir)


_PIN_SELECT = """SELECT o.id AS office_id, o.lat, o.lng, o.city, o.country, coalesce(o.address, '') AS address,
       c.id AS company_id, c.name AS company_name, coalesce(c.logo_url, '') AS company_logo, COUNT(*) AS job_count
FROM offices o JOIN companies c ON c.id = o.company_id JOIN jobs j ON j.office_id = o.id
WHERE {where}
GROUP BY ALL
ORDER BY job_count DESC, office_id
LIMIT {limit}"""


def _pin_sql(where: str, limit: int = 2000) -> str:
    return T.with_views(_PIN_SELECT.format(where=where, limit=limit), *V3)


PIN_FILTERS = {
    "pins_filtered": (PinFilter(keyword="bolt", work_types=("remote", "hybrid"),
                                experience_level="ni", limit=20),
                      "j.title ILIKE '%bolt%' AND j.work_type IN ('remote', 'hybrid') "
                      "AND j.experience_level ILIKE '%ni%'", 20),
    "pins_viewport": (PinFilter(has_viewport=True, min_lng=-100.0, min_lat=-40.0,
                                max_lng=60.0, max_lat=50.0),
                      "o.lat BETWEEN -40 AND 50 AND o.lng BETWEEN -100 AND 60", 2000),
    "pins_viewport_wrap": (PinFilter(has_viewport=True, min_lng=120.0, min_lat=-60.0,
                                     max_lng=-120.0, max_lat=60.0),
                           "o.lat BETWEEN -60 AND 60 AND (o.lng >= 120 OR o.lng <= -120)", 2000),
    "pins_skills_all": (PinFilter(skills=(" Small ", "ECONOMY")),
                        "list_contains(j.skills, 'small') AND list_contains(j.skills, 'economy')", 2000),
    "pins_salary_overlap": (PinFilter(salary_min=60000, salary_max=90000),
                            "(j.salary_max IS NULL OR j.salary_max >= 60000) "
                            "AND (j.salary_min IS NULL OR j.salary_min <= 90000)", 2000),
    "pins_viewport_geodesic": (PinFilter(has_viewport=True, min_lng=-60.0, min_lat=-30.0,
                                         max_lng=60.0, max_lat=50.0, edges="geodesic"),
                               "o.lng BETWEEN -60 AND 60 "
                               "AND o.lat >= degrees(atan(tan(radians(-30.0)) * cos(radians(o.lng - 0.0)) "
                               "/ cos(radians(60.0)))) "
                               "AND o.lat <= degrees(atan(tan(radians(50.0)) * cos(radians(o.lng - 0.0)) "
                               "/ cos(radians(60.0))))", 2000),
    "pins_company": (PinFilter(company="ion_1", source="remotive"),
                     "c.name ILIKE '%ion_1%' AND j.source = 'remotive'", 2000),
}


def _make_pin_query(name: str, flt: PinFilter, where: str, limit: int) -> None:
    @register(name, _pin_sql(where, limit))
    def _q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pins(*_views(spark, sf_dir), flt)


for _name, (_flt, _where, _limit) in PIN_FILTERS.items():
    _make_pin_query(_name, _flt, _where, _limit)


# -- office detail (flat rows) ---------------------------------------------------

# The driver's lineitem rows have no key of their own: these columns and the office name a row.
_JOB_KEY = ("l_orderkey", "l_linenumber", "l_partkey")
_JOB_COLUMNS = (*_JOB_KEY, *JOB_COLUMNS[1:])


def _detail_out(df: DataFrame) -> DataFrame:
    return df.withColumns({"skills": F.array_join("skills", "|"), "posted_date": F.col("posted_date").cast("string")})


_DETAIL_SQL = """SELECT o.id AS office_id, o.lat, o.lng, o.city, o.country, coalesce(o.address, '') AS address, c.id AS company_id,
       c.name AS company_name, coalesce(c.logo_url, '') AS company_logo,
       count(j.l_orderkey) OVER (PARTITION BY o.id) AS job_count, j.l_orderkey, j.l_linenumber, j.l_partkey, j.title,
       array_to_string(j.skills, '|') AS skills, j.work_type,
       CASE WHEN j.l_orderkey IS NOT NULL THEN coalesce(j.experience_level, '') END AS experience_level,
       j.salary_min, j.salary_max, CASE WHEN j.l_orderkey IS NOT NULL THEN coalesce(j.salary_currency, '') END AS salary_currency,
       CAST(j.posted_date AS VARCHAR) AS posted_date, j.source,
       CASE WHEN j.l_orderkey IS NOT NULL THEN coalesce(j.source_url, '') END AS source_url, j.created_at, j.updated_at
FROM offices o JOIN companies c ON c.id = o.company_id
LEFT JOIN (SELECT * FROM jobs WHERE {where}) j ON j.office_id = o.id"""

DETAIL_FILTER = PinFilter(salary_min=90000, work_types=("onsite",))
DETAIL_WHERE = "(salary_max IS NULL OR salary_max >= 90000) AND work_type IN ('onsite')"
EMPTY_FILTER = PinFilter(keyword="red bolt", source="adzuna", experience_level="senior")
EMPTY_WHERE = "title ILIKE '%red bolt%' AND source = 'adzuna' AND experience_level ILIKE '%senior%'"


@register("office_detail", T.with_views(_DETAIL_SQL.format(where=DETAIL_WHERE), *V3))
def q_office_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail_out(office_detail(*_views(spark, sf_dir), DETAIL_FILTER, job_columns=_JOB_COLUMNS))


@register("office_detail_ranked", T.with_views(
    "SELECT *, row_number() OVER (PARTITION BY office_id ORDER BY posted_date DESC NULLS LAST, created_at DESC NULLS LAST, "
    "l_orderkey, l_linenumber, l_partkey) AS place FROM (" + _DETAIL_SQL.format(where=DETAIL_WHERE) + ")", *V3))
def q_office_detail_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = office_detail(*_views(spark, sf_dir), DETAIL_FILTER, job_columns=_JOB_COLUMNS)
    return _detail_out(rank_detail(detail, _JOB_KEY))


@register("pins_count", T.with_views("SELECT count(*) AS count FROM (" + _PIN_SELECT.format(
    where=PIN_FILTERS["pins_viewport"][1], limit=10) + ")", *V3))
def q_pins_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_count(pins(*_views(spark, sf_dir), replace(PIN_FILTERS["pins_viewport"][0], limit=10)))


@register("office_detail_empty", T.with_views(_DETAIL_SQL.format(where=EMPTY_WHERE), *V3))
def q_office_detail_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail_out(office_detail(*_views(spark, sf_dir), EMPTY_FILTER, job_columns=_JOB_COLUMNS))


# -- stats and facets -------------------------------------------------------------

@register("stats", T.with_views("""SELECT (SELECT count(*) FROM companies) AS companies,
       (SELECT count(*) FROM offices) AS offices, (SELECT count(*) FROM jobs) AS jobs,
       (SELECT count(*) FROM jobs WHERE work_type = 'remote') AS remote_jobs""", *V3))
def q_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.stats(*_views(spark, sf_dir))


_SKILL_COUNTS = "SELECT skill, count(*) AS n FROM (SELECT unnest(skills) AS skill FROM jobs) GROUP BY skill"


@register("skill_facets", T.with_views(_SKILL_COUNTS + " ORDER BY n DESC, skill LIMIT 12", "jobs"))
def q_skill_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.skill_facets(T.jobs(spark, sf_dir), 12)


@register("skill_counts", T.with_views(_SKILL_COUNTS, "jobs"))
def q_skill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.skill_counts(T.jobs(spark, sf_dir))


@register("skill_suggest", T.with_views(
    f"SELECT skill, n FROM ({_SKILL_COUNTS} ORDER BY n DESC, skill LIMIT 10) t "
    "WHERE skill NOT IN ('red') AND contains(skill, 'e') ORDER BY n DESC, skill LIMIT 8", "jobs"))
def q_skill_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.skill_suggestions(T.jobs(spark, sf_dir), " E ", ["red"], pool=10)


@register("company_list", T.with_views(
    "SELECT id, name, region FROM companies ORDER BY name, id LIMIT 10", "companies"))
def q_company_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.company_list(T.companies(spark, sf_dir), 10).select("id", "name", "region")


@register("company_lookup", T.with_views(
    "SELECT id, name, region FROM companies WHERE id IN (SELECT company_id + 7 FROM offices WHERE id % 5 = 0)",
    "companies", "offices"))
def q_company_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # some of the ids asked for belong to no company
    asked = T.offices(spark, sf_dir).where(F.col("id") % 5 == 0).select((F.col("company_id") + 7).alias("company_id"))
    return facets.company_lookup(T.companies(spark, sf_dir), asked).select("id", "name", "region")


@register("pins_skills_index", _pin_sql(PIN_FILTERS["pins_skills_all"][1]))
def q_pins_skills_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 for what the original's skill index answers: one filter over the jobs' skill arrays, no index."""
    return pins(*_views(spark, sf_dir), PinFilter(skills=("ECONOMY", "small ")))
