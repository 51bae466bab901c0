"""Registered queries over many requests at once and of whole responses (F13, F16, S16, G9, P25/F8 with L1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as GEO
from ..operators import facets, spatial
from ..operators.pins import PinFilter, pins
from ..operators.requests import coerce_requests
from ..session import spread
from ..sources import sinks
from ..sources import tables as T
from . import q_map
from .q_cluster import q_viewport_buckets
from .registry import ORACLES, register

_V3 = ("companies", "offices", "jobs")


# -- parameters (F13, F16) ------------------------------------------------------------

# One request per order, in strings as they come; {k} is the order's key, {p} its price in whole units.
_PARAMS = {
    "keyword": "CASE k % 3 WHEN 0 THEN '  bolt ' WHEN 1 THEN ' ' END",
    "skills": "CASE k % 4 WHEN 0 THEN ' Small,, ECONOMY , ' WHEN 1 THEN ',' WHEN 2 THEN 'steel' END",
    "work_type": "CASE k % 5 WHEN 0 THEN 'remote,hybrid' WHEN 1 THEN '' ELSE 'onsite' END",
    "experience": "CASE k % 2 WHEN 0 THEN 'senior' END",
    "salary_min": "CASE k % 8 WHEN 0 THEN CAST(p AS STRING) WHEN 1 THEN concat(' -', CAST(p AS STRING), ' ') WHEN 2 THEN '12.5' "
                  "WHEN 3 THEN 'abc' WHEN 4 THEN '99999999999999999999' WHEN 5 THEN '9223372036854775807' WHEN 6 THEN '' END",
    "salary_max": "CASE k % 3 WHEN 0 THEN concat('00', CAST(p AS STRING)) WHEN 1 THEN '1e5' END",
    "source": "CASE k % 7 WHEN 0 THEN 'adzuna' END",
    "company": "CASE k % 11 WHEN 0 THEN ' ion ' WHEN 1 THEN '' END",
    "limit": "CASE k % 6 WHEN 0 THEN '20' WHEN 1 THEN 'all' WHEN 2 THEN '-3' END",
    "bbox": "CASE k % 9 WHEN 0 THEN concat('-', CAST(p % 180 AS STRING), '.5, -40,60 ,5e1') WHEN 1 THEN '1,2,3' WHEN 2 THEN '1,2,3,4,5' "
            "WHEN 3 THEN '1,2,x,4' WHEN 4 THEN '-10,-10,1e999,10' WHEN 5 THEN '1,,2,3,.5' WHEN 6 THEN 'NaN,1,2,3' "
            "WHEN 7 THEN concat('0,0,', CAST(p % 90 AS STRING), '.,+1') END",
}
_INT, _FLOAT = "[+-]?[0-9]+", "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"


def _sql_int(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '{_INT}') THEN TRY_CAST(trim({c}) AS BIGINT) END"


def _sql_list(c: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({c}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


def _sql_params() -> str:
    rows = ", ".join(f"{sql} AS r_{name}" for name, sql in _PARAMS.items())
    plain = ", ".join(f"trim(coalesce(r_{c}, '')) AS {c}" for c in ("keyword", "experience", "source", "company"))
    edges = ", ".join(f"CASE WHEN has_viewport THEN nums[{i + 1}] ELSE 0.0 END AS {n}" for i, n in enumerate(spatial.BOX))
    return f"""WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders),
r AS (SELECT k, {rows} FROM o),
v AS (SELECT k, {plain}, {_sql_list('r_skills')} AS sk, {_sql_list('r_work_type')} AS wt, {_sql_int('r_salary_min')} AS salary_min,
    {_sql_int('r_salary_max')} AS salary_max, coalesce({_sql_int('r_limit')}, 0) AS row_limit, list_transform({_sql_list('r_bbox')},
    lambda x: CASE WHEN regexp_full_match(x, '{_FLOAT}') AND isfinite(TRY_CAST(x AS DOUBLE)) THEN TRY_CAST(x AS DOUBLE) END) AS nums FROM r),
w AS (SELECT *, len(nums) = 4 AND len(list_filter(nums, lambda x: x IS NOT NULL)) = 4 AS has_viewport FROM v)
SELECT k AS o_orderkey, keyword, experience, source, company, array_to_string(sk, '|') AS skills, array_to_string(wt, '|') AS work_type,
    salary_min, salary_max, row_limit, has_viewport, {edges},
    CAST(len(sk) + len(wt) + (keyword <> '')::INT + (experience <> '')::INT + (source <> '')::INT + (company <> '')::INT
         + (salary_min IS NOT NULL)::INT AS INT) AS n_active FROM w"""


@register("request_filters", _sql_params())
def q_request_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("p"))
    asked = o.select(F.col("k").alias("o_orderkey"), *[F.expr(sql).alias(name) for name, sql in _PARAMS.items()])
    lists = {c: F.array_join(c, "|") for c in ("skills", "work_type")}
    return coerce_requests(asked).withColumns(lists)


# -- whole responses (S16) --------------------------------------------------------------

_RESPONSE_PINS = PinFilter(work_types=("remote",), limit=50)


@register("pins_response", f"""SELECT CAST(to_json({{'count': count(*), 'pins': coalesce(list(p ORDER BY p.job_count DESC, p.office_id), [])}}) AS VARCHAR)
AS value FROM ({q_map._pin_sql("j.work_type IN ('remote')", 50)}) p""")
def q_pins_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pins(T.companies(spark, sf_dir), T.offices(spark, sf_dir), T.jobs(spark, sf_dir), _RESPONSE_PINS)
    return sinks.envelope(found, "pins", [-F.col("job_count"), F.col("office_id")], count=True)


@register("skills_response", f"""SELECT CAST(to_json({{'skills': coalesce(list(skill ORDER BY n DESC, skill), [])}}) AS VARCHAR) AS value
FROM ({ORACLES['skill_facets']}) s""")
def q_skills_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.envelope(facets.skill_facets(T.jobs(spark, sf_dir), 12), "skills", [-F.col("n"), F.col("skill")], "skill")


@register("companies_response", T.with_views("""SELECT '{"companies":[' || coalesce(string_agg(CASE WHEN logo_url IS NULL
    THEN to_json({'id': id, 'name': name}) ELSE to_json({'id': id, 'name': name, 'logo_url': logo_url}) END, ',' ORDER BY name, id), '')
    || ']}' AS value FROM (SELECT * FROM companies ORDER BY name, id LIMIT 15)""", "companies"))
def q_companies_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = facets.company_list(T.companies(spark, sf_dir), 15).select("id", "name", "logo_url")
    return sinks.envelope(listed, "companies", [F.col("name"), F.col("id")])


# -- many circles, many viewports ---------------------------------------------------------

@register("offices_near_each", T.with_views(f"""SELECT c_custkey, office_id, round(d, 3) AS distance_km FROM (
    SELECT c_custkey, o.id AS office_id, 100.0 + (c_custkey % 7) * 400.0 AS km, 2 * 6371.0088 * asin(least(1.0, sqrt(
        pow(sin((radians(o.lat) - radians(c.lat)) / 2), 2)
        + cos(radians(c.lat)) * cos(radians(o.lat)) * pow(sin((radians(o.lng) - radians(c.lng)) / 2), 2)))) AS d
    FROM offices o, (SELECT c_custkey, CAST((c_custkey * 37) % 161 AS DOUBLE) - 80.0 AS lat,
        CAST((c_custkey * 73) % 359 AS DOUBLE) - 179.0 AS lng FROM customer) c) WHERE d <= km""", "offices"))
def q_offices_near_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offices around every customer, each with a radius of its own (up to 2,500 km)."""
    key = F.col("c_custkey")
    centres = spread(T.read_table(spark, sf_dir, "customer")).select(
        "c_custkey", T.grid_lat(key).alias("centre_lat"), T.grid_lng(key).alias("centre_lng"), (100.0 + key % 7 * 400.0).alias("km"))
    offices = T.offices(spark, sf_dir).select(F.col("id").alias("office_id"), "lat", "lng")
    return spatial.within_radius(centres, offices).select("c_custkey", "office_id", GEO.round_km("distance_km").alias("distance_km"))


@register("pins_of_viewports", T.with_views(f"""WITH buckets AS ({ORACLES['viewport_buckets']}),
q AS (SELECT DISTINCT q_west, q_south, q_east, q_north, q_east - q_west >= 270 OR q_west < -180 OR q_east > 180 AS world FROM buckets),
b AS (SELECT q_west, q_south, q_east, q_north, CASE WHEN world THEN -180.0 ELSE greatest(q_west, -180.0) END AS w,
    CASE WHEN world THEN -85.0 ELSE greatest(q_south, -85.0) END AS s, CASE WHEN world THEN 180.0 ELSE least(q_east, 180.0) END AS e,
    CASE WHEN world THEN 85.0 ELSE least(q_north, 85.0) END AS n FROM q),
p AS (SELECT o.id AS office_id, o.lat, o.lng, count(*) AS job_count FROM offices o JOIN jobs j ON j.office_id = o.id GROUP BY ALL)
SELECT q_west, q_south, q_east, q_north, office_id, job_count,
    CAST(row_number() OVER (PARTITION BY q_west, q_south, q_east, q_north ORDER BY job_count DESC, office_id) AS INT) AS place
FROM b JOIN p ON p.lng BETWEEN b.w AND b.e AND p.lat BETWEEN b.s AND b.n QUALIFY place <= 3""", *_V3))
def q_pins_of_viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest pins of every bucket of viewports, all in one plan."""
    key = ["q_west", "q_south", "q_east", "q_north"]
    buckets = q_viewport_buckets(spark, sf_dir).select(*key).distinct()
    box = GEO.clamp_viewport_cols(*key)
    boxes = buckets.select(*key, *[box[c].alias(c) for c in spatial.BOX])
    counts = T.jobs(spark, sf_dir).groupBy("office_id").agg(F.count(F.lit(1)).alias("job_count"))
    offices = T.offices(spark, sf_dir).select(F.col("id").alias("office_id"), "lat", "lng").join(counts, "office_id")
    found = spatial.top_in_boxes(boxes, offices, key, [F.col("job_count").desc(), F.col("office_id")], 3)
    return found.select(*key, "office_id", "job_count", "place")
