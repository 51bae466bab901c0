"""Registered clustering and display-projection queries.

Cluster points are the whole ``customer`` table (deterministic lat/lng spread of
the key), weighted by their number of orders -- the driver's offices never share
a cell, customers do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as GEO
from ..functions import text as X
from ..operators import cluster as C
from ..operators.pins import PinFilter, pins
from ..sources import tables as T
from .registry import register

_V3 = ("companies", "offices", "jobs")


def _points(spark: SparkSession, sf_dir: str, weight: str = "count") -> DataFrame:
    c = T.read_table(spark, sf_dir, "customer")
    o = T.read_table(spark, sf_dir, "orders")
    if weight == "lines":
        li, k = T.read_table(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 7 + F.col("l_linenumber")
        return li.select(k.alias("c_custkey"), T.grid_lat(k).alias("lat"), T.grid_lng(k).alias("lng"),
                         F.floor("l_extendedprice").cast("long").alias("job_count"))
    if weight == "count":
        w = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("w"))
    else:
        w = o.groupBy("o_custkey").agg(F.floor(F.sum("o_totalprice")).cast("long").alias("w"))
    return (c.join(w, c.c_custkey == w.o_custkey, "left")
            .select("c_custkey", T.grid_lat(F.col("c_custkey")).alias("lat"),
                    T.grid_lng(F.col("c_custkey")).alias("lng"),
                    F.coalesce(F.col("w"), F.lit(0)).cast("long").alias("job_count")))


def _points_sql(weight: str = "count") -> str:
    agg = "count(*)" if weight == "count" else "CAST(floor(sum(o_totalprice)) AS BIGINT)"
    rows = ("(SELECT l_orderkey * 7 + l_linenumber AS c_custkey, floor(l_extendedprice) AS w FROM lineitem)" if weight == "lines" else
            f"customer LEFT JOIN (SELECT o_custkey, {agg} AS w FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
    return f"""pts AS (SELECT c_custkey, CAST((c_custkey * 37) % 161 AS DOUBLE) - 80.0 AS lat,
        CAST((c_custkey * 73) % 359 AS DOUBLE) - 179.0 AS lng, CAST(coalesce(w, 0) AS BIGINT) AS w
    FROM {rows}),
px AS (SELECT c_custkey, CAST(zoom AS INTEGER) AS zoom, w,
        (lng + 180.0) / 360.0 * (512.0 * pow(2.0, zoom)) AS x,
        (1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * (512.0 * pow(2.0, zoom)) AS y
    FROM pts, range({{zmin}}, {{zmax}}) t(zoom)),
cells AS (SELECT zoom, CAST(floor(x / 48.0) AS BIGINT) AS cx, CAST(floor(y / 48.0) AS BIGINT) AS cy,
        count(*) AS point_count, CAST(sum(w) AS BIGINT) AS job_sum, avg(x) AS x, avg(y) AS y
    FROM px GROUP BY ALL)"""


def _psql(weight: str, zmin: int, zmax: int) -> str:
    return _points_sql(weight).replace("{zmin}", str(zmin)).replace("{zmax}", str(zmax + 1))


@register("cluster_grid", f"""WITH {_psql('count', 1, 1)}
SELECT zoom, cx, cy, point_count, job_sum, round(x, 3) AS x, round(y, 3) AS y FROM cells""")
def q_cluster_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.grid_clusters(_points(spark, sf_dir), 1)
    return g.select(F.col("zoom").cast("int").alias("zoom"), "cx", "cy", "point_count", "job_sum",
                    F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@register("cluster_pyramid", f"""WITH {_psql('count', 1, 12)}
SELECT zoom, cx, cy, point_count, job_sum FROM cells""")
def q_cluster_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.grid_pyramid(_points(spark, sf_dir))
    return g.select(F.col("zoom").cast("int").alias("zoom"), "cx", "cy", "point_count", "job_sum")


@register("cluster_expansion", f"""WITH {_psql('count', 1, 12)},
pz AS (SELECT c_custkey, zoom, CAST(floor(x / 48.0) AS BIGINT) AS cx, CAST(floor(y / 48.0) AS BIGINT) AS cy FROM px),
pairs AS (SELECT a.zoom, a.cx, a.cy, b.zoom AS dz, count(DISTINCT (b.cx, b.cy)) AS n_sub
    FROM pz a JOIN pz b ON a.c_custkey = b.c_custkey AND b.zoom > a.zoom GROUP BY ALL),
split AS (SELECT zoom, cx, cy, min(dz) AS split_zoom FROM pairs WHERE n_sub >= 2 GROUP BY ALL)
SELECT m.zoom, m.cx, m.cy, m.point_count, CAST(coalesce(s.split_zoom, 13) AS INTEGER) AS expansion_zoom
FROM cells m LEFT JOIN split s ON s.zoom = m.zoom AND s.cx = m.cx AND s.cy = m.cy
WHERE m.point_count >= 2""")
def q_cluster_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.expansion_zoom(C.grid_pyramid(_points(spark, sf_dir), spans=True))
    return e.select(F.col("zoom").cast("int").alias("zoom"), "cx", "cy", "point_count",
                    F.col("expansion_zoom").cast("int").alias("expansion_zoom"))


def _badge_sql(s: str) -> str:
    t6, t3 = f"(({s} + 50000) // 100000)", f"(({s} + 50) // 100)"
    return (f"CASE WHEN {s} >= 1000000 THEN CAST({t6} // 10 AS VARCHAR) || '.' || CAST({t6} % 10 AS VARCHAR) || 'M' "
            f"WHEN {s} >= 10000 THEN CAST(({s} + 500) // 1000 AS VARCHAR) || 'k' "
            f"WHEN {s} >= 1000 THEN CAST({t3} // 10 AS VARCHAR) || '.' || CAST({t3} % 10 AS VARCHAR) || 'k' "
            f"ELSE CAST({s} AS VARCHAR) END")


@register("cluster_labels", f"""WITH {_psql('lines', 1, 12)}
SELECT zoom, cx, cy, point_count, job_sum, {_badge_sql('job_sum')} AS badge,
    CASE WHEN point_count >= 100 THEN 2 WHEN point_count >= 25 THEN 1 ELSE 0 END AS tier,
    point_count >= 2 AS is_cluster, point_count = 1 AND job_sum > 1 AS show_badge FROM cells""")
def q_cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lineitem rows as points: enough of them for every tier
    g = C.grid_pyramid(_points(spark, sf_dir, "lines"))
    return C.cluster_labels(g).select(F.col("zoom").cast("int").alias("zoom"), "cx", "cy", "point_count",
                                      "job_sum", "badge", "tier", "is_cluster", "show_badge")


def _k_sql(n: str) -> str:
    return f"(CASE WHEN {n} >= 1000 THEN CAST(({n} + 500) // 1000 AS VARCHAR) || 'k' ELSE CAST({n} AS VARCHAR) END)"


_LO, _HI = "nullif(salary_min, 0)", "nullif(salary_max, 0)"
_CUR = "(CASE WHEN coalesce(salary_currency, '') <> '' THEN salary_currency || ' ' ELSE '' END)"


@register("salary_label", T.with_views(f"""SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN {_LO} IS NULL AND {_HI} IS NULL THEN ''
         WHEN {_LO} IS NOT NULL AND {_HI} IS NOT NULL THEN {_CUR} || {_k_sql(_LO)} || '–' || {_k_sql(_HI)}
         ELSE {_CUR} || {_k_sql(f'coalesce({_LO}, {_HI})')} END AS salary_label,
    array_to_string(skills[1:6], '|') AS card_skills
FROM jobs""", "jobs"))
def q_salary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = T.jobs(spark, sf_dir)
    return j.select("l_orderkey", "l_linenumber", "l_partkey",
                    X.salary_label("salary_min", "salary_max", "salary_currency").alias("salary_label"),
                    F.array_join(X.top_skills("skills", 6), "|").alias("card_skills"))


@register("viewport_buckets", """WITH v AS (SELECT o_orderkey, o_totalprice / 997.0 - 200.0 AS west,
        o_totalprice / 3001.0 - 95.0 AS south FROM orders),
w AS (SELECT o_orderkey, west, south, west + CAST(o_orderkey % 400 AS DOUBLE) AS east, south + 20.0 AS north
      FROM v),
c AS (SELECT *, east - west >= 270 OR west < -180 OR east > 180 AS world FROM w)
SELECT o_orderkey,
    CASE WHEN world THEN -180.0 ELSE greatest(west, -180.0) END AS min_lng,
    CASE WHEN world THEN -85.0 ELSE greatest(south, -85.0) END AS min_lat,
    CASE WHEN world THEN 180.0 ELSE least(east, 180.0) END AS max_lng,
    CASE WHEN world THEN 85.0 ELSE least(north, 85.0) END AS max_lat,
    round(west, 1) AS q_west, round(south, 1) AS q_south, round(east, 1) AS q_east, round(north, 1) AS q_north
FROM c""")
def q_viewport_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read_table(spark, sf_dir, "orders")
    v = o.select("o_orderkey", (F.col("o_totalprice") / 997.0 - 200.0).alias("west"),
                 (F.col("o_totalprice") / 3001.0 - 95.0).alias("south"),
                 (F.col("o_orderkey") % 400).cast("double").alias("span"))
    v = v.select("o_orderkey", "west", "south", (F.col("west") + F.col("span")).alias("east"),
                 (F.col("south") + 20.0).alias("north"))
    box = GEO.clamp_viewport_cols("west", "south", "east", "north")
    return v.select("o_orderkey", box["min_lng"].alias("min_lng"), box["min_lat"].alias("min_lat"),
                    box["max_lng"].alias("max_lng"), box["max_lat"].alias("max_lat"),
                    GEO.quantise("west").alias("q_west"), GEO.quantise("south").alias("q_south"),
                    GEO.quantise("east").alias("q_east"), GEO.quantise("north").alias("q_north"))


@register("office_labels", T.with_views("""SELECT o.id AS office_id,
    concat_ws(', ', nullif(o.city, ''), nullif(o.country, '')) AS label, upper(substr(c.name, 1, 1)) AS initial
FROM offices o JOIN companies c ON c.id = o.company_id""", "companies", "offices"))
def q_office_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = T.offices(spark, sf_dir), T.companies(spark, sf_dir)
    j = o.join(c, o.company_id == c.id)
    return j.select(o.id.alias("office_id"), X.office_label(o.city, o.country).alias("label"),
                    X.company_initial(c.name).alias("initial"))


@register("geojson_features", T.with_views("""WITH p AS (SELECT o.id AS office_id, o.lat, o.lng, o.city, o.country,
        c.name AS company_name, COUNT(*) AS job_count
    FROM offices o JOIN companies c ON c.id = o.company_id JOIN jobs j ON j.office_id = o.id
    GROUP BY o.id, o.lat, o.lng, o.city, o.country, c.name)
SELECT office_id, to_json({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [lng, lat]},
    'properties': {'office_id': office_id, 'company': company_name, 'city': city, 'country': country,
                   'job_count': job_count}})::VARCHAR AS feature FROM p""", *_V3))
def q_geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pins(T.companies(spark, sf_dir), T.offices(spark, sf_dir), T.jobs(spark, sf_dir), PinFilter(),
             limit=False)
    return C.geojson_features(p)


NEAR = (48.8566, 2.3522, 3000.0)   # lat, lng, km


@register("offices_near", T.with_views(f"""SELECT office_id, round(km, 3) AS distance_km FROM (
    SELECT id AS office_id, 2 * 6371.0088 * asin(least(1.0, sqrt(
        pow(sin((radians(lat) - radians({NEAR[0]})) / 2), 2)
        + cos(radians({NEAR[0]})) * cos(radians(lat)) * pow(sin((radians(lng) - radians({NEAR[1]})) / 2), 2)))) AS km
    FROM offices) WHERE km <= {NEAR[2]}""", "offices"))
def q_offices_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offices within a radius, box pre-filter (pushable) then exact great-circle distance."""
    o = T.offices(spark, sf_dir)
    lo_lng, lo_lat, hi_lng, hi_lat = GEO.radius_box(NEAR[0], NEAR[1], NEAR[2])
    box = GEO.in_viewport(o.lat, o.lng, lo_lng, lo_lat, hi_lng, hi_lat)
    d = GEO.haversine_km(F.lit(NEAR[0]), F.lit(NEAR[1]), o.lat, o.lng)
    return (o.where(box).select(o.id.alias("office_id"), d.alias("km"))
            .where(F.col("km") <= NEAR[2]).select("office_id", F.round("km", 3).alias("distance_km")))
