"""Registered store queries: geocoding (J4, G1, G5), keyed upserts (K1-K5, J5, J8) and
self-posted jobs (F17, J7, K7).

The "current snapshot" and the "batch" are two overlapping ranges of the same
driver table (e.g. ``p_size <= 30`` and ``p_size >= 20``), so every run has new
keys, conflicting keys and untouched keys, and the whole table is processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import geocode as G
from ..operators import merge as M
from ..operators.dedup import first_per_key
from ..session import staged
from ..sources import tables as T
from . import sqltext as S
from .registry import register



def RUN_TS():  # noqa: N802 - the run's fixed "now"
    return F.lit("2025-01-01 00:00:00").cast("timestamp")

# -- geocoding ---------------------------------------------------------------------


def _geo_inputs(spark: SparkSession, sf_dir: str):
    c = T.read_table(spark, sf_dir, "customer")
    n = T.read_table(spark, sf_dir, "nation")
    s = T.read_table(spark, sf_dir, "supplier")
    rec = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise("").alias("city"),
        F.col("n_name").alias("country"))
    rec = G.with_location(rec)
    cache = n.where(F.col("n_regionkey") == 0).select(
        F.lower("n_name").alias("location_key"), F.col("n_nationkey").cast("double").alias("latitude"),
        (-F.col("n_nationkey")).cast("double").alias("longitude"))
    gaz = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        F.lower("n_name").alias("location_key"), T.grid_lat(F.col("s_suppkey")).alias("lat"),
        T.grid_lng(F.col("s_suppkey")).alias("lng"), F.col("s_suppkey").alias("rank"))
    return rec, cache, gaz


_GEO_SQL = f"""WITH rec AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE '' END AS city,
        n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT c_custkey, {S.location_key('city', 'country')} AS location_key,
        {S.geocode_display('city', 'country')} AS display FROM rec),
cache AS (SELECT lower(n_name) AS location_key, CAST(n_nationkey AS DOUBLE) AS lat,
        CAST(-n_nationkey AS DOUBLE) AS lng FROM nation WHERE n_regionkey = 0),
gz AS (SELECT lower(n_name) AS location_key,
        arg_min(CAST((s_suppkey * 37) % 161 AS DOUBLE) - 80.0, s_suppkey) AS lat,
        arg_min(CAST((s_suppkey * 73) % 359 AS DOUBLE) - 179.0, s_suppkey) AS lng
        FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
coords AS (SELECT location_key, lat, lng, 'cache' AS resolved_by FROM cache
        UNION ALL SELECT location_key, lat, lng, 'gazetteer' FROM gz
        WHERE location_key NOT IN (SELECT location_key FROM cache))
"""


@register("geocode_hits", _GEO_SQL + """SELECT r.c_custkey, r.location_key, c.lat, c.lng, c.resolved_by
FROM r JOIN coords c ON r.location_key = c.location_key""")
def q_geocode_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec, cache, gaz = _geo_inputs(spark, sf_dir)
    keys = staged(G.unique_keys(rec), "geocode-keys")
    placed = G.placed_of(G.locate(rec, G.coords_of(G.resolve(keys, cache, gaz))))
    return placed.select("c_custkey", "location_key", "lat", "lng", "resolved_by")


@register("geocode_misses", _GEO_SQL + """SELECT location_key, min(display) AS display, count(*) AS n_records
FROM r WHERE location_key NOT IN (SELECT location_key FROM coords) GROUP BY location_key""")
def q_geocode_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec, cache, gaz = _geo_inputs(spark, sf_dir)
    keys = staged(G.unique_keys(rec), "geocode-keys")
    return G.unresolved_of(G.resolve(keys, cache, gaz)).select("location_key", "display", "n_records")


# -- provider responses (G3) and cache merge (K4/G4) -----------------------------------

def _loc(lat: F.Column, lng: F.Column) -> F.Column:
    return F.struct(F.struct(F.struct(lat.alias("lat"), lng.alias("lng")).alias("location")).alias("geometry"))


GOOGLE_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE")


def provider_responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One landed geocoder response per customer name (three market segments asked
    the first provider, the other two the second), in five shapes per provider: no
    result, several results, a malformed first result, a refused request and a plain one."""
    c = T.read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lat, lng = T.grid_lat(k), T.grid_lng(k)
    v = k % 5
    first_provider = F.col("c_mktsegment").isin(*GOOGLE_SEGMENTS)
    key = F.lower("c_name").alias("location_key")
    loc_t = "struct<geometry:struct<location:struct<lat:double,lng:double>>>"
    no_geo = F.struct(F.lit(None).cast("struct<location:struct<lat:double,lng:double>>").alias("geometry"))
    results = (F.when(v == 0, F.array().cast(f"array<{loc_t}>"))
               .when(v == 1, F.array(_loc(lat, lng), _loc(lat + 1, lng + 1)))
               .when(v == 2, F.array(no_geo))
               .otherwise(F.array(_loc(lat, lng))))
    status = F.when(v == 0, "ZERO_RESULTS").when(v == 3, "OVER_QUERY_LIMIT").otherwise("OK")
    google = c.where(first_provider).select(key, F.to_json(F.struct(status.alias("status"),
                                                                results.alias("results"))).alias("value"))
    s = lambda x: x.cast("string")
    pt = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    nomi_v = (F.when(v == 0, F.lit("[]"))
              .when(v == 1, F.to_json(F.array(pt(s(lat), s(lng)), pt(F.lit("0"), F.lit("0")))))
              .when(v == 2, F.to_json(F.array(pt(F.lit("x"), F.lit("1")), pt(s(lat), s(lng)))))
              .when(v == 3, F.to_json(F.array(pt(F.concat(F.lit(" "), s(lat), F.lit("abc")),
                                                 F.concat(s(lng), F.lit("e1"))))))
              .otherwise(F.lit("<html>rate limited</html>")))
    nominatim = c.where(~first_provider).select(key, nomi_v.alias("value"))
    return google, nominatim


@register("geocode_provider", """WITH c AS (SELECT lower(c_name) AS location_key,
        CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'google' ELSE 'nominatim' END AS provider,
        c_custkey % 5 AS v, CAST((c_custkey * 37) % 161 AS DOUBLE) - 80.0 AS lat,
        CAST((c_custkey * 73) % 359 AS DOUBLE) - 179.0 AS lng FROM customer)
SELECT location_key, CASE WHEN provider = 'google' AND v = 2 THEN 0.0 ELSE lat END AS lat,
       CASE WHEN provider = 'google' AND v = 2 THEN 0.0 WHEN provider = 'nominatim' AND v = 3 THEN lng * 10
            ELSE lng END AS lng
FROM c WHERE (provider = 'google' AND v IN (1, 2, 4)) OR (provider = 'nominatim' AND v IN (1, 3))""")
def q_geocode_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    google, nominatim = provider_responses(spark, sf_dir)
    rows = G.provider_rows(google, "google").unionByName(G.provider_rows(nominatim, "nominatim"))
    return G.first_result(rows)


def _cache_frames(spark: SparkSession, sf_dir: str):
    c = T.read_table(spark, sf_dir, "customer")
    n = T.read_table(spark, sf_dir, "nation")
    cn = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lower("c_mktsegment"), F.lit("|"), F.lower("n_name"), F.lit("|"),
                 (F.col("c_custkey") % 20).cast("string")).alias("location_key"),
        "n_nationkey", "c_custkey", "c_acctbal")
    current = cn.where(F.col("c_acctbal") <= 5000).select(
        "location_key", F.col("n_nationkey").cast("double").alias("latitude"),
        (-F.col("n_nationkey")).cast("double").alias("longitude"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at")).distinct()
    batch = cn.where(F.col("c_acctbal") >= 2000).select(
        "location_key", T.grid_lat(F.col("c_custkey")).alias("latitude"),
        T.grid_lng(F.col("c_custkey")).alias("longitude"), F.col("c_custkey").alias("seq"))
    return current, batch


@register("upsert_cache", """WITH c AS (SELECT lower(c_mktsegment) || '|' || lower(n_name) || '|' || CAST(c_custkey % 20 AS VARCHAR) AS location_key,
        n_nationkey, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
old AS (SELECT DISTINCT location_key, CAST(n_nationkey AS DOUBLE) AS latitude,
        CAST(-n_nationkey AS DOUBLE) AS longitude FROM c WHERE c_acctbal <= 5000),
b AS (SELECT location_key, arg_max(CAST((c_custkey * 37) % 161 AS DOUBLE) - 80.0, c_custkey) AS latitude,
        arg_max(CAST((c_custkey * 73) % 359 AS DOUBLE) - 179.0, c_custkey) AS longitude
        FROM c WHERE c_acctbal >= 2000 GROUP BY location_key)
SELECT coalesce(b.location_key, old.location_key) AS location_key,
       CASE WHEN b.location_key IS NULL THEN old.latitude ELSE b.latitude END AS latitude,
       CASE WHEN b.location_key IS NULL THEN old.longitude ELSE b.longitude END AS longitude,
       old.location_key IS NULL AS is_new
FROM old FULL JOIN b ON old.location_key = b.location_key""")
def q_upsert_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, batch = _cache_frames(spark, sf_dir)
    out = M.upsert_cache(current, batch, RUN_TS(), "seq")
    return out.select("location_key", "latitude", "longitude", (F.col("created_at") == RUN_TS()).alias("is_new"))


# -- companies (K1) -------------------------------------------------------------------

def _company_frames(spark: SparkSession, sf_dir: str):
    p = T.read_table(spark, sf_dir, "part")
    current = (p.where(F.col("p_size") <= 30).select(F.col("p_brand").alias("name")).distinct()
               .select(F.xxhash64("name").alias("id"), "name", F.lit(None).cast("string").alias("website"),
                       F.concat(F.lit("old-"), F.col("name")).alias("logo_url"),
                       F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at")))
    batch = p.where(F.col("p_size") >= 20).select(
        F.concat(F.col("p_brand"), F.when(F.col("p_size") > 45, " Ltd").otherwise("")).alias("name"),
        F.lit("").alias("website"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(
            F.concat(F.lit("logo-"), F.col("p_partkey").cast("string"))).alias("logo_url"),
        F.col("p_partkey").alias("seq"))
    return current, batch


@register("upsert_companies", """WITH old AS (SELECT DISTINCT p_brand AS name, CAST(NULL AS VARCHAR) AS website,
        'old-' || p_brand AS logo_url FROM part WHERE p_size <= 30),
b AS (SELECT p_brand || CASE WHEN p_size > 45 THEN ' Ltd' ELSE '' END AS name,
        CASE WHEN p_size % 3 = 0 THEN '' ELSE 'logo-' || CAST(p_partkey AS VARCHAR) END AS logo,
        p_partkey AS seq FROM part WHERE p_size >= 20),
f AS (SELECT name, arg_max(logo, seq) FILTER (WHERE logo <> '') AS logo, count(*) AS n_batch FROM b GROUP BY name)
SELECT coalesce(old.name, f.name) AS name, old.website AS website, coalesce(f.logo, old.logo_url) AS logo_url,
       old.name IS NULL AS is_new, coalesce(f.n_batch, 0) AS n_batch
FROM old FULL JOIN f ON old.name = f.name""")
def q_upsert_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, batch = _company_frames(spark, sf_dir)
    return M.upsert_companies(current, batch, RUN_TS()).select("name", "website", "logo_url", "is_new", "n_batch")


# -- offices (K2) ---------------------------------------------------------------------

def _office_rows(c: DataFrame) -> DataFrame:
    return c.select(
        F.col("c_nationkey").cast("long").alias("company_id"),
        F.when(F.col("c_acctbal") < -500, "").otherwise(F.col("c_mktsegment")).alias("city"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(
            F.concat(F.lit("C"), F.col("c_nationkey").cast("string"))).alias("country"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("street "), F.col("c_custkey").cast("string")))
         .otherwise("").alias("address"),
        T.grid_lat(F.col("c_custkey")).alias("lat"), T.grid_lng(F.col("c_custkey")).alias("lng"),
        F.col("c_custkey").alias("seq"))


def _office_frames(spark: SparkSession, sf_dir: str):
    c = T.read_table(spark, sf_dir, "customer")
    old_rows = _office_rows(c.where(F.col("c_acctbal") <= 3000)).withColumn(
        "country", M.office_country(F.col("city"), F.col("country")))
    current = (first_per_key(old_rows, ["company_id", "city", "country"], ["seq"])
               .select(F.xxhash64("company_id", "city", "country").alias("id"), "company_id", "city", "country",
                       F.concat(F.lit("addr-"), F.col("seq").cast("string")).alias("address"), "lat", "lng",
                       F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at")))
    batch = _office_rows(c.where(F.col("c_acctbal") >= 1000))
    return current, batch


_OFFICE_ROWS_SQL = """SELECT CAST(c_nationkey AS BIGINT) AS company_id,
    CASE WHEN c_acctbal < -500 THEN '' ELSE c_mktsegment END AS city,
    CASE WHEN c_acctbal < -500 AND c_acctbal < 0 THEN 'Remote' WHEN c_acctbal < 0 THEN ''
         ELSE 'C' || CAST(c_nationkey AS VARCHAR) END AS country,
    CASE WHEN c_custkey % 4 = 0 THEN 'street ' || CAST(c_custkey AS VARCHAR) ELSE '' END AS address,
    CAST((c_custkey * 37) % 161 AS DOUBLE) - 80.0 AS lat, CAST((c_custkey * 73) % 359 AS DOUBLE) - 179.0 AS lng,
    c_custkey AS seq FROM customer"""


@register("upsert_offices", f"""WITH o AS ({_OFFICE_ROWS_SQL} WHERE c_acctbal <= 3000),
old AS (SELECT company_id, city, country, 'addr-' || CAST(min(seq) AS VARCHAR) AS address,
        arg_min(lat, seq) AS lat, arg_min(lng, seq) AS lng FROM o GROUP BY ALL),
b AS ({_OFFICE_ROWS_SQL} WHERE c_acctbal >= 1000),
f AS (SELECT company_id, city, country, arg_max(address, seq) FILTER (WHERE address <> '') AS address,
        arg_max(lat, seq) AS lat, arg_max(lng, seq) AS lng, count(*) AS n_batch FROM b GROUP BY ALL)
SELECT coalesce(old.company_id, f.company_id) AS company_id, coalesce(old.city, f.city) AS city,
       coalesce(old.country, f.country) AS country, coalesce(f.address, old.address) AS address,
       CASE WHEN f.company_id IS NOT NULL THEN f.lat ELSE old.lat END AS lat,
       CASE WHEN f.company_id IS NOT NULL THEN f.lng ELSE old.lng END AS lng,
       old.company_id IS NULL AS is_new, coalesce(f.n_batch, 0) AS n_batch
FROM old FULL JOIN f ON old.company_id = f.company_id AND old.city = f.city AND old.country = f.country""")
def q_upsert_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, batch = _office_frames(spark, sf_dir)
    return M.upsert_offices(current, batch, RUN_TS()).select(
        "company_id", "city", "country", "address", "lat", "lng", "is_new", "n_batch")


# -- jobs (K3, D2) ----------------------------------------------------------------------

def _job_rows(p: DataFrame, url_prefix: str, salary) -> DataFrame:
    sal = F.floor(F.col("p_retailprice") * 100).cast("int")
    lo, hi = salary(sal)
    return p.select(
        X.dedup_hash("p_brand", "p_name", "p_type", F.lit("")).alias("dedup_hash"),
        F.col("p_size").cast("long").alias("office_id"), F.col("p_name").alias("title"),
        F.split("p_name", " ").alias("skills"), F.lit("").alias("experience_level"),
        F.lit("onsite").alias("work_type"), F.lit("USD").alias("salary_currency"),
        F.lit(None).cast("date").alias("posted_date"), F.lit("remotive").alias("source"),
        lo.alias("salary_min"), hi.alias("salary_max"),
        F.concat(F.lit(url_prefix), F.col("p_partkey").cast("string")).alias("source_url"),
        F.col("p_partkey").alias("seq"))


def _job_frames(spark: SparkSession, sf_dir: str):
    p = T.read_table(spark, sf_dir, "part")
    old = _job_rows(p.where(F.col("p_size") <= 30), "u-old-", lambda s: (s, s + 1000))
    current = (first_per_key(old, "dedup_hash", ["seq"]).drop("seq")
               .withColumn("id", F.xxhash64("dedup_hash"))
               .withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
               .withColumn("updated_at", F.col("created_at")))
    batch = _job_rows(p.where(F.col("p_size") >= 20), "u-new-",
                      lambda s: (F.when(F.col("p_size") % 2 == 0, F.lit(None).cast("int")).otherwise(s + 7),
                                 F.when(F.col("p_size") % 2 == 0, F.lit(None).cast("int")).otherwise(s + 9)))
    return current, batch


_FP = S.fingerprint("p_brand", "p_name", "p_type", "''")


@register("upsert_jobs", f"""WITH o AS (SELECT {_FP} AS dedup_hash, p_partkey AS seq, p_name,
        CAST(floor(p_retailprice * 100) AS INTEGER) AS sal FROM part WHERE p_size <= 30),
old AS (SELECT dedup_hash, arg_min(p_name, seq) AS title, arg_min(sal, seq) AS salary_min,
        arg_min(sal + 1000, seq) AS salary_max, 'u-old-' || CAST(min(seq) AS VARCHAR) AS source_url
        FROM o GROUP BY dedup_hash),
b AS (SELECT {_FP} AS dedup_hash, p_partkey AS seq, p_name,
        CASE WHEN p_size % 2 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 100) AS INTEGER) + 7 END AS lo,
        CASE WHEN p_size % 2 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 100) AS INTEGER) + 9 END AS hi
        FROM part WHERE p_size >= 20),
f AS (SELECT dedup_hash, arg_min(p_name, seq) AS title, max(seq) AS last_seq, count(*) AS n_batch
        FROM b GROUP BY dedup_hash),
fl AS (SELECT f.*, b.lo, b.hi FROM f JOIN b ON b.dedup_hash = f.dedup_hash AND b.seq = f.last_seq)
SELECT coalesce(old.dedup_hash, fl.dedup_hash) AS dedup_hash, coalesce(old.title, fl.title) AS title,
       CASE WHEN fl.dedup_hash IS NOT NULL THEN fl.lo ELSE old.salary_min END AS salary_min,
       CASE WHEN fl.dedup_hash IS NOT NULL THEN fl.hi ELSE old.salary_max END AS salary_max,
       CASE WHEN fl.dedup_hash IS NOT NULL THEN 'u-new-' || CAST(fl.last_seq AS VARCHAR)
            ELSE old.source_url END AS source_url,
       old.dedup_hash IS NULL AS inserted, coalesce(fl.n_batch, 0) AS n_batch
FROM old FULL JOIN fl ON old.dedup_hash = fl.dedup_hash""")
def q_upsert_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, batch = _job_frames(spark, sf_dir)
    return M.upsert_jobs(current, batch, RUN_TS()).select(
        "dedup_hash", "title", "salary_min", "salary_max", "source_url", "inserted", "n_batch")


# -- deletes (K5, J5) --------------------------------------------------------------------

def _delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders ask to delete all their lines, claimed by the ordering customer's nation."""
    li = T.read_table(spark, sf_dir, "lineitem")
    o = T.read_table(spark, sf_dir, "orders")
    c = T.read_table(spark, sf_dir, "customer")
    req_orders = (o.where(F.col("o_orderstatus") == "F")
                  .join(c, o.o_custkey == c.c_custkey)
                  .select("o_orderkey", F.col("c_nationkey").alias("company_id")))
    return (li.select("l_orderkey", "l_linenumber", "l_partkey")
            .join(req_orders, li.l_orderkey == req_orders.o_orderkey)
            .select("l_orderkey", "l_linenumber", "l_partkey", "company_id"))


@register("delete_jobs", T.with_views("""SELECT j.l_orderkey, j.l_linenumber, j.l_partkey, j.office_id FROM jobs j
WHERE NOT EXISTS (SELECT 1 FROM offices o JOIN orders ON o_orderkey = j.l_orderkey AND o_orderstatus = 'F'
    JOIN customer ON c_custkey = o_custkey
    WHERE o.id = j.office_id AND o.company_id = c_nationkey)""", "offices", "jobs"))
def q_delete_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, offices = T.jobs(spark, sf_dir), T.offices(spark, sf_dir)
    remaining, _ = M.delete_jobs(jobs, offices, _delete_requests(spark, sf_dir),
                                 ("l_orderkey", "l_linenumber", "l_partkey"))
    return remaining.select("l_orderkey", "l_linenumber", "l_partkey", "office_id")


# -- self-posted jobs (F17, J7, K7) ----------------------------------------------------------

def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as job submissions: the ordering customer's nation claims the order's first supplier."""
    o = T.read_table(spark, sf_dir, "orders")
    c = T.read_table(spark, sf_dir, "customer")
    li = T.read_table(spark, sf_dir, "lineitem")
    first_office = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("office_id"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(first_office, o.o_orderkey == first_office.l_orderkey)
    pri = F.col("o_orderpriority")
    return j.select(
        F.col("o_orderkey").alias("sub_id"), F.col("c_nationkey").cast("long").alias("company_id"),
        "office_id",
        F.when(pri.startswith("5"), F.lit("  ")).otherwise(F.concat(F.lit(" "), pri, F.lit(" "))).alias("title"),
        F.array(F.lit(" SQL "), F.lit(""), F.lower(pri)).alias("skills"),
        F.lit(" Senior ").alias("experience_level"),
        F.when(F.col("o_orderstatus") == "F", " Remote ").when(F.col("o_orderstatus") == "O", "HYBRID")
         .otherwise("contract").alias("work_type"),
        F.floor(F.col("o_totalprice")).cast("int").alias("salary_min"),
        F.lit(None).cast("int").alias("salary_max"), F.lit(" usd ").alias("salary_currency"),
        F.lit(" https://example.org/job ").alias("source_url"))


@register("self_posted", T.with_views(f"""WITH sub AS (SELECT o_orderkey AS sub_id, CAST(c_nationkey AS BIGINT) AS company_id,
        m.office_id, CASE WHEN o_orderpriority LIKE '5%' THEN '  ' ELSE ' ' || o_orderpriority || ' ' END AS title,
        o_orderpriority AS pri, o_orderstatus AS st, CAST(floor(o_totalprice) AS INTEGER) AS salary_min
    FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN (SELECT l_orderkey, min(l_suppkey) AS office_id FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = o_orderkey),
j AS (SELECT sub.*, o.company_id AS o_company, o.city AS o_city, o.country AS o_country, c.name AS c_name
    FROM sub LEFT JOIN offices o ON o.id = sub.office_id LEFT JOIN companies c ON c.id = sub.company_id),
k AS (SELECT *, {S.utrim('title')} <> '' AND office_id <> 0 AS req,
    coalesce(o_company = company_id, false) AS owned FROM j)
SELECT sub_id, company_id, office_id, CASE WHEN req AND owned THEN 'accepted' ELSE 'rejected' END AS status,
    CASE WHEN NOT req THEN '{"title and office_id are required"}' WHEN NOT owned
         THEN '{"office does not belong to your company"}' END AS reason,
    {S.utrim('title')} AS clean_title,
    array_to_string(['sql', lower(pri)], '|') AS clean_skills, 'Senior' AS clean_experience,
    CASE st WHEN 'F' THEN 'remote' WHEN 'O' THEN 'hybrid' ELSE 'onsite' END AS clean_work_type,
    salary_min, CAST(NULL AS INTEGER) AS salary_max, 'USD' AS clean_currency,
    'https://example.org/job' AS clean_source_url, 'self-posted' AS source,
    CASE WHEN req AND owned THEN {S.fingerprint('c_name', 'title', 'o_city', 'o_country')} END AS dedup_hash
FROM k""", "companies", "offices"))
def q_self_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selfpost import self_posted
    out = self_posted(_submissions(spark, sf_dir), T.offices(spark, sf_dir), T.companies(spark, sf_dir))
    return out.withColumn("clean_skills", F.array_join("clean_skills", "|"))


# -- dashboard offices (K6) -------------------------------------------------------------------

@register("dashboard_offices", f"""WITH req AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS company_id,
        CASE WHEN c_acctbal < -900 THEN '' WHEN c_acctbal < 0 THEN c_mktsegment ELSE '' END AS city,
        CASE WHEN c_acctbal < -900 THEN '' ELSE n_name END AS country,
        'street ' || CAST(c_custkey AS VARCHAR) AS address,
        CASE WHEN c_acctbal > 5000 THEN CAST(c_custkey % 90 AS DOUBLE) END AS lat,
        CASE WHEN c_acctbal > 5000 THEN CAST(c_custkey % 180 AS DOUBLE) END AS lng
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
gz AS (SELECT lower(n_name) AS location_key,
        arg_min(CAST((s_suppkey * 37) % 161 AS DOUBLE) - 80.0, s_suppkey) AS lat,
        arg_min(CAST((s_suppkey * 73) % 359 AS DOUBLE) - 179.0, s_suppkey) AS lng
        FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
k AS (SELECT req.*, {S.location_key('city', 'country')} AS location_key,
        city <> '' OR country <> '' AS ok_loc, lat IS NOT NULL AND lng IS NOT NULL AS explicit FROM req),
r AS (SELECT k.*, CASE WHEN explicit THEN k.lat ELSE gz.lat END AS rlat,
        CASE WHEN explicit THEN k.lng ELSE gz.lng END AS rlng
    FROM k LEFT JOIN gz ON gz.location_key = k.location_key)
SELECT c_custkey, company_id, address, location_key, city, country,
    CASE WHEN ok_loc THEN rlat END AS lat, CASE WHEN ok_loc THEN rlng END AS lng,
    CASE WHEN NOT ok_loc THEN 'city or country is required'
         WHEN rlat IS NULL THEN 'could not geocode that location' END AS reason
FROM r""")
def q_dashboard_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selfpost import dashboard_offices
    c = T.read_table(spark, sf_dir, "customer")
    n = T.read_table(spark, sf_dir, "nation")
    bal = F.col("c_acctbal")
    req = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        "c_custkey", F.col("c_nationkey").cast("long").alias("company_id"),
        F.when(bal < -900, "").when(bal < 0, F.col("c_mktsegment")).otherwise("").alias("city"),
        F.when(bal < -900, "").otherwise(F.col("n_name")).alias("country"),
        F.concat(F.lit("street "), F.col("c_custkey").cast("string")).alias("address"),
        F.when(bal > 5000, (F.col("c_custkey") % 90).cast("double")).alias("lat"),
        F.when(bal > 5000, (F.col("c_custkey") % 180).cast("double")).alias("lng"))
    _, _, gaz = _geo_inputs(spark, sf_dir)
    return dashboard_offices(req, G.first_result(gaz))
