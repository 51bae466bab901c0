"""Registered end-to-end ingestion query (E2 + A6): two consecutive runs over the landed
feed payloads built from ``part``; the second run sees the first run's store, so
known fingerprints count as skipped.  The oracles restate both runs in SQL: the
metrics, and the content of the four tables that the runs leave."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shared_path, staged
from ..sources import feeds as FD
from ..sources import tables as T
from . import ingest as I
from . import sqltext as S
from .q_feeds import _ITEMS_SQL, _feed_body, _part_items, landed_payloads
from .registry import register

# One page of these feeds is replaced by an error text: a client-side feed fails every query, a
# server-side one once, a marketplace silently.
BROKEN_PAGE = {"remoteok": 1, "jooble": 2, "adzuna": 3}
RUN1_SOURCES = ("remoteok", "remotive", "arbeitnow")
SEARCH = ("bolt", "gear", "")


def part_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial gazetteer from ``part``: "name|type" keys of parts up to size 25, and type-only keys."""
    p = T.read_table(spark, sf_dir, "part")
    pair = p.where(F.col("p_size") <= 25).select(
        F.concat(F.lower("p_name"), F.lit("|"), F.lower("p_type")).alias("location_key"), "p_partkey")
    single = p.select(F.lower("p_type").alias("location_key"), "p_partkey")
    return pair.unionByName(single).select(
        "location_key", T.grid_lat(F.col("p_partkey")).alias("lat"), T.grid_lng(F.col("p_partkey")).alias("lng"),
        F.col("p_partkey").alias("rank"))


def landed(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """The payload pages of one feed, one page of some broken.

    Pages are dealt out to as many partitions as the session shuffles into (one per core at least): by its
    bytes a feed is small and would be written as one file, which a single task then parses and normalises."""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pages = landed_payloads(spark, sf_dir, source, _part_items(spark, sf_dir, parts))
    bad = F.col("page_ord") == F.lit(BROKEN_PAGE.get(source))
    return pages.withColumn("value", F.when(bad, F.lit("HTTP 502 Bad Gateway")).otherwise(F.col("value")))


def _accepted(source: str) -> str:
    """The oracle's rows of one feed without its broken page."""
    bad = BROKEN_PAGE.get(source)
    page = "page_ord" if source != "adzuna" else f"page_ord % {FD.ADZUNA_PAGE_SPAN}"
    return f"SELECT * FROM ({_feed_body(source)})" + (f" WHERE {page} <> {bad}" if bad is not None else "")


def _runs_ctes() -> str:
    """Both runs restated in SQL: feed rows (J6 keyword match, L4 caps), fingerprint fields
    (P1, P9, P10, P13), first per fingerprint (D1), gazetteer placement (G5), and the
    second run's inserted / skipped split against the first run's fingerprints (K3)."""
    assert all("|" not in t for t in SEARCH)   # keyword match on the '|'-joined tag list is exact
    q = "(VALUES " + ", ".join(f"({i}, {S.q(t)})" for i, t in enumerate(SEARCH)) + ") q(qo, kw)"
    client = " UNION ALL ".join(_accepted(s) for s in FD.CLIENT_FILTERED)
    per = FD.DEFAULT_PER_QUERY

    def norm(raw: str) -> str:
        c0, k0 = S.utrim("city"), S.utrim("country")
        fb = f"({c0} = '' AND {k0} = '' AND coalesce(location_raw, '') <> '')"
        tags = f"list_transform(CASE WHEN skills_raw = '' THEN [] ELSE string_split(skills_raw, '|') END, lambda x: {S.clean_tag('x')})"
        mined = f"list_transform({S.mined('low', 'toks', X.KNOWN_SKILLS)}, lambda x: {S.clean_tag('x')})"
        mark = "coalesce(" + ", ".join(
            f"nullif(regexp_extract({c}, {S.seniority_re(X.SENIORITY_ALTERNATIVES)}, 1), '')" for c in ("title", "experience_raw", "body")) + ")"
        return f"""(SELECT *, {S.fingerprint('co', 'ti', 'ci', 'cn')} AS h, {S.location_key('ci', 'cn')} AS lk,
            array_to_string({S.ordered_distinct('all_skills')}, '|') AS skills FROM (
            SELECT *, list_filter(list_concat({tags}, {mined}), lambda x: x <> '') AS all_skills FROM (
            SELECT *, string_split_regex(low, '[^a-z0-9+#.]+') AS toks FROM (
            SELECT *, {S.lower('body')} AS low, coalesce({S.canon_seniority(mark)}, '') AS xp,
                CASE WHEN contains(hay, 'hybrid') THEN 'hybrid' WHEN contains(hay, 'remote') OR contains(hay, 'work from home')
                    OR contains(hay, 'wfh') OR contains(hay, 'anywhere') THEN 'remote' ELSE 'onsite' END AS wt FROM (
            SELECT source, source_ord, query_ord, page_ord, pos, {S.collapse('company_name')} AS co, {S.collapse('title')} AS ti,
                title, experience_raw, skills_raw, {S.strip_html("coalesce(description, '')")} AS body,
                {S.lower("coalesce(work_type_raw, '') || ' ' || coalesce(location_raw, '') || ' ' || "
                         + S.strip_html("coalesce(description, '')"))} AS hay,
                {S.utrim("coalesce(company_logo, '')")} AS logo, nullif(salary_min, 0) AS lo, nullif(salary_max, 0) AS hi,
                upper({S.utrim("coalesce(salary_currency, '')")}) AS cur, coalesce(source_url, '') AS url,
                CASE WHEN posted_at LIKE '____-__-__T%' THEN substr(posted_at, 1, 10) WHEN posted_at LIKE '__.__.____'
                    THEN substr(posted_at, 7, 4) || '-' || substr(posted_at, 4, 2) || '-' || substr(posted_at, 1, 2) END AS day,
                CASE WHEN {fb} THEN {S.split_city('location_raw')} ELSE {c0} END AS ci,
                CASE WHEN {fb} THEN {S.split_country('location_raw')} ELSE {k0} END AS cn
            FROM {raw})))) WHERE co <> '' AND ti <> '')"""

    def first(n: str) -> str:
        return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h
            ORDER BY source_ord, query_ord, page_ord, pos) AS rn FROM {n}) WHERE rn = 1)"""

    return f"""WITH items AS ({_ITEMS_SQL}),
client AS (SELECT r.* REPLACE (q.qo AS query_ord) FROM ({client}) r JOIN {q}
    ON (q.kw = '' OR contains(lower(r.title), lower(q.kw)) OR contains(lower(coalesce(r.description, '')), lower(q.kw))
        OR contains(lower(r.skills_raw), lower(q.kw)))),
client_cap AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, query_ord
    ORDER BY page_ord, pos) AS rn FROM client) WHERE rn <= {per}),
jooble_cap AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, query_ord
    ORDER BY page_ord, pos) AS rn FROM ({_accepted('jooble')})) WHERE rn <= {per}),
raw1 AS (SELECT * FROM client_cap WHERE source IN ({", ".join(S.q(s) for s in RUN1_SOURCES if s in FD.CLIENT_FILTERED)})
    UNION ALL {_accepted('remotive')}),
raw2 AS (SELECT * FROM client_cap UNION ALL {_accepted('remotive')}
    UNION ALL {_accepted('adzuna')} UNION ALL SELECT * FROM jooble_cap),
gaz AS (SELECT lk, arg_min(CAST((k * 37) % 161 AS DOUBLE) - 80.0, k) AS lat, arg_min(CAST((k * 73) % 359 AS DOUBLE) - 179.0, k) AS lng
    FROM (SELECT lower(p_name) || '|' || lower(p_type) AS lk, p_partkey AS k FROM part WHERE p_size <= 25
          UNION ALL SELECT lower(p_type), p_partkey FROM part) GROUP BY lk),
d1 AS {first(norm('raw1'))},
d2 AS {first(norm('raw2'))},
p1 AS (SELECT * FROM d1 WHERE lk IN (SELECT lk FROM gaz)),
p2 AS (SELECT * FROM d2 WHERE lk IN (SELECT lk FROM gaz))"""


def _errors(run: int) -> str:
    """Pages that broke, times the queries that a client-side feed is pulled for."""
    pages = {x: f"(SELECT count(DISTINCT p_partkey // 50) FROM part WHERE p_partkey // 50 = {n})" for x, n in BROKEN_PAGE.items()}
    client = f"{len(SEARCH)} * {pages['remoteok']}"
    return client if run == 1 else f"{client} + {pages['jooble']}"


METRICS_SQL = _runs_ctes() + f"""
SELECT (SELECT count(*) FROM raw1) AS fetched, (SELECT count(*) FROM d1) AS after_dedup,
    (SELECT count(*) FROM p1) AS inserted, CAST(0 AS BIGINT) AS skipped,
    (SELECT count(*) FROM d1) - (SELECT count(*) FROM p1) AS geocode_fail, CAST({_errors(1)} AS BIGINT) AS errors, 1 AS run
UNION ALL
SELECT (SELECT count(*) FROM raw2), (SELECT count(*) FROM d2),
    (SELECT count(*) FROM p2 WHERE h NOT IN (SELECT h FROM p1)),
    (SELECT count(*) FROM p2 WHERE h IN (SELECT h FROM p1)),
    (SELECT count(*) FROM d2) - (SELECT count(*) FROM p2), CAST({_errors(2)} AS BIGINT), 2"""

TS1, TS2 = "2025-01-01 00:00:00", "2025-01-01 06:00:00"


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Run both pulls; the store's folder and the metrics of each run."""
    queries = FD.queries_frame(spark, SEARCH, FD.DEFAULT_PER_QUERY)
    gaz = part_gazetteer(spark, sf_dir)
    # land the payload pages once, as the feed pulls would have written them
    payloads = {s: staged(landed(spark, sf_dir, s), f"landed-{s}") for s in FD.SOURCE_ORDER}
    root = shared_path(spark, "stores", uuid.uuid4().hex)
    for n, (sources, ts) in enumerate(((RUN1_SOURCES, TS1), (FD.SOURCE_ORDER, TS2)), 1):
        raw, err = I.fetch({s: payloads[s] for s in sources}, queries)
        store = I.read_store(spark, root, n - 1) if n > 1 else I.empty_store(spark)
        touched, metrics, _ = I.run(raw, store, gaz, F.lit(ts).cast("timestamp"), err)
        I.write_run(touched, metrics, root, n, pull=n)
    return root, I.finished_runs(spark, root).select(*I.METRICS, F.col("run").cast("int").alias("run"))


@register("run_metrics", METRICS_SQL)
def q_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_runs(spark, sf_dir)[1]


# -- what both runs leave in the store ----------------------------------------------------
# Surrogate ids are free to differ; rows are named by their natural keys.

_LATEST = "arg_max(struct_pack(a := logo), struct_pack(s := run, a := source_ord, b := query_ord, c := page_ord, d := pos))"
_BOTH = "SELECT *, 1 AS run FROM p1 UNION ALL SELECT *, 2 FROM p2"
_OFFICE = "CASE WHEN ci = '' AND cn = '' THEN 'Remote' ELSE cn END"


def _when(run: str) -> str:
    return f"CASE WHEN {run} = 1 THEN TIMESTAMP '{TS1}' ELSE TIMESTAMP '{TS2}' END"


COMPANIES_SQL = _runs_ctes() + f"""
SELECT co AS name, CAST(NULL AS VARCHAR) AS website, ({_LATEST} FILTER (WHERE logo <> '')).a AS logo_url,
    {_when('min(run)')} AS created_at FROM ({_BOTH}) GROUP BY co"""

OFFICES_SQL = _runs_ctes() + f"""
SELECT co AS company, ci AS city, {_OFFICE} AS country, CAST(NULL AS VARCHAR) AS address,
    any_value(g.lat) AS lat, any_value(g.lng) AS lng, {_when('min(run)')} AS created_at
FROM ({_BOTH}) b JOIN gaz g ON g.lk = b.lk GROUP BY ALL"""

JOBS_SQL = _runs_ctes() + f"""
SELECT f.co AS company, f.ci AS city, {_OFFICE.replace('ci ', 'f.ci ').replace('cn ', 'f.cn ').replace('ELSE cn', 'ELSE f.cn')} AS country,
    f.ti AS title, f.skills, nullif(f.xp, '') AS experience_level, f.wt AS work_type, CAST(l.lo AS BIGINT) AS salary_min,
    CAST(l.hi AS BIGINT) AS salary_max, nullif(f.cur, '') AS salary_currency, f.day AS posted_date, f.source,
    nullif(l.url, '') AS source_url, f.h AS dedup_hash, {_when('f.run')} AS created_at, {_when('l.run')} AS updated_at
FROM (SELECT * FROM ({_BOTH}) QUALIFY row_number() OVER (PARTITION BY h ORDER BY run) = 1) f
JOIN (SELECT * FROM ({_BOTH}) QUALIFY row_number() OVER (PARTITION BY h ORDER BY run DESC) = 1) l ON l.h = f.h"""

CACHE_SQL = _runs_ctes() + f"""
SELECT g.lk AS location_key, g.lat AS latitude, g.lng AS longitude, {_when('min(run)')} AS created_at
FROM (SELECT lk, 1 AS run FROM d1 UNION ALL SELECT lk, 2 FROM d2) d JOIN gaz g ON g.lk = d.lk GROUP BY g.lk, g.lat, g.lng"""


def _store(spark: SparkSession, sf_dir: str) -> I.Store:
    return I.read_store(spark, two_runs(spark, sf_dir)[0])


@register("store_companies", COMPANIES_SQL)
def q_store_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).companies.drop("id")


@register("store_offices", OFFICES_SQL)
def q_store_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _store(spark, sf_dir)
    names = st.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return st.offices.join(names, "company_id").drop("company_id", "id")


@register("store_jobs", JOBS_SQL)
def q_store_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _store(spark, sf_dir)
    names = st.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    places = st.offices.join(names, "company_id").select(F.col("id").alias("office_id"), "company", "city", "country")
    return st.jobs.join(places, "office_id").drop("office_id", "id").withColumns({
        "skills": F.array_join("skills", "|"), "posted_date": F.col("posted_date").cast("string")})


@register("store_cache", CACHE_SQL)
def q_store_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).cache


@register("store_checks", f"""WITH j AS ({JOBS_SQL}), b AS (SELECT * FROM j UNION ALL SELECT * FROM j WHERE dedup_hash < '4')
SELECT 'jobs.dedup_hash unique' AS rule, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows
    FROM (SELECT dedup_hash, count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'jobs.id unique', count(*), CAST(sum(n) AS BIGINT)
    FROM (SELECT dedup_hash, count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'jobs.office_id -> offices.id', count(*), CAST(sum(n) AS BIGINT)
    FROM (SELECT company, city, country, count(*) AS n FROM b WHERE city = '' GROUP BY ALL)""")
def q_store_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1/Q2 on the declared keys and references of the store that both runs leave, with some jobs
    doubled and the offices without a city lost: only these violations are found."""
    from ..operators.quality import store_checks
    st = _store(spark, sf_dir)
    jobs = st.jobs.unionByName(st.jobs.where(F.col("dedup_hash") < "4"))
    found = store_checks(st.companies, st.offices.where(F.col("city") != ""), jobs, st.cache)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))
