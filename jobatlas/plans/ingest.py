"""One ingestion run as a batch plan (E2) with its run metrics.

    payloads --adapters (S1-S6)--> raw  (client-side feeds: x queries (J6), capped per query (L4))
    raw --normalise (P17)--> drop incomplete (F9) --> first per fingerprint (D1)
        --> checkpoint (shared storage: cuts lineage, survives executor loss)
    distinct location keys --> cache / gazetteer (G1-G2) --> place records (G5)
    companies (K1) --> offices (K2) --> jobs (K3); new cache rows (K4)

Shuffles: D1 (fingerprint), G1 (location key), K1-K3 (their keys).  Every
keyed step is a partial aggregation, so hot keys are collapsed per task first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import geocode as G
from ..operators import merge as M
from ..operators.dedup import dedup_batch
from ..operators.normalize import drop_incomplete, normalize
from ..schemas import COMPANIES_DDL, GEOCODE_CACHE_DDL, JOBS_DDL, OFFICES_DDL, SEQ_COLUMNS
from ..session import observed_stage, staged
from ..sources import feeds as FD


METRICS = ("fetched", "after_dedup", "inserted", "skipped", "geocode_fail", "errors")


@dataclass
class Store:
    companies: DataFrame
    offices: DataFrame
    jobs: DataFrame
    cache: DataFrame


def empty_store(spark: SparkSession) -> Store:
    def e(ddl: str) -> DataFrame:
        return spark.createDataFrame([], ddl)
    return Store(e(COMPANIES_DDL), e(OFFICES_DDL), e(JOBS_DDL), e(GEOCODE_CACHE_DDL))


def fetch(payloads: dict[str, DataFrame], queries: DataFrame,
          per_page: int = FD.DEFAULT_PER_QUERY) -> tuple[DataFrame, DataFrame]:
    """All enabled sources -> (raw rows, payload errors).

    Feeds searched client-side run every query and keep the first rows per query up
    to its cap; jooble's payloads (searched server-side) are capped by their own
    query's cap.  A query's ``per_page`` of 0 means the run's ``per_page``; a
    negative one means no cap.  Caps hold within one pull: the payloads must be of
    one (:func:`jobatlas.streaming.incremental.ingest_stream` runs them one by one).
    A rejected payload counts as ``times`` run errors (``FD.run_errors``)."""
    frames, errors = {}, []
    # each query's own cap, the run's default where it has none (0)
    caps = FD.query_caps(queries, per_page)
    bound, asked = FD.largest_cap(caps), FD.search(caps)
    n_queries = queries.count()
    for s in FD.SOURCE_ORDER:
        if s not in payloads:
            continue
        raw = FD.ADAPTERS[s](payloads[s])
        if s in FD.CLIENT_FILTERED:
            raw = FD.cap_per_query(FD.apply_queries(raw, asked), max_per_page=bound)
        elif s == "jooble":
            raw = FD.cap_per_query(FD.with_query_caps(raw, caps, per_page), max_per_page=bound)
        frames[s] = raw
        errors.append(FD.run_errors(payloads[s], s, n_queries))
    return FD.union_sources(frames), reduce(DataFrame.unionByName, errors)


def _seq() -> Column:
    return F.struct(*[F.col(c) for c in SEQ_COLUMNS])


def run(raw: DataFrame, store: Store, gazetteer: DataFrame, run_ts: Column,
        errors: DataFrame | None = None, dictionary=X.KNOWN_SKILLS) -> tuple[Store, DataFrame, DataFrame]:
    """Returns (rows of each table that the run touches, one-row metrics, unresolved location keys).

    The history is read to find what the batch meets and never written: :func:`apply`
    puts the touched rows over it, :func:`write_run` stores them alone.

    Every stage that several later stages read -- raw rows, the deduplicated batch,
    located records and each table's touched rows -- is written once as a Parquet
    table in the shared checkpoint folder, so no stage is recomputed, new ids are fixed,
    and a lost executor only costs the current stage.  The metrics are observed while these
    tables are written: no job scans a table to count it.
    """
    ck, one = staged, F.lit(1)
    raw, n_raw = observed_stage(raw, "raw", fetched=one)
    norm = drop_incomplete(normalize(raw, dictionary)).withColumn("seq", _seq()).drop(*SEQ_COLUMNS)
    deduped, n_deduped = observed_stage(dedup_batch(norm, "dedup_hash", ["seq"]), "deduped", after_dedup=one)
    recs = deduped.withColumn("display", X.geocode_display("city", "country"))
    resolved = ck(G.resolve(G.unique_keys(recs), store.cache, gazetteer), "resolved")
    coords, unresolved, new_cache = G.coords_of(resolved), G.unresolved_of(resolved), G.new_cache_of(resolved)
    located, n_located = observed_stage(G.locate(recs, coords), "located", geocode_fail=F.col("resolved_by").isNull().cast("int"))
    placed = G.placed_of(located)

    companies = ck(M.touched_companies(
        store.companies,
        placed.select(F.col("company_name").alias("name"), F.lit("").alias("website"),
                      F.col("company_logo").alias("logo_url"), "seq"),
        run_ts, "seq"), "companies")
    with_company = placed.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")),
                               "company_name")
    offices = ck(M.touched_offices(
        store.offices,
        with_company.select("company_id", "city", "country", F.lit("").alias("address"), "lat", "lng", "seq"),
        run_ts, "seq"), "offices")
    office_ids = offices.select(
        F.col("id").alias("office_id"), "company_id", "city", F.col("country").alias("_office_country"))
    job_rows = (with_company.withColumn("_office_country", M.office_country(F.col("city"), F.col("country")))
                .join(office_ids, ["company_id", "city", "_office_country"]))
    new = F.col("inserted").cast("long")
    jobs, n_jobs = observed_stage(M.touched_jobs(store.jobs, job_rows, run_ts, "seq"), "jobs",
                                  inserted=new, skipped=F.col("n_batch") - new)
    cache = ck(M.touched_cache(store.cache, new_cache, run_ts), "cache")
    n_errors = {"errors": 0} if errors is None else observed_stage(errors, "errors", errors=F.col("times"))[1]
    counted = {**n_raw, **n_deduped, **n_jobs, **n_located, **n_errors}
    metrics = raw.sparkSession.createDataFrame([tuple(counted[c] for c in METRICS)], ", ".join(f"{c} long" for c in METRICS))
    touched = Store(companies.drop("is_new", "n_batch"), offices.drop("is_new", "n_batch"),
                    jobs.drop("inserted", "n_batch"), cache)
    return touched, metrics, unresolved


def apply(store: Store, touched: Store) -> Store:
    """The store after a run: every table's untouched rows and the rows that the run touched."""
    return Store(**{t: M.apply_touched(getattr(store, t), getattr(touched, t), k) for t, (_, k) in TABLES.items()})


def write_store(store: Store, path: str, layouts: bool = True) -> None:
    """Write a store snapshot version (companies, offices, jobs, geocode_cache) as parquet.

    With ``layouts`` the map tables get the layouts that stand in for the original's
    indexes: offices clustered by latitude band and longitude (viewport filters prune
    row groups), jobs partitioned by work type and sorted by office id."""
    from . import layout as L
    store.companies.write.mode("overwrite").parquet(f"{path}/companies")
    if layouts:
        L.write_offices_clustered(store.offices, f"{path}/offices")
        L.write_jobs_by_work_type(store.jobs, f"{path}/jobs")
    else:
        store.offices.write.mode("overwrite").parquet(f"{path}/offices")
        store.jobs.write.mode("overwrite").parquet(f"{path}/jobs")
    store.cache.write.mode("overwrite").parquet(f"{path}/geocode_cache")


def read_tables(spark: SparkSession, path: str) -> Store:
    """The tables of one folder that :func:`write_store` wrote."""
    return Store(*(spark.read.schema(ddl).parquet(f"{path}/{t}") for t, ddl in (
        ("companies", COMPANIES_DDL), ("offices", OFFICES_DDL), ("jobs", JOBS_DDL), ("geocode_cache", GEOCODE_CACHE_DDL))))


# -- the store: append-only tables, one folder per run ---------------------------------------

#: ``<root>/<table>/run=<n>``: the rows that run n touched.
TABLES = {"companies": (COMPANIES_DDL, M.COMPANY_KEY), "offices": (OFFICES_DDL, M.OFFICE_KEY), "jobs": (JOBS_DDL, M.JOB_KEY),
          "cache": (GEOCODE_CACHE_DDL, M.CACHE_KEY)}
RUNS_DDL = "stream string, batch_id long, pull long, " + ", ".join(f"{c} long" for c in METRICS)


def _runs_of(spark: SparkSession, root: str, table: str, ddl: str) -> DataFrame:
    """A table's rows with their run; empty if no run wrote it yet.  Any other failure is raised: a folder that
    cannot be read must not pass for an empty one."""
    ddl += ", run long"
    try:
        return spark.read.schema(ddl).parquet(f"{root}/{table}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], ddl)
        raise


def finished_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished run: where it came from and its metrics."""
    return _runs_of(spark, root, "runs", RUNS_DDL)


def last_run(spark: SparkSession, root: str) -> int:
    return finished_runs(spark, root).agg(F.max("run")).first()[0] or 0


def write_run(touched: Store, metrics: DataFrame, root: str, run: int, stream: str = "", batch_id: int = 0, pull: int = 0) -> None:
    """Append a run's touched rows, then its row among the finished runs.  A run that stopped before that row is not read
    by anyone, and is written anew, over what it left, when it is tried again."""
    for t in TABLES:
        getattr(touched, t).write.mode("overwrite").parquet(f"{root}/{t}/run={run}")
    metrics.select(F.lit(stream).alias("stream"), F.lit(batch_id).cast("long").alias("batch_id"), F.lit(pull).cast("long").alias("pull"),
                   *METRICS).coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/run={run}")


def read_store(spark: SparkSession, root: str, run: int | None = None) -> Store:
    """The store after a run (default: the last finished one): of every key the row that the newest run wrote.

    The fold is a partial aggregate per key; later filters and semi-joins on the key go below it."""
    run = last_run(spark, root) if run is None else run

    def newest(table: str) -> DataFrame:
        ddl, keys = TABLES[table]
        rows = _runs_of(spark, root, table, ddl).where(F.col("run") <= run)
        names = [c for c in rows.columns if c != "run"]
        rest = [c for c in names if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "run").alias("_row"))
        return last.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in names])

    return Store(**{t: newest(t) for t in TABLES})
