"""Keyed upserts into snapshot tables with per-column conflict rules.

The row-at-a-time upserts of the original become: fold the batch per key in
sequence order, join the folded batch with the rows of the snapshot that it
touches, and choose every column by its rule.

Every fold is a hash aggregate of ``min``/``max`` over ``struct(seq, value)``,
so it is pre-aggregated on the map side (a hot key costs one row per task), and
the join sees at most one row per key on each side.

The snapshot is the whole history and a run's batch is small next to it.  The
folded batch is written once; if its files are small (measured bytes) its keys are
broadcast, so the snapshot is scanned and never shuffled.  Larger batches use
shuffled joins.  ``touched_*`` give only the rows that the batch touches (what a run
has to write); ``upsert_*`` the whole next snapshot: the untouched rows and those.

New surrogate ids continue after the snapshot's largest, one id per new row, so no
two rows can get the same; they are fixed when the touched rows are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import planned_bytes, staged

# Largest folded batch (bytes of its written files) whose keys are broadcast against the snapshot.
BROADCAST_BATCH_BYTES = 16 << 20


def _probe(batch: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The batch's keys, marked for broadcast if the batch's files are small."""
    k = batch.select(*keys)
    return F.broadcast(k) if limit > 0 and planned_bytes(batch) <= limit else k


def with_touched(cur: DataFrame, b: DataFrame, keys: Sequence[str], limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """Every row of the folded batch ``b`` (one per key, written) beside the row of ``cur`` it meets, if any."""
    known = cur.join(_probe(b, keys, limit), list(keys), "left_semi")
    return b.join(known, list(keys), "left")


def apply_touched(current: DataFrame, touched: DataFrame, keys: Sequence[str],
                  limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """The next snapshot: rows of ``current`` that the batch does not touch, and the touched ones (written)."""
    kept = current.join(_probe(touched, keys, limit), list(keys), "left_anti")
    return kept.unionByName(touched, allowMissingColumns=True)


def _new_id(current: DataFrame) -> Column:
    top = current.agg(F.max("id").alias("m")).first().m or 0
    return F.lit(max(int(top), 0) + 1).cast("long") + F.monotonically_increasing_id()


def _snapshot(current: DataFrame, touched: DataFrame, keys: Sequence[str], flag: str, limit: int) -> DataFrame:
    touched = staged(touched, "touched")
    rest = current.select(*[c for c in touched.columns if c not in (flag, "n_batch")],
                          F.lit(False).alias(flag), F.lit(0).cast("long").alias("n_batch"))
    return apply_touched(rest, touched, keys, limit)


def _last_nonblank(c: str, seq: str) -> Column:
    """Latest non-blank value of ``c`` by ``seq`` (NULL if every value is blank)."""
    v = F.col(c)
    return F.max(F.when(X.null_to_blank(v) != "", F.struct(F.col(seq).alias("s"), v.alias("v"))))["v"]


def _last(cols: Sequence[str], seq: str) -> Column:
    return F.max(F.struct(F.col(seq).alias("_s"), *[F.col(c) for c in cols]))


def _first(cols: Sequence[str], seq: str) -> Column:
    return F.min(F.struct(F.col(seq).alias("_s"), *[F.col(c) for c in cols]))


COMPANY_KEY = ("name",)
OFFICE_KEY = ("company_id", "city", "country")
JOB_KEY = ("dedup_hash",)
CACHE_KEY = ("location_key",)


def touched_companies(current: DataFrame, batch: DataFrame, run_ts: Column, seq: str = "seq",
                      limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """K1: key ``name``; website/logo: latest non-blank from the batch, else kept.

    ``current``: id, name, website, logo_url, created_at.  ``batch``: name, website, logo_url, seq.
    Result: the rows touched, with ``is_new`` and ``n_batch`` (batch rows for the key).
    """
    b = staged(batch.groupBy("name").agg(_last_nonblank("website", seq).alias("b_website"),
                                              _last_nonblank("logo_url", seq).alias("b_logo"),
                                              F.count(F.lit(1)).alias("n_batch")), "batch")
    j = with_touched(current.select("id", "name", "website", "logo_url", "created_at"), b, COMPANY_KEY, limit)
    return j.select(
        F.coalesce(F.col("id"), _new_id(current)).alias("id"), "name",
        F.coalesce(F.col("b_website"), X.blank_to_null(F.col("website"))).alias("website"),
        F.coalesce(F.col("b_logo"), X.blank_to_null(F.col("logo_url"))).alias("logo_url"),
        F.coalesce(F.col("created_at"), run_ts).alias("created_at"),
        F.col("id").isNull().alias("is_new"), "n_batch")


def upsert_companies(current: DataFrame, batch: DataFrame, run_ts: Column, seq: str = "seq",
                     limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """K1, the whole next snapshot (see :func:`touched_companies`)."""
    return _snapshot(current, touched_companies(current, batch, run_ts, seq, limit), COMPANY_KEY, "is_new", limit)


def office_country(city: Column, country: Column) -> Column:
    """K2 insert rule: an office with neither city nor country is the "Remote" office."""
    return F.when((X.null_to_blank(city) == "") & (X.null_to_blank(country) == ""), F.lit("Remote")) \
        .otherwise(X.null_to_blank(country))


def touched_offices(current: DataFrame, batch: DataFrame, run_ts: Column, seq: str = "seq",
                    limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """K2: key (company_id, city, country); address: latest non-blank else kept; location: latest."""
    bb = batch.withColumn("country", office_country(F.col("city"), F.col("country"))) \
              .withColumn("city", X.null_to_blank(F.col("city")))
    b = staged(bb.groupBy(*OFFICE_KEY).agg(
        _last_nonblank("address", seq).alias("b_address"), _last(["lat", "lng"], seq).alias("_loc"),
        F.count(F.lit(1)).alias("n_batch")), "batch")
    j = with_touched(current.select("id", *OFFICE_KEY, "address", "created_at"), b, OFFICE_KEY, limit)
    return j.select(
        F.coalesce(F.col("id"), _new_id(current)).alias("id"), *OFFICE_KEY,
        F.coalesce(F.col("b_address"), X.blank_to_null(F.col("address"))).alias("address"),
        F.col("_loc.lat").alias("lat"), F.col("_loc.lng").alias("lng"),
        F.coalesce(F.col("created_at"), run_ts).alias("created_at"),
        F.col("id").isNull().alias("is_new"), "n_batch")


def upsert_offices(current: DataFrame, batch: DataFrame, run_ts: Column, seq: str = "seq",
                   limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """K2, the whole next snapshot (see :func:`touched_offices`)."""
    return _snapshot(current, touched_offices(current, batch, run_ts, seq, limit), OFFICE_KEY, "is_new", limit)


JOB_INSERT_COLUMNS = ("office_id", "title", "skills", "experience_level", "work_type", "salary_currency",
                      "posted_date", "source")
JOB_UPDATE_COLUMNS = ("salary_min", "salary_max", "source_url")


# Blank values of these are stored as NULL.
JOB_NULL_COLUMNS = ("experience_level", "salary_currency", "source_url")


def touched_jobs(current: DataFrame, batch: DataFrame, run_ts: Column, seq: str = "seq",
                 insert_cols: Sequence[str] = JOB_INSERT_COLUMNS, update_cols: Sequence[str] = JOB_UPDATE_COLUMNS,
                 limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """K3: key ``dedup_hash``.

    A known key keeps every column from first sight except ``salary_min``,
    ``salary_max`` and ``source_url``, which the latest batch row replaces (NULL
    included), and ``updated_at``.  Within one batch the first row inserts and
    later rows update.  ``inserted`` is true for keys new to the table;
    ``n_batch`` - 1 (or ``n_batch`` for known keys) counts the "already seen" rows.
    """
    blank = [c for c in JOB_NULL_COLUMNS if c in (*insert_cols, *update_cols)]
    b = staged(batch.withColumns({c: X.blank_to_null(c) for c in blank}).groupBy("dedup_hash").agg(
        _first(insert_cols, seq).alias("_ins"), _last(update_cols, seq).alias("_upd"),
        F.count(F.lit(1)).alias("n_batch")), "batch")
    j = with_touched(current.select("id", "dedup_hash", *insert_cols, "created_at"), b, JOB_KEY, limit)
    known = F.col("id").isNotNull()
    cols = [F.coalesce(F.col("id"), _new_id(current)).alias("id"), F.col("dedup_hash")]
    cols += [F.when(known, F.col(c)).otherwise(F.col(f"_ins.{c}")).alias(c) for c in insert_cols]
    cols += [F.col(f"_upd.{c}").alias(c) for c in update_cols]
    cols += [F.when(known, F.col("created_at")).otherwise(run_ts).alias("created_at"), run_ts.alias("updated_at"),
             (~known).alias("inserted"), F.col("n_batch")]
    return j.select(*cols)


def upsert_jobs(current: DataFrame, batch: DataFrame, run_ts: Column, seq: str = "seq",
                insert_cols: Sequence[str] = JOB_INSERT_COLUMNS, update_cols: Sequence[str] = JOB_UPDATE_COLUMNS,
                limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """K3, the whole next snapshot (see :func:`touched_jobs`)."""
    touched = touched_jobs(current, batch, run_ts, seq, insert_cols, update_cols, limit)
    return _snapshot(current, touched, JOB_KEY, "inserted", limit)


def touched_cache(current: DataFrame, batch: DataFrame, run_ts: Column, seq: str | None = None,
                  limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """Key ``location_key``; latitude/longitude replaced (last write wins)."""
    last = F.max(F.struct("latitude", "longitude")) if seq is None else _last(["latitude", "longitude"], seq)
    b = staged(batch.groupBy("location_key").agg(last.alias("_c")), "batch")
    j = with_touched(current.select("location_key", "created_at"), b, CACHE_KEY, limit)
    return j.select("location_key", F.col("_c.latitude").alias("latitude"), F.col("_c.longitude").alias("longitude"),
                    F.coalesce(F.col("created_at"), run_ts).alias("created_at"))


def upsert_cache(current: DataFrame, batch: DataFrame, run_ts: Column, seq: str | None = None,
                 limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """K4, the whole next snapshot (see :func:`touched_cache`)."""
    touched = staged(touched_cache(current, batch, run_ts, seq, limit), "touched")
    return apply_touched(current.select(*touched.columns), touched, CACHE_KEY, limit)


def delete_jobs(jobs: DataFrame, offices: DataFrame, requests: DataFrame,
                job_key: Sequence[str] = ("id",),
                limit: int = BROADCAST_BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """Delete requested jobs whose office belongs to the requesting company.

    ``requests``: job key columns + ``company_id``.  Returns (remaining jobs,
    requests that matched nothing -> "not found or not yours").  The requested
    jobs are picked out of the table first, so the ownership check only joins them.
    The requests are written once; while their files are small (measured bytes) their
    keys are broadcast and the jobs table is only scanned.
    """
    keys = list(job_key)
    req = staged(requests, "delete-requests")
    asked = jobs.select(*keys, "office_id").join(_probe(req, keys, limit), keys, "left_semi")
    owned = staged(
        asked.join(offices.select(F.col("id").alias("office_id"), F.col("company_id")), "office_id")
        .join(req.select(*keys, "company_id"), keys + ["company_id"], "left_semi").select(*keys).distinct(), "deleted")
    return jobs.join(_probe(owned, keys, limit), keys, "left_anti"), req.join(owned, keys, "left_anti")


def inserted_or_existing(batch_keys: DataFrame, table_keys: DataFrame, key: str) -> DataFrame:
    """Flag each batch key as new (not yet in the table) or existing."""
    existing = table_keys.select(key).distinct().withColumn("_e", F.lit(True))
    return batch_keys.join(existing, key, "left").select(
        key, F.col("_e").isNull().alias("inserted"))
