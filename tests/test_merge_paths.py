"""The broadcast-batch merge equals the shuffled full outer join for every keyed upsert."""

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from jobatlas.operators import merge as M
from jobatlas.plans import q_store as QS


def _bag(df):
    from collections import Counter
    df = df.drop("id")  # new ids only have to be distinct
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("frames, upsert", [
    (QS._company_frames, M.upsert_companies),
    (QS._office_frames, M.upsert_offices),
    (QS._job_frames, M.upsert_jobs),
    (QS._cache_frames, M.upsert_cache),
])
def test_broadcast_merge_equals_full_outer_join(spark, frames, upsert):
    current, batch = frames(spark, SMOKE)
    ts = QS.RUN_TS()
    via_broadcast = upsert(current, batch, ts, "seq", limit=1 << 30)
    via_shuffle = upsert(current, batch, ts, "seq", limit=0)
    assert via_broadcast.columns == via_shuffle.columns
    a, b = _bag(via_broadcast), _bag(via_shuffle)
    assert a == b and sum(a.values()) > 0


def test_broadcast_merge_does_not_shuffle_the_snapshot(spark):
    current, batch = QS._job_frames(spark, SMOKE)
    plan = M.upsert_jobs(current, batch, QS.RUN_TS(), "seq")._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_delete_jobs_ownership(spark, limit):
    """Only the owner's delete removes a job; foreign and unknown ids come back as not found."""
    jobs = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 20, "c")], "id long, office_id long, title string")
    offices = spark.createDataFrame([(10, 100), (20, 200)], "id long, company_id long")
    requests = spark.createDataFrame([(1, 100), (3, 100), (9, 100)], "id long, company_id long")
    remaining, not_found = M.delete_jobs(jobs, offices, requests, limit=limit)
    assert sorted(r.id for r in remaining.collect()) == [2, 3]
    assert sorted(r.id for r in not_found.collect()) == [3, 9]


def test_new_ids_are_distinct_and_continue(spark):
    ts = QS.RUN_TS()
    batch = spark.range(0, 500, 1, 7).selectExpr("concat('c', id) AS name", "'' AS website", "'' AS logo_url", "id AS seq")
    empty = spark.createDataFrame([], "id long, name string, website string, logo_url string, created_at timestamp")
    first = M.upsert_companies(empty, batch.where("seq < 300"), ts).drop("is_new", "n_batch")
    second = M.upsert_companies(first, batch.where("seq >= 200"), ts)
    a = {r.name: r.id for r in first.collect()}
    b = {r.name: r.id for r in second.collect()}
    assert len(b) == 500 == len(set(b.values())) and all(b[n] == i for n, i in a.items())
    assert min(i for n, i in b.items() if n not in a) > max(a.values())


def test_blank_job_fields_are_stored_as_null(spark):
    current, batch = QS._job_frames(spark, SMOKE)
    blank = batch.withColumns({c: F.lit("") for c in ("experience_level", "salary_currency", "source_url")})
    new = M.upsert_jobs(current.limit(0), blank, QS.RUN_TS()).collect()
    assert new and all(r.experience_level is r.salary_currency is r.source_url is None for r in new)
    met = [r for r in M.upsert_jobs(current, blank, QS.RUN_TS()).collect() if r.n_batch and not r.inserted]
    assert met and all(r.source_url is None and r.salary_currency == "USD" for r in met)
