"""An ingestion run over hand-written landed payloads, checked against counts derived by hand."""

import json

from pyspark.sql import functions as F

from jobatlas.plans import ingest as I
from jobatlas.sources import feeds as FD

REMOTEOK = json.dumps([
    {"legal": "Terms of use"},
    {"id": "1", "company": "Acme", "position": "Engineer", "location": "Berlin, Germany", "tags": ["Go"],
     "description": "<b>Go</b> and docker", "salary_min": "90000.0", "date": "2024-01-05T00:00:00Z"},
    {"id": "2", "company": "acme", "position": "engineer", "location": "berlin, germany"},
    {"id": "3", "company": "X", "position": "   "},
    {"id": "4", "company": "Globex", "position": "Designer", "location": "Remote"},
])
JOOBLE = json.dumps({"jobs": [
    {"id": 10, "company": "Acme", "title": "Engineer", "location": "Berlin, Germany", "updated": "05.01.2024"},
    {"id": 11, "company": "Initech", "title": "Analyst", "location": "Paris, France", "type": "Hybrid"},
]})


def _run_twice(spark):
    payloads = {"remoteok": spark.createDataFrame([(REMOTEOK,)], "value string"),
                "jooble": spark.createDataFrame([(JOOBLE,), ("not json",)], "value string")}
    gaz = spark.createDataFrame([("berlin|germany", 52.5, 13.4, 0), ("paris|france", 48.9, 2.35, 0)],
                                "location_key string, lat double, lng double, rank int")
    queries = FD.queries_frame(spark, [""], 100)
    raw, err = I.fetch(payloads, queries)
    touched, m1, unresolved = I.run(raw, I.empty_store(spark), gaz, F.lit("2025-01-01").cast("timestamp"), err)
    store1 = I.apply(I.empty_store(spark), touched)
    raw2, err2 = I.fetch(payloads, queries)
    _, m2, _ = I.run(raw2, store1, gaz, F.lit("2025-01-02").cast("timestamp"), err2)
    return store1, m1.first(), m2.first(), unresolved


def test_two_runs(spark):
    store1, m1, m2, unresolved = _run_twice(spark)
    assert (m1.fetched, m1.after_dedup, m1.inserted, m1.skipped, m1.geocode_fail, m1.errors) == (5, 3, 2, 0, 1, 1)
    assert (m2.inserted, m2.skipped) == (0, 2)
    assert [r.location_key for r in unresolved.collect()] == ["remote"]
    jobs = {r.title: r for r in store1.jobs.collect()}
    assert set(jobs) == {"Engineer", "Analyst"}
    assert jobs["Engineer"].source == "remoteok"           # first occurrence in feed order wins
    assert jobs["Engineer"].salary_min == 90000
    assert jobs["Engineer"].skills == ["go", "docker"]
    assert jobs["Analyst"].work_type == "hybrid"
    assert str(jobs["Engineer"].posted_date) == "2024-01-05"
    assert {r.name for r in store1.companies.collect()} == {"Acme", "Initech"}
    assert store1.offices.count() == 2


def test_map_queries_over_ingested_store(spark):
    from jobatlas.operators import facets
    from jobatlas.operators.pins import PinFilter, office_detail, order_detail, pins
    store1, _, _, _ = _run_twice(spark)
    p = {r.company_name: r.job_count for r in pins(store1.companies, store1.offices, store1.jobs).collect()}
    assert p == {"Acme": 1, "Initech": 1}
    near_berlin = PinFilter(has_viewport=True, min_lng=10, min_lat=50, max_lng=15, max_lat=55)
    assert [r.company_name for r in pins(store1.companies, store1.offices, store1.jobs, near_berlin).collect()] \
        == ["Acme"]
    st = facets.stats(store1.companies, store1.offices, store1.jobs).first()
    assert (st.companies, st.offices, st.jobs, st.remote_jobs) == (2, 2, 2, 1)
    sk = {r.skill: r.n for r in facets.skill_facets(store1.jobs).collect()}
    assert sk == {"go": 1, "docker": 1}
    d = office_detail(store1.companies, store1.offices, store1.jobs, PinFilter(keyword="analyst"))
    got = order_detail(d).collect()
    assert sorted((r.company_name, r.title, r.job_count, r.address) for r in got) == [
        ("Acme", None, 0, ""), ("Initech", "Analyst", 1, "")]
    assert {"id", "source_url", "created_at", "updated_at", "company_logo"} <= set(d.columns)


def test_store_integrity_after_two_runs(spark):
    from jobatlas.operators.quality import store_checks
    store1, _, _, _ = _run_twice(spark)
    assert store_checks(store1.companies, store1.offices, store1.jobs, store1.cache).count() == 0
    broken = store1.jobs.unionByName(store1.jobs.limit(1))
    bad = store_checks(store1.companies, store1.offices, broken, store1.cache).collect()
    assert {r.rule for r in bad} == {"jobs.dedup_hash unique", "jobs.id unique"}


def test_per_query_caps(spark):
    """A query's own cap wins; 0 means the run's default; a negative cap means none.
    Jooble (searched server-side) is capped by the query its payload answered."""
    payloads = {"remoteok": spark.createDataFrame([(REMOTEOK,)], "value string"),
                "jooble": spark.createDataFrame([(JOOBLE, 0)], "value string, query_ord int")}
    queries = spark.createDataFrame([(0, "", 1), (1, "", 0), (2, "", -1)],
                                    "query_ord int, keywords string, per_page int")
    raw, _ = I.fetch(payloads, queries, per_page=2)
    got = {(r.source, r.query_ord): r.n for r in raw.groupBy("source", "query_ord").count()
           .withColumnRenamed("count", "n").collect()}
    assert got == {("remoteok", 0): 1, ("remoteok", 1): 2, ("remoteok", 2): 3, ("jooble", 0): 1}


def test_failed_marketplace_is_not_a_run_error(spark):
    """A bad adzuna payload is skipped silently; a bad jooble payload is a run error."""
    payloads = {"adzuna": spark.createDataFrame([("not json", "gb")], "value string, country string"),
                "jooble": spark.createDataFrame([("not json",)], "value string")}
    _, err = I.fetch(payloads, FD.queries_frame(spark, [""], 100))
    assert {r.source: r.times for r in err.collect()} == {"adzuna": 0, "jooble": 1}


def test_a_rejected_payload_gives_no_items_and_an_error_per_query(spark):
    """One object in place of a list of them: nothing is read from it, and every query of the feed fails."""
    one = json.dumps({"id": "1", "company": "Acme", "position": "Engineer", "location": "Berlin"})
    raw, err = I.fetch({"remoteok": spark.createDataFrame([(one,), (REMOTEOK,)], "value string")},
                       FD.queries_frame(spark, ["", "x", "y"], 100))
    assert {r.source_id for r in raw.collect()} == {"1", "2", "4"} and raw.where("company_name = 'Acme'").count() == 1
    assert [(r.reason, r.times) for r in err.collect()] == [(FD.PAYLOAD_WRONG_SHAPE, 3)]


def test_null_items_are_rows_without_fields(spark):
    raw = FD.jooble(spark.createDataFrame([('{"jobs": [null, {"company": "A", "title": "B", "id": 1}]}',)], "value string"))
    assert sorted((r.pos, r.title) for r in raw.collect()) == [(0, ""), (1, "B")]


def test_written_store_uses_layouts_and_reads_back(spark):
    import glob
    import tempfile
    store1, _, _, _ = _run_twice(spark)
    path = tempfile.mkdtemp(prefix="store-") + "/v1"
    I.write_store(store1, path)
    back = I.read_tables(spark, path)
    assert glob.glob(f"{path}/jobs/work_type=*")
    assert back.jobs.count() == store1.jobs.count() and back.offices.count() == store1.offices.count()
    assert {r.title: r.work_type for r in back.jobs.collect()} == \
        {r.title: r.work_type for r in store1.jobs.collect()}


def test_missing_numeric_id_reads_as_zero(spark):
    """Feeds with numeric ids (remotive, jobicy, jooble) give "0" for an item without one."""
    payload = json.dumps({"jobs": [{"company": "Acme", "title": "Engineer"}]})
    raw = FD.jooble(spark.createDataFrame([(payload,)], "value string"))
    assert [r.source_id for r in raw.collect()] == ["0"]


def test_uncapped_feed_needs_no_window(spark):
    raw = FD.remoteok(spark.createDataFrame([(REMOTEOK,)], "value string"))
    out = FD.cap_per_query(raw, -1)
    assert out.count() == raw.count() == 3
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
