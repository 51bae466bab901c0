"""Vectors for filters, keyed merges, geo helpers and display labels (FIXTURES.md part C)."""

from pyspark.sql import functions as F

from jobatlas.functions import geo as GEO
from jobatlas.functions import text as X
from jobatlas.operators import merge as M
from jobatlas.operators.pins import PinFilter
from jobatlas.sources import feeds as FD

TS = "2025-01-01 00:00:00"


def test_salary_floor_and_skills_filters(spark):
    jobs = spark.createDataFrame([(1, None, None, ["go", "sql", "aws"]), (2, None, 50000, ["go"]),
                                  (3, None, 49999, ["go", "sql"])],
                                 "id int, salary_min int, salary_max int, skills array<string>")
    f = PinFilter(salary_min=50000)
    assert sorted(r.id for r in jobs.where(f.job_predicates()[0]).collect()) == [1, 2]
    f2 = PinFilter(skills=(" Go ", "SQL "))
    assert sorted(r.id for r in jobs.where(f2.job_predicates()[0]).collect()) == [1, 3]


def test_pin_filter_from_params():
    f = PinFilter.from_params({"bbox": "1,2,3,4", "skills": " go, ,sql ", "salary_min": "x", "limit": "10"})
    assert f.has_viewport and (f.min_lng, f.min_lat, f.max_lng, f.max_lat) == (1.0, 2.0, 3.0, 4.0)
    assert f.skills == ("go", "sql") and f.salary_min is None and f.limit == 10 and f.edges == "geodesic"
    loose = PinFilter.from_params({"bbox": "1_0,2,3,4", "salary_min": "1_000", "limit": "٣", "salary_max": "+7"})
    assert (loose.has_viewport, loose.salary_min, loose.limit, loose.salary_max) == (False, None, 0, 7)
    assert PinFilter.from_params({"bbox": "1e1,-.5,3.,4", "limit": "9" * 30}).min_lng == 10.0
    assert not PinFilter.from_params({"bbox": "1,2,3"}).has_viewport
    assert PinFilter(keyword="a", salary_max=5).active_count() == 1
    assert PinFilter().effective_limit() == 2000


def test_company_merge_keeps_latest_nonblank_logo(spark):
    cur = spark.createDataFrame([(1, "Acme", None, "a", None)], "id bigint, name string, website string, "
                                "logo_url string, created_at timestamp")
    batch = spark.createDataFrame([("Acme", "", "", 1), ("Acme", "", "b", 2), ("Acme", "", "", 3)],
                                  "name string, website string, logo_url string, seq int")
    (r,) = M.upsert_companies(cur, batch, F.lit(TS).cast("timestamp")).collect()
    assert (r.id, r.logo_url, r.is_new, r.n_batch) == (1, "b", False, 3)


def test_job_merge_rules(spark):
    cur = spark.createDataFrame(
        [(7, "h", 1, "T", ["x"], "", "onsite", "USD", None, "remotive", 10, 20, "u1", None, None)],
        "id bigint, dedup_hash string, office_id bigint, title string, skills array<string>, "
        "experience_level string, work_type string, salary_currency string, posted_date date, source string, "
        "salary_min int, salary_max int, source_url string, created_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame(
        [("h", 9, "t", ["y"], "senior", "remote", "EUR", None, "adzuna", None, None, "u2", 1),
         ("n", 9, "new", ["y"], "", "remote", "", None, "adzuna", 5, 6, "u3", 2)],
        "dedup_hash string, office_id bigint, title string, skills array<string>, experience_level string, "
        "work_type string, salary_currency string, posted_date date, source string, salary_min int, "
        "salary_max int, source_url string, seq int")
    out = {r.dedup_hash: r for r in M.upsert_jobs(cur, batch, F.lit(TS).cast("timestamp")).collect()}
    h = out["h"]
    assert (h.title, h.salary_min, h.salary_max, h.source_url, h.inserted, h.office_id) == \
        ("T", None, None, "u2", False, 1)
    assert out["n"].inserted and out["n"].title == "new"


def test_office_merge_remote_country(spark):
    cur = spark.createDataFrame([], "id bigint, company_id bigint, city string, country string, address string, "
                                "lat double, lng double, created_at timestamp")
    batch = spark.createDataFrame([(1, "", "", "", 1.0, 2.0, 1), (1, "", "", "x st", 3.0, 4.0, 2)],
                                  "company_id bigint, city string, country string, address string, lat double, "
                                  "lng double, seq int")
    (r,) = M.upsert_offices(cur, batch, F.lit(TS).cast("timestamp")).collect()
    assert (r.country, r.address, r.lat, r.lng, r.n_batch) == ("Remote", "x st", 3.0, 4.0, 2)


def test_badges_and_tiers(spark):
    df = spark.createDataFrame([(999,), (1500,), (12000,), (2500000,), (1250,), (9999,), (25,), (100,)], "n long")
    got = [(r[0], r[1]) for r in df.select(X.cluster_badge("n"), X.cluster_tier("n")).collect()]
    assert [g[0] for g in got] == ["999", "1.5k", "12k", "2.5M", "1.3k", "10.0k", "25", "100"]
    assert [g[1] for g in got] == [2, 2, 2, 2, 2, 2, 1, 2]


def test_salary_label(spark):
    df = spark.createDataFrame([("USD", 50000, 80000), ("", None, 900), (None, 0, 0), ("EUR", 1499, None)],
                               "c string, lo int, hi int")
    got = [r[0] for r in df.select(X.salary_label("lo", "hi", "c")).collect()]
    assert got == ["USD 50k–80k", "900", "", "EUR 1k"]


def test_viewport_clamp_and_quantise(spark):
    assert GEO.clamp_viewport(-200, -10, 150, 20) == GEO.WORLD_BOX
    assert GEO.clamp_viewport(-10, -90, 20, 90) == (-10, -85.0, 20, 85.0)
    df = spark.createDataFrame([(12.34,), (-0.25,), (1.05,), (2.0,)], "x double")
    assert [r[0] for r in df.select(GEO.quantise("x")).collect()] == [12.3, -0.3, 1.1, 2.0]


def test_adzuna_helpers(spark):
    df = spark.createDataFrame([(["India", "Karnataka", "Bengaluru"], "x", "IT Jobs", "gb"),
                                (["India"], "x", "  ", "ca"), ([], "Pune, India", "Sales", "zz")],
                               "area array<string>, d string, label string, cc string")
    got = df.select(FD.adzuna_location(F.col("area"), F.col("d")).alias("l"),
                    FD.split_category(F.col("label")).alias("c"),
                    FD.currency_for_country(F.col("cc")).alias("cur")).collect()
    assert [(r.l.city, r.l.country) for r in got] == [("Bengaluru", "India"), ("", "India"), ("Pune", "India")]
    assert [r.c for r in got] == [["IT"], [], ["Sales"]]
    assert [r.cur for r in got] == ["GBP", "USD", ""]


def test_haversine_and_radius_box(spark):
    df = spark.createDataFrame([(52.52, 13.405, 48.8566, 2.3522)], "a double, b double, c double, d double")
    km = df.select(GEO.haversine_km("a", "b", "c", "d")).first()[0]
    assert 870 < km < 885
    lo_lng, lo_lat, hi_lng, hi_lat = GEO.radius_box(52.52, 13.405, 900)
    assert lo_lat < 48.8566 < hi_lat and lo_lng < 2.3522 < hi_lng
