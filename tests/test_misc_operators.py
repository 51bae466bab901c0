"""Smaller operators: provider payloads (G3), cache merge (K4), J8, sinks (S15, S16), Q3 defaults."""

import json
import tempfile

from pyspark.sql import functions as F

from jobatlas.operators import cluster as C
from jobatlas.operators import geocode as G
from jobatlas.operators import merge as M
from jobatlas.operators import quality as Q
from jobatlas.sources import sinks


def test_provider_rows(spark):
    google = json.dumps({"status": "OK", "results": [{"geometry": {"location": {"lat": 12.97, "lng": 77.59}}},
                                                     {"geometry": {"location": {"lat": 1.0, "lng": 2.0}}}]})
    nomi = json.dumps([{"lat": "52.52", "lon": "13.40"}, {"lat": "x", "lon": "1"}])
    g = G.provider_rows(spark.createDataFrame([("bengaluru|india", google)], "location_key string, value string"),
                        "google")
    n = G.provider_rows(spark.createDataFrame([("berlin", nomi), ("nowhere", "[]")], "location_key string, value string"),
                        "nominatim")
    best = {r.location_key: (r.lat, r.lng) for r in G.first_result(g.unionByName(n)).collect()}
    assert best == {"bengaluru|india": (12.97, 77.59), "berlin": (52.52, 13.40)}


def test_cache_merge_last_write_wins(spark):
    cur = spark.createDataFrame([("berlin", 1.0, 1.0, None)], "location_key string, latitude double, "
                                "longitude double, created_at timestamp")
    new = spark.createDataFrame([("berlin", 2.0, 2.0, 1), ("berlin", 3.0, 3.0, 2), ("paris", 4.0, 4.0, 1)],
                                "location_key string, latitude double, longitude double, seq int")
    out = {r.location_key: (r.latitude, r.longitude) for r in
           M.upsert_cache(cur, new, F.lit("2025-01-01").cast("timestamp"), "seq").collect()}
    assert out == {"berlin": (3.0, 3.0), "paris": (4.0, 4.0)}


def test_inserted_or_existing(spark):
    batch = spark.createDataFrame([("a",), ("b",)], "k string")
    table = spark.createDataFrame([("b",), ("b",)], "k string")
    got = {r.k: r.inserted for r in M.inserted_or_existing(batch, table, "k").collect()}
    assert got == {"a": True, "b": False}


def test_sinks_drop_fingerprint_and_geojson(spark):
    df = spark.createDataFrame([(1, 2.5, 3.5, "Acme", "Berlin", "Germany", 4, "h")],
                               "office_id long, lat double, lng double, company_name string, city string, "
                               "country string, job_count long, dedup_hash string")
    assert "dedup_hash" not in sinks.public_projection(df).columns
    out = tempfile.mkdtemp(prefix="sink-") + "/r"
    sinks.write_json_results(df, out)
    assert "dedup_hash" not in spark.read.json(out).columns
    feat = json.loads(C.geojson_features(df).first().feature)
    assert feat["geometry"] == {"type": "Point", "coordinates": [3.5, 2.5]}
    assert feat["properties"]["company"] == "Acme" and feat["properties"]["job_count"] == 4


def test_defaults_and_domain(spark):
    jobs = spark.createDataFrame([(1, "T", None, None, 1, 5), (2, None, ["a"], "freelance", 1, None)],
                                 "office_id int, title string, skills array<string>, work_type string, "
                                 "salary_min int, salary_max int")
    fixed = Q.apply_defaults(jobs).orderBy("office_id").collect()
    assert fixed[0].skills == [] and fixed[0].work_type == "onsite"
    v = {r.rule: r.n_violations for r in Q.domain_violations(jobs).collect()}
    assert v["work_type_domain"] == 2 and v["title_not_null"] == 1 and v["skills_not_null"] == 1


def test_provider_rows_first_result_rules(spark):
    """Only the first result counts; refused or malformed responses resolve nothing."""
    ok2 = json.dumps({"status": "OK", "results": [{"geometry": {"location": {"lat": 1.5, "lng": 2.5}}},
                                                  {"geometry": {"location": {"lat": 9.0, "lng": 9.0}}}]})
    refused = json.dumps({"status": "OVER_QUERY_LIMIT", "results": [{"geometry": {"location": {"lat": 1, "lng": 1}}}]})
    empty = json.dumps({"status": "ZERO_RESULTS", "results": []})
    no_geo = json.dumps({"status": "OK", "results": [{}]})
    g = G.provider_rows(spark.createDataFrame(
        [("a", ok2), ("b", refused), ("c", empty), ("d", no_geo), ("e", "not json")],
        "location_key string, value string"), "google")
    assert {r.location_key: (r.lat, r.lng) for r in g.collect()} == {"a": (1.5, 2.5), "d": (0.0, 0.0)}
    bad_first = json.dumps([{"lat": "x", "lon": "1"}, {"lat": "5", "lon": "6"}])
    prefix = json.dumps([{"lat": " 12.5abc", "lon": "-7e1"}])
    n = G.provider_rows(spark.createDataFrame(
        [("f", bad_first), ("g", prefix), ("h", "[]"), ("i", "<html/>")],
        "location_key string, value string"), "nominatim")
    assert {r.location_key: (r.lat, r.lng) for r in n.collect()} == {"g": (12.5, -70.0)}


def test_payload_reason_shapes(spark):
    from jobatlas.sources import feeds as FD
    cases = {  # value -> (remoteok reason, remotive reason)
        "[]": (None, FD.PAYLOAD_WRONG_SHAPE),
        '[{"id": "1"}, null]': (None, FD.PAYLOAD_WRONG_SHAPE),
        '[1, {"id": "1"}]': (FD.PAYLOAD_WRONG_SHAPE, FD.PAYLOAD_WRONG_SHAPE),
        "null": (None, None),
        "{}": (FD.PAYLOAD_WRONG_SHAPE, None),
        '{"jobs": null}': (FD.PAYLOAD_WRONG_SHAPE, None),
        '{"jobs": [{"id": 1}]}': (FD.PAYLOAD_WRONG_SHAPE, None),
        '{"jobs": {"id": 1}}': (FD.PAYLOAD_WRONG_SHAPE, FD.PAYLOAD_WRONG_SHAPE),
        '{"jobs": [[1]]}': (FD.PAYLOAD_WRONG_SHAPE, FD.PAYLOAD_WRONG_SHAPE),
        "<html>busy</html>": (FD.PAYLOAD_NOT_JSON, FD.PAYLOAD_NOT_JSON),
    }
    df = spark.createDataFrame([(v,) for v in cases], "value string")
    got = df.select("value", FD.payload_reason(F.col("value"), "remoteok").alias("a"),
                    FD.payload_reason(F.col("value"), "remotive").alias("b")).collect()
    assert {r.value: (r.a, r.b) for r in got} == cases


def test_expansion_zoom_equals_ancestor_count(spark):
    """The span formula gives the same expansion zooms as counting descendants,
    including clusters beyond the Mercator latitude limit (negative cell rows)."""
    pts = spark.range(0, 3000).select(
        (F.col("id") * 37 % 181 - 90.0 + F.col("id") % 7 * 0.001).alias("lat"),
        (F.col("id") * 73 % 359 - 179.0).alias("lng"), F.lit(1).alias("job_count"))
    pyr = C.grid_pyramid(pts, spans=True)
    fast = {tuple(r) for r in C.expansion_zoom(pyr).collect()}
    slow = {tuple(r) for r in C.expansion_zoom_by_ancestors(pyr).collect()}
    assert fast == slow and len(fast) > 100
