"""Many requests at once: parameters as columns, whole responses, boxes and circles against points."""

import json
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMOKE
from jobatlas.functions.geo import in_viewport, round_km
from jobatlas.operators import requests as R
from jobatlas.operators import spatial as S
from jobatlas.operators.pins import PinFilter
from jobatlas.sources import sinks
from test_plans import plan_of

NUMBERS = ["", " 7 ", "+5", "-3", "12.5", "abc", "9223372036854775807", "9223372036854775808", "1e3", "٣", None]
BOXES = ["1,2,3,4", " -10 , -5.5, 1e1 ,.5", "1,2,3", "1,2,3,4,5", "1,,2,3,4", "1,2,1e999,4", "NaN,1,2,3", "inf,1,2,3", "1,2,3,4d", "", None]


def test_requests_as_columns_follow_the_rules_for_one_request(spark):
    asked = [{"keyword": k, "skills": s, "work_type": "remote, ,onsite", "experience": " mid ", "salary_min": n, "salary_max": n,
              "source": None, "company": "", "limit": n, "bbox": b}
             for n, b, k, s in zip(NUMBERS, BOXES, [" a ", "", None] * 4, ["x", " y ,Z", ",", None] * 3)]
    ddl = "i int, " + ", ".join(f"`{p}` string" for p in R.PARAMETERS)
    df = spark.createDataFrame([(i, *[a[p] for p in R.PARAMETERS]) for i, a in enumerate(asked)], ddl)
    got = {r.i: r for r in R.coerce_requests(df).collect()}
    for i, a in enumerate(asked):
        f, r = PinFilter.from_params(a), got[i]
        assert (r.keyword, tuple(r.skills), tuple(r.work_type), r.experience, r.salary_min, r.salary_max, r.source, r.company, r.row_limit) == (
            f.keyword, f.skills, f.work_types, f.experience_level, f.salary_min, f.salary_max, f.source, f.company, f.limit)
        assert (r.has_viewport, r.min_lng, r.min_lat, r.max_lng, r.max_lat) == (f.has_viewport, f.min_lng, f.min_lat, f.max_lng, f.max_lat)
        assert r.n_active == f.active_count()
    assert sum(r.has_viewport for r in got.values()) == 3  # the fifth: blank parts drop out


def test_envelopes(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "h1"), (1, "b", "h2"), (3, "c", "h3")], "id int, name string, dedup_hash string")
    whole = sinks.envelope(df, "pins", [-F.col("id")], count=True).collect()
    assert json.loads(whole[0].value) == {"count": 3, "pins": [{"id": 3, "name": "c"}, {"id": 2}, {"id": 1, "name": "b"}]}
    assert sinks.envelope(df, "skills", [F.col("id")], "id").first().value == '{"skills":[1,2,3]}'
    assert sinks.envelope(df.limit(0), "pins", [F.col("id")], count=True).first().value == '{"count":0,"pins":[]}'
    sinks.write_envelope(sinks.envelope(df, "skills", [F.col("id")], "id"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"skills":[1,2,3]}']


def _points(spark, rng, n=400):
    rows = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), rng.randrange(20)) for i in range(n)]
    rows += [(n + i, *p, 5) for i, p in enumerate(((90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (45.0, 90.0), (0.0, 0.0)))]
    rows += [(2 * n + i, 10.0, 20.0, 7) for i in range(50)]  # many at one point
    rows += [(9000, None, 1.0, 99), (9001, 5.0, 200.0, 99), (9002, float("nan"), 1.0, 99)]
    return spark.createDataFrame(rows, "id int, lat double, lng double, jobs int")


@pytest.mark.parametrize("k", [1, 7, 10_000])
def test_top_of_many_boxes_equals_one_filter_each(spark, k):
    rng = random.Random(k)
    points = _points(spark, rng)
    boxes = [(-180.0, -85.0, 180.0, 85.0), (-180.0, -90.0, 180.0, 90.0), (20.0, 10.0, 20.0, 10.0), (170.0, -60.0, -170.0, 60.0),
             (10.0, -80.0, 5.0, 80.0), (0.0, 0.0, 90.0, 45.0), (-400.0, -100.0, 400.0, 100.0)]
    for _ in range(20):
        w, s, size = rng.uniform(-180, 170), rng.uniform(-90, 80), 10 ** rng.uniform(-2, 2)
        boxes.append((w, s, w + size, s + size))
    wrong = [(5.0, 10.0, 6.0, 9.0), (None, 0.0, 1.0, 1.0), (0.0, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes + wrong)], "box int, min_lng double, min_lat double, max_lng double, max_lat double")
    found = S.top_in_boxes(df, points, ["box"], [F.col("jobs").desc(), F.col("id")], k)
    got = {}
    for r in found.collect():
        got.setdefault(r.box, []).append((r.place, r.id))
    on_map = [p for p in points.collect() if p.lat is not None and -90 <= p.lat <= 90 and -180 <= p.lng <= 180]
    for i, (w, s, e, n) in enumerate(boxes):
        inside = [p for p in on_map if s <= p.lat <= n and (w <= p.lng <= e if w <= e else p.lng >= w or p.lng <= e)]
        want = [p.id for p in sorted(inside, key=lambda p: (-p.jobs, p.id))][:k]
        assert [x for _, x in sorted(got.pop(i, []))] == want, boxes[i]
    assert not got
    i, (w, s, e, n) = 3, boxes[3]  # the same rule as the filter of one viewport
    if k > 1000:
        ids = {r.id for r in points.where(in_viewport("lat", "lng", w, s, e, n)).collect()} - {9000, 9001, 9002}
        assert ids == {r.id for r in found.where("box = 3").collect()}


@pytest.mark.parametrize("k", [1, 3])
def test_boxes_open_edge_cells_only_as_far_as_needed(spark, k):
    """the best points lie just outside the boxes, thin boxes hold no cell, hundreds of points share a place."""
    rng = random.Random(k)
    rows = [(i, rng.uniform(0, 20), rng.uniform(0, 20), rng.randrange(50)) for i in range(1500)]
    rows += [(2000 + i, rng.uniform(9, 10), rng.uniform(0, 20), 1000 + i) for i in range(500)]
    rows += [(3000 + i, 10.5, 5.5, i % 9) for i in range(300)] + [(4000 + i, 10.5, 5.5 + 1e-7 * i, 900) for i in range(200)]
    points = spark.createDataFrame(rows, "id int, lat double, lng double, jobs int")
    boxes = [(0.0, 10.0, 20.0, 20.0), (5.5, 10.5, 5.5, 10.5), (5.5, 10.0, 5.5, 11.0), (3.0, 0.0, 3.0001, 20.0), (5.5 + 1e-5, 10.4, 6.0, 10.6)]
    boxes += [(w, 10.0001, w + 3.0, 12.0) for w in (0.0, 2.5, 4.9, 9.0)] * 2
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "box int, min_lng double, min_lat double, max_lng double, max_lat double")
    found = S.top_in_boxes(df, points, ["box"], [F.col("jobs").desc(), F.col("id")], k)
    assert "sequence(" not in found._jdf.queryExecution().executedPlan().toString()  # no box meets all points of its edge cells
    got = sorted((r.box, r.place, r.id) for r in found.collect())
    want = []
    for i, (w, s, e, n) in enumerate(boxes):
        inside = sorted((p for p in rows if s <= p[1] <= n and w <= p[2] <= e), key=lambda p: (-p[3], p[0]))[:k]
        want += [(i, j, p[0]) for j, p in enumerate(inside, 1)]
    assert got == want


def _km(a, b):
    (la, lo), (lb, lp) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def test_circles_around_many_centres_equal_all_distances(spark):
    rng = random.Random(3)
    points = _points(spark, rng).drop("jobs")
    centres = [(89.5, 10.0, 500.0), (-90.0, 0.0, 2000.0), (0.0, 179.9, 900.0), (0.0, -180.0, 900.0), (10.0, 20.0, 0.0), (0.0, 0.0, 30_000.0),
               (5.0, 5.0, 11_000.0), (80.0, -100.0, 1100.0)]
    centres += [(rng.uniform(-90, 90), rng.uniform(-180, 180), 10 ** rng.uniform(0, 3.9)) for _ in range(25)]
    wrong = [(0.0, 0.0, -1.0), (0.0, 0.0, None), (91.0, 0.0, 5000.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(centres + wrong)], "c int, centre_lat double, centre_lng double, km double")
    got = {(r.c, r.id): r.distance_km for r in S.within_radius(df, points).collect()}
    on_map = [p for p in points.collect() if p.lat is not None and -90 <= p.lat <= 90 and -180 <= p.lng <= 180]
    want = {(i, p.id): d for i, (la, lo, km) in enumerate(centres) for p in on_map if (d := _km((la, lo), (p.lat, p.lng))) <= km}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_circles_meet_cells_of_their_own_size(spark):
    """a circle over a pole met a half of all points, and the exploded tables were broadcast into the one task of a scan."""
    rng = random.Random(6)
    rows = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(3000)]
    rows += [(5000 + i, lat, lng) for i, (lat, lng) in enumerate((a, o) for a in (90.0, -90.0, 0.0, 89.999) for o in (180.0, -180.0, 0.0))]
    centres = [(lat, lng, km) for lat in (90.0, -90.0, 80.0, -67.51, 0.0, 45.0) for lng in (180.0, -180.0, 0.0, 77.7)
               for km in (0.0, 0.001, 30.0, 900.0, 2500.0, 9000.0)]
    points = spark.createDataFrame(rows, "id int, lat double, lng double")
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "c int, centre_lat double, centre_lng double, km double")
    circles = df.select("c", F.radians("centre_lat").alias("_p"), F.radians("centre_lng").alias("_l"), F.col("km").alias("_km"))
    met = S.circle_cells(circles)
    assert max(r["count"] for r in met.groupBy("c").count().collect()) <= 120
    pairs = [(r.c, r.id, r._whole) for r in met.join(S.circle_filed(points), ["_level", "_cx", "_cy"]).collect()]
    assert len(pairs) == len({p[:2] for p in pairs})  # no cell twice
    far = {(c, i): _km(centres[c][:2], p) - centres[c][2] for c in range(len(centres)) for i, *p in rows}
    assert {p for p, d in far.items() if d <= 0} <= {p[:2] for p in pairs} and all(far[c, i] <= 0 for c, i, whole in pairs if whole)
    assert len(pairs) <= 2 * sum(d <= 0 for d in far.values()) + 10 * len(centres)
    assert {(r.c, r.id) for r in S.within_radius(df, points).collect()} == {p for p, d in far.items() if d <= 0}
    found = E.queries()["offices_near_each"](spark, SMOKE)
    joins = [x for x in plan_of(found, "simple").splitlines() if "Join" in x and "_cx" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_distances_round_as_round_does(spark):
    rng = random.Random(7)
    values = [rng.uniform(0, 20_100) for _ in range(3000)] + [k / 1000 + 0.0005 for k in range(0, 9000, 7)] + [0.0, 1.0, 99_999.9996, 123_456.7895]
    values += [math.nextafter(2.0005, 3), math.nextafter(2.0005, 0), 1e17, -1.0005, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(round_km("v").alias("got"), F.round("v", 3).alias("want"))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_columns_of_both_tables_are_refused(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lat double, lng double")
    with pytest.raises(ValueError):
        S.within_radius(p.select("id", F.lit(0.0).alias("centre_lat"), F.lit(0.0).alias("centre_lng"), F.lit(1.0).alias("km")), p)


@pytest.mark.parametrize("name", ["offices_near_each", "pins_of_viewports"])
def test_boxes_and_points_meet_by_equal_cells(spark, name):
    plan = plan_of(E.queries()[name](spark, SMOKE), "simple")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "_cx" in plan


def test_response_is_the_pins_in_order(spark):
    from jobatlas.operators.pins import pins
    from jobatlas.plans.q_map import _views
    from jobatlas.plans.q_requests import _RESPONSE_PINS
    got = json.loads(E.queries()["pins_response"](spark, SMOKE).first().value)
    want = pins(*_views(spark, SMOKE), replace(_RESPONSE_PINS)).collect()
    assert got["count"] == len(want) and [p["office_id"] for p in got["pins"]] == [r.office_id for r in want]
