"""Property tests of the pure-Python geo helpers against brute force."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from jobatlas.functions import geo as GEO


def hav(lat1, lng1, lat2, lng2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * GEO.EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(a)))


def inside(lat, lng, box):
    lo_lng, lo_lat, hi_lng, hi_lat = box
    lat_ok = lo_lat <= lat <= hi_lat
    lng_ok = (lo_lng <= lng <= hi_lng) if lo_lng <= hi_lng else (lng >= lo_lng or lng <= hi_lng)
    return lat_ok and lng_ok


lat_s = st.floats(-89.0, 89.0)
lng_s = st.floats(-180.0, 180.0)


@settings(max_examples=400, deadline=None)
@given(lat_s, lng_s, st.floats(1.0, 5000.0), lat_s, lng_s)
def test_radius_box_contains_every_point_in_range(lat0, lng0, km, lat, lng):
    if hav(lat0, lng0, lat, lng) <= km * (1 - 1e-9):
        assert inside(lat, lng, GEO.radius_box(lat0, lng0, km))


@settings(max_examples=200, deadline=None)
@given(st.floats(-400, 400), st.floats(-100, 100), st.floats(0, 400), st.floats(0, 60))
def test_clamp_viewport_is_inside_world(w, s, span, h):
    box = GEO.clamp_viewport(w, s, w + span, s + h)
    assert -180 <= box[0] <= 180 and -180 <= box[2] <= 180
    assert box[1] >= -85 and box[3] <= 85


def _gc_lat(lat_e, lng, mid, half):
    """Latitude of the great circle through (mid-half, lat_e), (mid+half, lat_e) at lng, by vectors."""
    def vec(lat, lon):
        la, lo = math.radians(lat), math.radians(lon)
        return (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la))
    a, b = vec(lat_e, mid - half), vec(lat_e, mid + half)
    n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    lo = math.radians(lng)
    # n . (cos(la)cos(lo), cos(la)sin(lo), sin(la)) = 0  ->  tan(la) = -(n0 cos lo + n1 sin lo) / n2
    return math.degrees(math.atan(-(n[0] * math.cos(lo) + n[1] * math.sin(lo)) / n[2]))


@settings(max_examples=300, deadline=None)
@given(st.floats(-170, 10), st.floats(1, 170), st.floats(-80, 80), st.floats(0, 1))
def test_geodesic_edge_formula(min_lng, span, lat_e, frac):
    if abs(lat_e) < 1e-3:
        return
    mid, half = min_lng + span / 2, span / 2
    lng = min_lng + frac * span
    expect = _gc_lat(lat_e, lng, mid, half)
    got = math.degrees(math.atan(math.tan(math.radians(lat_e)) * math.cos(math.radians(lng - mid))
                                 / math.cos(math.radians(half))))
    assert abs(expect - got) < 1e-7


def test_geodesic_viewport_column(spark):
    df = spark.createDataFrame([(50.5, 0.0), (50.5, -29.0), (49.0, 0.0), (-51.0, 0.0)], "lat double, lng double")
    rows = df.where(GEO.in_viewport_geodesic(df.lat, df.lng, -30.0, -50.0, 30.0, 50.0)).collect()
    # the top edge bows north to ~52.3 deg at the centre and meets 50 deg at the corners
    assert sorted((r.lat, r.lng) for r in rows) == [(-51.0, 0.0), (49.0, 0.0), (50.5, 0.0)]
