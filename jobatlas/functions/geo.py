"""Geographic Column functions: viewport tests, Web-Mercator pixel grid, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the map client
TILE_SIZE = 512            # world width in pixels at zoom 0
CLUSTER_RADIUS_PX = 48     # cluster radius in screen pixels
CLUSTER_MAX_ZOOM = 12      # above this zoom no clustering happens
MAP_MIN_ZOOM = 1
WORLD_BOX = (-180.0, -85.0, 180.0, 85.0)   # minLng, minLat, maxLng, maxLat
EARTH_RADIUS_KM = 6371.0088


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def in_viewport(lat, lng, min_lng: float, min_lat: float, max_lng: float, max_lat: float) -> Column:
    """F8: point inside an inclusive lng/lat box; a box with min_lng > max_lng wraps the antimeridian.

    Written as plain range comparisons so both bounds reach the Parquet scan as
    pushed filters when lat/lng are stored columns.
    """
    la, ln = _c(lat), _c(lng)
    lat_ok = (la >= F.lit(float(min_lat))) & (la <= F.lit(float(max_lat)))
    if min_lng <= max_lng:
        lng_ok = (ln >= F.lit(float(min_lng))) & (ln <= F.lit(float(max_lng)))
    else:
        lng_ok = (ln >= F.lit(float(min_lng))) | (ln <= F.lit(float(max_lng)))
    return lat_ok & lng_ok


def _edge_lat(lat_deg: Column | float, lng: Column, lng_mid: float, half_span_deg: float) -> Column:
    """Latitude (degrees) at longitude ``lng`` of the great circle through
    (mid - half, lat) and (mid + half, lat): atan(tan(lat) * cos(lng - mid) / cos(half))."""
    return F.degrees(F.atan(F.tan(F.radians(F.lit(float(lat_deg)))) * F.cos(F.radians(lng - F.lit(lng_mid)))
                            / F.lit(math.cos(math.radians(half_span_deg)))))


def in_viewport_geodesic(lat, lng, min_lng: float, min_lat: float, max_lng: float, max_lat: float) -> Column:
    """F8 with great-circle top/bottom edges (geography envelope semantics): the edges
    bow poleward between the corners.  Valid for 0 < span < 180 deg without wrap;
    other boxes fall back to the planar test.  A planar pre-filter on the box that
    contains the bowed edges comes first, so the scan still gets pushed range filters.
    """
    span = max_lng - min_lng
    if not (0 < span < 180) or max_lat >= 90 or min_lat <= -90:
        return in_viewport(lat, lng, min_lng, min_lat, max_lng, max_lat)
    half, mid = span / 2.0, (min_lng + max_lng) / 2.0
    widen = lambda b: math.degrees(math.atan(math.tan(math.radians(b)) / math.cos(math.radians(half))))
    outer = in_viewport(lat, lng, min_lng, min(min_lat, widen(min_lat)), max_lng, max(max_lat, widen(max_lat)))
    la, ln = _c(lat), _c(lng)
    return outer & (la >= _edge_lat(min_lat, ln, mid, half)) & (la <= _edge_lat(max_lat, ln, mid, half))


def clamp_viewport(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float]:
    """P26 (driver-side scalar): world box when the span is >= 270 deg or crosses +-180,
    else longitudes clamped to +-180 and latitudes to +-85.  Returns (minLng, minLat, maxLng, maxLat)."""
    if east - west >= 270 or west < -180 or east > 180:
        return WORLD_BOX
    return (max(west, -180.0), max(south, -85.0), min(east, 180.0), min(north, 85.0))


def clamp_viewport_cols(west, south, east, north) -> Column:
    """P26 as a Column over a table of viewports: struct<min_lng,min_lat,max_lng,max_lat>."""
    w, s, e, n = _c(west), _c(south), _c(east), _c(north)
    world = ((e - w) >= 270) | (w < -180) | (e > 180)
    return F.struct(
        F.when(world, F.lit(-180.0)).otherwise(F.greatest(w, F.lit(-180.0))).alias("min_lng"),
        F.when(world, F.lit(-85.0)).otherwise(F.greatest(s, F.lit(-85.0))).alias("min_lat"),
        F.when(world, F.lit(180.0)).otherwise(F.least(e, F.lit(180.0))).alias("max_lng"),
        F.when(world, F.lit(85.0)).otherwise(F.least(n, F.lit(85.0))).alias("max_lat"),
    )


def quantise(c, digits: int = 1) -> Column:
    """P25: scale by 10^digits in floating point, round half away from zero, scale back
    (so 444.04999999999995 -> 4440.5 -> 444.1, as the scaled product rounds)."""
    scale = float(10 ** digits)
    return F.round(_c(c) * F.lit(scale), 0) / F.lit(scale)


def world_px(zoom) -> Column:
    """World width in pixels at ``zoom``: 512 * 2^zoom."""
    return F.lit(float(TILE_SIZE)) * F.pow(F.lit(2.0), _c(zoom).cast("double"))


def mercator_x(lng, zoom) -> Column:
    """Pixel x of a longitude at ``zoom``."""
    return (_c(lng) + 180.0) / 360.0 * world_px(zoom)


def mercator_y(lat, zoom) -> Column:
    """Pixel y of a latitude at ``zoom`` (0 at the top)."""
    phi = F.radians(_c(lat))
    return (F.lit(1.0) - F.asinh(F.tan(phi)) / F.lit(math.pi)) / F.lit(2.0) * world_px(zoom)


def grid_cell(px, radius_px: int = CLUSTER_RADIUS_PX) -> Column:
    return F.floor(_c(px) / F.lit(float(radius_px)))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in kilometres."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    return great_circle_km(p1, F.cos(p1), F.radians(_c(lng1)), p2, F.cos(p2), F.radians(_c(lng2)))


def great_circle_km(p1: Column, cos1: Column, l1: Column, p2: Column, cos2: Column, l2: Column) -> Column:
    """:func:`haversine_km` of latitudes and longitudes in radians, with the cosines of the latitudes."""
    a = F.pow(F.sin((p2 - p1) / 2), 2) + cos1 * cos2 * F.pow(F.sin((l2 - l1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def round_km(km, digits: int = 3) -> Column:
    """``F.round`` of a distance, without its decimal arithmetic per row: only values within a millionth of a tie,
    and those that are no ordinary distance, go through it."""
    d, scale = _c(km), float(10 ** digits)
    off_tie = F.abs(d * scale - F.floor(d * scale) - 0.5) > 1e-6
    return F.when((d >= 0) & (d < 1e5) & off_tie, F.floor(d * scale + 0.5) / scale).otherwise(F.round(d, digits))


def radius_box(lat0: float, lng0: float, km: float) -> tuple[float, float, float, float]:
    """Lat/lng box containing every point within ``km`` of (lat0, lng0): a cheap,
    pushable pre-filter in front of :func:`haversine_km`.  Returns (minLng, minLat, maxLng, maxLat).

    Longitude half-width is asin(sin(r) / cos(lat0)) with r the angular radius (the
    widest point of the circle lies poleward of its centre); a circle that reaches a
    pole spans all longitudes.  A box crossing the antimeridian comes back with
    minLng > maxLng, which :func:`in_viewport` treats as wrapping.
    """
    r = km / EARTH_RADIUS_KM
    dlat = math.degrees(r)
    lo_lat, hi_lat = max(-90.0, lat0 - dlat), min(90.0, lat0 + dlat)
    if lat0 + dlat >= 90 or lat0 - dlat <= -90:
        return (-180.0, lo_lat, 180.0, hi_lat)
    ratio = math.sin(r) / math.cos(math.radians(lat0))
    if ratio >= 1:
        return (-180.0, lo_lat, 180.0, hi_lat)
    dlng = math.degrees(math.asin(ratio))
    lo, hi = lng0 - dlng, lng0 + dlng
    lo = lo + 360 if lo < -180 else lo
    hi = hi - 360 if hi > 180 else hi
    return (lo, lo_lat, hi, hi_lat)
