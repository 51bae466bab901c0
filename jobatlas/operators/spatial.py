"""Many boxes or circles against many points (G9, F8 and L1 for a table of viewports).

A box is covered by cells of a quadtree level that suits its size (at most about a hundred of them),
and a point is filed under its cell of every level in ``LEVELS``, so boxes and points meet in an
equi-join on (level, cell): no pair of a box and a far point is ever formed.  Cells on a box's edge
are verified point by point.  Cells that lie wholly inside need no test.  For the top of a list a box
meets only each cell's own top, which is made once for all boxes; a cell on the edge is opened, one level
finer at a time, only where points below its top could still be among the box's first.
A circle meets cells of a grid of its own, of one height and nearly one width from the equator to the poles.

A box with ``min_lng > max_lng`` wraps the antimeridian.  A box with a NULL or NaN edge, or with its
edges the wrong way round, holds nothing; nor does any hold a point off the map (beyond 180 or 90 degrees).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import EARTH_RADIUS_KM, great_circle_km
from ..session import staged

LEVELS = tuple(range(2, 15, 2))
#: Levels of the cells in which circles and points meet.
CIRCLE_LEVELS = tuple(range(2, 15))
BOX = ("min_lng", "min_lat", "max_lng", "max_lat")
_CELL = ["_level", "_cx", "_cy"]
#: Degrees that keep rounding from calling a cell inside, or a point outside, by mistake.
_MARGIN = 1e-9
#: Degrees or km that keep rounding from missing a cell of a circle, or calling it inside.
_CIRCLE_MARGIN = 1e-6


def _cell_of(degrees: Column, origin: float, level: Column) -> Column:
    return F.floor((degrees + origin) / (F.lit(360.0) / F.pow(F.lit(2.0), level))).cast("long")


def covering(boxes: DataFrame) -> DataFrame:
    """A row per box and cell that meets it: the columns of ``boxes``, ``_lo``, ``_hi`` (longitudes of the part of
    the box that the cell covers), the cell, and ``_whole`` (the cell lies inside)."""
    west, east = F.greatest("min_lng", F.lit(-180.0)), F.least("max_lng", F.lit(180.0))
    part = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    parts = F.when(F.col("min_lng") > F.col("max_lng"), F.array(part(west, F.lit(180.0)), part(F.lit(-180.0), east))) \
             .otherwise(F.array(part(west, east)))
    sound = [F.col(c).isNotNull() & ~F.isnan(c) for c in BOX]
    b = boxes.where(sound[0] & sound[1] & sound[2] & sound[3]).select("*", F.explode(parts).alias("_part"))
    b = b.withColumns({"_lo": F.col("_part.lo"), "_hi": F.col("_part.hi"), "_s": F.greatest("min_lat", F.lit(-90.0)),
                       "_n": F.least("max_lat", F.lit(90.0))}).drop("_part").where("_lo <= _hi AND _s <= _n")
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.col("_n") - F.col("_s"), F.lit(360.0 / 2 ** LEVELS[-1]))
    level = F.floor(F.log2(F.lit(360.0) / span)).cast("int") + 3
    b = b.withColumn("_level", F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[-1]), level - level % 2)))
    at = F.col("_level")
    b = b.withColumn("_cx", F.explode(F.sequence(_cell_of(F.col("_lo"), 180.0, at), _cell_of(F.col("_hi"), 180.0, at))))
    b = b.withColumn("_cy", F.explode(F.sequence(_cell_of(F.col("_s"), 90.0, at), _cell_of(F.col("_n"), 90.0, at))))
    return _flagged(b)


def _flagged(b: DataFrame) -> DataFrame:
    """``_whole`` of boxes (``_lo``, ``_hi``, ``_s``, ``_n``) beside a cell."""
    size = F.lit(360.0) / F.pow(F.lit(2.0), F.col("_level"))
    x, y = F.col("_cx") * size - 180.0, F.col("_cy") * size - 90.0
    whole = (((x >= F.col("_lo") + _MARGIN) | (F.col("_lo") <= -180)) & ((x + size <= F.col("_hi") - _MARGIN) | (F.col("_hi") >= 180))
             & ((y >= F.col("_s") + _MARGIN) | (F.col("_s") <= -90)) & ((y + size <= F.col("_n") - _MARGIN) | (F.col("_n") >= 90)))
    return b.withColumn("_whole", whole).drop("_s", "_n")


def _opened(cells: DataFrame) -> DataFrame:
    """Boxes beside a cell, as the cells one step of ``LEVELS`` finer that meet them.  Cell sizes are exact in
    binary, so a finer cell lies in one coarser cell."""
    step = LEVELS[1] - LEVELS[0]
    n = 2 ** step
    b = cells.withColumns({"_level": F.col("_level") + step, "_s": F.greatest("min_lat", F.lit(-90.0)), "_n": F.least("max_lat", F.lit(90.0))})
    for c, lo, hi, origin in (("_cx", "_lo", "_hi", 180.0), ("_cy", "_s", "_n", 90.0)):
        first = F.greatest(F.col(c) * n, _cell_of(F.col(lo), origin, F.col("_level")))
        last = F.least(F.col(c) * n + (n - 1), _cell_of(F.col(hi), origin, F.col("_level")))
        b = b.withColumn(c, F.explode(F.sequence(first, last)))
    return _flagged(b)


def filed(points: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``points`` on the map, once per level, with their cell."""
    on_map = F.col(lat).between(-90.0, 90.0) & F.col(lng).between(-180.0, 180.0)
    p = points.where(on_map).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in LEVELS])))
    return p.withColumns({"_cx": _cell_of(F.col(lng), 180.0, F.col("_level")), "_cy": _cell_of(F.col(lat), 90.0, F.col("_level"))})


def _disjoint(a: DataFrame, b: DataFrame) -> None:
    twice = set(a.columns) & set(b.columns)
    if twice:
        raise ValueError(f"columns of both tables: {sorted(twice)}")


def _inside(lat: str, lng: str) -> Column:
    return F.col(lng).between(F.col("_lo"), F.col("_hi")) & F.col(lat).between(F.col("min_lat"), F.col("max_lat"))


def top_in_boxes(boxes: DataFrame, points: DataFrame, key: Sequence[str], order: Sequence[Column], k: int,
                 lat: str = "lat", lng: str = "lng") -> DataFrame:
    """The first ``k`` points by ``order`` of every box (``key`` names a box), with their ``place`` from 1.

    ``order`` must tell all points apart.  Points get a rank by one sort, equal boxes are answered once, and a
    cell lists its first few points.  A box takes the first ``k`` of those listed in its cells that it holds.
    A cell on its edge that has more points than it lists is opened into finer cells, unless the last one
    listed already comes after the box's ``k``-th.  In a cell of the finest level the points behind the
    listed ones, and before the ``k``-th, are tested one by one.  So a box meets about as many points as it has cells,
    not as many as lie along its edge.
    """
    _disjoint(boxes, points)
    finest, n_listed = LEVELS[-1], max(2 * k, 16)
    on_map = F.col(lat).between(-90.0, 90.0) & F.col(lng).between(-180.0, 180.0)
    ranked = staged(points.where(on_map).orderBy(*order).withColumn("_rank", F.monotonically_increasing_id()), "ranked")
    areas = staged(boxes.select(*BOX).distinct().withColumn("_box", F.monotonically_increasing_id()), "areas")
    at = filed(ranked.select("_rank", F.col(lat).alias("_lat"), F.col(lng).alias("_lng")), "_lat", "_lng")

    def first(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_rank"))).where(F.col("place") <= n)

    listed = staged(first(at, _CELL, n_listed + 1).groupBy(*_CELL).agg(
        F.sort_array(F.collect_list(F.struct("_rank", "_lat", "_lng"))).alias("_listed")), "cells")
    pairs, best, deep = covering(areas).withColumn("_after", F.lit(-1).cast("long")), None, []
    for _ in LEVELS:
        held = F.when(F.col("_whole"), F.slice("_listed", 1, k)).otherwise(F.filter("_listed", lambda p: p["_lng"].between(
            F.col("_lo"), F.col("_hi")) & p["_lat"].between(F.col("min_lat"), F.col("max_lat"))))
        new = F.slice(F.filter(held, lambda p: p["_rank"] > F.col("_after")), 1, k)
        met = staged(pairs.join(listed, _CELL).select(
            *BOX, "_box", "_lo", "_hi", *_CELL, F.transform(new, lambda p: p["_rank"]).alias("_new"),
            (~F.col("_whole") & (F.size("_listed") > n_listed)).alias("_more"),
            F.greatest("_after", F.element_at("_listed", -1)["_rank"]).alias("_after")), "met")
        ranks = met.select("_box", F.explode("_new").alias("_rank"))
        best = staged(first(ranks if best is None else best.unionByName(ranks), ["_box"], k).drop("place"), "best")
        full = best.groupBy("_box").agg(F.count(F.lit(1)).alias("_n_found"), F.max("_rank").alias("_worst")).where(F.col("_n_found") >= k)
        unsettled = staged(met.where("_more").drop("_new", "_more").join(full.drop("_n_found"), "_box", "left")
                           .where(F.col("_worst").isNull() | (F.col("_after") < F.col("_worst"))), "unsettled")
        deep.append(unsettled.where(F.col("_level") == finest))
        wide = unsettled.where(F.col("_level") < finest).drop("_worst")
        if wide.isEmpty():
            break
        pairs = _opened(wide)
    rest = reduce(DataFrame.unionByName, deep).join(at.where(F.col("_level") == finest), _CELL).where(
        _inside("_lat", "_lng") & (F.col("_rank") > F.col("_after")) & (F.col("_worst").isNull() | (F.col("_rank") < F.col("_worst"))))
    found = boxes.join(areas, list(BOX)).join(best.unionByName(rest.select("_box", "_rank")), "_box").join(ranked, "_rank")
    return first(found, list(key), k).select(*boxes.columns, *points.columns, "place")


def _cells_around(level: Column, band: Column) -> Column:
    """How many cells lie around the earth in a band of latitude (bands are 360 / 2^level degrees high, counted from the
    south pole).  No cell is wider than high; the count is exact in binary, so circles and points agree on it everywhere."""
    half = F.pow(F.lit(2.0), level - 2)
    off = F.least(F.abs(band - half), F.abs(band + 1 - half)) / half
    return F.greatest(F.lit(1), F.ceil(F.pow(F.lit(2.0), level) * (1 - off * off))).cast("long")


def _size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def circle_cells(circles: DataFrame) -> DataFrame:
    """A row per circle (``_p``, ``_l``, radians, and ``_km``) and cell that it may meet, and ``_whole`` (the cell lies inside).
    Cells are a half to a quarter of the radius high, so a circle has some fifty at most, at the poles too."""
    reach = F.least(F.degrees(F.col("_km") / EARTH_RADIUS_KM), F.lit(180.0))
    level = F.ceil(F.log2(F.lit(720.0) / F.greatest(reach, F.lit(720.0 / 2 ** CIRCLE_LEVELS[-1])))).cast("int")
    c = circles.withColumns({"_reach": reach + _CIRCLE_MARGIN, "_level": F.greatest(F.lit(CIRCLE_LEVELS[0]), level),
                             "_lat": F.degrees("_p"), "_lng": F.degrees("_l")})
    last = F.pow(F.lit(2.0), F.col("_level") - 1).cast("long") - 1
    edge = lambda lat: F.floor((lat + 90.0) / _size(F.col("_level"))).cast("long")
    c = c.withColumn("_cy", F.explode(F.sequence(F.greatest(edge(F.col("_lat") - F.col("_reach")), F.lit(0)),
                                                 F.least(edge(F.col("_lat") + F.col("_reach")), last))))
    n, size = _cells_around(F.col("_level"), F.col("_cy")), F.radians(_size(F.col("_level")))
    c = c.withColumns({"_n": n, "_south": F.col("_cy") * size - math.pi / 2, "_size": size})
    # how far the corners of the band's cells lie from their middle at most
    wide = F.cos(F.least(F.abs("_south"), F.abs(F.col("_south") + F.col("_size")))) * math.pi / F.col("_n")
    corner = F.asin(F.least(F.lit(1.0), F.sqrt(F.pow(F.col("_size") / 4, 2) + F.pow(wide / 2, 2))))
    over_pole = F.abs("_lat") + F.col("_reach") >= 90
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("_reach")) / F.cos("_p")))) + _CIRCLE_MARGIN
    x = lambda lng: F.floor((lng + 180.0) / 360.0 * F.col("_n")).cast("long")
    first = F.when(over_pole, F.lit(0)).otherwise(x(F.col("_lng") - side))
    end = F.when(over_pole, F.col("_n") - 1).otherwise(F.least(x(F.col("_lng") + side), first + F.col("_n") - 1))
    c = c.withColumns({"_corner": corner * 2 * EARTH_RADIUS_KM + _CIRCLE_MARGIN, "_cx": F.explode(F.sequence(first, end))})
    middle = great_circle_km(F.col("_p"), F.cos("_p"), F.col("_l"), F.col("_south") + F.col("_size") / 2,
                             F.cos(F.col("_south") + F.col("_size") / 2), (F.col("_cx") + 0.5) * (2 * math.pi) / F.col("_n") - math.pi)
    c = c.withColumns({"_middle": middle, "_cx": F.pmod("_cx", "_n")}).where(F.col("_middle") <= F.col("_km") + F.col("_corner"))
    return c.withColumn("_whole", F.col("_middle") <= F.col("_km") - F.col("_corner")).drop(
        "_reach", "_lat", "_lng", "_n", "_south", "_size", "_corner", "_middle")


def circle_filed(points: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``points`` on the map, once per level of ``CIRCLE_LEVELS``, with their cell among those of :func:`circle_cells`."""
    on_map = F.col(lat).between(-90.0, 90.0) & F.col(lng).between(-180.0, 180.0)
    p = points.where(on_map).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in CIRCLE_LEVELS])))
    last = F.pow(F.lit(2.0), F.col("_level") - 1).cast("long") - 1
    p = p.withColumn("_cy", F.least(F.floor((F.col(lat) + 90.0) / _size(F.col("_level"))).cast("long"), last))
    n = _cells_around(F.col("_level"), F.col("_cy"))
    return p.withColumn("_cx", F.least(F.floor((F.col(lng) + 180.0) / 360.0 * n).cast("long"), n - 1))


def within_radius(centres: DataFrame, points: DataFrame, centre: Sequence[str] = ("centre_lat", "centre_lng", "km"),
                  lat: str = "lat", lng: str = "lng") -> DataFrame:
    """G9 for a table of centres: every pair of a centre and a point at most its ``km`` away, with ``distance_km``.
    A negative or NULL radius, or a centre off the map, finds nothing.

    The result may grow with the product of both tables, so the work for a pair is kept small: a circle meets the
    cells of a grid that follows the circle (not its box, which is the whole parallel near a pole), what belongs to
    one place (radians, cosine) is computed before the join, and points of a cell inside the circle need no test.  The
    join is a merge of both shuffled sides: the planner's sizes do not know of the rows per cell, so it would broadcast
    one of them and leave the pairs to the few tasks of the other's scan."""
    _disjoint(centres, points)
    c_lat, c_lng, km = (F.col(c) for c in centre)
    sound = c_lat.between(-90.0, 90.0) & c_lng.between(-180.0, 180.0) & (km >= 0) & ~F.isnan(km)
    circles = centres.where(sound).withColumns({"_p": F.radians(c_lat), "_l": F.radians(c_lng), "_km": km.cast("double")})
    at = circle_filed(points, lat, lng).withColumns({"_p2": F.radians(lat), "_l2": F.radians(lng), "_cos2": F.cos(F.radians(lat))})
    d = great_circle_km(F.col("_p"), F.col("_cos"), F.col("_l"), F.col("_p2"), F.col("_cos2"), F.col("_l2"))
    pairs = circle_cells(circles).withColumn("_cos", F.cos("_p")).join(at.hint("merge"), _CELL).where(F.col("_whole") | (d <= F.col("_km")))
    return pairs.select(*centres.columns, *points.columns, d.alias("distance_km"))
