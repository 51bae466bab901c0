"""Map clustering as a Web-Mercator grid (G6-G8), labels (P21-P23, F15) and GeoJSON.

A point falls into cell ``(floor(x/48), floor(y/48))`` of the 48-pixel grid at
zoom z, where (x, y) are its world pixel coordinates (world width 512 * 2^z).
Because the world width doubles per zoom, and scaling by a power of two is
exact in floating point, the cells nest exactly: the parent of a cell at z+k is
``(cx >> k, cy >> k)``.  The whole zoom pyramid is one explode (zooms 1-12)
plus one partial+final aggregation keyed by (zoom, cell); a hot cell is summed
on the map side, so no cell's points are ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as GEO
from ..functions import text as X


def _cells(points: DataFrame, zoom: Column, lat: str, lng: str, radius_px: int) -> list[Column]:
    x = GEO.mercator_x(F.col(lng), zoom)
    y = GEO.mercator_y(F.col(lat), zoom)
    return [GEO.grid_cell(x, radius_px).cast("long").alias("cx"),
            GEO.grid_cell(y, radius_px).cast("long").alias("cy"), x.alias("_x"), y.alias("_y")]


def grid_pyramid(points: DataFrame, weight: str = "job_count", lat: str = "lat", lng: str = "lng",
                 min_zoom: int = GEO.MAP_MIN_ZOOM, max_zoom: int = GEO.CLUSTER_MAX_ZOOM,
                 radius_px: int = GEO.CLUSTER_RADIUS_PX, spans: bool = False) -> DataFrame:
    """G6+G8: (zoom, cx, cy, point_count, job_sum, x, y) for every occupied cell at every zoom.

    x, y are the cell's mean pixel position (the cluster marker position).  With
    ``spans``, also the smallest and largest finest-zoom cell of the cell's points
    (``fx_lo, fx_hi, fy_lo, fy_hi``), which :func:`expansion_zoom` needs.
    """
    z = F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))).alias("zoom")
    fine = []
    if spans:
        fz = F.lit(max_zoom)
        fine = [GEO.grid_cell(GEO.mercator_x(F.col(lng), fz), radius_px).cast("long").alias("_fx"),
                GEO.grid_cell(GEO.mercator_y(F.col(lat), fz), radius_px).cast("long").alias("_fy")]
    exploded = points.select(F.col(lat), F.col(lng), F.col(weight).alias("_w"), *fine, z)
    keep = ["_fx", "_fy"] if spans else []
    cells = exploded.select("zoom", "_w", *keep, *_cells(exploded, F.col("zoom"), lat, lng, radius_px))
    aggs = [F.count(F.lit(1)).alias("point_count"), F.sum("_w").alias("job_sum"),
            F.avg("_x").alias("x"), F.avg("_y").alias("y")]
    if spans:
        aggs += [F.min("_fx").alias("fx_lo"), F.max("_fx").alias("fx_hi"),
                 F.min("_fy").alias("fy_lo"), F.max("_fy").alias("fy_hi")]
    return cells.groupBy("zoom", "cx", "cy").agg(*aggs)


def grid_clusters(points: DataFrame, zoom: int, weight: str = "job_count", lat: str = "lat",
                  lng: str = "lng", radius_px: int = GEO.CLUSTER_RADIUS_PX) -> DataFrame:
    """G6 at one zoom (above the max cluster zoom every point is its own marker)."""
    return grid_pyramid(points, weight, lat, lng, zoom, zoom, radius_px)


def expansion_zoom(pyramid: DataFrame, max_zoom: int = GEO.CLUSTER_MAX_ZOOM) -> DataFrame:
    """For every cell holding >= 2 points, the first deeper zoom at which it splits
    into >= 2 cells; ``max_zoom + 1`` if it never splits while clustering is on.

    Needs a pyramid built with ``spans=True``.  Cells nest exactly, so a point's
    cell at zoom z' is its finest cell shifted right by ``max_zoom - z'``, and the
    cell's points share one cell at z' exactly when its smallest and largest finest
    cells do.  With ``d = (fx_lo xor fx_hi) | (fy_lo xor fy_hi)`` that first fails at
    ``z' = max_zoom - (highest set bit of d)``: one expression per cell, no join.
    """
    d = (F.col("fx_lo").bitwiseXOR(F.col("fx_hi"))).bitwiseOR(F.col("fy_lo").bitwiseXOR(F.col("fy_hi")))
    high_bit = F.length(F.bin(d)) - 1
    split = F.when(d != 0, F.greatest(F.col("zoom") + 1, F.lit(max_zoom) - high_bit)).otherwise(max_zoom + 1)
    return pyramid.where(F.col("point_count") >= 2).select(
        "zoom", "cx", "cy", "point_count", split.alias("expansion_zoom"))


def expansion_zoom_by_ancestors(pyramid: DataFrame, min_zoom: int = GEO.MAP_MIN_ZOOM,
                                max_zoom: int = GEO.CLUSTER_MAX_ZOOM) -> DataFrame:
    """G7 counted directly (a cross-check of :func:`expansion_zoom`): every occupied cell
    is exploded to its ancestors, descendants are counted per (ancestor, depth), and
    the smallest depth with two or more wins."""
    occ = pyramid.select(F.col("zoom").alias("dz"), F.col("cx").alias("dcx"), F.col("cy").alias("dcy"))
    anc = occ.where(F.col("dz") > min_zoom).select(
        "dz", F.explode(F.sequence(F.lit(min_zoom), F.col("dz") - 1)).alias("zoom"), "dcx", "dcy")
    anc = anc.select("zoom", "dz", F.expr("shiftright(dcx, CAST(dz - zoom AS INT))").alias("cx"),
                     F.expr("shiftright(dcy, CAST(dz - zoom AS INT))").alias("cy"))
    split = (anc.groupBy("zoom", "cx", "cy", "dz").agg(F.count(F.lit(1)).alias("n_sub"))
             .where(F.col("n_sub") >= 2)
             .groupBy("zoom", "cx", "cy").agg(F.min("dz").alias("split_zoom")))
    multi = pyramid.where(F.col("point_count") >= 2)
    return (multi.join(split, ["zoom", "cx", "cy"], "left")
            .select("zoom", "cx", "cy", "point_count",
                    F.coalesce(F.col("split_zoom"), F.lit(max_zoom + 1)).alias("expansion_zoom")))


def cluster_labels(cells: DataFrame) -> DataFrame:
    """Badge text of the job sum, size tier, and marker flags."""
    return cells.select("*",
                        X.cluster_badge(F.col("job_sum")).alias("badge"),
                        X.cluster_tier(F.col("point_count")).alias("tier"),
                        (F.col("point_count") >= 2).alias("is_cluster"),
                        ((F.col("point_count") == 1) & (F.col("job_sum") > 1)).alias("show_badge"))


def geojson_features(pins: DataFrame) -> DataFrame:
    """One GeoJSON Feature per pin (coordinates in lng, lat order), as JSON text."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
        F.struct(F.col("office_id"), F.col("company_name").alias("company"), "city", "country",
                 "job_count").alias("properties"))
    return pins.select("office_id", F.to_json(feature).alias("feature"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """GeoJSON text sequence: one Feature per line."""
    features.select("feature").write.mode("overwrite").text(path)
