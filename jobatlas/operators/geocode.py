"""Geocoding by location key against a cache and a gazetteer.

The network geocoder is replaced by a gazetteer table ``(location_key, lat, lng,
rank)`` supplied by the caller (e.g. parsed provider responses, G3).  Plan:

    records --distinct keys (partial agg)--> keys
    cache and gazetteer semi keys -> the rows of this run's keys
    keys left join both           -> one row per key with its coordinates and where they came from:
                                     cache hits, gazetteer rows (merged into the cache, K4) and
                                     unresolved keys (the work list; retried next run, never cached)
    records left join coordinates -> placed records, and those without coordinates counted as failures (G5)

The record-side join is on the key; a key that holds a third of all records
(e.g. "remote") is a skewed partition that AQE's skew-join splitting handles,
and the coords side holds one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def unique_keys(records: DataFrame, key: str = "location_key", display: str = "display") -> DataFrame:
    """G1: one lookup per distinct key, with one display string and the number of records."""
    return records.groupBy(key).agg(F.min(display).alias("display"), F.count(F.lit(1)).alias("n_records"))


def first_result(gazetteer: DataFrame, key: str = "location_key", rank: str = "rank") -> DataFrame:
    """The first provider result per key (lowest rank)."""
    best = F.min_by(F.struct("lat", "lng"), F.col(rank)) if rank in gazetteer.columns \
        else F.min(F.struct("lat", "lng"))
    return gazetteer.groupBy(key).agg(best.alias("_c")).select(key, F.col("_c.lat").alias("lat"),
                                                              F.col("_c.lng").alias("lng"))


# Provider response shapes and the leading-float rule of a "%f" scan
# (leading blanks skipped, the longest decimal prefix read, trailing text ignored).
GOOGLE_RESPONSE = ("struct<status:string,results:array<struct<geometry:struct<"
                   "location:struct<lat:double,lng:double>>>>>")
NOMINATIM_RESPONSE = "array<struct<lat:string,lon:string>>"
LEADING_FLOAT = r"^\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)"


def scan_float(c: Column) -> Column:
    """The number a "%f" scan reads from the start of a string; NULL if none."""
    return F.nullif(F.regexp_extract(c, LEADING_FLOAT, 1), F.lit("")).try_cast("double")


def provider_rows(responses: DataFrame, provider: str) -> DataFrame:
    """Landed provider responses (location_key, value JSON) -> gazetteer rows.

    Only the first result of a response counts.  ``google``: the response must have
    status ``OK`` and at least one result; ``results[0].geometry.location`` gives
    the point (an absent location decodes to 0, 0).  ``nominatim``: ``[0].lat`` and
    ``[0].lon`` are text, both must start with a number.  A response that is not
    JSON, or fails these rules, gives no row: the key stays unresolved and is not
    cached, so the next run asks again.  Extra columns of ``responses`` (e.g. a
    fetch order used as ``rank``) are kept.
    """
    extra = [c for c in responses.columns if c not in ("location_key", "value")]
    if provider == "google":
        doc = F.from_json("value", GOOGLE_RESPONSE)
        first = F.try_element_at(doc["results"], F.lit(1))
        ok = (doc["status"] == "OK") & first.isNotNull()
        lat = F.coalesce(first["geometry"]["location"]["lat"], F.lit(0.0))
        lng = F.coalesce(first["geometry"]["location"]["lng"], F.lit(0.0))
    elif provider == "nominatim":
        first = F.try_element_at(F.from_json("value", NOMINATIM_RESPONSE), F.lit(1))
        lat, lng = scan_float(first["lat"]), scan_float(first["lon"])
        ok = lat.isNotNull() & lng.isNotNull()
    else:
        raise ValueError(provider)
    out = responses.select("location_key", *extra, F.when(ok, lat).alias("lat"), F.when(ok, lng).alias("lng"))
    return out.where(F.col("lat").isNotNull())


def resolve(keys: DataFrame, cache: DataFrame, gazetteer: DataFrame, key: str = "location_key") -> DataFrame:
    """``keys`` (distinct) with lat, lng and ``resolved_by`` ('cache', 'gazetteer' or NULL).

    ``cache`` columns: (location_key, latitude, longitude).  The cache and the gazetteer
    keep growing while a run's keys are few: both are cut down to this run's keys while
    they are scanned (the planner broadcasts the keys if they are small), so that the first
    result is chosen among rows that are asked for.  ``keys`` is read in every branch: give a
    written table (``session.staged``) where it comes from a scan of records.
    """
    asked = keys.select(key)
    c = cache.join(asked, key, "left_semi").select(key, F.struct("latitude", "longitude").alias("_c"))
    g = first_result(gazetteer.join(asked, key, "left_semi"), key).select(key, F.struct("lat", "lng").alias("_g"))
    by = F.when(F.col("_c").isNotNull(), "cache").when(F.col("_g").isNotNull(), "gazetteer")
    return keys.join(c, key, "left").join(g, key, "left").select(
        *keys.columns, F.when(F.col("_c").isNotNull(), F.col("_c.latitude")).otherwise(F.col("_g.lat")).alias("lat"),
        F.when(F.col("_c").isNotNull(), F.col("_c.longitude")).otherwise(F.col("_g.lng")).alias("lng"),
        by.alias("resolved_by"))


def coords_of(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("resolved_by").isNotNull())


def unresolved_of(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("resolved_by").isNull()).drop("lat", "lng", "resolved_by")


def new_cache_of(resolved: DataFrame, key: str = "location_key") -> DataFrame:
    return resolved.where(F.col("resolved_by") == "gazetteer").select(
        key, F.col("lat").alias("latitude"), F.col("lng").alias("longitude"))


def locate(records: DataFrame, coords: DataFrame, key: str = "location_key") -> DataFrame:
    """Every record with its key's lat, lng and ``resolved_by`` (NULL where the key has none)."""
    return records.join(coords.select(key, "lat", "lng", "resolved_by"), key, "left")


def placed_of(located: DataFrame) -> DataFrame:
    return located.where(F.col("resolved_by").isNotNull())


def failed_of(located: DataFrame) -> DataFrame:
    return located.where(F.col("resolved_by").isNull()).drop("lat", "lng", "resolved_by")


def with_location(df: DataFrame, city: str = "city", country: str = "country") -> DataFrame:
    """Add location_key (P10) and display."""
    return df.withColumn("location_key", X.location_key(city, country)) \
             .withColumn("display", X.geocode_display(city, country))
