"""Self-posted jobs and dashboard offices as batch jobs.

Submissions are validated with column predicates, the ownership check is a join
of each submission's office id against the offices table (one row per office,
so the join never multiplies rows), and accepted rows get the same fingerprint
as ingested postings so a later K3 merge treats re-posts as updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import WORK_TYPES

# The source name of self-posted jobs and the reject messages.
SELF_SOURCE = "self-posted"
REJECT_REQUIRED = "title and office_id are required"
REJECT_OWNER = "office does not belong to your company"
REJECT_LOCATION = "city or country is required"
REJECT_GEOCODE = "could not geocode that location"


def job_fields(s: DataFrame) -> list[Column]:
    wt = X.fold_lower(X.utrim(X.null_to_blank(F.col("work_type"))))
    skills = F.filter(F.transform(F.coalesce(F.col("skills"), F.array().cast("array<string>")),
                                  lambda x: X.fold_lower(X.utrim(x))), lambda x: x != "")
    return [X.utrim(X.null_to_blank(F.col("title"))).alias("clean_title"),
            skills.alias("clean_skills"),
            X.utrim(X.null_to_blank(F.col("experience_level"))).alias("clean_experience"),
            F.when(wt.isin(*WORK_TYPES), wt).otherwise("onsite").alias("clean_work_type"),
            X.clean_currency(F.col("salary_currency")).alias("clean_currency"),
            X.utrim(X.null_to_blank(F.col("source_url"))).alias("clean_source_url"),
            F.lit(SELF_SOURCE).alias("source")]


def self_posted(submissions: DataFrame, offices: DataFrame, companies: DataFrame) -> DataFrame:
    """Every submission with ``status`` accepted/rejected, ``reason`` and,
    when accepted, the posting fields and its ``dedup_hash``.

    ``submissions``: sub_id, company_id, office_id, title, skills, experience_level,
    work_type, salary_min, salary_max, salary_currency, source_url.
    """
    o = offices.select(F.col("id").alias("office_id"), F.col("company_id").alias("_o_company"),
                       F.col("city").alias("_o_city"), F.col("country").alias("_o_country"))
    c = companies.select(F.col("id").alias("_c_id"), F.col("name").alias("_c_name"))
    s = submissions.select("*", *job_fields(submissions))
    j = s.join(o, "office_id", "left").join(c, F.col("company_id") == F.col("_c_id"), "left")
    required = (F.col("clean_title") != "") & F.coalesce(F.col("office_id") != 0, F.lit(False))
    owned = F.coalesce(F.col("_o_company") == F.col("company_id"), F.lit(False))
    status = F.when(required & owned, "accepted").otherwise("rejected")
    reason = F.when(~required, REJECT_REQUIRED).when(~owned, REJECT_OWNER)
    fp = X.dedup_hash(F.col("_c_name"), F.col("title"), F.col("_o_city"), F.col("_o_country"))
    return j.select("sub_id", "company_id", "office_id", status.alias("status"), reason.alias("reason"),
                    "clean_title", "clean_skills", "clean_experience", "clean_work_type",
                    "salary_min", "salary_max", "clean_currency", "clean_source_url", "source",
                    F.when(required & owned, fp).alias("dedup_hash"))


def dashboard_offices(requests: DataFrame, coords: DataFrame | None = None) -> DataFrame:
    """K6: office requests (company_id, city, country, address, lat, lng); explicit
    coordinates win, otherwise the geocoded coordinates of the location key;
    both blank city and country are rejected."""
    r = requests.select("*", X.utrim(X.null_to_blank(F.col("city"))).alias("_city"),
                        X.utrim(X.null_to_blank(F.col("country"))).alias("_country"))
    r = r.withColumn("location_key", X.location_key("_city", "_country"))
    if coords is not None:
        r = r.join(coords.select("location_key", F.col("lat").alias("_glat"), F.col("lng").alias("_glng")),
                   "location_key", "left")
    else:
        r = r.withColumn("_glat", F.lit(None).cast("double")).withColumn("_glng", F.lit(None).cast("double"))
    explicit = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    ok_loc = (F.col("_city") != "") | (F.col("_country") != "")
    lat = F.when(explicit, F.col("lat")).otherwise(F.col("_glat"))
    lng = F.when(explicit, F.col("lng")).otherwise(F.col("_glng"))
    reason = F.when(~ok_loc, REJECT_LOCATION).when(lat.isNull(), REJECT_GEOCODE)
    keep = [c for c in requests.columns if c not in ("city", "country", "lat", "lng")]
    return r.select(*keep, "location_key", F.col("_city").alias("city"), F.col("_country").alias("country"),
                    F.when(ok_loc, lat).alias("lat"), F.when(ok_loc, lng).alias("lng"), reason.alias("reason"))
