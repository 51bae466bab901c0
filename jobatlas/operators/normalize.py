"""Whole-row normaliser (P17) and the incomplete-record drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import NORMALIZED_COLUMNS, SEQ_COLUMNS


def normalize(raw: DataFrame, dictionary=X.KNOWN_SKILLS) -> DataFrame:
    """RawJob rows -> normalised postings (+ the sequence columns that order a run).

    Pure row-wise projection in ``select`` steps, so that what several outputs or branches read (the tag-free
    description, the resolved city/country, the seniority marker, the trimmed date) is computed once.
    """
    city0, country0 = X.utrim(X.null_to_blank(F.col("city"))), X.utrim(X.null_to_blank(F.col("country")))
    fallback = (city0 == "") & (country0 == "") & (X.null_to_blank(F.col("location_raw")) != "")
    parsed = X.split_location(F.col("location_raw"))
    seq = [c for c in SEQ_COLUMNS if c in raw.columns]
    step1 = raw.select(
        X.clean_company("company_name").alias("company_name"),
        X.utrim(X.null_to_blank(F.col("company_logo"))).alias("company_logo"),
        F.when(fallback, parsed["city"]).otherwise(city0).alias("city"),
        F.when(fallback, parsed["country"]).otherwise(country0).alias("country"),
        X.clean_title("title").alias("title"),
        F.col("title").alias("_title_raw"),
        X.strip_html(X.null_to_blank(F.col("description"))).alias("_desc"),
        X.utrim(X.null_to_blank(F.col("posted_at"))).alias("_posted"),
        "skills_raw", "experience_raw", "work_type_raw", "location_raw",
        "salary_min", "salary_max", "salary_currency", "source", "source_url", *seq)
    step2 = step1.withColumns({
        "_low": X.lowered_text("_desc"), "_marker": X.experience_marker("_title_raw", "experience_raw", "_desc"),
        "_hay": X.work_type_text("work_type_raw", "location_raw", "_desc")})
    step3 = step2.withColumn("_marker", X.folded_marker("_marker"))
    out = step3.select(
        "company_name", "company_logo", "city", "country",
        X.location_key("city", "country").alias("location_key"),
        "title",
        X.normalize_skills("skills_raw", None, dictionary, F.col("_low")).alias("skills"),
        F.coalesce(X.canonical_marker("_marker"), F.lit("")).alias("experience_level"),
        X.work_type_of("_hay").alias("work_type"),
        X.nil_if_zero("salary_min").alias("salary_min"),
        X.nil_if_zero("salary_max").alias("salary_max"),
        X.clean_currency("salary_currency").alias("salary_currency"),
        X.parse_trimmed_date("_posted").alias("posted_date"),
        "source", X.null_to_blank(F.col("source_url")).alias("source_url"),
        X.dedup_hash("company_name", "title", "city", "country").alias("dedup_hash"),
        *seq)
    return out.select(*NORMALIZED_COLUMNS, *seq)


def drop_incomplete(norm: DataFrame) -> DataFrame:
    """postings without a company or a title cannot become pins."""
    return norm.where((F.col("company_name") != "") & (F.col("title") != ""))
