"""Schemas of the posting data model."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_JOB_DDL = (
    "source string, source_id string, source_url string, company_name string, company_logo string, "
    "location_raw string, city string, country string, title string, description string, "
    "skills_raw array<string>, experience_raw string, work_type_raw string, "
    "salary_min bigint, salary_max bigint, salary_currency string, posted_at string, "
    "source_ord int, query_ord int, page_ord int, pos int"
)
RAW_JOB_COLUMNS = tuple(f.split(" ")[0] for f in RAW_JOB_DDL.split(", "))

NORMALIZED_COLUMNS = (
    "company_name", "company_logo", "city", "country", "location_key", "title", "skills",
    "experience_level", "work_type", "salary_min", "salary_max", "salary_currency",
    "posted_date", "source", "source_url", "dedup_hash",
)
SEQ_COLUMNS = ("source_ord", "query_ord", "page_ord", "pos")

COMPANIES_DDL = "id bigint, name string, website string, logo_url string, created_at timestamp"
OFFICES_DDL = ("id bigint, company_id bigint, city string, country string, address string, "
               "lat double, lng double, created_at timestamp")
JOBS_DDL = ("id bigint, office_id bigint, title string, skills array<string>, experience_level string, "
            "work_type string, salary_min bigint, salary_max bigint, salary_currency string, posted_date date, "
            "source string, source_url string, dedup_hash string, created_at timestamp, updated_at timestamp")
GEOCODE_CACHE_DDL = "location_key string, latitude double, longitude double, created_at timestamp"

WORK_TYPES = ("remote", "onsite", "hybrid")


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
