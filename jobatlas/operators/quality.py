"""Declared table constraints as data-quality jobs (Q1-Q4).

Each check is one aggregation or anti-join over whole tables; none gathers a
group in one place (uniqueness is a partial count per key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import WORK_TYPES


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q1: keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Q2: child rows whose foreign key has no parent (NULL keys are not orphans)."""
    return child.where(F.col(fk).isNotNull()).join(
        parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def job_domain_checks(jobs: DataFrame) -> dict[str, Column]:
    """Q3: per-row violation flags of the jobs table's declared domain."""
    return {
        "work_type_domain": F.col("work_type").isNull() | ~F.col("work_type").isin(*WORK_TYPES),
        "title_not_null": F.col("title").isNull(),
        "skills_not_null": F.col("skills").isNull(),
        "office_not_null": F.col("office_id").isNull(),
    }


def domain_violations(jobs: DataFrame) -> DataFrame:
    """Q3: (rule, n_violations) for every check, zero counts included, in one pass."""
    checks = job_domain_checks(jobs)
    counts = jobs.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    stack = ", ".join(f"'{k}', `{k}`" for k in checks)
    return counts.select(F.expr(f"stack({len(checks)}, {stack}) AS (rule, n_violations)"))


def apply_defaults(jobs: DataFrame) -> DataFrame:
    """Q3 defaults: empty skills list, work type onsite."""
    return (jobs.withColumn("skills", F.coalesce(F.col("skills"), F.array().cast("array<string>")))
            .withColumn("work_type", F.coalesce(F.col("work_type"), F.lit("onsite"))))


def cascade_delete(companies: DataFrame, offices: DataFrame, jobs: DataFrame,
                   deleted_company_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q4: delete companies -> their offices -> those offices' jobs (anti-join chain)."""
    gone = deleted_company_ids.select(F.col("id")).distinct()
    c = companies.join(gone, "id", "left_anti")
    o = offices.join(gone.select(F.col("id").alias("company_id")), "company_id", "left_anti")
    gone_offices = offices.join(gone.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    j = jobs.join(gone_offices.select(F.col("id").alias("office_id")), "office_id", "left_anti")
    return c, o, j


def store_checks(companies: DataFrame, offices: DataFrame, jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Q1 + Q2 over a posting store: (rule, key, n) for every violation, empty when clean.

    Keys are rendered as text so all rules share one result schema.
    """
    def dup(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
        return duplicate_keys(df, keys).select(F.lit(rule).alias("rule"),
                                               F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
                                               F.col("n"))

    def orphan(child: DataFrame, fk: str, parent: DataFrame, pk: str, rule: str) -> DataFrame:
        return orphans(child, fk, parent, pk).groupBy(fk).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(rule).alias("rule"), F.col(fk).cast("string").alias("key"), F.col("n"))

    parts = [
        dup(companies, ["name"], "companies.name unique"),
        dup(companies, ["id"], "companies.id unique"),
        dup(offices, ["company_id", "city", "country"], "offices key unique"),
        dup(offices, ["id"], "offices.id unique"),
        dup(jobs, ["dedup_hash"], "jobs.dedup_hash unique"),
        dup(jobs, ["id"], "jobs.id unique"),
        dup(cache, ["location_key"], "geocode_cache.location_key unique"),
        orphan(offices, "company_id", companies, "id", "offices.company_id -> companies.id"),
        orphan(jobs, "office_id", offices, "id", "jobs.office_id -> offices.id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
