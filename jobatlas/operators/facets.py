"""Facets and summary statistics over the posting store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SKILL_LIMIT = 50
DEFAULT_COMPANY_LIMIT = 100
SUGGEST_POOL = 60
SUGGEST_LIMIT = 8


def stats(companies: DataFrame, offices: DataFrame, jobs: DataFrame) -> DataFrame:
    """A2: one row (companies, offices, jobs, remote_jobs).

    The three tables are stacked as indicator rows and summed in a single
    aggregation: each table is scanned once (no columns but ``work_type``),
    and no join of the per-table results is needed.
    """
    zero, one = F.lit(0), F.lit(1)
    parts = [
        companies.select(one.alias("c"), zero.alias("o"), zero.alias("j"), zero.alias("r")),
        offices.select(zero.alias("c"), one.alias("o"), zero.alias("j"), zero.alias("r")),
        jobs.select(zero.alias("c"), zero.alias("o"), one.alias("j"),
                    F.when(F.col("work_type") == "remote", 1).otherwise(0).alias("r")),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.agg(F.sum("c").cast("long").alias("companies"),
                       F.sum("o").cast("long").alias("offices"),
                       F.sum("j").cast("long").alias("jobs"),
                       F.sum("r").cast("long").alias("remote_jobs"))


def skill_counts(jobs: DataFrame) -> DataFrame:
    """A3 before the top-k: (skill, n); a skill repeated inside one job counts each time.

    explode + count is a partial (map-side) aggregation, so a hot skill is
    pre-summed per task before the shuffle.
    """
    return (jobs.select(F.explode("skills").alias("skill"))
            .groupBy("skill").agg(F.count(F.lit(1)).alias("n")))


def skill_facets(jobs: DataFrame, limit: int = DEFAULT_SKILL_LIMIT) -> DataFrame:
    """A3 + L2: most frequent skills, ties broken by skill text."""
    k = limit if limit > 0 else DEFAULT_SKILL_LIMIT
    return skill_counts(jobs).orderBy(F.col("n").desc(), F.col("skill")).limit(k)


def skill_suggestions(jobs: DataFrame, typed: str, selected: list[str],
                      pool: int = SUGGEST_POOL, limit: int = SUGGEST_LIMIT) -> DataFrame:
    """from the top ``pool`` skills, those not selected that contain the typed text."""
    q = typed.strip().lower()
    top = skill_facets(jobs, pool)
    cond = ~F.col("skill").isin(list(selected)) if selected else F.lit(True)
    if q:
        cond = cond & F.contains(F.col("skill"), F.lit(q))
    return top.where(cond).orderBy(F.col("n").desc(), F.col("skill")).limit(limit)


def company_list(companies: DataFrame, limit: int = DEFAULT_COMPANY_LIMIT) -> DataFrame:
    """L3: companies by name (binary collation), then id."""
    k = limit if limit > 0 else DEFAULT_COMPANY_LIMIT
    return companies.orderBy(F.col("name"), F.col("id")).limit(k)


def company_lookup(companies: DataFrame, requests: DataFrame, key: str = "company_id") -> DataFrame:
    """F11 in batch form: the company row for every requested id (unknown ids drop out)."""
    ids = requests.select(F.col(key).alias("id")).distinct()
    return companies.join(ids, "id", "left_semi")
