"""Registered data-quality queries (Q1-Q4) and lenient JSON field parsing (S8 over ``events.props``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import facets
from ..operators import quality as Q
from ..sources import tables as T
from .registry import register


@register("dq_unique", T.with_views("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM jobs
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""", "jobs"))
def q_dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_keys(T.jobs(spark, sf_dir), ["l_orderkey", "l_linenumber"])


# (rule, child table, fk, parent table, pk)
FK_RULES = (
    ("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem.l_partkey", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem.l_suppkey", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer.c_nationkey", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("labels.doc_id", "labels", "doc_id", "documents", "doc_id"),
    # holds for some rows only: not every document is labelled
    ("documents.doc_id", "documents", "doc_id", "labels", "doc_id"),
)


@register("dq_orphans", "\nUNION ALL\n".join(
    f"SELECT '{r}' AS rule, CAST({fk} AS BIGINT) AS key FROM {c} WHERE {fk} IS NOT NULL "
    f"AND {fk} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)" for r, c, fk, p, pk in FK_RULES))
def q_dq_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for rule, child, fk, parent, pk in FK_RULES:
        o = Q.orphans(T.read_table(spark, sf_dir, child), fk, T.read_table(spark, sf_dir, parent), pk)
        parts.append(o.select(F.lit(rule).alias("rule"), F.col(fk).cast("long").alias("key")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("dq_domain", T.with_views("""SELECT rule, n_violations FROM (SELECT
    count(*) FILTER (WHERE work_type IS NULL OR work_type NOT IN ('remote', 'onsite', 'hybrid')) AS work_type_domain,
    count(*) FILTER (WHERE title IS NULL) AS title_not_null,
    count(*) FILTER (WHERE skills IS NULL) AS skills_not_null,
    count(*) FILTER (WHERE office_id IS NULL) AS office_not_null FROM (SELECT
        CASE WHEN l_linenumber = 3 THEN 'contract' WHEN l_linenumber <> 4 THEN work_type END AS work_type,
        nullif(title, (SELECT min(title) FROM jobs)) AS title, CASE WHEN l_linenumber <> 5 THEN skills END AS skills,
        nullif(office_id, 1) AS office_id FROM jobs))
UNPIVOT (n_violations FOR rule IN (work_type_domain, title_not_null, skills_not_null, office_not_null))""", "jobs"))
def q_dq_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with holes punched into them, so that every rule has violations to count."""
    j, line = T.jobs(spark, sf_dir), F.col("l_linenumber")
    least = j.agg(F.min("title").alias("t"))
    holed = j.join(F.broadcast(least), F.col("title") == F.col("t"), "left").withColumns({
        "work_type": F.when(line == 3, "contract").when(line != 4, F.col("work_type")),
        "title": F.when(F.col("t").isNull(), F.col("title")),
        "skills": F.when(line != 5, F.col("skills")), "office_id": F.nullif("office_id", F.lit(1).cast("long"))})
    return Q.domain_violations(holed)


@register("cascade_delete", T.with_views("""WITH gone AS (SELECT id FROM companies WHERE region IN
        (SELECT r_name FROM region WHERE r_regionkey = 0)),
o AS (SELECT * FROM offices WHERE company_id NOT IN (SELECT id FROM gone))
SELECT (SELECT count(*) FROM companies WHERE id NOT IN (SELECT id FROM gone)) AS companies,
       (SELECT count(*) FROM o) AS offices,
       (SELECT count(*) FROM jobs WHERE office_id IN (SELECT id FROM o)) AS jobs,
       (SELECT count(*) FROM jobs WHERE office_id IN (SELECT id FROM o) AND work_type = 'remote') AS remote_jobs""",
    "companies", "offices", "jobs"))
def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, j = T.companies(spark, sf_dir), T.offices(spark, sf_dir), T.jobs(spark, sf_dir)
    r = T.read_table(spark, sf_dir, "region").where(F.col("r_regionkey") == 0)
    gone = c.join(r, c.region == r.r_name, "left_semi").select("id")
    c2, o2, j2 = Q.cascade_delete(c, o, j, gone)
    return facets.stats(c2, o2, j2)


@register("props_json", """SELECT event_id, event_type, json_extract_string(props, '$.k') AS k_text,
    coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events""")
def q_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read_table(spark, sf_dir, "events")
    k = F.from_json("props", "k string")["k"]
    return e.select("event_id", "event_type", k.alias("k_text"), X.lenient_int(k).alias("k"))
