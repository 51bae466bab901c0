"""Readers for the landed tables and the companies / offices / jobs views over them.

The driver's test tables are TPC-H shaped.  The views below present them in the
shape of the posting store (companies 1:N offices 1:N jobs) so every read
operator runs over whole tables whose size grows with the scale factor:

* companies  <- nation x region      (fixed 25-row dimension: broadcast is size-safe)
* offices    <- supplier x nation    (grows with the data; join strategy left to AQE)
* jobs       <- lineitem x part      (the fact table; part grows too, no forced broadcast)

Only ``nation``/``region`` are broadcast explicitly: their row count is fixed by
definition.  Everything else is left to the planner, whose broadcast decision
is guarded by ``spark.sql.autoBroadcastJoinThreshold`` and AQE runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_SCHEMAS: dict[str, object] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table reader; the schema is inferred from the footers once per path and
    then passed explicitly, so repeated plan construction does not re-read footers."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[path] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(n.n_nationkey.alias("id"), n.n_name.alias("name"), r.r_name.alias("region"),
                    F.when(n.n_nationkey % 3 != 0, F.concat(F.lit("logo-"), F.lower(n.n_name))).alias("logo_url")))


def grid_lat(key: Column) -> Column:
    """Deterministic latitude spread of an integer key over [-80, 80]."""
    return (key * 37 % 161).cast("double") - 80.0


def grid_lng(key: Column) -> Column:
    """Deterministic longitude spread of an integer key over [-179, 179]."""
    return (key * 73 % 359).cast("double") - 179.0


def offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
            .select(s.s_suppkey.alias("id"), s.s_nationkey.alias("company_id"),
                    s.s_name.alias("city"), n.n_name.alias("country"),
                    F.when(s.s_acctbal >= 0, F.concat(F.lit("street "), s.s_suppkey.cast("string"))).alias("address"),
                    grid_lat(s.s_suppkey).alias("lat"), grid_lng(s.s_suppkey).alias("lng")))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem, dressed as a job posting.

    (l_orderkey, l_linenumber, l_partkey, l_suppkey) identifies a row;
    (l_orderkey, l_linenumber) alone does not.
    """
    li = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part")
    price = F.floor(li.l_extendedprice).cast("int")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .select(
                li.l_orderkey, li.l_linenumber, li.l_partkey,
                li.l_suppkey.alias("office_id"),
                p.p_name.alias("title"),
                F.lower(p.p_type).alias("kind"),
                F.concat(F.split(p.p_name, " "), F.array(F.lower(p.p_type))).alias("skills"),
                F.when(li.l_returnflag == "A", "remote").when(li.l_returnflag == "N", "onsite")
                 .otherwise("hybrid").alias("work_type"),
                F.when(p.p_size >= 40, "senior").when(p.p_size >= 25, "mid")
                 .when(p.p_size >= 10, "junior").alias("experience_level"),
                F.when(li.l_discount != 0, price).alias("salary_min"),
                F.when(li.l_tax != 0, price + 5000).alias("salary_max"),
                F.when(li.l_returnflag != "R", F.lit("USD")).alias("salary_currency"),
                F.when(li.l_linestatus == "F", "adzuna").otherwise("remotive").alias("source"),
                li.l_shipdate.cast("date").alias("posted_date"),
                F.when(li.l_quantity > 10, F.concat(F.lit("https://jobs.example/"), li.l_orderkey.cast("string")))
                 .alias("source_url"),
                li.l_shipdate.cast("timestamp").alias("created_at"),
                (li.l_shipdate + F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("updated_at"),
            ))


# DuckDB text of the same three views, used as CTEs by the oracle SQL.
ORACLE_VIEWS = {
    "companies": """SELECT n_nationkey AS id, n_name AS name, r_name AS region,
        CASE WHEN n_nationkey % 3 <> 0 THEN 'logo-' || lower(n_name) END AS logo_url
        FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "offices": """SELECT s_suppkey AS id, s_nationkey AS company_id, s_name AS city, n_name AS country,
        CASE WHEN s_acctbal >= 0 THEN 'street ' || CAST(s_suppkey AS VARCHAR) END AS address,
        CAST((s_suppkey*37)%161 AS DOUBLE)-80.0 AS lat, CAST((s_suppkey*73)%359 AS DOUBLE)-179.0 AS lng
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "jobs": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS office_id, p_name AS title,
        lower(p_type) AS kind,
        list_concat(string_split(p_name, ' '), [lower(p_type)]) AS skills,
        CASE l_returnflag WHEN 'A' THEN 'remote' WHEN 'N' THEN 'onsite' ELSE 'hybrid' END AS work_type,
        CASE WHEN p_size >= 40 THEN 'senior' WHEN p_size >= 25 THEN 'mid'
             WHEN p_size >= 10 THEN 'junior' END AS experience_level,
        CASE WHEN l_discount = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS INT) END AS salary_min,
        CASE WHEN l_tax = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS INT) + 5000 END AS salary_max,
        CASE WHEN l_returnflag <> 'R' THEN 'USD' END AS salary_currency,
        CASE l_linestatus WHEN 'F' THEN 'adzuna' ELSE 'remotive' END AS source,
        CAST(l_shipdate AS DATE) AS posted_date, CAST(l_shipdate AS TIMESTAMP) AS created_at,
        CASE WHEN l_quantity > 10 THEN 'https://jobs.example/' || CAST(l_orderkey AS VARCHAR) END AS source_url,
        CAST(l_shipdate AS TIMESTAMP) + INTERVAL 1 DAY AS updated_at
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named oracle views as CTEs."""
    ctes = ",\n".join(f"{n} AS ({ORACLE_VIEWS[n]})" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"
