"""Registered feed-adapter queries (S1-S12, L6, P27) and feed search / cap.

Landed payloads are produced from the whole ``part`` table: items are rendered
per source with that feed's field names, grouped into pages of at most 50 items
(``p_partkey div 50``, so no page grows with the data) and written out as JSON
text with ``to_json``.  The adapters then parse that text like any landed file.
The oracle states the expected RawJob rows straight from ``part``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import feeds as FD
from ..sources import tables as T
from . import sqltext as S
from .registry import register

PAGE = 50


def _part_items(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """The feed items of ``part``; ``parts`` deals whole pages out to that many partitions first."""
    p = T.read_table(spark, sf_dir, "part").withColumn("page_ord", (F.col("p_partkey") / PAGE).cast("long").cast("int"))
    if parts:
        p = p.repartition(parts, "page_ord")
    ps = F.col("p_size")
    sal = F.floor(F.col("p_retailprice") * 100).cast("long")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return p.select(
        F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
        "page_ord",
        F.when(ps <= 2, " ").otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("title_raw"),
        F.when(ps == 3, "").otherwise(F.concat(F.col("p_brand"), F.lit("  "))).alias("company_raw"),
        F.concat(F.lit("<p>Build "), F.col("p_name"), F.lit(" with "), F.lower("p_type"),
                 F.lit(" tools</p>")).alias("descr"),
        F.when(ps % 5 == 0, "Remote").when(ps % 5 == 1, "")
         .when(ps % 5 == 2, F.concat(F.upper("p_name"), F.lit(", "), F.col("p_type")))
         .when(ps % 5 == 3, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")))
         .otherwise(F.concat(F.col("p_name"), F.lit(", X, "), F.col("p_type"))).alias("loc_raw"),
        F.array(F.col("p_type"), F.lower("p_brand"),
                F.concat(F.lit(" "), F.split("p_name", " ").getItem(0), F.lit("."))).alias("tags"),
        F.concat(F.lit("2024-"), pad(ps % 12 + 1), F.lit("-"), pad(ps % 28 + 1),
                 F.lit("T08:00:00Z")).alias("dt"),
        F.concat(pad(ps % 28 + 1), F.lit("."), pad(ps % 12 + 1), F.lit(".2024")).alias("dt_dots"),
        sal.alias("sal"),
        F.when(ps % 4 == 0, "").when(ps % 4 == 1, sal.cast("string"))
         .when(ps % 4 == 2, F.concat(sal.cast("string"), F.lit(".75"))).otherwise("n/a").alias("sal_txt"),
        F.element_at(F.array(*[F.lit(c) for c in FD.ADZUNA_COUNTRIES]), (ps % 8 + 1).cast("int")).alias("cc"),
    )


def _item(source: str) -> Column:
    c = F.col
    url = F.concat(F.lit("https://jobs.example/"), c("k").cast("string"))
    if source == "remoteok":
        return F.struct(F.when(c("k") % PAGE == 0, F.lit("Terms of use")).alias("legal"),
                        c("k").cast("string").alias("id"), url.alias("url"),
                        c("company_raw").alias("company"),
                        F.concat(F.lit("logo-"), c("p_brand")).alias("company_logo"),
                        c("title_raw").alias("position"), c("descr").alias("description"),
                        c("loc_raw").alias("location"), c("tags").alias("tags"), c("dt").alias("date"),
                        c("sal_txt").alias("salary_min"),
                        (c("sal") + 5000).cast("double").alias("salary_max"))
    if source == "remotive":
        return F.struct(c("k").alias("id"), url.alias("url"), c("title_raw").alias("title"),
                        c("company_raw").alias("company_name"),
                        F.concat(F.lit("logo-"), c("p_brand")).alias("company_logo"),
                        F.when(c("p_size") % 2 == 0, c("p_type")).otherwise("").alias("category"),
                        c("tags").alias("tags"), c("loc_raw").alias("candidate_required_location"),
                        c("descr").alias("description"), c("dt").alias("publication_date"))
    if source == "arbeitnow":
        return F.struct(F.concat(F.lower("p_brand"), F.lit("-"), c("k").cast("string")).alias("slug"),
                        c("company_raw").alias("company_name"), c("title_raw").alias("title"),
                        c("descr").alias("description"), (c("p_size") % 2 == 0).alias("remote"),
                        url.alias("url"), c("tags").alias("tags"), c("loc_raw").alias("location"))
    if source == "jobicy":
        geo = F.when(c("p_size") % 4 == 0, "").when(c("p_size") % 4 == 1, "Worldwide").otherwise(c("loc_raw"))
        return F.struct(c("k").alias("id"), url.alias("url"), c("title_raw").alias("jobTitle"),
                        c("company_raw").alias("companyName"), geo.alias("jobGeo"),
                        c("descr").alias("jobExcerpt"), c("tags").alias("jobIndustry"),
                        c("dt").alias("pubDate"))
    if source == "adzuna":
        area = (F.when(c("p_size") % 3 == 0, F.array().cast("array<string>"))
                .when(c("p_size") % 3 == 1, F.array(c("p_type")))
                .otherwise(F.array(c("p_type"), c("p_brand"), c("p_name"))))
        label = F.when(c("p_size") % 2 == 0, F.concat(F.upper("p_type"), F.lit(" Jobs"))).otherwise("  ")
        return F.struct(c("k").cast("string").alias("id"), url.alias("redirect_url"),
                        c("title_raw").alias("title"), c("descr").alias("description"),
                        c("dt").alias("created"),
                        F.when(c("p_size") % 3 != 0, c("p_retailprice") * 100).alias("salary_min"),
                        (c("p_retailprice") * 100 + 5000.5).alias("salary_max"),
                        F.when(c("p_size") % 2 == 0, "full_time").otherwise("part_time").alias("contract_time"),
                        F.struct(c("company_raw").alias("display_name")).alias("company"),
                        F.struct(c("loc_raw").alias("display_name"), area.alias("area")).alias("location"),
                        F.struct(label.alias("label")).alias("category"))
    if source == "jooble":
        typ = (F.when(c("p_size") % 3 == 0, "Full-time").when(c("p_size") % 3 == 1, "Remote")
               .otherwise("Hybrid office"))
        return F.struct(c("title_raw").alias("title"), c("loc_raw").alias("location"),
                        c("descr").alias("snippet"), typ.alias("type"), url.alias("link"),
                        c("company_raw").alias("company"), c("dt_dots").alias("updated"), c("k").alias("id"))
    raise ValueError(source)


ENVELOPE = FD.ENVELOPES


def landed_payloads(spark: SparkSession, sf_dir: str, source: str, items: DataFrame | None = None) -> DataFrame:
    """JSON payload pages of one feed (columns: value, page_ord[, country]).
    ``items`` (from ``_part_items``) can be shared by several feeds of one plan."""
    items = _part_items(spark, sf_dir) if items is None else items
    keys = ["page_ord", "cc"] if source == "adzuna" else ["page_ord"]
    g = items.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("k"), _item(source).alias("v")))).alias("arr"))
    arr = F.transform("arr", lambda x: x["v"])
    env = ENVELOPE[source]
    value = F.to_json(arr) if env is None else F.to_json(F.struct(arr.alias(env)))
    cols = [value.alias("value"), F.col("page_ord")]
    if source == "adzuna":
        cols.append(F.col("cc").alias("country"))
    return g.select(*cols)


def _out(raw: DataFrame) -> DataFrame:
    return raw.withColumn("skills_raw", F.array_join("skills_raw", "|"))


# -- oracle ------------------------------------------------------------------------

_ITEMS_SQL = f"""SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, p_retailprice,
    CAST(p_partkey // {PAGE} AS INTEGER) AS page_ord,
    CASE WHEN p_size <= 2 THEN ' ' ELSE '  ' || p_name || ' ' END AS title_raw,
    CASE WHEN p_size = 3 THEN '' ELSE p_brand || '  ' END AS company_raw,
    '<p>Build ' || p_name || ' with ' || lower(p_type) || ' tools</p>' AS descr,
    CASE WHEN p_size % 5 = 0 THEN 'Remote' WHEN p_size % 5 = 1 THEN ''
         WHEN p_size % 5 = 2 THEN upper(p_name) || ', ' || p_type
         WHEN p_size % 5 = 3 THEN ' ' || p_brand || ' '
         ELSE p_name || ', X, ' || p_type END AS loc_raw,
    [p_type, lower(p_brand), ' ' || split_part(p_name, ' ', 1) || '.'] AS tags,
    '2024-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '-'
        || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || 'T08:00:00Z' AS dt,
    lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0')
        || '.2024' AS dt_dots,
    CAST(floor(p_retailprice * 100) AS BIGINT) AS sal,
    {S.sql_list(FD.ADZUNA_COUNTRIES)}[p_size % 8 + 1] AS cc
FROM part"""

_URL = "'https://jobs.example/' || CAST(k AS VARCHAR)"


def _raw_sql(source: str, cols: dict, where: str = "TRUE", pos_keys: str = "page_ord",
             page_ord: str = "page_ord") -> str:
    d = {"source_id": "CAST(k AS VARCHAR)", "source_url": _URL, "company_name": S.utrim("company_raw"),
         "company_logo": "''", "location_raw": "loc_raw", "city": S.split_city("loc_raw"),
         "country": S.split_country("loc_raw"), "title": S.utrim("title_raw"), "description": "descr",
         "skills_raw": "array_to_string(tags, '|')", "experience_raw": "''", "work_type_raw": "''",
         "salary_min": "0", "salary_max": "0", "salary_currency": "''", "posted_at": "''"}
    d.update(cols)
    sel = ",\n    ".join(f"{v} AS {k}" for k, v in d.items())
    return f"""SELECT k, '{source}' AS source, {sel},
    {FD.SOURCE_ORDER.index(source)} AS source_ord, 0 AS query_ord, {page_ord} AS page_ord,
    CAST(row_number() OVER (PARTITION BY {pos_keys} ORDER BY k) - 1 AS INTEGER) AS pos
FROM items WHERE {where}"""


_JOBICY_GEO = "(CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'Worldwide' ELSE loc_raw END)"
_JOBICY_PLACELESS = f"({_JOBICY_GEO} = '' OR lower({_JOBICY_GEO}) = 'worldwide')"
_REMOTIVE_LOC = f"coalesce(nullif({S.utrim('loc_raw')}, ''), 'Remote')"
_ADZ_AREA = "(CASE WHEN p_size % 3 = 0 THEN CAST([] AS VARCHAR[]) WHEN p_size % 3 = 1 THEN [p_type] ELSE [p_type, p_brand, p_name] END)"
_CURRENCY_CASE = "CASE cc " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in FD.ADZUNA_CURRENCY.items()) + " ELSE '' END"

RAW_SQL = {
    # pos counts every item of a page (filters apply after the explode), so filters sit outside
    "remoteok": f"""SELECT * FROM ({_raw_sql("remoteok", {
        "company_logo": "'logo-' || p_brand", "work_type_raw": "'remote'",
        "salary_min": "CAST(CASE WHEN p_size % 4 IN (1, 2) THEN sal ELSE 0 END AS INTEGER)",
        "salary_max": "CAST(sal + 5000 AS INTEGER)", "posted_at": "dt"})})
        WHERE k % {PAGE} <> 0 AND title <> ''""",
    "remotive": _raw_sql("remotive", {
        "company_logo": "'logo-' || p_brand", "location_raw": _REMOTIVE_LOC,
        "city": S.split_city(_REMOTIVE_LOC), "country": S.split_country(_REMOTIVE_LOC),
        "skills_raw": "array_to_string(CASE WHEN p_size % 2 = 0 THEN list_append(tags, p_type) ELSE tags END, '|')",
        "work_type_raw": "'remote'", "posted_at": "dt"}),
    "arbeitnow": f"""SELECT * FROM ({_raw_sql("arbeitnow", {
        "source_id": "lower(p_brand) || '-' || CAST(k AS VARCHAR)",
        "work_type_raw": "CASE WHEN p_size % 2 = 0 THEN 'remote' ELSE 'onsite' END"})})
        WHERE title <> '' AND company_name <> ''""",
    "jobicy": f"""SELECT * FROM ({_raw_sql("jobicy", {
        "location_raw": _JOBICY_GEO,
        "city": f"CASE WHEN {_JOBICY_PLACELESS} THEN '' ELSE {S.split_city(_JOBICY_GEO)} END",
        "country": f"CASE WHEN {_JOBICY_PLACELESS} THEN 'Remote' ELSE {S.split_country(_JOBICY_GEO)} END",
        "work_type_raw": "'remote'", "posted_at": "dt"})}) WHERE title <> ''""",
    "adzuna": _raw_sql("adzuna", {
        "city": f"CASE WHEN len({_ADZ_AREA}) >= 2 THEN {_ADZ_AREA}[-1] WHEN len({_ADZ_AREA}) = 1 THEN '' "
                f"ELSE {S.split_city('loc_raw')} END",
        "country": f"CASE WHEN len({_ADZ_AREA}) >= 1 THEN {_ADZ_AREA}[1] ELSE {S.split_country('loc_raw')} END",
        "skills_raw": "CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE '' END",
        "work_type_raw": "CASE WHEN p_size % 2 = 0 THEN 'full_time' ELSE 'part_time' END",
        "salary_min": "CASE WHEN p_size % 3 = 0 THEN 0 ELSE CAST(trunc(p_retailprice * 100) AS INTEGER) END",
        "salary_max": "CAST(trunc(p_retailprice * 100 + 5000.5) AS INTEGER)",
        "salary_currency": _CURRENCY_CASE, "posted_at": "dt"}, pos_keys="page_ord, cc",
        page_ord=f"CAST(list_position({S.sql_list(FD.ADZUNA_COUNTRIES)}, cc) * {FD.ADZUNA_PAGE_SPAN} + page_ord AS INTEGER)"),
    "jooble": _raw_sql("jooble", {
        "work_type_raw": "CASE WHEN p_size % 3 = 0 THEN 'Full-time' WHEN p_size % 3 = 1 THEN 'Remote' "
                         "ELSE 'Hybrid office' END",
        "skills_raw": "''", "posted_at": "dt_dots"}),
}


def _feed_body(source: str) -> str:
    return f"SELECT * EXCLUDE (k) FROM ({RAW_SQL[source]})"


def _feed_oracle(source: str) -> str:
    return f"WITH items AS ({_ITEMS_SQL})\n{_feed_body(source)}"


def _make_feed_query(source: str) -> None:
    @register(f"feeds_{source}", _feed_oracle(source))
    def _q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _out(FD.ADAPTERS[source](landed_payloads(spark, sf_dir, source)))


for _s in FD.SOURCE_ORDER:
    _make_feed_query(_s)


@register("feeds_union", "WITH items AS (" + _ITEMS_SQL + ")\n" + "\nUNION ALL\n".join(
    _feed_body(s) for s in FD.SOURCE_ORDER))
def q_feeds_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _part_items(spark, sf_dir)
    frames = {s: FD.ADAPTERS[s](landed_payloads(spark, sf_dir, s, items)) for s in FD.SOURCE_ORDER}
    return _out(FD.union_sources(frames))


# -- search and per-query cap over documents as a client-side feed ----------------------

SEARCH_TERMS = ("the", "und", "que", "", "ment", "src1", "EN")
CAP = 7


def _doc_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.read_table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.substring_index("text", "\n", 1).alias("title"),
                    F.col("text").alias("description"), F.array("lang", "source").alias("skills_raw"),
                    F.lit(0).alias("page_ord"), F.col("doc_id").alias("pos"))


_TERMS_SQL = "(VALUES " + ", ".join(f"({i}, {S.q(t)})" for i, t in enumerate(SEARCH_TERMS)) + ") q(query_ord, kw)"
_MATCH_SQL = f"""SELECT doc_id, source, query_ord FROM (SELECT doc_id, source,
    split_part(text, chr(10), 1) AS title, text, [lang, source] AS tags FROM documents) d
JOIN {_TERMS_SQL} ON (kw = '' OR contains(lower(coalesce(title, '')), lower(kw))
    OR contains(lower(coalesce(text, '')), lower(kw))
    OR len(list_filter(tags, lambda t: contains(lower(t), lower(kw)))) > 0)"""


@register("feed_keyword_join", _MATCH_SQL)
def q_feed_keyword_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = FD.queries_frame(spark, SEARCH_TERMS, CAP)
    return FD.apply_queries(_doc_feed(spark, sf_dir), qs).select("doc_id", "source", "query_ord")


@register("feed_cap", f"""SELECT doc_id, source, query_ord FROM (SELECT *, row_number() OVER (
    PARTITION BY source, query_ord ORDER BY doc_id) AS rn FROM ({_MATCH_SQL})) WHERE rn <= {CAP}""")
def q_feed_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = FD.queries_frame(spark, SEARCH_TERMS, CAP)
    hits = FD.apply_queries(_doc_feed(spark, sf_dir), qs)
    return FD.cap_per_query(hits.drop("_per_page"), CAP).select("doc_id", "source", "query_ord")


# -- rejected payloads (S12) ---------------------------------------------------------

def event_payloads(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Every event landed as a payload of ``source``: ``props`` (a JSON object) becomes
    one item of a well-formed page, except that error events arrive as an HTTP error
    text, view events put the object where the item list belongs, and click events
    send a list that mixes a number with the object."""
    e = T.read_table(spark, sf_dir, "events")
    env = FD.ENVELOPES[source]

    def page(items: Column) -> Column:
        return items if env is None else F.concat(F.lit('{"' + env + '": '), items, F.lit("}"))
    props, et = F.col("props"), F.col("event_type")
    value = (F.when(et == "error", F.concat(F.lit("HTTP 500 "), props))
             .when(et == "view", props if env is None else page(props))
             .when(et == "click", page(F.concat(F.lit("[1, "), props, F.lit("]"))))
             .otherwise(page(F.concat(F.lit("["), props, F.lit("]")))))
    return e.select(value.alias("value"), F.concat(F.lit("events/"), F.col("event_id").cast("string")).alias("path"))


def _payload_errors_sql(source: str) -> str:
    env = FD.ENVELOPES[source]

    def page(items: str) -> str:
        return items if env is None else f"""'{{"{env}": ' || {items} || '}}'"""

    def object_list(path: str) -> str:
        t = f"json_type(doc, '{path}')"
        return (f"({t} IS NULL OR {t} = 'NULL' OR ({t} = 'ARRAY' AND len(list_filter("
                f"json_type(doc, '{path}[*]'), lambda x: x NOT IN ('OBJECT', 'NULL'))) = 0))")
    shape = object_list("$") if env is None else \
        f"(json_type(doc) IN ('OBJECT', 'NULL') AND {object_list('$.' + env)})"
    return f"""SELECT '{source}' AS source, path, CASE WHEN doc IS NULL THEN '{FD.PAYLOAD_NOT_JSON}'
        ELSE '{FD.PAYLOAD_WRONG_SHAPE.replace("'", "''")}' END AS reason
FROM (SELECT path, TRY_CAST(value AS JSON) AS doc FROM (SELECT 'events/' || CAST(event_id AS VARCHAR) AS path,
        CASE event_type WHEN 'error' THEN 'HTTP 500 ' || props WHEN 'view' THEN {page('props')}
             WHEN 'click' THEN {page("'[1, ' || props || ']'")} ELSE {page("'[' || props || ']'")} END AS value
        FROM events))
WHERE doc IS NULL OR NOT {shape}"""


@register("payload_errors", "\nUNION ALL\n".join(_payload_errors_sql(s) for s in FD.SOURCE_ORDER))
def q_payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FD.union_sources({s: FD.payload_errors(event_payloads(spark, sf_dir, s), s)
                             for s in FD.SOURCE_ORDER})
