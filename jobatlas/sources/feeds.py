"""Feed adapters: landed JSON payloads -> RawJob rows.

A payload is one JSON document per row (``value``), as landed from one feed
request.  Optional payload columns carry request context:

* ``query_ord``  index of the search query the payload was fetched for
                 (server-side-filtered feeds); NULL for feeds filtered client-side
* ``page_ord``   order of the payload within a source/query (page, or country for adzuna)
* ``country``    adzuna marketplace code
* ``path``       file name, for error reporting

Every adapter is ``from_json`` with an explicit schema + ``posexplode`` of the
item list + one projection, i.e. native expressions only.  One payload is one
row until the explode (a feed bounds its payloads, at most 100 items a request).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..schemas import RAW_JOB_COLUMNS
from ..session import staged

# Fixed values ---------------------------------------------------------------
# Source order of one ingestion run.
SOURCE_ORDER = ("remoteok", "remotive", "arbeitnow", "jobicy", "adzuna", "jooble")
# Adzuna marketplaces, in the order they are pulled, and their display currencies.
ADZUNA_COUNTRIES = ("gb", "us", "in", "au", "ca", "de", "fr", "sg")
ADZUNA_CURRENCY = {"gb": "GBP", "us": "USD", "ca": "USD", "in": "INR", "au": "AUD",
                   "de": "EUR", "fr": "EUR", "sg": "SGD"}
# Field holding the item list of each feed's payload (remoteok: the payload is the list).
ENVELOPES = {"remoteok": None, "remotive": "jobs", "arbeitnow": "data", "jobicy": "jobs",
             "adzuna": "results", "jooble": "jobs"}
# Feeds whose failed requests are skipped without counting as a run error
# (one marketplace failing does not fail the worldwide pull).
SILENT_FAILURES = ("adzuna",)
# Feeds whose search runs client-side (the payload is the whole feed).
CLIENT_FILTERED = ("remoteok", "arbeitnow", "jobicy")
DEFAULT_PER_QUERY = 100
# adzuna rows are ordered by (marketplace, page): page_ord = marketplace index * span + page
ADZUNA_PAGE_SPAN = 100_000
# Search terms of a scheduled run when none are given.
DEFAULT_QUERY_TERMS = ("software engineer", "backend", "frontend", "data scientist",
                       "devops", "product manager", "designer", "full stack")

# Payload schemas (fields not listed are ignored, as in a struct-tag decoder).
SCHEMAS = {
    "remoteok": ("array<struct<legal:string,id:string,url:string,company:string,company_logo:string,"
                 "position:string,description:string,location:string,tags:array<string>,date:string,"
                 "salary_min:string,salary_max:string>>"),
    "remotive": ("struct<`job-count`:int,jobs:array<struct<id:bigint,url:string,title:string,"
                 "company_name:string,company_logo:string,category:string,tags:array<string>,"
                 "job_type:string,candidate_required_location:string,salary:string,description:string,"
                 "publication_date:string>>>"),
    "arbeitnow": ("struct<data:array<struct<slug:string,company_name:string,title:string,"
                  "description:string,remote:boolean,url:string,tags:array<string>,"
                  "job_types:array<string>,location:string,created_at:bigint>>>"),
    "jobicy": ("struct<jobs:array<struct<id:bigint,url:string,jobTitle:string,companyName:string,"
               "jobGeo:string,jobType:string,jobExcerpt:string,jobIndustry:array<string>,"
               "pubDate:string>>>"),
    "adzuna": ("struct<results:array<struct<id:string,redirect_url:string,title:string,"
               "description:string,created:string,salary_min:double,salary_max:double,"
               "contract_time:string,company:struct<display_name:string>,"
               "location:struct<display_name:string,area:array<string>>,"
               "category:struct<label:string>>>>"),
    "jooble": ("struct<totalCount:int,jobs:array<struct<title:string,location:string,snippet:string,"
               "salary:string,source:string,type:string,link:string,company:string,updated:string,"
               "id:bigint>>>"),
}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files: one whole file per row, with its path."""
    return (spark.read.option("wholetext", True).text(path)
            .select(F.col("value"), F.input_file_name().alias("path")))


def _ctx(payloads: DataFrame, name: str) -> list[Column]:
    cols = set(payloads.columns)
    ctx = [F.col(c) if c in cols else F.lit(None).cast(t).alias(c)
           for c, t in (("query_ord", "int"), ("page_ord", "int"), ("country", "string"))]
    return ctx


def _items(payloads: DataFrame, name: str) -> DataFrame:
    """posexplode the item list of every accepted payload (pos = index within the payload).

    A payload with a :func:`payload_reason` gives no items.  A JSON null in the list is an
    item without fields, as in a typed decoder; an absent list gives none."""
    doc = F.from_json(F.when(payload_reason(F.col("value"), name).isNull(), F.col("value")), SCHEMAS[name])
    envelope = ENVELOPES[name]
    arr = doc if envelope is None else doc.getField(envelope)
    return payloads.select(*_ctx(payloads, name), F.posexplode(arr).alias("pos", "it"))


def _raw(name: str, it: dict) -> list[Column]:
    """Project adapter fields into RawJob column order; missing ones are blank."""
    out = [F.lit(name).alias("source")]
    for c in RAW_JOB_COLUMNS[1:]:
        if c == "source_ord":
            out.append(F.lit(SOURCE_ORDER.index(name)).alias(c))
        elif c in ("query_ord", "page_ord"):
            out.append(F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c))
        elif c == "pos":
            out.append(F.col("pos").cast("int").alias(c))
        elif c not in it:  # a field this feed does not have: blank, 0 or []
            blank = (F.lit(0).cast("bigint") if c in ("salary_min", "salary_max")
                     else F.array().cast("array<string>") if c == "skills_raw" else F.lit(""))
            out.append(blank.alias(c))
        else:
            v = it[c]
            if c in ("salary_min", "salary_max"):
                v = F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint"))
            elif c == "skills_raw":
                v = F.coalesce(v, F.array().cast("array<string>"))
            else:
                v = X.null_to_blank(v)
            out.append(v.alias(c))
    return out


def _s(f: str) -> Column:
    return F.col(f"it.{f}")


def _int_id() -> Column:
    """A numeric item id as text; an absent id decodes to 0, as in a typed decoder."""
    return F.coalesce(_s("id"), F.lit(0)).cast("string")


def remoteok(payloads: DataFrame) -> DataFrame:
    """Top-level array; the legal header element and blank positions are skipped."""
    it = _items(payloads, "remoteok")
    it = it.where((X.null_to_blank(_s("legal")) == "") & (X.utrim(X.null_to_blank(_s("position"))) != ""))
    loc = X.split_location(_s("location"))
    return it.select(*_raw("remoteok", {
        "source_id": _s("id"), "source_url": _s("url"), "company_name": X.utrim(_s("company")),
        "company_logo": _s("company_logo"), "location_raw": _s("location"),
        "city": loc["city"], "country": loc["country"], "title": X.utrim(_s("position")),
        "description": _s("description"), "skills_raw": _s("tags"), "work_type_raw": F.lit("remote"),
        "salary_min": X.lenient_int(_s("salary_min")), "salary_max": X.lenient_int(_s("salary_max")),
        "posted_at": _s("date")}))


def remotive(payloads: DataFrame) -> DataFrame:
    """Blank location -> "Remote"; category appended to tags."""
    it = _items(payloads, "remotive")
    loc_raw = F.coalesce(F.nullif(X.utrim(X.null_to_blank(_s("candidate_required_location"))), F.lit("")),
                         F.lit("Remote"))
    loc = X.split_location(loc_raw)
    tags = F.coalesce(_s("tags"), F.array().cast("array<string>"))
    skills = F.when(X.null_to_blank(_s("category")) != "",
                    F.concat(tags, F.array(_s("category")))).otherwise(tags)
    return it.select(*_raw("remotive", {
        "source_id": _int_id(), "source_url": _s("url"),
        "company_name": X.utrim(_s("company_name")), "company_logo": _s("company_logo"),
        "location_raw": loc_raw, "city": loc["city"], "country": loc["country"],
        "title": X.utrim(_s("title")), "description": _s("description"), "skills_raw": skills,
        "work_type_raw": F.lit("remote"), "posted_at": _s("publication_date")}))


def arbeitnow(payloads: DataFrame) -> DataFrame:
    """S3: blank title or company skipped; remote flag -> remote/onsite; no posted date."""
    it = _items(payloads, "arbeitnow")
    it = it.where((X.utrim(X.null_to_blank(_s("title"))) != "")
                  & (X.utrim(X.null_to_blank(_s("company_name"))) != ""))
    loc = X.split_location(_s("location"))
    return it.select(*_raw("arbeitnow", {
        "source_id": _s("slug"), "source_url": _s("url"), "company_name": X.utrim(_s("company_name")),
        "location_raw": _s("location"), "city": loc["city"], "country": loc["country"],
        "title": X.utrim(_s("title")), "description": _s("description"), "skills_raw": _s("tags"),
        "work_type_raw": F.when(F.coalesce(_s("remote"), F.lit(False)), "remote").otherwise("onsite")}))


def jobicy(payloads: DataFrame) -> DataFrame:
    """Blank title skipped; empty or "worldwide" geo -> country "Remote"."""
    it = _items(payloads, "jobicy")
    it = it.where(X.utrim(X.null_to_blank(_s("jobTitle"))) != "")
    geo = X.null_to_blank(_s("jobGeo"))
    loc = X.split_location(geo)
    placeless = (geo == "") | (X.fold_lower(geo) == "worldwide")
    return it.select(*_raw("jobicy", {
        "source_id": _int_id(), "source_url": _s("url"),
        "company_name": X.utrim(_s("companyName")), "location_raw": geo,
        "city": F.when(placeless, "").otherwise(loc["city"]),
        "country": F.when(placeless, "Remote").otherwise(loc["country"]),
        "title": X.utrim(_s("jobTitle")), "description": _s("jobExcerpt"),
        "skills_raw": _s("jobIndustry"), "work_type_raw": F.lit("remote"), "posted_at": _s("pubDate")}))


def adzuna_location(area: Column, display: Column) -> Column:
    """Area is broad -> narrow: >= 2 -> (last, first); 1 -> ('', first); else split display."""
    n = F.coalesce(F.size(area), F.lit(0))
    split = X.split_location(display)
    return F.struct(
        F.when(n >= 2, F.try_element_at(area, F.lit(-1))).when(n == 1, F.lit(""))
         .otherwise(split["city"]).alias("city"),
        F.when(n >= 1, F.try_element_at(area, F.lit(1))).otherwise(split["country"]).alias("country"))


def split_category(label: Column) -> Column:
    """Trimmed label without one trailing " Jobs", as a one-element list; blank -> []."""
    t = X.utrim(X.null_to_blank(label))
    return F.when(t == "", F.array().cast("array<string>")) \
        .otherwise(F.array(F.regexp_replace(t, r" Jobs\z", "")))


def currency_for_country(code: Column) -> Column:
    """Marketplace code -> currency ('' when unknown)."""
    m = F.create_map(*[F.lit(x) for kv in ADZUNA_CURRENCY.items() for x in kv])
    return F.coalesce(m[F.lower(X.null_to_blank(code))], F.lit(""))


def adzuna(payloads: DataFrame) -> DataFrame:
    """One payload per marketplace (``country`` column); salary truncated to an integer.

    Marketplaces are pulled in a fixed order, so the marketplace's position is
    folded into ``page_ord`` and "first occurrence" follows that order.
    """
    codes = F.array(*[F.lit(c) for c in ADZUNA_COUNTRIES])
    market = F.array_position(codes, F.lower(X.null_to_blank(F.col("country"))))
    page = F.coalesce(F.col("page_ord"), F.lit(0)) if "page_ord" in payloads.columns else F.lit(0)
    payloads = payloads.withColumn("page_ord", (market * ADZUNA_PAGE_SPAN + page).cast("int"))
    it = _items(payloads, "adzuna")
    loc = adzuna_location(_s("location.area"), _s("location.display_name"))
    trunc = lambda c: F.when(c.isNull(), F.lit(0.0)).otherwise(
        F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))).try_cast("bigint")
    return it.select(*_raw("adzuna", {
        "source_id": _s("id"), "source_url": _s("redirect_url"),
        "company_name": X.utrim(_s("company.display_name")), "location_raw": _s("location.display_name"),
        "city": loc["city"], "country": loc["country"], "title": X.utrim(_s("title")),
        "description": _s("description"), "skills_raw": split_category(_s("category.label")),
        "work_type_raw": _s("contract_time"), "salary_min": trunc(_s("salary_min")),
        "salary_max": trunc(_s("salary_max")), "salary_currency": currency_for_country(F.col("country")),
        "posted_at": _s("created")}))


def jooble(payloads: DataFrame) -> DataFrame:
    """Snippet as description, free-text type as work type, ``updated`` as date."""
    it = _items(payloads, "jooble")
    loc = X.split_location(_s("location"))
    return it.select(*_raw("jooble", {
        "source_id": _int_id(), "source_url": _s("link"),
        "company_name": X.utrim(_s("company")), "location_raw": _s("location"),
        "city": loc["city"], "country": loc["country"], "title": X.utrim(_s("title")),
        "description": _s("snippet"), "work_type_raw": _s("type"), "posted_at": _s("updated")}))


ADAPTERS = {"remoteok": remoteok, "remotive": remotive, "arbeitnow": arbeitnow,
            "jobicy": jobicy, "adzuna": adzuna, "jooble": jooble}


def _json_kind(v: Column) -> Column:
    """Kind of a variant's top value: OBJECT, ARRAY, VOID (JSON null), STRING, BIGINT, ..."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _object_list(v: Column) -> Column:
    """An item list a typed decoder accepts: absent, JSON null, or a list whose
    elements are objects or nulls (``ARRAY<VOID>`` is the empty or all-null list)."""
    s = F.schema_of_variant(v)
    return v.isNull() | (s == "VOID") | s.rlike(r"^ARRAY<(OBJECT|VOID)")


PAYLOAD_NOT_JSON = "payload is not valid JSON"
PAYLOAD_WRONG_SHAPE = "payload does not have the feed's shape"


def payload_reason(value: Column, source: str) -> Column:
    """Why a whole payload is rejected, NULL if it is not.

    A payload is rejected when it is not JSON, or when its envelope has the wrong
    kind: a top value that is neither an object nor null (the list itself for
    remoteok), or an item list that is not a list of objects.  Unknown fields and
    a missing item list are accepted (an empty page), as by a struct decoder.
    """
    v = F.try_parse_json(value)
    env = ENVELOPES[source]
    if env is None:
        shape_ok = _object_list(v)
    else:
        shape_ok = _json_kind(v).isin("OBJECT", "VOID") & _object_list(F.variant_get(v, f"$.{env}", "variant"))
    return F.when(v.isNull(), F.lit(PAYLOAD_NOT_JSON)).when(~shape_ok, F.lit(PAYLOAD_WRONG_SHAPE))


def payload_errors(payloads: DataFrame, source: str) -> DataFrame:
    """Rejected payloads with their reason (the rest of the run continues)."""
    path = F.col("path") if "path" in payloads.columns else F.lit(None).cast("string")
    out = payloads.select(F.lit(source).alias("source"), path.alias("path"),
                          payload_reason(F.col("value"), source).alias("reason"))
    return out.where(F.col("reason").isNotNull())


# -- queries (J6, F10, L4) -------------------------------------------------------------

def queries_frame(spark: SparkSession, terms: Sequence[str] = DEFAULT_QUERY_TERMS,
                  per_page: int = DEFAULT_PER_QUERY) -> DataFrame:
    """The search list of a run: (query_ord, keywords, per_page)."""
    rows = [(i, t, per_page) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "query_ord int, keywords string, per_page int")


def matches_keyword(kw: Column, title: Column, desc: Column, tags: Column) -> Column:
    """lower-cased keyword is a substring of the title, description or any tag."""
    k = X.fold_lower(kw)
    return ((k == "") | F.contains(X.fold_lower(X.null_to_blank(title)), k)
            | F.contains(X.fold_lower(X.null_to_blank(desc)), k)
            | F.exists(F.coalesce(tags, F.array().cast("array<string>")),
                       lambda t: F.contains(X.fold_lower(t), k)))


# Bytes of search terms that are broadcast to the feed scan; a longer list is joined without a hint.
BROADCAST_QUERY_BYTES = 8 << 20


def small_query_list(queries: DataFrame, max_bytes: int = BROADCAST_QUERY_BYTES) -> bool:
    """Whether the search list's measured size allows a broadcast."""
    size = queries.agg(F.sum(F.octet_length(X.null_to_blank("keywords")) + F.lit(64)).alias("n")).first().n
    return (size or 0) <= max_bytes


GRAM = 3
# Distinct pieces of a search list up to which each text is asked for every one; beyond, the text is cut into its own.
FEW_GRAMS = 64


@dataclass(frozen=True)
class Search:
    """A search list ready to be joined: (_q, _kw, _per_page, _gram), the pieces' lengths, whether it is small, and
    the distinct pieces themselves if there are few."""

    queries: DataFrame
    lengths: tuple[int, ...]
    small: bool
    grams: tuple[str, ...] | None = None


def search(queries: DataFrame, small: bool | None = None) -> Search:
    """The search list with ``_gram``, a piece of the keyword that every text it is found in must hold: the keyword itself
    up to ``GRAM`` characters (blank ones included), else that of its pieces of three which the fewest keywords have.
    A small list (measured) is worked out in the driver, a longer one is written as a table."""
    small = small_query_list(queries) if small is None else small
    q = queries.select(F.col("query_ord").alias("_q"), X.fold_lower(X.null_to_blank("keywords")).alias("_kw"),
                       F.col("per_page").alias("_per_page"))
    if small:
        rows = q.collect()
        times = Counter(kw[i:i + GRAM] for kw in {r["_kw"] for r in rows} for i in range(len(kw) - GRAM + 1))

        def gram(kw: str) -> str:
            return kw if len(kw) <= GRAM else min((kw[i:i + GRAM] for i in range(len(kw) - GRAM + 1)), key=lambda g: (times[g], g))

        table = q.sparkSession.createDataFrame([(*r, gram(r["_kw"])) for r in rows], q.schema.add("_gram", "string"))
        grams = tuple(sorted({gram(r["_kw"]) for r in rows}))
        return Search(table, tuple(sorted({min(len(r["_kw"]), GRAM) for r in rows})), True,
                      grams if len(grams) <= FEW_GRAMS else None)
    pieces = q.select("_kw").distinct().select("_kw", F.explode(_grams(F.col("_kw"), GRAM)).alias("_gram"))
    times = pieces.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = pieces.join(times, "_gram").groupBy("_kw").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_rarest"))
    table = staged(q.join(rarest, "_kw", "left").select(
        "_q", "_kw", "_per_page", F.when(F.length("_kw") <= GRAM, F.col("_kw")).otherwise(F.col("_rarest")).alias("_gram")), "search")
    lengths = table.select(F.least(F.length("_kw"), F.lit(GRAM))).distinct().collect()  # 0 to GRAM
    return Search(table, tuple(sorted(r[0] for r in lengths)), False)


def _grams(text: Column, n: int) -> Column:
    """The distinct pieces of ``n`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def apply_queries(raw: DataFrame, queries: DataFrame | Search) -> DataFrame:
    """A client-side-filtered feed is searched once per query.

    A keyword is contained in a text only if its pieces are.  So each row is cut into its distinct pieces
    of three characters (and of two, one and none, if there are keywords that short), which meet the
    keywords' rarest pieces in an equi-join; what is found is verified by ``contains`` on each field.
    A row meets a keyword by one piece only, so no pair comes twice.  The search list is broadcast below a
    measured size, so the feed is scanned once and not shuffled; beyond it the join shuffles.  While the
    list has few pieces (``FEW_GRAMS``), a row is asked for each by ``contains`` instead of being cut: a
    long text has thousands of pieces, and cutting them out costs far more than so many scans.
    """
    asked = queries if isinstance(queries, Search) else search(queries)
    low = raw.withColumns({
        "_title": X.fold_lower(X.null_to_blank("title")), "_desc": X.fold_lower(X.null_to_blank("description")),
        "_tags": F.transform(F.coalesce("skills_raw", F.array().cast("array<string>")), X.fold_lower)})

    def holds(piece: Column) -> Column:
        return ((piece == "") | F.contains("_title", piece) | F.contains("_desc", piece)
                | F.exists("_tags", lambda t: F.contains(t, piece)))

    if asked.grams:
        cut = low.withColumn("_gram", F.explode(F.filter(F.array(*[F.lit(g) for g in asked.grams]), holds)))
    else:
        # NULs keep pieces from reaching over two fields; those that do are refused below.
        whole = F.concat_ws("\0", "_title", "_desc", F.array_join("_tags", "\0", ""))
        low = low.withColumn("_text", whole)
        pieces = [F.array(F.lit("")) if n == 0 else _grams(F.col("_text"), n) for n in asked.lengths] or [F.array().cast("array<string>")]
        cut = low.withColumn("_gram", F.explode(F.concat(*pieces))).drop("_text")
    met = holds(F.col("_kw"))
    j = cut.join(F.broadcast(asked.queries) if asked.small else asked.queries, "_gram").where(met)
    return j.withColumn("query_ord", F.col("_q")).drop("_q", "_kw", "_gram", "_title", "_desc", "_tags")


def query_caps(queries: DataFrame, default: int = DEFAULT_PER_QUERY) -> DataFrame:
    """The search list with each query's effective cap: its own ``per_page``, or the
    run's default when that is 0 (or missing); a negative cap means no cap."""
    pp = F.coalesce(F.col("per_page"), F.lit(0))
    return queries.withColumn("per_page", F.when(pp == 0, F.lit(default)).otherwise(pp))


def largest_cap(queries: DataFrame) -> int | None:
    """The largest positive cap of a search list, read on the driver."""
    return queries.agg(F.max(F.when(F.col("per_page") > 0, F.col("per_page"))).alias("m")).first().m


def with_query_caps(raw: DataFrame, queries: DataFrame, default: int = DEFAULT_PER_QUERY) -> DataFrame:
    """``_per_page`` of each feed row's query (server-side-searched feeds carry ``query_ord``
    from their payload); rows of a query that is not in the list get the default."""
    q = queries.select(F.col("query_ord").alias("_qo"), F.col("per_page").alias("_pp"))
    j = raw.join(q, raw.query_ord == q._qo, "left")  # two integers a query: the planner broadcasts them by size
    return j.withColumn("_per_page", F.coalesce(F.col("_pp"), F.lit(default))).drop("_qo", "_pp")


def cap_per_query(raw: DataFrame, per_page: int | Column | None = None,
                  max_per_page: int | None = None) -> DataFrame:
    """L4: first N accepted rows per (source, query) in feed order.

    ``row_number() <= N`` over a partitioned window lets Spark insert a
    WindowGroupLimit before the shuffle, so at most N rows per group and task move.
    With ``per_page=None`` every row carries its query's cap in ``_per_page``
    (<= 0: no cap); groups without a cap skip the window, and ``max_per_page``
    (the largest cap) keeps a literal bound on the window so the limit still applies
    before the shuffle.
    """
    w = Window.partitionBy("source", "query_ord").orderBy("page_ord", "pos")
    if per_page is None:
        capped = F.coalesce(F.col("_per_page"), F.lit(0)) > 0
        out = raw.where(capped).withColumn("_rn", F.row_number().over(w))
        if max_per_page is not None:
            out = out.where(F.col("_rn") <= F.lit(max_per_page))
        out = out.where(F.col("_rn") <= F.col("_per_page")).drop("_rn")
        return out.unionByName(raw.where(~capped)).drop("_per_page")
    if not isinstance(per_page, Column) and per_page <= 0:
        # no cap: nothing to rank, so no window (and no group gathered in one task)
        return raw.drop("_per_page") if "_per_page" in raw.columns else raw
    n = per_page if isinstance(per_page, Column) else F.lit(per_page)
    out = raw.withColumn("_rn", F.row_number().over(w))
    out = out.where((n <= 0) | (F.col("_rn") <= n))
    return out.drop("_rn", "_per_page") if "_per_page" in raw.columns else out.drop("_rn")


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Bag union of the enabled sources (source_ord fixes their order)."""
    dfs = [frames[s] for s in SOURCE_ORDER if s in frames]
    return reduce(lambda a, b: a.unionByName(b), dfs)


def run_errors(payloads: DataFrame, source: str, n_queries: int) -> DataFrame:
    """S12 as a run counts it: ``times`` per rejected payload.  A feed searched client-side is pulled
    once per query, so its broken payload fails every query; a feed in ``SILENT_FAILURES`` none."""
    times = 0 if source in SILENT_FAILURES else n_queries if source in CLIENT_FILTERED else 1
    return payload_errors(payloads, source).withColumn("times", F.lit(times).cast("long"))
