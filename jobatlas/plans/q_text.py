"""Registered text-function queries (P1-P14, P24), fingerprint (P12-P13) and batch dedup.

Inputs are whole driver tables: ``documents.text``, ``pages.html``, ``customer``
(location strings), ``orders`` (date strings) and ``part`` (postings to fingerprint).
The driver text holds no job vocabulary, so the classifier queries pass their
marker vocabulary as a parameter, exactly as a caller with another vocabulary would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.dedup import dedup_batch
from ..session import spread
from ..sources import tables as T
from . import sqltext as S
from .registry import register

# Mining dictionary of the text queries: the skill dictionary plus words that occur
# in the driver's prose (one of them with the trailing dot a token can keep).
MINING_DICT = X.KNOWN_SKILLS + ("the", "and", "that", "for", "with", "der", "die", "und",
                                "que", "des", "the.", "of the", "in der")
SENIORITY_MARKERS = X.SENIORITY_ALTERNATIVES + "|that|und|des"
WORK_HYBRID = "und"
WORK_REMOTE = ("que", "with")


def _bytes_md5(c) -> list:
    return [F.md5(c).alias("text_md5"), F.octet_length(c).cast("long").alias("text_bytes")]


@register("clean_text", f"""SELECT doc_id, md5(c) AS text_md5, CAST(strlen(c) AS BIGINT) AS text_bytes
FROM (SELECT doc_id, {S.collapse('text')} AS c FROM documents)""")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(T.read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", *_bytes_md5(X.collapse_ws("text")))


@register("strip_html", f"""SELECT page_id, md5(c) AS text_md5, CAST(strlen(c) AS BIGINT) AS text_bytes
FROM (SELECT page_id, {S.collapse(S.strip_html('html'))} AS c FROM pages)""")
def q_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(T.read_table(spark, sf_dir, "pages"))
    return p.select("page_id", *_bytes_md5(X.collapse_ws(X.strip_html("html"))))


_MINE_CTE = f"""d AS (SELECT *, {S.lower(S.strip_html("coalesce(text, '')"))} AS low FROM documents),
t AS (SELECT *, string_split_regex(low, '[^a-z0-9+#.]+') AS toks FROM d)"""


def _skills_sql(tags_sql: str) -> str:
    raw = f"list_concat({tags_sql}, {S.mined('low', 'toks', MINING_DICT)})"
    cleaned = f"list_filter(list_transform({raw}, lambda x: {S.clean_tag('x')}), lambda x: x <> '')"
    return f"""WITH {_MINE_CTE},
c AS (SELECT doc_id, text, {cleaned} AS l FROM t)
SELECT doc_id, array_to_string({S.ordered_distinct('l')}, '|') AS skills@EXTRA@ FROM c"""


@register("mine_skills", _skills_sql("CAST([] AS VARCHAR[])").replace("@EXTRA@", ""))
def q_mine_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(T.read_table(spark, sf_dir, "documents")).select("doc_id", "text")
    d = X.with_skills(d, "skills", F.array().cast("array<string>"), X.strip_html("text"), MINING_DICT)
    return d.select("doc_id", F.array_join("skills", "|").alias("skills"))


_FIRST_LINE_SQL = "split_part(text, chr(10), 1)"
_TAGS_SQL = "[' .NET ', upper(lang), source, lang || ';']"


@register("skill_lists", _skills_sql(_TAGS_SQL).replace(
    "@EXTRA@", ", array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), ','), "
          "lambda x: " + S.utrim("x") + "), lambda x: x <> ''), '|') AS csv"))
def q_skill_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(T.read_table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source")
    tags = F.array(F.lit(" .NET "), F.upper("lang"), F.col("source"), F.concat("lang", F.lit(";")))
    d = X.with_skills(d, "skills", tags, X.strip_html("text"), MINING_DICT)
    return d.select("doc_id", F.array_join("skills", "|").alias("skills"),
                    F.array_join(X.csv_list("text"), "|").alias("csv"))


@register("seniority", f"""WITH d AS (SELECT doc_id, {_FIRST_LINE_SQL} AS title, source AS exp,
    {S.strip_html("coalesce(text, '')")} AS body FROM documents),
m AS (SELECT doc_id, coalesce(nullif(regexp_extract(title, {S.seniority_re(SENIORITY_MARKERS)}, 1), ''),
    nullif(regexp_extract(exp, {S.seniority_re(SENIORITY_MARKERS)}, 1), ''),
    nullif(regexp_extract(body, {S.seniority_re(SENIORITY_MARKERS)}, 1), '')) AS mk FROM d)
SELECT doc_id, coalesce({S.canon_seniority('mk')}, '') AS experience_level FROM m""")
def q_seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(T.read_table(spark, sf_dir, "documents"))
    lvl = X.classify_experience(F.substring_index("text", "\n", 1), F.col("source"),
                                X.strip_html("text"), SENIORITY_MARKERS)
    return d.select("doc_id", lvl.alias("experience_level"))


# Title prefixes that reach every canonical form, and some that only look like one.
LEVELS = ("Sr. ", "sr ", "JR ", "Jr. ", "Mid-Level ", "mid level ", "midlevel ", "Entry-level ", "entry level ", "EntryLevel ",
          "Principal ", "staff ", "Lead ", "Interning ", "intern ", "Graduate ", "Seniority ", "mid ", "")
_LEVEL_CANON = {"sr.": "senior", "sr": "senior", "jr": "junior", "jr.": "junior", "mid-level": "mid", "mid level": "mid",
                "midlevel": "mid", "entry-level": "entry", "entry level": "entry", "interning": "", "seniority": ""}


@register("seniority_titles", "SELECT p_partkey, CASE p_partkey % " + str(len(LEVELS)) + " " + " ".join(
    f"WHEN {i} THEN {S.q(_LEVEL_CANON.get(t.strip().lower(), t.strip().lower()))}" for i, t in enumerate(LEVELS))
    + " END AS experience_level FROM part")
def q_seniority_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6/P7 over titles with a marker in front; the expected level is written out per prefix."""
    p = T.read_table(spark, sf_dir, "part")
    level = F.get(F.array(*[F.lit(t) for t in LEVELS]), (F.col("p_partkey") % len(LEVELS)).cast("int"))
    title = F.concat(level, F.lit("#"), F.col("p_brand"))
    return p.select("p_partkey", X.classify_experience(title, F.lit(""), F.lit("")).alias("experience_level"))


# Words whose lower-casing depends on more than one code point in Java: a final sigma, a dotted capital i.
_CASED = ("ΑΘΗΝΑΣ", "İSTANBUL", "HYBRİD Büro", "ΟΔΟΣ Σ", "Straße")
_CASED_LOW = ("αθηνασ", "istanbul", "hybrid büro", "οδοσ σ", "straße")


def _case_of(words, key: str) -> str:
    return f"CASE {key} % {len(words)} " + " ".join(f"WHEN {i} THEN {S.q(w)}" for i, w in enumerate(words)) + " END"


@register("unicode_lower", f"""SELECT c_custkey, low || '|' || lower(c_name) AS location_key, [low] AS tags,
    CASE WHEN low LIKE '%hybrid%' THEN 'hybrid' ELSE 'onsite' END AS work_type, low = 'istanbul' AS found
FROM (SELECT c_custkey, c_name, {_case_of(_CASED_LOW, 'c_custkey')} AS low FROM customer)""")
def q_unicode_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P8, P10 and F10 over capitals that lower-case rune by rune; the expected forms are written out."""
    from ..sources.feeds import matches_keyword
    c = T.read_table(spark, sf_dir, "customer")
    word = F.get(F.array(*[F.lit(w) for w in _CASED]), (F.col("c_custkey") % len(_CASED)).cast("int"))
    w = c.select("c_custkey", "c_name", word.alias("w"))
    return w.select("c_custkey", X.location_key(F.col("w"), F.col("c_name")).alias("location_key"),
                    X.normalize_skills(F.array("w"), F.lit("")).alias("tags"),
                    X.classify_work_type(F.col("w"), F.lit(""), F.lit("")).alias("work_type"),
                    matches_keyword(F.lit("istanbul"), F.col("w"), F.lit(""), F.array("w")).alias("found"))


@register("work_type", f"""WITH d AS (SELECT doc_id, lower(coalesce(source, '') || ' ' || coalesce(lang, '')
    || ' ' || {S.strip_html("coalesce(text, '')")}) AS hay FROM documents)
SELECT doc_id, CASE WHEN contains(hay, {S.q(WORK_HYBRID)}) THEN 'hybrid'
    WHEN {' OR '.join(f'contains(hay, {S.q(m)})' for m in WORK_REMOTE)} THEN 'remote'
    ELSE 'onsite' END AS work_type FROM d""")
def q_work_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(T.read_table(spark, sf_dir, "documents"))
    wt = X.classify_work_type(F.col("source"), F.col("lang"), X.strip_html("text"),
                              WORK_HYBRID, WORK_REMOTE)
    return d.select("doc_id", wt.alias("work_type"))


# -- locations ---------------------------------------------------------------------

def _location_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text locations built from customer / nation / region names."""
    c = T.read_table(spark, sf_dir, "customer")
    n = T.read_table(spark, sf_dir, "nation")
    r = T.read_table(spark, sf_dir, "region")
    j = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
         .join(F.broadcast(r), n.n_regionkey == r.r_regionkey))
    seg = F.col("c_mktsegment")
    raw = (F.when(seg == "AUTOMOBILE", F.concat_ws(", ", "c_name", "n_name", "r_name"))
           .when(seg == "BUILDING", F.concat(F.lit(" \u00a0"), F.col("n_name"), F.lit("\t ")))
           .when(seg == "FURNITURE", F.when(F.col("c_acctbal") < 0, F.lit("WORLDWIDE"))
                 .otherwise(F.lit(" , ,")))
           .when(seg == "HOUSEHOLD", F.when(F.col("c_acctbal") < 5000, F.lit("remote"))
                 .otherwise(F.lit("Global ")))
           .otherwise(F.concat(F.col("c_name"), F.lit(","), F.col("n_name"), F.lit(","))))
    return j.select("c_custkey", raw.alias("raw"))


_LOCATION_RAW_SQL = """SELECT c_custkey, CASE c_mktsegment
    WHEN 'AUTOMOBILE' THEN concat_ws(', ', c_name, n_name, r_name)
    WHEN 'BUILDING' THEN ' ' || chr(160) || n_name || chr(9) || ' '
    WHEN 'FURNITURE' THEN CASE WHEN c_acctbal < 0 THEN 'WORLDWIDE' ELSE ' , ,' END
    WHEN 'HOUSEHOLD' THEN CASE WHEN c_acctbal < 5000 THEN 'remote' ELSE 'Global ' END
    ELSE c_name || ',' || n_name || ',' END AS raw
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

_PLACELESS_SQL = ", ".join(S.q(p) for p in X.PLACELESS_LOCATIONS)


@register("split_location", f"""WITH r AS ({_LOCATION_RAW_SQL}),
s AS (SELECT c_custkey, raw, {S.utrim('raw')} AS s FROM r),
p AS (SELECT *, list_filter(list_transform(string_split(s, ','), lambda x: {S.utrim('x')}),
    lambda x: x <> '') AS parts FROM s),
l AS (SELECT c_custkey, raw,
    CASE WHEN s = '' THEN '' WHEN lower(s) IN ({_PLACELESS_SQL}) THEN ''
         WHEN len(parts) >= 2 THEN parts[1] ELSE '' END AS city,
    CASE WHEN s = '' THEN '' WHEN lower(s) IN ({_PLACELESS_SQL})
         THEN upper(substr(lower(s), 1, 1)) || substr(lower(s), 2)
         WHEN len(parts) >= 2 THEN parts[-1] WHEN len(parts) = 1 THEN parts[1] ELSE '' END AS country
    FROM p)
SELECT c_custkey, raw, city, country,
    coalesce(nullif(concat_ws('|', nullif({S.lower(S.utrim('city'))}, ''),
        nullif({S.lower(S.utrim('country'))}, '')), ''), 'remote') AS location_key,
    coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(country, '')), ''), 'Remote') AS display
FROM l""")
def q_split_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = _location_strings(spark, sf_dir).withColumn("loc", X.split_location("raw"))
    return loc.select("c_custkey", "raw", F.col("loc.city").alias("city"),
                      F.col("loc.country").alias("country"),
                      X.location_key("loc.city", "loc.country").alias("location_key"),
                      X.geocode_display("loc.city", "loc.country").alias("display"))


@register("location_key", T.with_views(f"""SELECT id AS office_id,
    coalesce(nullif(concat_ws('|', nullif({S.lower(S.utrim('city'))}, ''),
        nullif({S.lower(S.utrim('country'))}, '')), ''), 'remote') AS location_key,
    coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(country, '')), ''), 'Remote') AS display
FROM offices""", "offices"))
def q_location_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.offices(spark, sf_dir)
    return o.select(o.id.alias("office_id"), X.location_key("city", "country").alias("location_key"),
                    X.geocode_display("city", "country").alias("display"))


# -- dates ---------------------------------------------------------------------------

def _date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read_table(spark, sf_dir, "orders")
    ymd = F.date_format("o_orderdate", "yyyy-MM-dd")
    pri, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    raw = (F.when(pri == "1-URGENT", F.concat(ymd, F.lit("T23:30:00-08:00")))
           .when(pri == "2-HIGH", F.concat(ymd, F.lit("T00:00:00.0000000")))
           .when(pri == "3-MEDIUM", F.concat(ymd, F.lit(" 12:34:56")))
           .when(pri == "4-NOT SPECIFIED",
                 F.when(st == "F", F.date_format("o_orderdate", "yyyy/MM/dd"))
                 .when(st == "O", F.date_format("o_orderdate", "dd.MM.yyyy"))
                 .otherwise(F.concat(ymd, F.lit("T24:00:00Z"))))
           .otherwise(F.when(st == "F", F.date_format("o_orderdate", "yyyy-13-dd"))
                      .when(st == "O", F.concat(F.lit("  "), ymd, F.lit("\n")))
                      .otherwise(F.concat(ymd, F.lit("Z")))))
    return o.select("o_orderkey", raw.alias("raw"))


_DATE_RAW_SQL = """SELECT o_orderkey, CASE o_orderpriority
    WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:30:00-08:00'
    WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.0000000'
    WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d') || ' 12:34:56'
    WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y/%m/%d')
        WHEN 'O' THEN strftime(o_orderdate, '%d.%m.%Y')
        ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T24:00:00Z' END
    ELSE CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-13-%d')
        WHEN 'O' THEN '  ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10)
        ELSE strftime(o_orderdate, '%Y-%m-%d') || 'Z' END END AS raw
FROM orders"""


def _date_sql() -> str:
    dt, sl, dot = S.q(X.DATE_TIME_RE), S.q(X.SLASH_DATE_RE), S.q(X.DOT_DATE_RE)
    g = lambda i: f"nullif(regexp_extract(s, {dt}, {i}), '')"
    return f"""WITH r AS ({_DATE_RAW_SQL}),
s AS (SELECT o_orderkey, raw, {S.utrim('raw')} AS s FROM r),
p AS (SELECT o_orderkey, raw, s, coalesce({g(2)}, {g(5)}) AS hh, coalesce({g(3)}, {g(6)}) AS mi,
    coalesce({g(4)}, {g(7)}) AS ss FROM s),
y AS (SELECT o_orderkey, raw, CASE
    WHEN regexp_matches(s, {dt}) AND (hh IS NULL OR (CAST(hh AS INT) < 24 AND CAST(mi AS INT) < 60
        AND CAST(ss AS INT) < 60)) THEN regexp_extract(s, {dt}, 1)
    WHEN regexp_matches(s, {sl}) THEN regexp_extract(s, {sl}, 1) || '-' || regexp_extract(s, {sl}, 2)
        || '-' || regexp_extract(s, {sl}, 3)
    WHEN regexp_matches(s, {dot}) THEN regexp_extract(s, {dot}, 3) || '-' || regexp_extract(s, {dot}, 2)
        || '-' || regexp_extract(s, {dot}, 1) END AS ymd FROM p)
SELECT o_orderkey, raw, CAST(CAST(try_strptime(ymd, '%Y-%m-%d') AS DATE) AS VARCHAR) AS posted_date FROM y"""


@register("parse_dates", _date_sql())
def q_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _date_strings(spark, sf_dir)
    return d.select("o_orderkey", "raw", X.parse_posted_date("raw").cast("string").alias("posted_date"))


# -- fingerprint and batch dedup -------------------------------------------------------

def _part_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part rows as postings: company = brand, title = name, city = type, country = ''."""
    p = T.read_table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_brand", "p_name", "p_type",
                    X.dedup_hash("p_brand", "p_name", "p_type", F.lit("")).alias("dedup_hash"))


_FP_SQL = S.fingerprint("p_brand", "p_name", "p_type", "''")


@register("fingerprint", f"SELECT p_partkey, p_brand, p_name, p_type, {_FP_SQL} AS dedup_hash FROM part")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_postings(spark, sf_dir)


@register("dedup_batch", f"""SELECT p_partkey, p_brand, p_name, p_type, dedup_hash FROM (
    SELECT *, row_number() OVER (PARTITION BY dedup_hash ORDER BY p_partkey) AS rn
    FROM (SELECT p_partkey, p_brand, p_name, p_type, {_FP_SQL} AS dedup_hash FROM part)) WHERE rn = 1""")
def q_dedup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_batch(_part_postings(spark, sf_dir), "dedup_hash", ["p_partkey"])


# -- large-dictionary mining (dictionary as a table) -----------------------------------------

@register("mine_skills_dict", f"""WITH dict AS (SELECT DISTINCT trim(t, '.,;:') AS skill FROM (
        SELECT unnest(string_split_regex({S.lower("coalesce(text, '')")}, '[^a-z0-9+#.]+')) AS t FROM benchmark)
        WHERE trim(t, '.,;:') <> ''
    UNION SELECT n || ' the' FROM (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS n FROM benchmark)),
low AS (SELECT doc_id, {S.lower(S.strip_html("coalesce(text, '')"))} AS low FROM documents),
dt AS (SELECT doc_id, unnest(list_distinct(string_split_regex(low, '[^a-z0-9+#.]+'))) AS tok FROM low),
hit AS (SELECT doc_id, skill FROM dt JOIN dict ON tok = skill
    UNION SELECT doc_id, skill FROM low JOIN dict ON contains(skill, ' ') AND contains(low, skill))
SELECT doc_id, string_agg(skill, '|' ORDER BY skill) AS skills FROM hit GROUP BY doc_id""")
def q_mine_skills_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's words, and phrases made of its items' first words, as a dictionary table."""
    from ..operators.skills import dictionary_from_tokens, mine_skills_with_table
    b = T.read_table(spark, sf_dir, "benchmark")
    phrases = b.select(F.concat(F.lower(F.substring_index("text", " ", 1)), F.lit(" the")).alias("skill")).distinct()
    d = spread(T.read_table(spark, sf_dir, "documents")).select("doc_id", "text")
    out = mine_skills_with_table(d, "doc_id", X.strip_html("text"), dictionary_from_tokens(b, "text").union(phrases))
    return out.select("doc_id", F.array_join("skills", "|").alias("skills"))
