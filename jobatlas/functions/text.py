"""Column -> Column text functions for cleaning and classifying postings.

Every function here is a native Spark expression (regexp / higher-order array
functions), so it runs inside whole-stage codegen with no Python in the task.
Regular expressions avoid constructs that differ between Java's engine and an
RE2-style engine: word boundaries are spelled as ASCII look-arounds and
"whitespace" is an explicit Unicode class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for identical results)
# ---------------------------------------------------------------------------

# Skill dictionary used to mine skills from description text, in its original order.
KNOWN_SKILLS = (
    "go", "golang", "python", "java", "javascript", "typescript", "react",
    "next.js", "node.js", "node", "vue", "angular", "svelte", "rust", "c++",
    "c#", ".net", "ruby", "rails", "php", "laravel", "django", "flask",
    "fastapi", "spring", "kotlin", "swift", "objective-c", "scala", "elixir",
    "postgres", "postgresql", "mysql", "mongodb", "redis", "elasticsearch",
    "kafka", "rabbitmq", "graphql", "rest", "grpc", "docker", "kubernetes",
    "k8s", "terraform", "ansible", "aws", "gcp", "azure", "ci/cd", "jenkins",
    "github actions", "linux", "bash", "sql", "nosql", "spark", "hadoop",
    "tensorflow", "pytorch", "pandas", "numpy", "machine learning", "ml",
    "data science", "html", "css", "tailwind", "sass", "figma", "flutter",
    "react native", "android", "ios",
)
# Characters stripped from both ends of a skill tag.
SKILL_CUTSET = ".,;:"
# Tokens of skill mining (applied to lower-cased, tag-free text): maximal runs of these characters.
SKILL_TOKEN = r"[a-z0-9+#.]+"
# Seniority markers; the leftmost match wins, alternatives tried in this order.
SENIORITY_ALTERNATIVES = (r"principal|staff|lead|senior|sr\.?|mid[- ]?level|mid|junior|jr\.?"
                          r"|intern|entry[- ]?level|graduate")
# Canonical forms of seniority markers (others map to themselves).
SENIORITY_CANON = {
    "sr": "senior", "jr": "junior",
    "mid-level": "mid", "mid level": "mid", "midlevel": "mid",
    "entry-level": "entry", "entry level": "entry",
}
# Work-type vocabulary: "hybrid" is checked first, then any of the remote markers.
HYBRID_MARKER = "hybrid"
REMOTE_MARKERS = ("remote", "work from home", "wfh", "anywhere")
# Location strings that mean "no fixed place".
PLACELESS_LOCATIONS = ("remote", "worldwide", "anywhere", "global")
# Fingerprint field separator (ASCII unit separator).
FINGERPRINT_SEP = "\u001f"
# HTML tag pattern (no entity decoding; script/style bodies stay).
HTML_TAG = r"<[^>]*>"
# Unicode White_Space characters (what a Unicode-aware TrimSpace/Fields treats as space).
WS_CLASS = (r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

ASCII_WORD = "0-9A-Za-z_"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# Whitespace and markup
# ---------------------------------------------------------------------------

def utrim(c) -> Column:
    """Trim Unicode whitespace from both ends (Spark's trim only strips U+0020)."""
    return F.regexp_replace(_c(c), f"^{WS_CLASS}+|{WS_CLASS}+\\z", "")


def collapse_ws(c) -> Column:
    """Trim and collapse every run of Unicode whitespace to one space."""
    return utrim(F.regexp_replace(_c(c), f"{WS_CLASS}+", " "))


def strip_html(c) -> Column:
    """Replace each tag by one space.

    Every tag ends at a '>', so nothing after the text's last '>' is part of one:
    the regex only runs up to there and the rest is appended unchanged.  Same
    result, but a long text with many '<' and no '>' after them no longer costs a
    failed scan to the end of the text per '<' (quadratic in the text length)."""
    t = _c(c)
    rest = F.substring_index(t, ">", -1)        # after the last '>' (all of t when there is none)
    head = F.substring(t, F.lit(1), F.length(t) - F.length(rest))
    return F.concat(F.regexp_replace(head, HTML_TAG, " "), rest)


def fold_lower(c) -> Column:
    """Lower-case every code point on its own.  Java's String lower-casing looks at the whole
    string in two cases: U+0130 becomes two code points (here a plain 'i'), and a capital
    sigma at the end of a word becomes the final form (here always the ordinary one).
    ``replace`` only scans a text without these two; ``translate`` would rebuild every text by the character."""
    plain = F.replace(F.replace(_c(c), F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ"))
    return F.lower(plain)


def blank_to_null(c) -> Column:
    """P19 write side: '' -> NULL."""
    return F.nullif(_c(c), F.lit(""))


def null_to_blank(c) -> Column:
    """P19 read side: NULL -> ''."""
    return F.coalesce(_c(c), F.lit(""))


def clean_company(c) -> Column:
    return collapse_ws(c)


def clean_title(c) -> Column:
    return collapse_ws(c)


# ---------------------------------------------------------------------------
# skills
# ---------------------------------------------------------------------------

def clean_skill_tag(c) -> Column:
    """lower(utrim(tag)) then strip the cut-set from both ends."""
    return F.btrim(fold_lower(utrim(c)), F.lit(SKILL_CUTSET))


def desc_tokens(lowered_text) -> Column:
    """The skill tokens of a text.

    Extracting the token runs gives the same tokens minus the empty strings a
    split leaves at the ends (no consumer keeps an empty token), and on long
    texts it is several times faster than splitting on the complement class.
    """
    return F.regexp_extract_all(_c(lowered_text), F.lit(SKILL_TOKEN), 0)


def mine_skills_lowered(lowered, dictionary=KNOWN_SKILLS) -> Column:
    """P5 over text that is already tag-free and lower-cased (see :func:`lowered_text`).

    One-word entries must equal a whole token; entries containing a space match
    as substrings.  No lambda touches the text: token membership is one
    hash-based ``array_intersect`` and a second ``array_intersect`` with the
    dictionary restores dictionary order.
    """
    empty = F.array().cast("array<string>")
    if not dictionary:
        return empty
    low = _c(lowered)
    words = [k for k in dictionary if " " not in k]
    phrases = [k for k in dictionary if " " in k]
    found = []
    if words:
        found.append(F.array_intersect(F.array(*[F.lit(w) for w in words]), desc_tokens(low)))
    if phrases:
        found.append(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases]))
    hits = F.concat(*found) if len(found) > 1 else found[0]
    mined = F.array_intersect(F.array(*[F.lit(k) for k in dictionary]), hits)
    return F.when(F.coalesce(low, F.lit("")) == "", empty).otherwise(mined)


def lowered_text(desc_text) -> Column:
    """The text skill mining works on: lower-cased (tag-free input expected)."""
    return fold_lower(F.coalesce(_c(desc_text), F.lit("")))


def mine_skills(desc_text, dictionary=KNOWN_SKILLS) -> Column:
    """P5: dictionary skills found in (already tag-free) text, in dictionary order.

    For large inputs prefer :func:`with_skills`, which materialises the
    lower-cased text once: this Column form repeats it per reference when it
    ends up below a higher-order function.
    """
    return mine_skills_lowered(lowered_text(desc_text), dictionary)


def _clean_literal(k: str) -> str:
    """Python twin of :func:`clean_skill_tag` for literal dictionary entries."""
    return k.strip().replace("İ", "i").replace("Σ", "σ").lower().strip(SKILL_CUTSET)


def normalize_skills(tags, desc_text=None, dictionary=KNOWN_SKILLS, lowered=None) -> Column:
    """Cleaned source tags then mined skills; blanks dropped, first occurrence kept.

    Pass ``lowered`` (a column holding :func:`lowered_text`) to mine from a
    materialised column instead of re-deriving it from ``desc_text``.
    """
    tag_arr = F.coalesce(_c(tags), F.array().cast("array<string>"))
    tags_clean = F.filter(F.transform(tag_arr, clean_skill_tag), lambda x: x != "")
    low = lowered if lowered is not None else lowered_text(desc_text)
    mined = mine_skills_lowered(low, dictionary)
    # dictionary entries are literals: clean them here instead of per row
    cleaned = {k: _clean_literal(k) for k in dictionary}
    if any(k != v for k, v in cleaned.items()):
        m = F.create_map(*[F.lit(x) for kv in cleaned.items() for x in kv])
        mined = F.filter(F.transform(mined, lambda k: m[k]), lambda x: x != "")
    return F.array_distinct(F.concat(tags_clean, mined))


def with_skills(df, out: str, tags, desc_text, dictionary=KNOWN_SKILLS):
    """DataFrame form of P4/P5: lower-cases the text once in its own projection."""
    staged = df.withColumn("_skill_low", lowered_text(desc_text))
    return staged.withColumn(out, normalize_skills(tags, None, dictionary, F.col("_skill_low"))).drop("_skill_low")


# ---------------------------------------------------------------------------
# classification
# ---------------------------------------------------------------------------

def seniority_pattern(alternatives: str = SENIORITY_ALTERNATIVES) -> str:
    """Case-insensitive alternation bounded by ASCII word boundaries (spelled as look-arounds:
    Java's ``\\b`` treats accented letters as word characters)."""
    return f"(?i)(?<![{ASCII_WORD}])({alternatives})(?![{ASCII_WORD}])"


SENIORITY_PATTERN = seniority_pattern()


def seniority_marker(c, alternatives: str = SENIORITY_ALTERNATIVES) -> Column:
    """Leftmost seniority marker in ``c`` or NULL."""
    return F.nullif(F.regexp_extract(F.coalesce(_c(c), F.lit("")), seniority_pattern(alternatives), 1),
                    F.lit(""))


def canonical_seniority(m) -> Column:
    """lower/trim, drop one trailing '.', map abbreviations."""
    return canonical_marker(folded_marker(m))


def folded_marker(m) -> Column:
    """The first step of P7: lower/trim, drop one trailing '.'."""
    return F.regexp_replace(fold_lower(utrim(m)), r"\.$", "")


def canonical_marker(folded) -> Column:
    """The second step of P7: map abbreviations.  Every branch reads ``folded``: give a materialised column
    where it is costly."""
    low = _c(folded)
    expr = None
    for k, v in SENIORITY_CANON.items():
        expr = (F.when(low == k, v) if expr is None else expr.when(low == k, v))
    return expr.otherwise(low)


def classify_experience(title, experience_raw, desc_text,
                        alternatives: str = SENIORITY_ALTERNATIVES) -> Column:
    """First marker in the title, else the experience field, else the description."""
    return F.coalesce(canonical_seniority(experience_marker(title, experience_raw, desc_text, alternatives)), F.lit(""))


def experience_marker(title, experience_raw, desc_text, alternatives: str = SENIORITY_ALTERNATIVES) -> Column:
    """The marker that P6 finds, as it is written; NULL if none."""
    return F.coalesce(seniority_marker(title, alternatives), seniority_marker(experience_raw, alternatives),
                      seniority_marker(desc_text, alternatives))


def classify_work_type(work_raw, location_raw, desc_text, hybrid_marker: str = HYBRID_MARKER,
                       remote_markers: tuple[str, ...] = REMOTE_MARKERS) -> Column:
    """Substring vote over lower(work || ' ' || location || ' ' || description)."""
    return work_type_of(work_type_text(work_raw, location_raw, desc_text), hybrid_marker, remote_markers)


def work_type_text(work_raw, location_raw, desc_text) -> Column:
    """The text that P8 votes over."""
    return fold_lower(F.concat_ws(" ", null_to_blank(work_raw), null_to_blank(location_raw),
                                  null_to_blank(desc_text)))


def work_type_of(text, hybrid_marker: str = HYBRID_MARKER,
                 remote_markers: tuple[str, ...] = REMOTE_MARKERS) -> Column:
    """P8's vote over :func:`work_type_text` (every marker reads it: give a materialised column where it is costly)."""
    hay = _c(text)
    remote = None
    for m in remote_markers:
        p = F.contains(hay, F.lit(m))
        remote = p if remote is None else remote | p
    return (F.when(F.contains(hay, F.lit(hybrid_marker)), "hybrid")
            .when(remote, "remote").otherwise("onsite"))


# ---------------------------------------------------------------------------
# location
# ---------------------------------------------------------------------------

_NOT_SEP = r"[^,\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SEP = WS_CLASS[:-1] + ",]"
# first / last non-empty comma-separated segment (trimmed), and "at least two such segments"
FIRST_SEGMENT_RE = f"^{_SEP}*([^,]*{_NOT_SEP})"
LAST_SEGMENT_RE = f"({_NOT_SEP}(?:[^,]*{_NOT_SEP})?){_SEP}*\\z"
TWO_SEGMENTS_RE = f"(?s){_NOT_SEP}[^,]*,.*{_NOT_SEP}"


def split_location(raw) -> Column:
    """struct<city, country> from free text like "San Francisco, CA, USA".

    Blank -> ('', ''); remote/worldwide/anywhere/global -> ('', Title-case);
    otherwise the comma-separated, trimmed, non-empty segments: one -> ('', it),
    several -> (first, last).  Written with anchored regexes (no array lambdas) so
    the whole expression is code-generated and each part is evaluated once.
    """
    s = utrim(null_to_blank(raw))
    first = F.regexp_extract(s, FIRST_SEGMENT_RE, 1)
    last = F.regexp_extract(s, LAST_SEGMENT_RE, 1)
    placeless = fold_lower(s).isin(*PLACELESS_LOCATIONS)
    city = F.when(placeless, "").when(s.rlike(TWO_SEGMENTS_RE), first).otherwise("")
    country = F.when(placeless, F.initcap(fold_lower(s))).otherwise(last)
    return F.struct(city.alias("city"), country.alias("country"))


def location_key(city, country) -> Column:
    """P10: "city|country", one of them, or "remote"."""
    c = F.nullif(fold_lower(utrim(null_to_blank(city))), F.lit(""))
    k = F.nullif(fold_lower(utrim(null_to_blank(country))), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("|", c, k), F.lit("")), F.lit("remote"))


def geocode_display(city, country) -> Column:
    """P11: "City, Country", one of them, or "Remote"."""
    c = F.nullif(null_to_blank(city), F.lit(""))
    k = F.nullif(null_to_blank(country), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(", ", c, k), F.lit("")), F.lit("Remote"))


# ---------------------------------------------------------------------------
# fingerprint
# ---------------------------------------------------------------------------

def canonical_token(c, keep_unicode: bool = False) -> Column:
    """Lower-case, runs of non [a-z0-9] -> one space, trimmed.

    ``keep_unicode=True`` keeps every Unicode letter and digit instead, so titles in
    non-Latin scripts do not all collapse to '' (and collide); the default keeps the
    original fingerprints.
    """
    pattern = r"[^\p{L}\p{N}]+" if keep_unicode else "[^a-z0-9]+"
    return F.trim(F.regexp_replace(fold_lower(null_to_blank(c)), pattern, " "))


def dedup_hash(company, title, city, country, keep_unicode: bool = False) -> Column:
    """SHA-256 hex of the four canonical tokens joined by U+001F."""
    t = lambda x: canonical_token(x, keep_unicode)
    return F.sha2(F.concat_ws(FINGERPRINT_SEP, t(company), t(title), t(city), t(country)), 256)


# ---------------------------------------------------------------------------
# Dates, salary, currency
# ---------------------------------------------------------------------------

# Accepted layouts, tried in this order (fixed values):
#   yyyy-MM-ddTHH:mm:ss(.frac)(Z|+hh:mm)   RFC 3339 (twice in the original list)
#   yyyy-MM-ddTHH:mm:ss(.frac)             local
#   yyyy-MM-dd HH:mm:ss(.frac)             local, space separated
#   yyyy-MM-dd
#   yyyy/MM/dd
#   dd.MM.yyyy
# The written calendar date is kept; no time-zone conversion.
_FRAC = r"(?:[.,][0-9]+)?"
DATE_TIME_RE = (r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:T([0-9]{1,2}):([0-9]{2}):([0-9]{2})" + _FRAC
                + r"(?:Z|[+-][0-9]{2}:[0-9]{2})?| ([0-9]{1,2}):([0-9]{2}):([0-9]{2})" + _FRAC + r")?$")
SLASH_DATE_RE = r"^([0-9]{4})/([0-9]{2})/([0-9]{2})$"
DOT_DATE_RE = r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$"


def parse_posted_date(raw) -> Column:
    """DATE of the first matching layout, NULL if none matches or the value is invalid."""
    return parse_trimmed_date(utrim(null_to_blank(raw)))


def parse_trimmed_date(trimmed) -> Column:
    """P14 over text that is already trimmed (every part reads it: give a materialised column where it is costly)."""
    s = _c(trimmed)
    g = lambda pat, i: F.regexp_extract(s, pat, i)
    is_dt = s.rlike(DATE_TIME_RE)
    hh = F.coalesce(F.nullif(g(DATE_TIME_RE, 2), F.lit("")), F.nullif(g(DATE_TIME_RE, 5), F.lit("")))
    mm = F.coalesce(F.nullif(g(DATE_TIME_RE, 3), F.lit("")), F.nullif(g(DATE_TIME_RE, 6), F.lit("")))
    ss = F.coalesce(F.nullif(g(DATE_TIME_RE, 4), F.lit("")), F.nullif(g(DATE_TIME_RE, 7), F.lit("")))
    time_ok = hh.isNull() | ((hh.cast("int") < 24) & (mm.cast("int") < 60) & (ss.cast("int") < 60))
    ymd = (F.when(is_dt & time_ok, g(DATE_TIME_RE, 1))
           .when(s.rlike(SLASH_DATE_RE),
                 F.concat_ws("-", g(SLASH_DATE_RE, 1), g(SLASH_DATE_RE, 2), g(SLASH_DATE_RE, 3)))
           .when(s.rlike(DOT_DATE_RE),
                 F.concat_ws("-", g(DOT_DATE_RE, 3), g(DOT_DATE_RE, 2), g(DOT_DATE_RE, 1))))
    return F.try_to_date(ymd, "yyyy-MM-dd")


def nil_if_zero(c) -> Column:
    """0 -> NULL."""
    return F.nullif(_c(c), F.lit(0))


def clean_currency(c) -> Column:
    """upper(utrim(x))."""
    return F.upper(utrim(null_to_blank(c)))


def lenient_int(c) -> Column:
    """S8: '' -> 0, integer text, else float text truncated, else 0."""
    s = utrim(null_to_blank(c))
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


# ---------------------------------------------------------------------------
# Display projections
# ---------------------------------------------------------------------------

def _k_label(n: Column) -> Column:
    # n >= 1000 -> rounded thousands with a 'k' (half up, integer arithmetic)
    return F.when(n >= 1000, F.concat(((n + 500) / 1000).cast("long").cast("string"), F.lit("k"))) \
        .otherwise(n.cast("string"))


def salary_label(salary_min, salary_max, currency) -> Column:
    """P20: "USD 50k–80k", "900", or ''."""
    lo = F.nullif(_c(salary_min), F.lit(0))
    hi = F.nullif(_c(salary_max), F.lit(0))
    cur = F.when(null_to_blank(currency) != "", F.concat(_c(currency), F.lit(" "))).otherwise("")
    return (F.when(lo.isNull() & hi.isNull(), "")
            .when(lo.isNotNull() & hi.isNotNull(),
                  F.concat(cur, _k_label(lo), F.lit("–"), _k_label(hi)))
            .otherwise(F.concat(cur, _k_label(F.coalesce(lo, hi)))))


def _tenths(n: Column, unit: int) -> Column:
    t = ((n + unit // 20) / (unit // 10)).cast("long")  # tenths of `unit`, half up
    return F.concat((t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def cluster_badge(count) -> Column:
    """999 -> "999", 1500 -> "1.5k", 12000 -> "12k", 2500000 -> "2.5M"."""
    n = _c(count).cast("long")
    return (F.when(n >= 1_000_000, F.concat(_tenths(n, 1_000_000), F.lit("M")))
            .when(n >= 10_000, F.concat(((n + 500) / 1000).cast("long").cast("string"), F.lit("k")))
            .when(n >= 1_000, F.concat(_tenths(n, 1_000), F.lit("k")))
            .otherwise(n.cast("string")))


def cluster_tier(count) -> Column:
    """0 / 1 / 2 at 25 and 100."""
    n = _c(count)
    return F.when(n >= 100, 2).when(n >= 25, 1).otherwise(0)


def office_label(city, country) -> Column:
    """Non-empty of (city, country) joined by ', '."""
    return F.concat_ws(", ", blank_to_null(city), blank_to_null(country))


def company_initial(name) -> Column:
    return F.upper(F.substring(null_to_blank(name), 1, 1))


def top_skills(skills, n: int = 6) -> Column:
    """The first ``n`` skills shown on an office card."""
    return F.slice(F.coalesce(_c(skills), F.array().cast("array<string>")), 1, n)


def csv_list(c) -> Column:
    """Comma-separated text -> trimmed, non-empty list."""
    return F.filter(F.transform(F.split(null_to_blank(c), ","), utrim), lambda x: x != "")


def parse_csv_list(s: str) -> list[str]:
    """Driver-side twin of :func:`csv_list` for request parameters."""
    return [p.strip() for p in (s or "").split(",") if p.strip()]
