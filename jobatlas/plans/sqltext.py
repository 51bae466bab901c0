"""DuckDB SQL snippets that state the text functions independently, for oracle queries."""

from __future__ import annotations

from ..functions import text as X


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def utrim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + X.WS_CLASS + '+|' + X.WS_CLASS + '+$')}, '', 'g')"


def collapse(x: str) -> str:
    return utrim(f"regexp_replace({x}, {q(X.WS_CLASS + '+')}, ' ', 'g')")


def strip_html(x: str) -> str:
    return f"regexp_replace({x}, {q(X.HTML_TAG)}, ' ', 'g')"


def lower(x: str) -> str:
    return f"lower(replace({x}, 'İ', 'i'))"


def canon_token(x: str) -> str:
    low = lower(f"coalesce({x}, '')")
    return f"trim(regexp_replace({low}, '[^a-z0-9]+', ' ', 'g'))"


def fingerprint(company: str, title: str, city: str, country: str) -> str:
    parts = ", ".join(canon_token(p) for p in (company, title, city, country))
    return f"sha256(concat_ws(chr(31), {parts}))"


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def clean_tag(x: str) -> str:
    return f"trim({lower(utrim(x))}, {q(X.SKILL_CUTSET)})"


def mined(low: str, toks: str, dictionary) -> str:
    """Dictionary entries (uncleaned) present in lowered text, in dictionary order."""
    return (f"list_filter({sql_list(dictionary)}, lambda k: CASE WHEN contains(k, ' ') "
            f"THEN contains({low}, k) ELSE list_contains({toks}, k) END)")


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: NOT list_contains(list_slice({lst}, 1, i - 1), x))"


def canon_seniority(m: str) -> str:
    low = f"regexp_replace(lower({utrim(m)}), '\\.$', '')"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.SENIORITY_CANON.items())
    return f"(CASE {low} {cases} ELSE {low} END)"


def seniority_re(alternatives: str) -> str:
    return q(f"(?i)\\b({alternatives})\\b")


PLACELESS = ", ".join(q(p) for p in X.PLACELESS_LOCATIONS)


def _split_parts(s: str) -> str:
    return f"list_filter(list_transform(string_split({s}, ','), lambda x: {utrim('x')}), lambda x: x <> '')"


def split_city(raw: str) -> str:
    s = utrim(f"coalesce({raw}, '')")
    parts = _split_parts(s)
    return (f"(CASE WHEN {s} = '' THEN '' WHEN lower({s}) IN ({PLACELESS}) THEN '' "
            f"WHEN len({parts}) >= 2 THEN ({parts})[1] ELSE '' END)")


def split_country(raw: str) -> str:
    s = utrim(f"coalesce({raw}, '')")
    parts = _split_parts(s)
    return (f"(CASE WHEN {s} = '' THEN '' WHEN lower({s}) IN ({PLACELESS}) "
            f"THEN upper(substr(lower({s}), 1, 1)) || substr(lower({s}), 2) "
            f"WHEN len({parts}) >= 2 THEN ({parts})[-1] WHEN len({parts}) = 1 THEN ({parts})[1] ELSE '' END)")


def location_key(city: str, country: str) -> str:
    return (f"coalesce(nullif(concat_ws('|', nullif({lower(utrim(city))}, ''), "
            f"nullif({lower(utrim(country))}, '')), ''), 'remote')")


def geocode_display(city: str, country: str) -> str:
    return f"coalesce(nullif(concat_ws(', ', nullif({city}, ''), nullif({country}, '')), ''), 'Remote')"
