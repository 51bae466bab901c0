"""Operator 12: personal data by weak supervision, in DataFrame and SQL expressions only.

Base spans follow fixed rules (``BASE`` plus a check per kind) and always stay.  Looser forms --
spelled-out addresses, IPv6, other card and telephone formats, numbers that fail a base check -- are
candidates.  Labelers vote on every span, base or candidate, with 1, 0 (no opinion) or -1:

* ``rule``: the base rule holds, or a check of it fails;
* ``shape``: a regular expression for well-formed spans of the kind;
* ``gazetteer``: top-level domains, routable blocks, card issuers, calling codes;
* ``before``, ``after``: words of the kind, or of other numbers, in the text next to the span.

Expectation-maximisation over the counts of vote patterns (at most 3^5 a kind, so one bounded array a
kind) estimates how often each labeler votes how on true and on false spans, and with that how likely
each pattern is true.  These likelihoods train the final classifier, naive Bayes over hashed features of
a span, its votes and the words next to it, ``BUCKETS`` weights a kind.  A candidate is added if
the classifier holds it likelier true than not and its surroundings speak for it (a word next to it; for
an address, being spelled out under a known domain): numbers without any such sign stay alone.

Texts are read once.  Spans are found in the row of their text, without a shuffle: matches and the
gaps between them give the places, by running sums in blocks, and candidates are looked for where the
base spans, and candidates of earlier kinds, are blanked out, so none overlap.  All patterns run in
time linear in the text.

Defined cases: null or empty text has no span; places count code points; repeated rows get a row each; a null
``doc_id`` is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.session import cut_lineage, spread

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("rule", "shape", "gazetteer", "before", "after")
BUCKETS = 1024
SWEEPS = 25
#: Pseudo-counts: before any data a labeler is right this often, and wrong or silent once each.
TRUST = 4.0
#: So many spans, shared out like all others, are added to what is seen of each feature.
DRAWN = 2.0
#: Code points of context kept on either side of a span.
CONTEXT = 48
#: Matches of a text are summed up in blocks of this many.
BLOCK = 128

_LOCAL = "A-Za-z0-9._%+-"
# The base rules in a form that Java's engine runs in linear time: runs are tried from their start only, or from the end of
# the last match (\G), and never given back.  Runs of digits that are too short or too long for a card do not match at all.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\s@\s|\sat\s)"
_DOT = r"(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s|\.)"
_HEX = "0-9A-Fa-f"
LOOSE = {
    "email": rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++",
    "ip": rf"(?<![{_HEX}:.])(?:(?:[{_HEX}]{{1,4}}:){{7}}[{_HEX}]{{1,4}}|(?:[{_HEX}]{{1,4}}:){{1,6}}(?::[{_HEX}]{{1,4}}){{1,6}}"
          r"|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})" rf"(?![{_HEX}:])",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20./-][0-9])(?:[\x20./-]?[0-9]){12,18}+(?![\x20./-]?[0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][\x20().0-9-]{6,18}[0-9]|\(?[2-9][0-9]{2}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}"
             r"|0[1-9][0-9]{1,4}[\x20/-][0-9]{3,8}(?:[\x20-][0-9]{2,4}){0,3}+)(?![0-9])",
}
#: What a text must hold for a pattern to be tried at all.
_NEEDS = {"email": "@", "phone": "+"}

# Word lists and number ranges of the labelers.
WORDS = {
    "email": "e-?mail|mail|contact|write to|reach|correo|courriel|kontakt|adresse|address",
    "ip": "ip|ipv4|ipv6|host|server|client|login|ping|address|adresse|rechner",
    "card": "card|visa|mastercard|amex|credit|debit|cvv|tarjeta|carte|karte|kreditkarte|payment",
    "phone": "phone|tel|telephone|telefon|mobile|cell|fax|call|whatsapp|tel[eé]fono|t[eé]l[eé]phone|handy|anruf",
}
OTHER_WORDS = "version|release|build|isbn|issn|doi|order|invoice|serial|sku|ticket|section|chapter|figure|token|hash|id"
DOMAINS = "com|org|net|edu|gov|info|io|co|biz|eu|de|fr|es|it|nl|uk|us|ca|au|at|ch|be|br|mx|jp|cn|in|ru|pl|se|no|dk|fi|pt|ie|nz|test|example"
ISSUERS = r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[689]|35|6011|64[4-9]|65|62)"
CALLING_CODES = r"^(?:[17]|2[0-79]|3[0-469]|35|37|38|4[0-9]|5[0-9]|6[0-9]|8[124568]|9[0-689])"


def _raw(text: str) -> str:
    return f"r'{text}'"


def let(x: str, name: str, then: str) -> str:
    """SQL for ``then`` with ``name`` standing for ``x``, computed once."""
    return f"transform(array({x}), {name} -> {then})[0]"


def running(lengths: str) -> str:
    """SQL for the sums of what stands before each number of a non-empty array, in time n * BLOCK + (n / BLOCK)^2."""
    def scan(xs: str) -> str:
        return (f"aggregate({xs}, named_struct('at', 0L, 'out', CAST(array() AS array<bigint>)), "
                "(acc, x) -> named_struct('at', acc.at + x, 'out', array_append(acc.out, acc.at)), acc -> acc.out)")

    blocks = f"transform(sequence(0, CAST((size({lengths}) - 1) div {BLOCK} AS int)), k -> slice({lengths}, k * {BLOCK} + 1, {BLOCK}))"
    totals = "transform(blocks, b -> aggregate(b, 0L, (acc, x) -> acc + x))"
    sums = f"flatten(transform(blocks, (b, k) -> transform({scan('b')}, y -> y + get(firsts, k))))"
    return let(blocks, "blocks", let(scan(totals), "firsts", sums))


def digits(span: str) -> str:
    return f"regexp_replace({span}, '[^0-9]', '')"


def luhn(number: str) -> str:
    """SQL for whether a string of digits passes the checksum of card numbers."""
    worth = "CASE WHEN i % 2 = 0 THEN INT(c) WHEN INT(c) > 4 THEN 2 * INT(c) - 9 ELSE 2 * INT(c) END"
    return f"aggregate(transform(split(reverse({number}), '(?!$)'), (c, i) -> {worth}), 0, (acc, x) -> acc + x) % 10 = 0"


def holds(kind: str, span: str) -> str:
    """SQL for whether a match of the base pattern passes the kind's check."""
    if kind == "ip":
        # Long parts are no numbers below 256 unless they are zeros in front.
        return (f"forall(split({span}, r'\\.'), p -> regexp_replace(p, '^0+(?=.)', '') "
                "RLIKE '^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')")
    return {"email": "true", "card": luhn(digits(span)), "phone": f"length({digits(span)}) BETWEEN 8 AND 15"}[kind]


def _matches(text: str, pattern: str, needs: str) -> str:
    found = f"regexp_extract_all({text}, {_raw(pattern)}, 0)"
    return f"if(contains({text}, '{needs}'), {found}, NULL)" if needs else found


def located(text: str, pattern: str, needs: str = "") -> str:
    """SQL for the pattern's matches in a text: array of (span, start, end, before, after), or null if there is none."""
    lengths = "transform(found, (m, i) -> length(m) + length(get(gaps, i)) + 0L)"
    one = ("named_struct('span', m, 'start', get(at, i) + length(get(gaps, i)), 'end', get(at, i) + length(get(gaps, i)) + length(m), "
           f"'before', substring(get(gaps, i), -{CONTEXT}, {CONTEXT}), 'after', substring(get(gaps, i + 1), 1, {CONTEXT}))")
    places = let(lengths, "lengths", let(running("lengths"), "at", f"transform(found, (m, i) -> {one})"))
    return let(_matches(text, pattern, needs), "found",
               f"if(size(found) > 0, {let(f'split({text}, {_raw(pattern)}, -1)', 'gaps', places)}, NULL)")


def blanked(text: str, pattern: str, test: str = "true") -> str:
    """SQL for the text with those matches ``m`` that pass a test replaced by as many NULs."""
    filled = f"concat(get(gaps, i), if({test}, repeat(char(0), length(m)), m))"
    parts = f"concat(array_join(transform(found, (m, i) -> {filled}), ''), element_at(gaps, -1))"
    return let(_matches(text, pattern, ""), "found", let(f"split({text}, {_raw(pattern)}, -1)", "gaps", parts))


def _near(kind: str, words: str) -> str:
    own, other = (_raw(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{w})(?![\p{{L}}\p{{N}}])") for w in (WORDS[kind], OTHER_WORDS))
    return f"CASE WHEN {words} RLIKE {own} THEN 1 WHEN {words} RLIKE {other} THEN -1 ELSE 0 END"


#: Per kind: what speaks for and against a span's form, then for and against its parts (gazetteers).  ``s`` is the span.
_SHAPE = {
    "email": (r"s NOT RLIKE r'\s' AND contains(s, '@') OR s RLIKE r'(?i)[\])}]|\sdot\s'", r"s RLIKE r'\.\.|\.@|^\.'"),
    "ip": ("true", r"s RLIKE r'(?:^|\.)0[0-9]' OR contains(s, ':') AND NOT s RLIKE r'(?::[^:]+){2}|::[^:]*$'"),
    "card": (r"s RLIKE r'^(?:[0-9]{13,19}|[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$'", "true"),
    "phone": ("length(regexp_replace(s, '[^0-9]', '')) BETWEEN 9 AND 13",
              r"length(replace(s, '(', '')) <> length(replace(s, ')', '')) OR s RLIKE r'[.-]{2}|\x20{2}'"),
}
_GAZETTEER = {
    "email": (rf"s RLIKE r'(?i)[^a-z0-9](?:{DOMAINS})$'", "true"),
    "ip": (r"s RLIKE r'^0*(?!127[.\[])(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])(?:\.|\[)'", r"s RLIKE r'^[0-9]+[.\[]'"),
    "card": (f"{digits('s')} RLIKE {_raw(ISSUERS)}", "true"),
    "phone": (rf"if(s RLIKE r'^(?:\+|00)', regexp_replace({digits('s')}, '^00', '') RLIKE {_raw(CALLING_CODES)}, "
              f"{digits('s')} RLIKE '^(?:[2-9][0-9]{{2}}[2-9]|0[1-9])')", "true"),
}


def _judged(kind: str, base: bool) -> str:
    """SQL for one located span ``c`` with its votes and its features' slots in the classifier's weights."""
    k = KINDS.index(kind)
    # A pattern that speaks against an address or an odd form comes before what speaks for it.
    order = {"email": (1, 0), "ip": (1, 0), "phone": (1, 0), "card": (0, 1)}[kind]
    shape = " ".join(f"WHEN {_SHAPE[kind][i]} THEN {(1, -1)[i]}" for i in order)
    gazetteer = f"WHEN {_GAZETTEER[kind][0]} THEN 1 WHEN {_GAZETTEER[kind][1]} THEN -1"
    rule = "1" if base else f"if(s RLIKE {_raw(f'^(?:{BASE[kind]})$')}, -1, 0)"
    votes = (f"array({rule}, CASE {shape} ELSE 0 END, CASE {gazetteer} ELSE 0 END, {_near(kind, 'c.before')}, {_near(kind, 'c.after')})")
    form = r"regexp_replace(regexp_replace(regexp_replace(s, r'\p{L}+', 'a'), '[0-9]', '9'), r'\s', ' ')"
    said = [f"concat('{name}=', v[{i}])" for i, name in enumerate(LABELERS)]
    word = r"regexp_extract_all(lower(c.{}), r'[\p{{L}}\p{{N}}]+', 0)"
    seen = [f"concat('form=', substring({form}, 1, 40))", "concat('length=', least(length(s), 40))",
            "concat('word-1=', coalesce(try_element_at(b, -1), ''))", "concat('word-2=', coalesce(try_element_at(b, -2), ''))",
            "concat('word+1=', coalesce(try_element_at(a, 1), ''))", "concat('left=', substring(c.before, -1, 1))",
            "concat('right=', substring(c.after, 1, 1))"]
    slots = f"transform(array({', '.join(said + seen)}), x -> CAST(pmod(xxhash64(x), {BUCKETS}) + {k * BUCKETS} AS int))"
    signs = "v[3] > 0 OR v[4] > 0" + (" OR v[1] > 0 AND v[2] > 0" if kind == "email" else "")
    out = (f"named_struct('kind', {k}, 'start', c.start, 'end', c.end, 'base', {str(base).lower()}, 'votes', v, 'slots', {slots}, "
           f"'signs', {signs})")
    return let("c.span", "s", let(votes, "v", let(word.format("before"), "b", let(word.format("after"), "a", out))))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, loose)`` per row: its base spans and candidates, each with kind, places, votes and feature slots."""
    df = spread(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    none = "CAST(array() AS array<struct<span: string, start: bigint, end: bigint, before: string, after: string>>)"
    df = df.selectExpr("*", *[f"coalesce(filter({located('text', BASE[k], _NEEDS.get(k, ''))}, c -> {holds(k, 'c.span')}), {none}) AS base_{k}"
                              for k in KINDS])
    # Base spans are blanked kind by kind, then candidates one kind after the other.
    for k in KINDS:
        df = df.withColumn("text", F.expr(f"if(size(base_{k}) > 0, {blanked('text', BASE[k], holds(k, 'm'))}, text)"))
    for k in KINDS:
        df = df.withColumn(f"loose_{k}", F.expr(f"coalesce({located('text', LOOSE[k])}, {none})"))
        df = df.withColumn("text", F.expr(f"if(size(loose_{k}) > 0, {blanked('text', LOOSE[k])}, text)"))
    return df.selectExpr("doc_id", *[
        f"concat({', '.join(f'transform({p}_{k}, c -> {_judged(k, p == 'base')})' for k in KINDS)}) AS {p}" for p in ("base", "loose")])


def estimate(patterns: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """``patterns (kind, votes, n)`` with ``truth``, the likelihood that a span with these votes is true, by expectation-
    maximisation over labelers that err independently of each other.  The table has at most 3^labelers rows a kind."""
    per_kind = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("seen"))
    # Before any data: the majority of the votes.
    first = "transform(seen, p -> 1 / (1 + exp(-aggregate(p.votes, 0D, (acc, v) -> acc + v))))"

    def mass(part: str, hit: str = "true") -> str:
        return f"aggregate(rows, 0D, (acc, r) -> acc + if({hit}, r.seen.n * {part}, 0D))"

    vote = "get(r.seen.votes, j div 3) = j % 3 - 1"
    # Log of how much likelier each vote of each labeler is on true spans than on false ones; j = 3 * labeler + vote + 1.
    weight = (f"ln(({mass('r.truth', vote)} + if(j % 3 = 2, {TRUST}D, 1D)) / ({mass('r.truth')} + {TRUST + 2}D)) - "
              f"ln(({mass('(1 - r.truth)', vote)} + if(j % 3 = 0, {TRUST}D, 1D)) / ({mass('(1 - r.truth)')} + {TRUST + 2}D))")
    model = (f"named_struct('w', transform(sequence(0, {3 * len(LABELERS) - 1}), j -> {weight}), "
             f"'p', ln(({mass('r.truth')} + 1) / ({mass('(1 - r.truth)')} + 1)))")
    odds = "m.p + aggregate(transform(s.votes, (v, i) -> get(m.w, i * 3 + v + 1)), 0D, (acc, x) -> acc + x)"
    sweep = let("arrays_zip(seen, truth)", "rows", let(model, "m", f"transform(seen, s -> 1 / (1 + exp(-greatest(-30D, least(30D, {odds})))))"))
    truth = F.expr(f"aggregate(sequence(1, {sweeps}), {first}, (truth, k) -> {sweep})")
    zipped = per_kind.select("kind", F.explode(F.arrays_zip(F.col("seen"), truth.alias("truth"))).alias("r"))
    return zipped.select("kind", "r.seen.votes", F.col("r.seen.n").cast("long").alias("n"), "r.truth")


def train(found: DataFrame, truths: DataFrame) -> DataFrame:
    """One row ``(weights, priors)``: the classifier's log-odds per slot and per kind, learned from spans
    weighted with their patterns' likelihoods."""
    every = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.kind", "s.votes", "s.slots")
    known = every.join(F.broadcast(truths.select("kind", "votes", "truth")), ["kind", "votes"])  # at most 3^5 rows a kind
    seen = known.select(F.explode("slots").alias("slot"), "truth").groupBy("slot").agg(
        F.sum("truth").alias("yes"), F.sum(1 - F.col("truth")).alias("no"))
    sides = truths.groupBy("kind").agg(F.sum(F.col("n") * F.col("truth")).alias("all_yes"), F.sum(F.col("n") * (1 - F.col("truth"))).alias("all_no"))
    spark = found.sparkSession
    slots = spark.range(len(KINDS) * BUCKETS).select(F.col("id").cast("int").alias("slot"), F.floor(F.col("id") / BUCKETS).cast("int").alias("kind"))
    # How a feature moves a kind's odds, drawn towards no move at all: a feature that was never seen says nothing.
    all_yes, all_no = (F.coalesce(c, F.lit(0.0)) + 1 for c in ("all_yes", "all_no"))
    share = all_yes / (all_yes + all_no)
    odds = (F.log((F.coalesce("yes", F.lit(0.0)) + DRAWN * share) / (F.coalesce("no", F.lit(0.0)) + DRAWN * (1 - share)))
            - F.log(all_yes / all_no))
    weights = slots.join(F.broadcast(sides), "kind", "left").join(seen, "slot", "left").select("slot", odds.alias("w"))
    prior = F.log(all_yes / all_no)
    priors = spark.range(len(KINDS)).select(F.col("id").cast("int").alias("kind")).join(F.broadcast(sides), "kind", "left")
    rows = weights.select("slot", "w").unionByName(priors.select((F.col("kind") - len(KINDS)).alias("slot"), prior.alias("w")))
    model = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "w"))), lambda r: r["w"]).alias("all"))
    n = len(KINDS)
    return model.select(F.slice("all", 1, n).alias("priors"), F.slice("all", n + 1, n * BUCKETS).alias("weights"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)`` per row of ``docs``: arrays of (kind, start, end, score), sorted by kind
    (its place in ``KINDS``) and start.  ``score`` is the classifier's log-odds; base spans stay whatever it says."""
    found = cut_lineage(spans(docs, id_col, text_col), "pii-spans")
    every = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.kind", "s.votes")
    truths = cut_lineage(estimate(every.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))), "pii-truths")
    model = cut_lineage(train(found, truths), "pii-model")
    # The one row of the model reaches the tasks as a scalar subquery: a fixed number of weights.
    weights, priors = (model.select(c).scalar() for c in ("weights", "priors"))

    def scored(s: Column) -> Column:
        odds = F.aggregate(s["slots"], F.get("priors", s["kind"]), lambda acc, i: acc + F.get("weights", i))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), odds.alias("score"),
                        s["base"].alias("is_base"), s["signs"].alias("signs"))

    rows = found.withColumns({"weights": weights, "priors": priors})
    rows = rows.select("doc_id", F.transform(F.concat("base", "loose"), scored).alias("all"))
    plain = lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"])
    kept = F.filter("all", lambda s: s["is_base"] | s["signs"] & (s["score"] > 0))
    return rows.select("doc_id", F.sort_array(F.transform(F.filter("all", lambda s: s["is_base"]), plain)).alias("base"),
                       F.sort_array(F.transform(kept, plain)).alias("spans"))


def joined(spans_: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
