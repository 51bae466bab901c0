"""Skill mining against a dictionary table (P5, large-dictionary form).

The literal-array form in :mod:`jobatlas.functions.text` puts the dictionary in
the plan; for dictionaries of many thousands of entries the dictionary is a
DataFrame ``(skill, pos)`` instead:

    documents --distinct tokens per document (explode)--> (key, token)
              join dictionary on token = skill   (broadcast only below a measured size)
              group by document: hits ordered by dictionary position

A document's group holds at most its own distinct tokens, so no group grows
with the table.  One-word entries are whole-token matches; entries with a
space keep the substring rule of the literal form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

BROADCAST_DICTIONARY_BYTES = 8 << 20


def dictionary_from_tokens(texts: DataFrame, text_col: str) -> DataFrame:
    """A one-word dictionary ``(skill)`` of the cleaned distinct tokens of a text column;
    its order is alphabetical, so it needs no position column (and no global ranking)."""
    toks = texts.select(F.explode(X.desc_tokens(X.lowered_text(F.col(text_col)))).alias("t"))
    return toks.select(F.btrim("t", F.lit(X.SKILL_CUTSET)).alias("skill")).where(F.col("skill") != "").distinct()


def mine_skills_with_table(docs: DataFrame, key: str, text, dictionary: DataFrame,
                           limit: int = BROADCAST_DICTIONARY_BYTES) -> DataFrame:
    """(key, skills) for every document with at least one dictionary entry.

    Skills come in dictionary order: by ``pos`` when the dictionary has that
    column, else alphabetically.  Entries with a space match as substrings of the text; there is
    no key to join those on, so each document is held against the list of them.
    """
    has_pos = "pos" in dictionary.columns
    d = dictionary.select("skill", F.col("pos") if has_pos else F.col("skill").alias("pos"))
    size = d.agg(F.sum(F.octet_length("skill") + F.lit(32)).alias("n"),
                 F.count_if(F.contains("skill", F.lit(" "))).alias("phrases")).first()
    mark = F.broadcast if (size.n or 0) <= limit else (lambda x: x)
    low = docs.select(F.col(key), X.lowered_text(text).alias("_low"))
    tokens = low.select(key, F.explode(F.array_distinct(X.desc_tokens("_low"))).alias("token"))
    hits = tokens.join(mark(d.where(~F.contains("skill", F.lit(" ")))), F.col("token") == F.col("skill"))
    hits = hits.select(key, "pos", "skill")
    if size.phrases:
        phrases = mark(d.where(F.contains("skill", F.lit(" "))))
        hits = hits.unionByName(low.join(phrases, F.contains("_low", "skill")).select(key, "pos", "skill"))
    return (hits.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("pos", "skill"))).alias("_h"))
            .select(key, F.transform("_h", lambda x: x["skill"]).alias("skills")))
