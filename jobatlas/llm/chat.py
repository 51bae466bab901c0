"""Operator 10: chat formatting with Spark expressions only.

Turns are collected per conversation and sorted as structs (turn, role, text); adjacent
turns of one role become one block::

    <|im_start|>role\\ntext[<|im_sep|>text...]<|im_end|>\\n

Control strings inside texts are escaped: ``<|`` gains a backslash after ``<``, and so does
``<`` plus any backslashes plus ``|``, so that an escaped text never holds ``<|`` and
unescaping takes exactly one backslash away.  In role names a backslash and a line feed are
escaped as well.  The loss mask is a list of spans (``start`` from 0, ``length``, in code points of
the formatted text): one span per assistant turn, text only.

Defined cases: null role or text counts as empty; null turns sort first; rows that repeat a
turn follow in order of role and text; a null conversation id is a conversation; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = unescape(role)
    return F.regexp_replace(F.regexp_replace(plain, r"(?<!\\)((?:\\\\)*+)\\n", "$1\n"), r"\\\\", r"\\")


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``, one row per conversation."""
    rows = turns.select("conv_id", F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def role_at(i: Column) -> Column:
        return F.get(F.col("turns"), i)["role"]

    def piece(t: Column, i: Column) -> Column:
        opens = ~role_at(i - 1).eqNullSafe(t["role"])
        closes = ~role_at(i + 1).eqNullSafe(t["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP)).alias("head"),
            escape(t["text"]).alias("body"), F.when(closes, F.lit(END + "\n")).otherwise(F.lit("")).alias("tail"),
            t["role"].isin(*loss_roles).alias("loss"))

    pieces = convs.select("conv_id", F.transform("turns", piece).alias("pieces"))
    span = "struct<start: bigint, length: bigint>"
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(f"array<{span}>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).alias("at"),
            F.when(p["loss"], F.concat(F.coalesce(acc["spans"], F.array().cast(f"array<{span}>")), F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: F.coalesce(acc["spans"], F.array().cast(f"array<{span}>")))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return pieces.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns array<struct<role, text>>, loss_text)``, read back from the formatted
    text and its mask alone."""
    def turns_of(block: Column) -> Column:
        at = F.instr(block, "\n")
        body = F.substr(block, at + 1, F.length(block) - at - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(
            unescape_role(F.substr(block, F.lit(1), at - 1)).alias("role"), unescape(x).alias("text")))

    blocks = F.split("formatted", r"<\|im_start\|>")
    return formatted.select(
        "conv_id", "formatted",
        F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turns_of)).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(
            F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "").alias("loss_text"))
