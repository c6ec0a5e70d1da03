"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; adjacent turns of one role share a block.
A block is ``<turn ROLE>`` text ``<next/>`` text ``</turn>`` and a line end. Inside
texts and roles the backslash and both angle brackets are written as backslash and a
letter, so a bracket in the output always belongs to a mark and all can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, NEXT, CLOSE = "<turn ", "<next/>", "</turn>"


def escape(text) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted.

    The segments, end to end, are the formatted text; those under the loss mask are
    the escaped texts of the ``learn`` role. Turns are ordered by turn (null first),
    then role, then text; repeated rows are turns of their own. A null role or text
    is empty. Rows with a null conversation form one. A conversation is one value
    of one row, so its turns meet in one task; nothing larger does.
    """
    turn = F.struct(turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"),
                    F.coalesce(turns[text_col], F.lit("")).alias("text"))
    rows = turns.groupBy(turns[conv_col].alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(x, i):
        same = (i > 0) & (F.get("turns", i - 1)["role"] == x["role"])
        head = F.when(same, F.lit(NEXT)).otherwise(F.concat(F.when(i > 0, F.lit(f"{CLOSE}\n")).otherwise(F.lit("")),
                                                            F.lit(OPEN), escape(x["role"]), F.lit(">")))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(x["text"]).alias("text"), (x["role"] == learn).alias("loss")))

    last = F.array(F.struct(F.lit(f"{CLOSE}\n").alias("text"), F.lit(False).alias("loss")))
    rows = rows.withColumn("segments", F.concat(F.flatten(F.transform("turns", pieces)), last))
    return rows.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))


def read_turns(formatted) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def block(b):
        role = F.substring_index(b, ">", 1)
        body = F.substring_index(F.substring(b, F.length(role) + 2, F.length(b)), CLOSE, 1)
        return F.transform(F.split(body, NEXT), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, OPEN)
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), block))


def read_loss(segments) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
