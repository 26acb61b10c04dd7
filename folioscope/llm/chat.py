"""Chat formatting by Spark expressions only.

The template writes each run of adjacent turns of one role as one block::

    <|role:assistant|>first text<|next|>second text<|end|>

In texts ``<|`` is written ``<||``, so no text can hold a mark: after ``<|`` a mark has a letter, an
escaped text has ``|``. In roles ``%`` and ``|`` are written ``%25`` and ``%7C``. Reading a
conversation back splits at the marks and undoes that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, CLOSE, NEXT, END = "<|role:", "|>", "<|next|>", "<|end|>"
#: Role whose texts are under the loss mask.
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted`` of ``turns (conv_id, turn, role, text)``.

    Turns are sorted by turn, null turns last, ties by role and text, repeated rows stay. A null text or role is
    empty; a null ``conv_id`` is a conversation of its own. Other columns are not read.
    """
    row = F.struct(
        F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))

    def piece(x: Column, i: Column) -> Column:
        # get() beyond either end is null
        opens = F.coalesce(F.get("t", i - 1)["role"] != x["role"], F.lit(True))
        return F.concat(
            F.when(opens, F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(ROLE), escaped_role(x["role"]), F.lit(CLOSE)))
            .otherwise(F.lit(NEXT)),
            escaped(x["text"]))

    return sorted_turns.select(
        "conv_id", F.concat(F.array_join(F.transform("t", piece), ""), F.lit(END)).alias("formatted"))


def read_back(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns array<struct<role, text>>`` of ``conv_id, formatted``."""
    body = F.col("formatted").substr(F.lit(1), F.length("formatted") - len(END))
    blocks = F.split(body, r"<\|end\|>")

    def turns_of(block: Column) -> Column:
        close = F.instr(block, CLOSE)
        role = unescaped_role(block.substr(F.lit(len(ROLE) + 1), close - len(ROLE) - 1))
        texts = F.split(block.substr(close + len(CLOSE), F.length(block)), r"<\|next\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return conversations.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == TRAINED), lambda t: t["text"]), "")
