"""Operator 8: chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn, role, text); neighbours with one role share
one block: a turn opens a block if the role before it differs, and closes it if the role after it differs. Blocks are
``<|role|>\\n`` text ``<|+|>`` text ... ``<|end|>\\n``. Inside texts and roles a backslash, ``<`` and ``[`` are written
``\\b``, ``\\l`` and ``\\s`` (in roles ``|`` also, as ``\\p``), so that neither this template's marks nor those of other
common templates can occur there, and ``parse`` gives the turns back exactly. ``loss_mask`` has the run lengths of the
formatted text in order, each with whether it is under the loss (assistant texts only).

Defined results: null texts and roles are empty; ties in ``turn`` are put in order by role and text, a null turn first;
repeated rows are turns of their own; a null conv_id is a conversation; other columns are ignored; an empty table gives
no rows. A conversation is one output row, so it is inherently gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks.
OPEN, CLOSE_ROLE, JOIN, END = "<|", "|>\n", "<|+|>", "<|end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = text
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"), *([("|", "\\p")] if role else [])):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    out = text
    for plain, coded in (("|", "\\p"), ("[", "\\s"), ("<", "\\l"), ("\\", "\\b")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of rows (conv_id, turn, role, text)."""
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        final = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(CLOSE_ROLE))).otherwise(F.lit(JOIN)).alias("mark"),
            escape(t["text"]).alias("body"),
            F.when(final, F.lit(END)).otherwise(F.lit("")).alias("end"),
            (t["role"] == LOSS_ROLE).alias("loss"),
        )

    pieces = chats.select("conv_id", F.transform("turns", piece).alias("pieces"))
    run = lambda text, loss: F.struct(F.length(text).cast("long").alias("chars"), loss.alias("loss"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"], p["end"])), "").alias("formatted"),
        F.flatten(F.transform("pieces", lambda p: F.array(run(p["mark"], F.lit(False)), run(p["body"], p["loss"]), run(p["end"], F.lit(False))))).alias("loss_mask"),
    )


def under_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts, unescaped, that the mask puts under the loss, cut out of the formatted text by the mask's run lengths."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("cut"))

    def step(acc: Column, m: Column) -> Column:
        piece = F.substr(formatted, acc["at"].cast("int"), m["chars"].cast("int"))
        return F.struct((acc["at"] + m["chars"]).alias("at"), F.when(m["loss"], F.concat(acc["cut"], F.array(piece))).otherwise(acc["cut"]).alias("cut"))

    return F.transform(F.aggregate(loss_mask, start, step)["cut"], unescape)


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(b, r"\|>\n", 2))
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.split(p[1], r"<\|\+\|>", -1),
                lambda text: F.struct(unescape(F.substr(p[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(text).alias("text")),
            ),
        )
    )
