"""Operator 1, preference formatting of chosen and rejected conversations.

A pair of conversations shares the turns before the first turn number at which
their messages differ.  These are rendered once, as the prompt, and what
follows is rendered for each side with a mask: of a completion's assistant
turns the text and the end mark train, everything else is context.

Everything is a join or an aggregate over single turns: a message that only one
side has shows up in a count per (pair, turn, role, text), and the least such
turn is the border.  No conversation is gathered into one row, so a very long
one spreads like any other rows.

Rows without a conversation id belong to none and are left out.  A null turn
comes before all others, a null role reads ``unknown``, a null text is empty.
Repeated rows count once; messages of the same turn are ordered by role and
text.  Equal sides give a prompt and no completion; sides that differ from the
start give no prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEAD, CLOSE, END = "<|", "|>\n", "<|end|>\n"
FIRST = -(1 << 63)
TRAINED = "assistant"


def turns(rows: DataFrame, pair: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair, turn, role, text) with nulls replaced."""
    return rows.where(F.col(pair).isNotNull()).select(
        F.col(pair).alias("pair"), F.coalesce(F.col(turn).cast("long"), F.lit(FIRST)).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def formatted(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair, part, turn, role, rendered, train_from, train_to) for two tables of :func:`turns`.

    ``part`` is prompt, chosen or rejected.  The characters of ``rendered`` from
    ``train_from`` to before ``train_to`` train; both are 0 where none does.
    """
    sides = chosen.withColumn("side", F.lit(1)).unionAll(rejected.withColumn("side", F.lit(2)))
    message = sides.groupBy("pair", "turn", "role", "text").agg(
        F.max(F.col("side") == 1).alias("in_chosen"),
        F.max(F.col("side") == 2).alias("in_rejected"))
    border = message.where("in_chosen <> in_rejected").groupBy("pair").agg(F.min("turn").alias("border"))
    placed = message.join(border, "pair", "left")
    shared = F.col("border").isNull() | (F.col("turn") < F.col("border"))
    part = F.when(shared, F.array(F.lit("prompt"))).otherwise(F.array_compact(F.array(
        F.when(F.col("in_chosen"), "chosen"), F.when(F.col("in_rejected"), "rejected"))))
    head = F.concat(F.lit(HEAD), F.col("role"), F.lit(CLOSE))
    rendered = F.concat(head, F.col("text"), F.lit(END))
    trains = (F.col("part") != "prompt") & (F.col("role") == TRAINED)

    def place(x: Column) -> Column:
        return F.when(trains, F.length(x)).otherwise(0).cast("long")

    return placed.withColumn("part", F.explode(part)).select(
        "pair", "part", "turn", "role", rendered.alias("rendered"), place(head).alias("train_from"),
        place(rendered).alias("train_to"))


def answer_pairs(conversations: DataFrame, id: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations with whole-number ids.

    Chosen is a conversation as it is.  Rejected is the same up to its last
    assistant turn, which is replaced by the last assistant turn of the
    conversation whose id differs in the lowest bit; without such a partner the
    answer is missing.  Conversations without an assistant turn are rejected
    as they are.
    """
    chosen = turns(conversations, id).distinct()
    said = chosen.where(F.col("role") == TRAINED)
    last = said.groupBy("pair").agg(F.max(F.struct("turn", "text")).alias("last"))
    own = last.select("pair", F.col("last.turn").alias("at"))
    other = last.select(F.col("pair").bitwiseXOR(F.lit(1)).alias("pair"), F.col("last.text").alias("text"))
    before = chosen.join(own, "pair", "left").where("at is null or turn < at").select(*chosen.columns)
    answer = own.join(other, "pair").select("pair", F.col("at").alias("turn"), F.lit(TRAINED).alias("role"), "text")
    return chosen, before.unionAll(answer)
