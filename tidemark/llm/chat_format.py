"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; neighbours of one role are merged into one block by array
functions; the blocks are concatenated. Template::

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT ...]<|im_end|>\\n

Texts and roles are escaped first (``\\`` doubled, ``<|`` written ``<\\|``), so that a control string in a text can never be
taken for the template's own, and reading back gives the text as it was. A line break in a role becomes ``<|im_nl|>``.

Defined results: null text or role counts as empty; rows that tie on ``turn`` are ordered by role, then text, null turns
first; repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives no rows; columns other
than the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, BREAK = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|im_nl|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) rows to one row each: conv_id, formatted, segments.

    ``segments`` cuts ``formatted`` into pieces of template and text, in order, each with ``loss``: true for exactly the texts
    of ``loss_role``. Concatenated, the pieces are ``formatted``.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    # Positions where a block begins: the role differs from the neighbour before.
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    with_blocks = sorted_turns.withColumn("begins", begins).withColumn(
        "blocks",
        F.transform(
            "begins",
            lambda b, k: F.struct(
                role_at(b).alias("role"),
                F.transform(F.slice("turns", b + 1, F.coalesce(F.get(F.col("begins"), k + 1), n) - b), lambda t: escape(t["text"])).alias("texts"),
            ),
        ),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = lambda block: F.concat(
        F.flatten(
            F.transform(
                block["texts"],
                lambda x, i: F.array(
                    piece(F.when(i == 0, F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n"))).otherwise(F.lit(SEP)), F.lit(False)),
                    piece(x, block["role"] == loss_role),
                ),
            )
        ),
        F.array(piece(F.lit(END), F.lit(False))),
    )
    segments = F.flatten(F.transform("blocks", pieces))
    return (
        with_blocks.select("conv_id", segments.alias("segments"))
        .select("conv_id", F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments")
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    turns_of = lambda b: F.transform(
        F.split(F.substring(b, F.instr(b, "\n") + 1, F.length(b)), r"<\|im_sep\|>"),
        lambda x: F.struct(
            unescape_role(F.substring(F.substring_index(b, "\n", 1), len(START) + 1, F.length(b))).alias("role"),
            unescape(x).alias("text"),
        ),
    )
    return F.flatten(F.transform(blocks, turns_of))


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
