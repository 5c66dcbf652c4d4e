"""Chat formatting with Spark expressions alone.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged into a block by
array functions, and the blocks are concatenated:

    <|im_start|>ROLE\\nTEXT<|im_next|>TEXT<|im_end|>\\n

Escaping is reversible: in a text or role, `<`, k backslashes and `|` become `<`, k + 1 backslashes and `|`, so no text
holds a control string. In roles, backslash and newline are also written as `\\s` and `\\n`.

The loss mask is an array of (block, text, start, chars) spans, one for each assistant text: the number of its block, its own in the block, and code points
from the block's beginning. So neither writing nor reading a span goes through what is before it.

Defined results: a null text or role is empty; turns that are null sort first; rows with equal turn sort by role, then
text, and repeated rows stay repeated; each row of a null conv_id is a conversation of its own, as nothing says which rows belong
together; a very long text is formatted whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_mask array of struct(block, start, chars)."""
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = turns.select("conv_id", "turn", "role", "text", alone.alias("alone")).groupBy("conv_id", "alone").agg(
        F.array_sort(
            F.collect_list(
                F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            )
        ).alias("turns")
    )
    # where blocks of one role start
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda x: escape(x["text"])
            ).alias("texts"),
        ),
    )
    head = lambda b: F.concat(F.lit(START), _escape_role(b["role"]), F.lit("\n"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(END + "\n"))), "")
    # of a block's texts, each begins where the one before it and a mark end
    span = "array<struct<block:int,text:int,start:bigint,chars:bigint>>"
    placed = lambda b, k, sums: F.transform(
        F.arrays_zip(b["texts"].alias("t"), sums.alias("end")),
        lambda x, i: F.struct(k.alias("block"), i.alias("text"), (F.length(head(b)) + x["end"] - F.length(x["t"]) - len(NEXT)).cast("bigint").alias("start"), F.length(x["t"]).cast("bigint").alias("chars")),
    )
    spans = lambda b, k: let(running_sums(F.transform(b["texts"], lambda t: (F.length(t) + len(NEXT)).cast("bigint"))), lambda sums: placed(b, k, sums))
    mask = F.flatten(F.transform("blocks", lambda b, k: F.when(b["role"] == LOSS_ROLE, spans(b, k)).otherwise(F.array().cast(span))))
    return grouped.withColumn("starts", starts).withColumn("blocks", blocks).select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Back from format_chats: conv_id, turns array of struct(role, text), loss_texts array of string."""
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    # a role holds no newline, so the first one ends it; every block is split once, for turns and spans
    body = lambda b: let(F.locate("\n", b), lambda at: F.substring(b, at + 1, F.length(b) - at - len(END) - 1))
    split = F.transform(blocks, lambda b: F.struct(_unescape_role(F.substring_index(b, "\n", 1)).alias("role"), F.transform(F.split(body(b), r"<\|im_next\|>", -1), unescape).alias("texts")))
    turns = lambda bs: F.flatten(F.transform(bs, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), t.alias("text")))))
    losses = lambda bs: F.transform("loss_mask", lambda s: F.get(F.get(bs, s["block"])["texts"], s["text"]))
    read = formatted.select("conv_id", "formatted", let(split, lambda bs: F.struct(turns(bs).alias("turns"), losses(bs).alias("loss_texts"))).alias("r"))
    return read.select("conv_id", "r.turns", "r.loss_texts", F.length("formatted").cast("bigint").alias("formatted_chars"))
