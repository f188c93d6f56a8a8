"""Chat formatting with DataFrame expressions only.

A conversation becomes one string: ``<s>``, its blocks, ``</s>``. A block is what neighbouring
turns of one role merge into; blocks of roles other than assistant stand between ``[INST]`` and
``[/INST]``. Each turn in a block begins with ``<|role|>``. In texts and roles ``~`` is written
``~0``, ``<`` ``~1`` and ``[`` ``~2``, in roles also ``|`` ``~3``; so no control string can
come from a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def _lit(text: str) -> Column:
    return F.lit(text)


def escape(text: Column) -> Column:
    """``text`` without control characters of the template."""
    return F.replace(F.replace(F.replace(text, _lit("~"), _lit("~0")), _lit("<"), _lit("~1")), _lit("["), _lit("~2"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape`` for texts and roles."""
    text = F.replace(F.replace(text, _lit("~3"), _lit("|")), _lit("~2"), _lit("["))
    return F.replace(F.replace(text, _lit("~1"), _lit("<")), _lit("~0"), _lit("~"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_mask.

    loss_mask is an array of (start, length), in characters of ``formatted`` from 0: the escaped
    assistant texts in order. Turns are sorted by number, then role, then text; null texts and
    roles count as empty, a null turn number sorts first, rows of a null conversation form one
    conversation, repeated rows stay repeated; an empty table gives no rows. Other columns are
    ignored, whatever their names. A conversation is one string by definition, so its turns meet
    in one row, however long its texts are; nothing larger than a conversation does.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role).cast("string"), _lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), _lit("")).alias("text"),
        ).alias("row"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    marked = F.transform(
        "turns",
        lambda t: F.struct(
            t["role"].alias("role"),
            F.concat(_lit("<|"), F.replace(escape(t["role"]), _lit("|"), _lit("~3")), _lit("|>")).alias("mark"),
            escape(t["text"]).alias("body"),
        ),
    )
    chats = chats.select("conv_id", marked.alias("turns"))
    # a turn opens a block where its role differs from the one before, and closes it likewise
    previous = F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t["role"]))
    chats = chats.withColumn("before", previous)
    instructed = lambda role: role != ASSISTANT
    pieces = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.concat(
                F.when(i == 0, _lit("<s>"))
                .when(instructed(F.element_at("before", i + 1)) & (F.element_at("before", i + 1) != t["role"]), _lit("[/INST]"))
                .otherwise(_lit("")),
                F.when(instructed(t["role"]) & ((i == 0) | (F.element_at("before", i + 1) != t["role"])), _lit("[INST]")).otherwise(_lit("")),
                t["mark"],
            ).alias("head"),
            t["body"].alias("body"),
            (~instructed(t["role"])).alias("learned"),
        ),
    )
    chats = chats.select(
        "conv_id",
        pieces.alias("pieces"),
        F.when(instructed(F.element_at("before", -1)), _lit("[/INST]</s>")).otherwise(_lit("</s>")).alias("tail"),
    )
    step = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(
                p["learned"],
                F.array_append(acc["mask"], F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))),
            )
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
    )
    joined = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), ""), F.col("tail"))
    return chats.select("conv_id", joined.alias("formatted"), step["mask"].alias("loss_mask"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, as they were) and loss_text, read from ``format_chats``."""
    bare = F.col("formatted")
    for control in ("<s>", "</s>", "[INST]", "[/INST]"):
        bare = F.replace(bare, _lit(control), _lit(""))
    parts = F.split(bare, r"<\|")
    turns = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: F.struct(
            unescape(F.substring_index(p, "|>", 1)).alias("role"),
            unescape(F.substring(p, F.locate("|>", p) + 2, F.length(p))).alias("text"),
        ),
    )
    learned = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(learned, "").alias("loss_text"))


def chat_digests(turns: DataFrame, **columns: str) -> DataFrame:
    """What the formatted strings say when read back: counts and digests per conversation."""
    read = parse_chats(format_chats(turns, **columns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], _lit("\n"), t["text"], _lit("\n"))), "")
    roles = F.transform("turns", lambda t: t["role"])
    blocks = F.size(F.filter(roles, lambda r, i: (i == 0) | (r != F.element_at(roles, F.greatest(i, F.lit(1))))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        blocks.cast("long").alias("n_blocks"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
