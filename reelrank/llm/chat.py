"""Chat formatting with Spark expressions only (operator 7).

A conversation's turns are collected as structs and sorted, adjacent turns of
one role are merged into a block, and blocks are concatenated between marks.
Marks inside texts are escaped with a backslash, so the string can be parsed
back into its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE_MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER_OPEN, OTHER_BODY, OTHER_CLOSE = "<|turn|>", "<|body|>", "<|end|>"   # any other role, by name
NEXT = "<|next|>"                                                        # between texts of a block
CONTROL = [*(m for pair in ROLE_MARKS.values() for m in pair), OTHER_OPEN, OTHER_BODY, OTHER_CLOSE, NEXT]
CLOSE = r"\[/INST\]|<</SYS>>|</s>|<\|end\|>"


def escape(text: Column) -> Column:
    """Double backslashes, then break each control string after its first
    character.  No mark remains, and none can form across a text's ends."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, which: int, other: Column) -> Column:
    out = None
    for name, marks in ROLE_MARKS.items():
        out = (F.when if out is None else out.when)(role == name, F.lit(marks[which]))
    return out.otherwise(other)


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _block(block: Column) -> Column:
    """Segments of one block: open mark, texts with marks between, close mark."""
    no = F.lit(False)
    role = F.get(block, 0)["role"]
    learnt = role == "assistant"
    texts = F.flatten(F.transform(block, lambda t, i: F.when(
        i == 0, F.array(_segment(escape(t["text"]), learnt))).otherwise(
        F.array(_segment(F.lit(NEXT), no), _segment(escape(t["text"]), learnt)))))
    named = F.concat(F.lit(OTHER_OPEN), escape(role), F.lit(OTHER_BODY))
    return F.concat(F.array(_segment(_by_role(role, 0, named), no)), texts,
                    F.array(_segment(_by_role(role, 1, F.lit(OTHER_CLOSE)), no)))


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    ``segments`` (array of text, loss) concatenate to ``formatted``; those
    with loss true, the assistant texts, are the loss mask.

    Edge cases: a null text or role is empty; null ids are one conversation;
    turns sort by (turn, role, text) with null turns first, so ties and
    repeated rows have a place and stay; an empty table gives no rows; other
    columns are ignored.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = (turns.groupBy(F.col(conv_id).alias("conv_id"))
            .agg(F.sort_array(F.collect_list(said)).alias("turns"))
            .withColumn("n", F.size("turns")))
    every = F.sequence(F.lit(1), F.col("n"))
    rows = rows.withColumn("starts", F.filter(every, lambda i: (i == 1) | (
        F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"])))
    rows = rows.withColumn("blocks", F.transform("starts", lambda s, k: F.slice(
        "turns", s, F.coalesce(F.get("starts", k + 1), F.col("n") + 1) - s)))
    rows = rows.withColumn("segments", F.flatten(F.transform("blocks", _block)))
    return rows.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                       "segments")


def parse_chat(formatted: Column) -> Column:
    """The turns, array of (role, text), that a formatted string holds."""
    def turns(block: Column) -> Column:
        role, body = F.lit(None).cast("string"), F.lit(None).cast("string")
        other = F.split(F.substr(block, F.lit(len(OTHER_OPEN) + 1)), r"<\|body\|>", 2)
        role = F.when(F.startswith(block, F.lit(OTHER_OPEN)), unescape(F.get(other, 0)))
        body = F.when(F.startswith(block, F.lit(OTHER_OPEN)), F.get(other, 1))
        for name, (mark, _) in ROLE_MARKS.items():
            here = F.startswith(block, F.lit(mark))
            role = role.when(here, F.lit(name))
            body = body.when(here, F.substr(block, F.lit(len(mark) + 1)))
        return F.transform(F.split(body, r"<\|next\|>", -1),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    blocks = F.split(formatted, CLOSE, -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))
