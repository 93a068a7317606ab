"""Chat formatting: turns to one marked text per conversation, with a loss mask.

Native expressions only.  The markers below never occur inside an escaped text, so a
formatted text can be split at them and read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, PART, END = "<|start|>", "<|text|>", "<|part|>", "<|end|>"


def escape(text: Column) -> Column:
    """Break up ``<|`` and ``|>``, of which every marker has one; undone by unescape."""
    for old, new in (("&", "&amp;"), ("<|", "&lt;|"), ("|>", "|&gt;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text: Column) -> Column:
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def format_chats(turns: DataFrame, trained: str = "assistant", conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``segments``, ``formatted``.

    ``segments`` are (text, loss) in order; their texts joined are ``formatted``, and loss
    marks the texts of the ``trained`` role.  Adjacent turns of one role share a header,
    each text a part of its own.  Rows go by turn, then role and text (null first), so ties
    and repeated rows have a fixed order and all stay.  Null role or text: empty.  Null
    conversation: one of its own.  Other columns are ignored; no rows give no rows.
    One conversation is one row, so one conversation must fit into memory.
    """
    picked = turns.select(
        turns[f"`{conv}`"].alias(conv),
        F.struct(turns[f"`{turn}`"].alias("turn"),
                 F.coalesce(turns[f"`{role}`"], F.lit("")).alias("role"),
                 F.coalesce(turns[f"`{text}`"], F.lit("")).alias("text")).alias("one"))
    sorted_turns = picked.groupBy(conv).agg(F.sort_array(F.collect_list("one")).alias("all"))

    def segment(what: Column, loss: Column) -> Column:
        return F.struct(what.alias("text"), loss.alias("loss"))

    def pieces(t: Column, k: Column) -> Column:
        begins = (k == 0) | (F.get("all", k - 1)["role"] != t["role"])
        head = F.when(begins, F.concat(F.when(k > 0, F.lit(END)).otherwise(""), F.lit(START),
                                       escape(t["role"]), F.lit(BODY))).otherwise(PART)
        return F.array(segment(head, F.lit(False)),
                       segment(escape(t["text"]), t["role"] == trained))
    last = F.array(segment(F.lit(END), F.lit(False)))
    marked = sorted_turns.select(
        conv, F.concat(F.flatten(F.transform("all", pieces)), last).alias("segments"))
    return marked.withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """``turns``: array of (role, text) that the formatted text was made from."""
    def marker(text: str) -> str:
        return text.replace("|", r"\|")
    split = formatted.withColumn(
        "turns", F.filter(F.split(column, marker(START)), lambda g: g != ""))

    def of_group(group: Column) -> Column:
        body = F.substring_index(F.substring_index(group, BODY, -1), END, 1)
        name = unescape(F.substring_index(group, BODY, 1))
        return F.transform(F.split(body, marker(PART)),
                           lambda p: F.struct(name.alias("role"), unescape(p).alias("text")))
    return split.withColumn("turns", F.flatten(F.transform("turns", of_group)))


def loss_text(segments: str = "segments") -> Column:
    """All texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"])), "")
