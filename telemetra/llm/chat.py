"""Chat formatting: fold an event log to final messages, then render them.

Events carry conversation, message, sequence, kind, role and text.  The text of
a message is what its last ``message``, ``edit`` or ``regenerate`` event says,
followed by the ``delta`` events after it.  Messages are folded and rendered one
by one in parallel; only finished pieces meet in the row of their conversation,
which is one record by its nature.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the template.  Texts hold none of them once escaped.
START, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Characters that begin a control string, and what stands for them; the first one is the escape itself.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")]


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def fold(events: DataFrame, conv: str, message: Sequence[str], seq: str = "seq", kind: str = "kind",
         role: str = "role", text: str = "text") -> DataFrame:
    """(conv, *message, role, text): the final text of every message.

    Events of equal sequence are taken in the order of kind and text, so repeated
    runs agree.  An unknown or null kind counts as ``message``; null texts are
    empty; the role is that of the last replacing event.  A message with deltas
    only starts from nothing and takes its first role.
    """
    e = F.struct(F.col(seq).alias("s"), (F.coalesce(F.col(kind), F.lit("message")) == "delta").alias("d"),
                 F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(role).alias("r"))
    g = events.groupBy(conv, *message).agg(F.sort_array(F.collect_list(e)).alias("_e"))
    last = F.array_max(F.transform(F.col("_e"), lambda x, i: F.when(x["d"], F.lit(-1)).otherwise(i)))
    base = F.greatest(last, F.lit(0)) + 1
    rest = F.slice("_e", base, F.size("_e") - base + 1)
    return g.select(conv, *message, F.element_at("_e", base)["r"].alias("role"),
                    F.array_join(F.transform(rest, lambda x: x["t"]), "").alias("text"))


def render(messages: DataFrame, conv: str, order: Sequence[str], loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, mask): one record per conversation.

    ``mask`` has a run per message, in order: characters before its text, of its
    text and after it, and whether the text is trained on.  A null role is empty.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(START), escape(role), F.lit(BODY))
    piece = messages.select(conv, F.struct(*order).alias("_o"), head.alias("_h"), escape(text).alias("_t"), (role == loss_role).alias("_l"))
    run = F.struct(F.char_length("_h").alias("head"), F.char_length("_t").alias("text"), F.lit(len(END)).alias("tail"), F.col("_l").alias("loss"))
    one = F.struct(F.col("_o").alias("o"), F.concat("_h", "_t", F.lit(END)).alias("p"), run.alias("m"))
    g = piece.groupBy(conv).agg(F.sort_array(F.collect_list(one)).alias("_x"))
    return g.select(conv, F.array_join(F.transform("_x", lambda x: x["p"]), "").alias("formatted"),
                    F.transform("_x", lambda x: x["m"]).alias("mask"))


def read_back(records: DataFrame) -> Column:
    """The turns (role, text, masked text or null) read from ``formatted`` and ``mask``."""
    parts = F.split(F.col("formatted"), F.lit(r"<\|end\|>"), -1)
    pieces = F.slice(parts, 1, F.size(parts) - 1)
    def turn(p, m):
        return F.struct(
            unescape(F.substring_index(F.substring(p, len(START) + 1, F.length(p)), BODY, 1)).alias("role"),
            unescape(F.substring(p, F.char_length(F.substring_index(p, BODY, 1)) + len(BODY) + 1, F.length(p))).alias("text"),
            F.when(m["loss"], unescape(F.substring(p, m["head"] + 1, m["text"]))).alias("loss"))
    return F.zip_with(pieces, F.col("mask"), turn)


def digest(records: DataFrame, conv: str) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the records alone."""
    r = records.withColumn("_turns", read_back(records))
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("_turns", lambda x: x["loss"].isNotNull()), lambda x: x["loss"]), "")
    r = r.withColumn("_loss", loss)
    return r.select(conv, F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                    F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars"))


def format_chats(events: DataFrame, conv: str, message: Sequence[str], loss_role: str = "assistant", **names) -> DataFrame:
    """Fold and render: one record per conversation, messages ordered by the ``message`` columns."""
    return render(fold(events, conv, message, **names), conv, message, loss_role)
