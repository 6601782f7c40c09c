"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log row is one event of one message of one conversation. Events are put in order of their sequence
number and folded: ``message`` and ``edit`` set the text, ``delta`` adds to it, ``regenerate`` starts it
anew. The messages of a conversation are then put in order and rendered with a turn template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Every ``<``, any backslashes, ``|`` gets one more backslash: no control string stays in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line: a backslash is doubled, a line feed becomes backslash n."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # doubled backslashes are taken from the left, so what stands between two of them holds none but those of line feeds
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Messages from events ``conv_id, msg, seq, kind, role, text``.

    Returns ``conv_id, msg, seq, role, text`` with the sequence number of a message's first event and the
    last role given. A null text adds nothing, a null role counts as empty, an unknown kind sets the text;
    events with one sequence number are folded in the order message, edit, regenerate, delta, then by text.
    """
    order = F.expr("case kind when 'edit' then 1 when 'regenerate' then 2 when 'delta' then 3 else 0 end")
    kept = events.select("conv_id", "msg", "seq", F.struct("seq", order.alias("o"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")).alias("e"))
    log = kept.groupBy("conv_id", "msg").agg(F.min("seq").alias("seq"), F.sort_array(F.collect_list("e")).alias("log"))
    # what stands before the last event that sets the text has no part in it
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["o"] == 3, 0).otherwise(i)))
    pieces = F.transform(F.slice("log", last + 1, F.size("log")), lambda e: e["text"])
    return log.select("conv_id", "msg", "seq", F.element_at("log", -1)["role"].alias("role"), F.array_join(pieces, "").alias("text"))


def format_chats(messages: DataFrame) -> DataFrame:
    """Render ``conv_id, msg, seq, role, text`` to ``conv_id, n_turns, formatted, loss_spans``; null roles and texts must be gone.

    Messages stand in order of seq, then msg. ``loss_spans`` are the half-open code point ranges of the
    escaped assistant texts in ``formatted``. A conversation is one row, by its nature; no messages give no row.
    Messages that repeat are rendered each.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "seq", "msg", (F.col("role") == "assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    # where a turn ends is a running sum within its conversation
    end = F.sum(F.length("head") + F.length("body") + F.lit(len(END) + 1)).over(Window.partitionBy("conv_id").orderBy("seq", "msg").rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumn("end", end - F.lit(len(END) + 1))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "msg", "head", "body", "loss", "end"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct((t["end"] - F.length(t["body"])).cast("int").alias("start"), t["end"].cast("int").alias("end")))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), spans.alias("loss_spans"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """The inverse: adds ``turns array<struct<role, text>>``, read back from ``formatted``; a column of that name is not allowed."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(p: Column) -> Column:
        head = F.instr(p, "\n")
        return F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, head + 1, F.length(p) - head - F.lit(len(END) + 1))).alias("text"))

    return chats.select("*", F.transform(pieces, turn).alias("turns"))


def loss_text(chats: DataFrame) -> DataFrame:
    """Adds ``loss_text``: all text under the loss mask, unescaped, nothing between."""
    cut = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return chats.select("*", F.array_join(cut, "").alias("loss_text"))


def conversation_events(conversations: DataFrame, size: int = 256) -> DataFrame:
    """The event log of a table of whole turns ``conv_id, turn, role, text``, as a chat service would have streamed it.

    An assistant's message begins with a draft, is regenerated and then comes in deltas of ``size`` characters; any
    other message begins with a draft and is edited to its text. Every row is a message of its own; rows with one turn
    number keep an order by role, then text. A null text or role counts as empty. Rows are dealt by conversation once,
    and what orders, folds and renders them needs no other exchange.
    """
    flat = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = flat.withColumn("msg", F.struct("turn", place.cast("long").alias("place")))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    draft = F.substring("text", 1, 16)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / size).cast("int") - 1), lambda i: event("delta", F.substr("text", i * size + 1, F.lit(size))))
    deltas = F.when(F.col("text") != "", cut).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    streamed = F.concat(F.array(event("delta", draft), event("regenerate", F.lit(None).cast("string"))), deltas)
    edited = F.array(event("message", draft), event("edit", F.col("text")))
    log = rows.select("conv_id", "msg", "role", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("step", "e"))
    return log.select("conv_id", "msg", F.struct("msg.turn", "msg.place", "step").alias("seq"), "e.kind", "role", "e.text")


def fold_conversations(conversations: DataFrame) -> DataFrame:
    """The messages of a table of whole turns, folded from its event log."""
    return fold_events(conversation_events(conversations))
