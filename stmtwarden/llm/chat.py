"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations: ``start`` opens a message, ``delta`` adds
text to it, ``edit`` replaces its text, ``regenerate`` empties it for a new
answer, ``delete`` removes it. Events are folded in order of their sequence
number into final messages, messages into one formatted text per conversation
with spans of assistant text for the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPE = "\\"
#: Characters that marks are made of, and what stands for them inside texts. The escape itself comes first.
CODES = [(ESCAPE, "b"), ("<", "l"), ("#", "h")]
HEAD, TAIL = "### ", "</turn>\n"
RESETS = ("start", "edit", "regenerate", "delete")


def escaped(text: Column) -> Column:
    """Free of ``<`` and ``#``; every backslash is followed by a letter that says what stood there."""
    for char, code in CODES:
        text = F.replace(text, F.lit(char), F.lit(ESCAPE + code))
    return text


def unescaped(text: Column) -> Column:
    for char, code in reversed(CODES):
        text = F.replace(text, F.lit(ESCAPE + code), F.lit(char))
    return text


def escaped_role(role: Column) -> Column:
    """As a text, and free of colons, so that the first one ends it."""
    return F.replace(escaped(role), F.lit(":"), F.lit(ESCAPE + "c"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(ESCAPE + "c"), F.lit(":")))


def folded(events: DataFrame) -> DataFrame:
    """Messages (conv_id, msg_id, seq, role, text) from events (conv_id, msg_id, seq, kind, role, text).

    Events of one message apply in order of (seq, kind, text); equal rows are
    separate events. A null text is empty, a null kind a delta. Text counts
    from the last start, edit or regenerate on. The role is the last one given.
    ``seq`` of the message is its first event's. Deleted messages are left out.
    """
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    e = F.struct("seq", kind.alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("role").cast("string").alias("role"))
    log = events.groupBy("conv_id", "msg_id").agg(F.sort_array(F.collect_list(e)).alias("log"))
    at = F.transform("log", lambda x, i: F.when(x["kind"].isin(*RESETS), i).otherwise(-1))
    log = log.withColumn("last", F.array_max(at))
    log = log.where((F.col("last") < 0) | (F.get("log", F.col("last"))["kind"] != "delete"))
    live = F.filter("log", lambda x, i: i >= F.col("last"))
    roles = F.filter(F.col("log.role"), lambda r: r.isNotNull())
    return log.select("conv_id", "msg_id", F.get("log", F.lit(0))["seq"].alias("seq"), F.try_element_at(roles, F.lit(-1)).alias("role"), F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def formatted(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) from messages (conv_id, seq, msg_id, role, text), in order of seq, then msg_id, role and text.

    ``mask`` lists (start, length) in code points, 1-based, of each assistant
    text. A null role is written as an empty one. A turn is a head mark, the
    role, a colon and space, the text and a tail mark.
    """
    turn = F.struct("seq", "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(HEAD), escaped_role(t["role"]), F.lit(": "))
    parts = F.transform("turns", lambda t: F.struct(F.length(head(t)).alias("before"), F.length(escaped(t["text"])).alias("size"), (t["role"] == "assistant").alias("loss"), F.concat(head(t), escaped(t["text"]), F.lit(TAIL)).alias("out")))
    convs = convs.withColumn("parts", parts)
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        here = F.array(F.struct((acc["at"] + p["before"]).cast("long").alias("start"), p["size"].cast("long").alias("length")))
        return F.struct((acc["at"] + F.length(p["out"])).cast("long").alias("at"), F.when(p["loss"], F.concat(acc["mask"], here)).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("parts", start, step)["mask"]
    return convs.select("conv_id", F.array_join(F.col("parts.out"), "").alias("formatted"), mask.alias("mask"))


def read_back(texts: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss`` (text under the mask), read from ``formatted`` and ``mask`` alone."""
    pieces = F.split("formatted", TAIL)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    body = F.transform(pieces, lambda x: F.substr(x, F.lit(len(HEAD) + 1)))
    turns = F.transform(body, lambda x: F.struct(unescaped_role(F.substr(x, F.lit(1), F.instr(x, ":") - 1)).alias("role"), unescaped(F.substr(x, F.instr(x, ":") + 2)).alias("text")))
    loss = F.array_join(F.transform("mask", lambda m: unescaped(F.substr("formatted", m["start"].cast("int"), m["length"].cast("int")))), "")
    return texts.withColumns({"turns": turns, "loss": loss})


def events_of(conversations: DataFrame) -> DataFrame:
    """The log behind finished conversations (conv_id, turn, role, text): a start and a delta for each row.

    Rows that share a turn are messages of their own, repeated rows too: each
    gets an id made of its turn and a number within it. Rows without a turn
    come first; those without conv_id are one conversation.
    """
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.withColumn("msg_id", F.struct("turn", F.row_number().over(w).alias("nth")))
    empty, at = F.lit(None).cast("string"), F.coalesce(2 * F.col("turn"), F.lit(-(1 << 62)))
    both = F.array(
        F.struct(at.alias("seq"), F.lit("start").alias("kind"), "role", empty.alias("text")),
        F.struct((at + 1).alias("seq"), F.lit("delta").alias("kind"), empty.alias("role"), "text"),
    )
    return rows.select("conv_id", "msg_id", F.explode(both).alias("e")).select("conv_id", "msg_id", "e.*")
