"""Chat formatting from an event log.

The log holds, for each conversation, numbered events about messages: ``message`` (a whole
text), ``delta`` (a streamed part), ``edit`` (a new text), ``regenerate`` (the text starts
anew, deltas follow). An edit or a regeneration of a message takes back every later message
logged before it. Folding gives the final messages, rendering one text per conversation.

Only built-in expressions, windows and aggregates are used. A conversation is one row in the
end, so its messages must meet; nothing larger is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
OPEN, CLOSE = "<s>", "</s>"
ASK, ANSWER = "[INST]", "[/INST]"
#: The role whose texts are learnt.
LEARNT_ROLE = "assistant"

# A control string inside a text gets one ``~`` behind its bracket; strings that already look
# escaped get one more, so that taking one away restores every text.
_CONTROL = r"([<\[])(~*(?:/?s>|/?INST\]|/?SYS\]|/?SYS>))"
_ESCAPED = r"([<\[])~(~*(?:/?s>|/?INST\]|/?SYS\]|/?SYS>))"

KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1~$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (``conv_id``, ``message``, ``role``, ``text``) of a log with columns
    ``conv_id``, ``seq``, ``kind``, ``message`` (its number in the conversation), ``role``, ``text``.

    Null texts are empty, a null kind is ``message``, other kinds are ignored. Events with equal
    ``seq`` are ordered by message, kind, role and text, so repeated rows fold the same way everywhere.
    The role is the last one given. Null conversations form one group. Other columns are dropped.
    """
    log = events.select(
        "conv_id",
        "message",
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.struct("seq", "message", "kind", "role", "text").alias("at"),
    ).where(F.col("kind").isin(*KINDS))
    later = Window.partitionBy("conv_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cuts = F.when(F.col("kind").isin("edit", "regenerate"), F.col("message"))
    log = log.withColumn("cut", F.min(cuts).over(later)).where(F.col("cut").isNull() | (F.col("message") <= F.col("cut")))
    # The text of a message starts anew with everything but a delta.
    so_far = Window.partitionBy("conv_id", "message").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = log.withColumn("start", F.sum(F.when(F.col("kind") == "delta", 0).otherwise(1)).over(so_far))
    whole = Window.partitionBy("conv_id", "message")
    log = log.withColumn("final", F.max("start").over(whole))
    parts = F.sort_array(F.collect_list(F.when(F.col("start") == F.col("final"), F.struct("at", "text"))))
    folded = log.groupBy("conv_id", "message").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role")))["role"].alias("role"),
    )
    return folded.select("conv_id", "message", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``formatted`` and ``loss_mask``, the
    (start, end) code points of each learnt text in order. A null role is the empty one."""
    role = F.coalesce("role", F.lit(""))
    learnt = role == LEARNT_ROLE
    head = F.concat(F.lit(OPEN), escape(role), F.when(learnt, F.lit(ANSWER)).otherwise(F.lit(ASK)))
    turns = messages.select("conv_id", "message", learnt.alias("learnt"), head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("size", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    begin = F.col("start") + F.length("head")
    span = F.when(F.col("learnt"), F.struct(begin.alias("start"), (begin + F.length("body")).alias("end")))
    turn = F.struct("start", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), span.alias("span"))
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("held"))
    return held.select(
        "conv_id",
        F.size("held").cast("long").alias("n_turns"),
        F.array_join(F.transform("held", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("held", lambda t: t["span"].isNotNull()), lambda t: t["span"]).alias("loss_mask"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    turns = F.filter(F.split(formatted, CLOSE), lambda t: F.length(t) > 0)

    def turn(t: Column) -> Column:
        # Neither mark can occur inside the escaped role or text.
        mark = F.when(F.instr(t, ANSWER) > 0, F.lit(ANSWER)).otherwise(F.lit(ASK))
        at = F.when(F.instr(t, ANSWER) > 0, F.instr(t, ANSWER)).otherwise(F.instr(t, ASK))
        role = F.substring(t, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(t, at + F.length(mark), F.length(t))).alias("text"))

    return F.transform(turns, turn)


def learnt_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    parts = F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return F.array_join(parts, "")


#: Parts a streamed text is logged in at most.
DELTAS = 8


def numbered(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation by turn, ties by role and text, each its own message."""
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", number.alias("message"), "role", "text")


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """A log that folds back to the turns of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``).

    By a hash of conversation and number a turn is logged as a whole message; as streamed deltas; as a draft, an
    early message after it and an edit of the draft, which takes the early message back; or as a draft that went on
    for a while, a regeneration, and deltas. Rows are in no order; ``seq`` tells it. Null texts become empty
    messages, a null role is never given.
    """
    turns = numbered(conversations).withColumn("whole", F.coalesce("text", F.lit("")))
    size = F.greatest(F.lit(1), F.ceil(F.length("whole") / DELTAS)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(DELTAS - 1)), lambda i: F.substring(F.col("whole"), i * size + 1, size))
    pieces = F.filter(pieces, lambda p: F.length(p) > 0)

    def event(place: Column | int, kind: str, text: Column, role: Column | None = None, later: int = 0) -> Column:
        return F.struct(
            (F.lit(place) if isinstance(place, int) else place).cast("long").alias("place"),
            F.lit(kind).alias("kind"),
            (F.col("message") + later).alias("message"),
            (F.lit(None) if role is None else role).cast("string").alias("role"),
            text.cast("string").alias("text"),
        )

    role, whole = F.col("role"), F.col("whole")
    deltas = F.transform(pieces, lambda p, i: event(i + 10, "delta", p))
    streamed = F.concat(F.array(event(0, "delta", F.lit(""), role)), deltas)
    draft = event(0, "message", F.concat(F.lit("draft of "), whole), role)
    edited = F.array(draft, event(1, "message", F.lit("an early answer"), F.lit("assistant"), 1), event(2, "edit", whole))
    again = F.concat(F.array(draft, event(1, "delta", F.lit(" and more")), event(2, "regenerate", F.lit(""))), deltas)
    way = F.pmod(F.xxhash64("conv_id", "message"), F.lit(4))
    events = F.when(way == 0, F.array(event(0, "message", F.col("text"), role))).when(way == 1, streamed).when(way == 2, edited).otherwise(again)
    logged = turns.select("conv_id", F.col("message").alias("turn"), F.explode(events).alias("e"))
    return logged.select("conv_id", (F.col("turn") * 1_000 + F.col("e.place")).alias("seq"), "e.kind", "e.message", "e.role", "e.text")
