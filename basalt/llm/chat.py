"""Chat formatting from an event log, with DataFrame functions only.

Events (conv_id, seq, turn, kind, role, text) are folded to final messages and rendered:

* ``message`` opens a message of its turn; ``delta`` appends to the turn's latest message;
* ``edit`` replaces its text; ``regenerate`` empties it for a new answer and takes back what was said
  before at later turns of the conversation.

A message is rendered as ``<turn>role``, a line feed, its text, ``</turn>`` and a line feed.  In roles and
texts every ``<turn`` or ``</turn`` gets one backslash after its ``<`` (and one more if there are some),
which taking one away undoes; in roles a backslash and a line feed are written as two characters first.

The log is folded in two shuffles, by message and then by conversation; what is collected for a
conversation is its own rendered turns, as its output row is one string.

Defined results: null texts and roles are empty; very long texts are rendered whole; events of equal ``seq`` (a tie) follow in the order of kind,
role and text; repeated message rows are messages of their own; a delta, edit or regeneration without a
message makes one; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
LEARNED_ROLE = "assistant"

_ESCAPE = (r"<(\\*)(/?turn)", r"<\\$1$2")
_UNESCAPE = (r"<\\(\\*)(/?turn)", r"<$1$2")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *_ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *_UNESCAPE)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``; a doubled backslash is set aside while ``\\n`` is read."""
    pairs = F.transform(F.split(unescape(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(pairs, "\\")


def messages_as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, part (from 0, among a turn's messages), role, text."""
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    log = events.select(
        "conv_id", "turn", "seq", rank.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    again = log.filter("kind = 1").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "seq")).alias("again"))
    taken_back = F.exists("again", lambda r: (r["turn"] < F.col("turn")) & (r["seq"] > F.col("seq")))
    live = log.join(again, "conv_id", "left").filter(~F.coalesce(taken_back, F.lit(False))).drop("again")
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.greatest(F.sum((F.col("kind") == 0).cast("int")).over(order) - 1, F.lit(0))
    since = F.sum((F.col("kind") < 3).cast("int")).over(order)
    versions = live.withColumn("part", opened).withColumn("version", since)
    event = F.struct("version", "seq", "kind", "role", "text")
    grouped = versions.groupBy("conv_id", "turn", "part").agg(F.array_sort(F.collect_list(event)).alias("e"))
    latest = F.filter("e", lambda x: x["version"] == F.element_at("e", -1)["version"])
    text = F.array_join(F.transform(latest, lambda x: x["text"]), "")
    role = F.coalesce(F.get(F.filter(F.transform("e", lambda x: x["role"]), lambda r: r != ""), F.lit(0)), F.lit(""))
    return grouped.select("conv_id", "turn", "part", role.alias("role"), text.alias("text"))


def render(messages: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """conv_id and segments: (text, loss) pieces in order, whose texts joined are the formatted conversation.

    ``loss`` marks exactly the escaped texts of the learned role.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    turn = F.struct("turn", "part", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == learned_role).alias("loss"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    pieces = F.flatten(
        F.transform(
            "t",
            lambda x: F.array(
                F.struct(x["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(x["body"].alias("text"), x["loss"].alias("loss")),
                F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return turns.select("conv_id", pieces.alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def format_conversations(events: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """conv_id, formatted (the string to train on) and segments (its pieces with the loss mask)."""
    made = render(fold_events(events), learned_role)
    return made.select("conv_id", formatted(F.col("segments")).alias("formatted"), "segments")


def parse_formatted(text: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    turns = F.split(text, CLOSE, -1)
    bodies = F.transform(F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0))), lambda t: F.substring(t, len(OPEN) + 1, 2**31 - 1))
    return F.transform(
        bodies,
        lambda t: F.struct(
            unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
            unescape(t.substr(F.locate("\n", t) + 1, F.length(t))).alias("text"),
        ),
    )
