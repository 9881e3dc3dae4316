"""Conversations rebuilt from captures and message rows.

A conversation is a channel (its conversation_id); captures without one join the channel that their chain of parents
leads into. The place of a turn is its turn_index, or its parent's place plus one. Ordering by links and indexes stands
in for ordering by time and splitting at inactivity gaps (:mod:`pairloom.llm.sessions` does that, and how far the two
agree): a gap in the places is what an inactivity gap would be. Roles are inferred from their spellings, and conversations
without a reply to every turn are dropped.

No conversation is gathered: neighbours are compared through the parent link, counts are pre-aggregated, and chains
are followed by pointer doubling (as many rounds as the logarithm of the longest chain of gaps).

Defined results: repeated captures and message rows count once (of differing rows the smallest values count); blank
means no character but white space; a capture whose chain ends outside belongs to no conversation; a chain that runs
in a circle resolves to nothing; unknown roles are neither user nor assistant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.scratch import spool

# Spellings of roles.
ROLES = {"human": "user", "model": "assistant"}


def clean_role(role: Column) -> Column:
    """The role in lower case, with its other names replaced."""
    plain = F.lower(F.trim(role))
    for other, name in ROLES.items():
        plain = F.when(plain == other, name).otherwise(plain)
    return plain


def nearest_ancestor(rows: DataFrame) -> DataFrame:
    """For every row without a value, that of its nearest ancestor that has one.

    ``rows``: id (unique), parent, value. Returns id, value, steps for the rows whose value is null and whose chain
    reaches one. Pointer doubling: each round doubles the length of chain followed, and ends when none is left open.
    """
    found = rows.where("value is not null").select("id", "value", F.lit(0).cast("bigint").alias("steps"))
    lacking = rows.where("value is null and parent is not null")
    pointers = spool(lacking.select("id", F.col("parent").alias("at"), F.lit(1).cast("bigint").alias("more")), "chain")
    out = found.limit(0)
    reach, total = 1, pointers.count()
    # A chain is no longer than the rows without a value; pointers still open beyond that run in a circle.
    while total and reach <= 2 * total:
        # A pointer at a row resolved before is resolved too; one at a row resolved just now waits for the next round;
        # one at an open row jumps where that one points; one at no row is dropped.
        solved = spool(pointers.join(found.withColumnRenamed("id", "at"), "at").select("id", "value", (F.col("steps") + F.col("more")).alias("steps")), "chain-solved")
        out, found = out.unionByName(solved), found.unionByName(solved)
        left = pointers.join(solved.select("id"), "id", "left_anti")
        jump = left.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("more").alias("further"))
        stay = solved.select(F.col("id").alias("at"), F.col("id").alias("next"), F.lit(0).cast("bigint").alias("further"))
        pointers = spool(left.join(jump.unionByName(stay), "at").select("id", F.col("next").alias("at"), (F.col("more") + F.col("further")).alias("more")), "chain")
        if pointers.isEmpty():
            break
        reach *= 2
    return out


def placed_turns(captures: DataFrame) -> DataFrame:
    """Every capture of every conversation: conversation_id, capture_id, parent, place (null if it has none)."""
    one = spool(
        captures.where("capture_id is not null")
        .groupBy("capture_id")
        .agg(F.min("conversation_id").alias("conversation_id"), F.min(F.col("turn_index").cast("bigint")).alias("turn_index"), F.min("parent_capture_id").alias("parent")),
        "captures-once",
    )
    base = one.select(F.col("capture_id").alias("id"), "parent")
    joined = nearest_ancestor(one.select(F.col("capture_id").alias("id"), "parent", F.col("conversation_id").alias("value")))
    placed = nearest_ancestor(one.select(F.col("capture_id").alias("id"), "parent", F.col("turn_index").alias("value")))
    return (
        one.join(joined.select(F.col("id").alias("capture_id"), F.col("value").alias("_c")), "capture_id", "left")
        .join(placed.select(F.col("id").alias("capture_id"), (F.col("value") + F.col("steps")).alias("_p")), "capture_id", "left")
        .select(F.coalesce("conversation_id", "_c").alias("conversation_id"), "capture_id", "parent", F.coalesce("turn_index", "_p").alias("place"))
        .where("conversation_id is not null")
    )


def answered(messages: DataFrame) -> DataFrame:
    """capture_id of the captures with a user and an assistant message that are not blank."""
    role = clean_role(F.col("role"))
    spoken = F.col("content").rlike(r"(?U)\S")
    return (
        messages.where(spoken & role.isin("user", "assistant"))
        .groupBy("capture_id")
        .agg(F.bool_or(role == "user").alias("u"), F.bool_or(role == "assistant").alias("a"))
        .where("u and a")
        .select("capture_id")
    )


def sound_turns(captures: DataFrame, messages: DataFrame) -> DataFrame:
    """The turns of the sound conversations: conversation_id, turn_no, capture_id."""
    turns = spool(placed_turns(captures), "turns")
    before = turns.select(F.col("capture_id").alias("parent"), F.col("conversation_id").alias("parent_conversation"), F.col("place").alias("parent_place"))
    checked = (
        turns.join(before, "parent", "left")
        .join(answered(messages).withColumn("answered", F.lit(True)), "capture_id", "left")
        .select(
            "conversation_id",
            "capture_id",
            "place",
            F.coalesce(
                F.col("place").isNotNull()
                & F.col("answered")
                & (F.col("parent").isNull() | ((F.col("parent_conversation") == F.col("conversation_id")) & (F.col("parent_place") == F.col("place") - 1))),
                F.lit(False),
            ).alias("good"),
        )
    )
    checked = spool(checked, "turns-checked")
    # Distinct and without gap: as many places as turns, and as many as the span holds. Equal places meet first in a
    # finer grouping, so the largest conversation is pre-aggregated like any other.
    by_place = checked.groupBy("conversation_id", "place").agg(F.count("*").alias("n"), F.bool_and("good").alias("good"))
    spans = by_place.groupBy("conversation_id").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.sum("n").alias("turns"), F.count("*").alias("places"), F.bool_and("good").alias("good")
    )
    sound = spans.where("good and turns = places and last - first + 1 = turns").select("conversation_id", "first")
    return checked.join(sound, "conversation_id").select("conversation_id", (F.col("place") - F.col("first")).alias("turn_no"), "capture_id")


def whole_dialogues(captures: DataFrame, messages: DataFrame) -> DataFrame:
    """Every message of the sound conversations in order, with tool_calls and tool_call_id.

    One row a message; order by conversation_id, turn_no, seq, message_id. Blank messages stay: a request for tools often
    has no content, and the replies of the tools refer to it. Blank content counts for soundness only.
    """
    once = messages.groupBy("message_id").agg(
        F.min("capture_id").alias("capture_id"), F.min("seq").alias("seq"), F.min(clean_role(F.col("role"))).alias("role"), F.min("content").alias("content"),
        F.min("tool_calls").alias("tool_calls"), F.min("tool_call_id").alias("tool_call_id"),
    )
    return sound_turns(captures, messages).join(once, "capture_id").select("conversation_id", "turn_no", "seq", "message_id", "role", "content", "tool_calls", "tool_call_id")
