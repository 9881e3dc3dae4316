"""Executed tool calls linked to the model call, offered tool, result and chat message they belong to.

Built on the adjacency table of :mod:`pairloom.operators.shred`. Defined results: a call before any model call has no
model (-1) and so no offered tool; null names, call ids and lists match nothing; a message row that came twice counts
once; missing links are -1. A model call at the call's own sequence_index is not before it. Events without a
sequence_index cannot be ordered and link to no model call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.shred import adjacency, pivot_objects

EVENT_LEAVES = ["type", "sequence_index", "name", "call_id"]


def event_entities(captures: DataFrame) -> DataFrame:
    """One row an event: row_id, capture_id, object, type, sequence_index, name, call_id, tools_offered."""
    nodes = adjacency(captures, "row_id", ["capture_id"], {"trace.events": (EVENT_LEAVES, ["tools_offered"])})
    # All later grouping, windows and links are within a root, so the one exchange is placed here.
    flat = pivot_objects(nodes.repartition("root"), [*EVENT_LEAVES, "capture_id"], ["tools_offered"])
    whole = Window.partitionBy("root")
    return (
        flat.withColumn("capture_id", F.max("capture_id").over(whole))
        .where(F.col("type").isNotNull())
        .select(F.col("root").alias("row_id"), "capture_id", "object", "type", F.col("sequence_index").cast("long").alias("sequence_index"), "name", "call_id", "tools_offered")
    )


def message_calls(messages: DataFrame) -> DataFrame:
    """The tool calls of chat messages, shredded: capture_id, call_id, message_id (the smallest of the pair)."""
    nodes = messages.select("capture_id", "message_id", F.explode("tool_calls.id").alias("call_id"))
    return nodes.where("capture_id is not null and call_id is not null").groupBy("capture_id", "call_id").agg(F.min("message_id").cast("long").alias("message_id"))


def linked_calls(captures: DataFrame, messages: DataFrame) -> DataFrame:
    """One row a tool_call event: row_id, call_seq, model_seq, tool_pos, result_seq, message_id."""
    events = event_entities(captures)
    before = Window.partitionBy("row_id").orderBy("sequence_index").rangeBetween(Window.unboundedPreceding, -1)
    same_id = Window.partitionBy("row_id", "call_id")
    is_model = (F.col("type") == "model_call") & F.col("sequence_index").isNotNull()
    model = F.last(F.when(is_model, F.struct("sequence_index", "tools_offered")), ignorenulls=True).over(before)
    calls = (
        events.where(F.col("type").isin("model_call", "tool_call", "tool_result"))
        .withColumn("model", F.when(F.col("sequence_index").isNotNull(), model))
        .withColumn("result_seq", F.min(F.when(F.col("type") == "tool_result", F.col("sequence_index"))).over(same_id))
        .where("type = 'tool_call'")
        .withColumn("result_seq", F.when(F.col("call_id").isNotNull(), F.col("result_seq")))
    )
    place = F.array_position("model.tools_offered", F.col("name")).cast("long") - 1
    linked = calls.join(message_calls(messages), ["capture_id", "call_id"], "left")
    gone = F.lit(-1).cast("long")
    return linked.select(
        F.col("row_id").cast("long").alias("row_id"),
        F.coalesce("sequence_index", gone).alias("call_seq"),
        F.coalesce("model.sequence_index", gone).alias("model_seq"),
        F.coalesce(place, gone).alias("tool_pos"),
        F.coalesce("result_seq", gone).alias("result_seq"),
        F.coalesce("message_id", gone).alias("message_id"),
    )


def entity_tables(captures: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables: events, offered (event to tool), results, message_calls; keys are row_id and object."""
    events = event_entities(captures)
    return {
        "events": events.drop("tools_offered"),
        "offered": events.select("row_id", "object", "sequence_index", F.posexplode("tools_offered").alias("position", "tool_name")),
        "results": events.where("type = 'tool_result'").select("row_id", "object", "sequence_index", "call_id", "name"),
        "message_calls": message_calls(messages),
    }
