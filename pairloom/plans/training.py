"""Queries of the general training-data problems (2, 3 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.drift import approve, changes, ingest, promote
from pairloom.operators.timestamps import capture_timestamps
from pairloom.operators.tool_calls import linked_calls
from pairloom.plans.registry import Registry
from pairloom.scratch import spool
from pairloom.session import table

REGISTRY = Registry()

P7_SQL = """
WITH e AS (
  SELECT row_id, capture_id, u.type AS type, u.sequence_index AS seq, u.name AS name, u.call_id AS call_id, u.tools_offered AS offered
  FROM (SELECT row_id, capture_id, unnest(trace.events) AS u FROM multi_round_tools)
), c AS (SELECT * FROM e WHERE type = 'tool_call'),
m AS (
  SELECT c.row_id, c.seq, max(e.seq) AS model_seq
  FROM c JOIN e ON e.row_id = c.row_id AND e.type = 'model_call' AND e.seq < c.seq GROUP BY ALL
), r AS (SELECT row_id, call_id, min(seq) AS result_seq FROM e WHERE type = 'tool_result' AND call_id IS NOT NULL GROUP BY ALL),
g AS (
  SELECT capture_id, t.id AS call_id, min(message_id) AS message_id
  FROM (SELECT capture_id, message_id, unnest(tool_calls) AS t FROM chat_messages) GROUP BY ALL
)
SELECT CAST(c.row_id AS BIGINT) AS row_id, CAST(coalesce(c.seq, -1) AS BIGINT) AS call_seq,
  CAST(coalesce(m.model_seq, -1) AS BIGINT) AS model_seq,
  CAST(coalesce(nullif(coalesce(list_position(o.offered, c.name), 0), 0) - 1, -1) AS BIGINT) AS tool_pos,
  CAST(coalesce(r.result_seq, -1) AS BIGINT) AS result_seq, CAST(coalesce(g.message_id, -1) AS BIGINT) AS message_id
FROM c LEFT JOIN m ON m.row_id = c.row_id AND m.seq = c.seq
LEFT JOIN e AS o ON o.row_id = c.row_id AND o.type = 'model_call' AND o.seq = m.model_seq
LEFT JOIN r ON r.row_id = c.row_id AND r.call_id = c.call_id
LEFT JOIN g ON g.capture_id = c.capture_id AND g.call_id = c.call_id
"""


@REGISTRY.add("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every timestamp text that needs normalising and names one instant."""
    read = capture_timestamps(table(spark, folder, "multi_round_tools"), table(spark, folder, "source_traces"), table(spark, folder, "recorders"))
    return read.where("status = 'ok'").select("table_name", F.col("row_id").cast("long").alias("row_id"), "sequence_index", "utc_us")


@REGISTRY.add("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change between consecutive files of a stream, from the rescued ingestion of their records."""
    files = table(spark, folder, "capture_files")
    rows = spool(ingest(files), "capture_files")
    changed = changes(files, rows)
    return changed.select("stream", F.col("file_no").cast("long").alias("file_no"), "change", "field", "new_field")


@REGISTRY.add("p3_captures")
def p3_captures(spark: SparkSession, folder: str) -> DataFrame:
    """All capture records as one table: renamed and retyped fields in their typed columns, the rest still rescued."""
    files = table(spark, folder, "capture_files")
    rows = spool(ingest(files), "capture_files")
    approved = approve(spool(changes(files, rows), "drift-changes"))
    return promote(rows, approved)


@REGISTRY.add("p7_found", P7_SQL)
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every executed call with what it belongs to."""
    return linked_calls(table(spark, folder, "multi_round_tools"), table(spark, folder, "chat_messages"))
