"""Queries of the llm problems, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import sessions as by_time
from pairloom.llm.dialogues import sound_turns, whole_dialogues
from pairloom.llm.history import replay_batches, rows_of
from pairloom.llm.mixing import mix, shares
from pairloom.llm.reading import reading_levels
from pairloom.llm.sketch import call_sketches, merge, percentiles
from pairloom.llm.tokenizer import encode
from pairloom.llm.topn import first_of_repeats, top_n
from pairloom.plans.registry import Registry
from pairloom.session import table

REGISTRY = Registry()

P4_SQL = """
WITH once AS (
  SELECT prompt_id, evaluator_name, example_id, delta + 0.0 AS delta, min(reg_id) AS reg_id
  FROM (SELECT * REPLACE (source_score + 0.0 AS source_score, target_score + 0.0 AS target_score, delta + 0.0 AS delta) FROM top_regressions)
  WHERE prompt_id IS NOT NULL AND evaluator_name IS NOT NULL AND delta IS NOT NULL AND NOT isnan(delta)
  GROUP BY prompt_id, evaluator_name, example_id, delta, run_id, kind, source_score, target_score, source_text, target_text, explanation, truncated
)
SELECT prompt_id, evaluator_name, rank_no, reg_id FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id, evaluator_name ORDER BY delta, example_id NULLS LAST, reg_id) AS rank_no FROM once
) WHERE rank_no <= 5
"""

P6_TURNS = r"""
WITH RECURSIVE one AS (
  SELECT capture_id, min(conversation_id) AS conversation_id, CAST(min(turn_index) AS BIGINT) AS turn_index, min(parent_capture_id) AS parent
  FROM multi_round_tools WHERE capture_id IS NOT NULL GROUP BY capture_id
), c AS (
  SELECT capture_id, conversation_id FROM one WHERE conversation_id IS NOT NULL
  UNION SELECT o.capture_id, c.conversation_id FROM one o JOIN c ON o.parent = c.capture_id WHERE o.conversation_id IS NULL
), p AS (
  SELECT capture_id, turn_index AS place FROM one WHERE turn_index IS NOT NULL
  UNION SELECT o.capture_id, p.place + 1 FROM one o JOIN p ON o.parent = p.capture_id WHERE o.turn_index IS NULL
), t AS (
  SELECT c.conversation_id, c.capture_id, o.parent, p.place,
    lag(c.capture_id) OVER (PARTITION BY c.conversation_id ORDER BY p.place, c.capture_id) AS before
  FROM c JOIN one o USING (capture_id) LEFT JOIN p USING (capture_id)
), m AS (
  SELECT capture_id FROM (
    SELECT capture_id, CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'model' THEN 'assistant' ELSE lower(trim(role)) END AS r
    FROM chat_messages WHERE regexp_matches(content, '\S')
  ) GROUP BY capture_id HAVING bool_or(r = 'user') AND bool_or(r = 'assistant')
), s AS (
  SELECT conversation_id, min(place) AS first FROM t LEFT JOIN m USING (capture_id)
  GROUP BY conversation_id
  HAVING count(place) = count(*) AND count(DISTINCT place) = count(*) AND max(place) - min(place) + 1 = count(*)
    AND bool_and(parent IS NULL OR coalesce(parent = before, false)) AND count(m.capture_id) = count(*)
), turns AS (SELECT conversation_id, place - first AS turn_no, capture_id FROM t JOIN s USING (conversation_id))
"""

P6_SQL = P6_TURNS + "SELECT conversation_id, turn_no, capture_id FROM turns"

P6_DIALOGUES_SQL = P6_TURNS + r"""
SELECT conversation_id, turn_no, seq, message_id, role, content, tool_requests, tool_call_id FROM turns JOIN (
  SELECT DISTINCT message_id, capture_id, seq, content, coalesce(len(tool_calls), 0) AS tool_requests, tool_call_id,
    CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'model' THEN 'assistant' ELSE lower(trim(role)) END AS role
  FROM chat_messages
) USING (capture_id)
"""

# The sketch must give the middle of the bucket that holds the exact nearest-rank value.
P5_SQL = """
WITH once AS (
  SELECT run_id, prompt_id, example_id, role, sample_index, max(latency_ms) AS latency_ms, min(cost_usd) AS cost_usd
  FROM raw_calls GROUP BY ALL
), v AS (
  SELECT prompt_id, 'latency_ms' AS metric, CAST(latency_ms AS DOUBLE) AS x FROM once WHERE latency_ms >= 0
  UNION ALL SELECT prompt_id, 'cost_usd', cost_usd FROM once WHERE cost_usd IS NOT NULL AND NOT isnan(cost_usd)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY prompt_id, metric ORDER BY x) AS i, count(*) OVER (PARTITION BY prompt_id, metric) AS n FROM v
), q AS (
  SELECT prompt_id, metric, n,
    max(x) FILTER (i = greatest(1, (n * 500 + 999) // 1000)) AS p50, max(x) FILTER (i = greatest(1, (n * 900 + 999) // 1000)) AS p90,
    max(x) FILTER (i = greatest(1, (n * 950 + 999) // 1000)) AS p95, max(x) FILTER (i = greatest(1, (n * 990 + 999) // 1000)) AS p99
  FROM r GROUP BY ALL
)
SELECT prompt_id, metric, n, CAST(printf('%.9e', {p50}) AS DOUBLE) AS p50, CAST(printf('%.9e', {p90}) AS DOUBLE) AS p90, CAST(printf('%.9e', {p95}) AS DOUBLE) AS p95, CAST(printf('%.9e', {p99}) AS DOUBLE) AS p99 FROM q
""".format(**{p: f"sign({p}) * 2 / (1 + 1.01e0 / 0.99e0) * exp(ceil(ln(CASE WHEN {p} = 0 THEN 1 ELSE abs({p}) END) / ln(1.01e0 / 0.99e0)) * ln(1.01e0 / 0.99e0))" for p in ("p50", "p90", "p95", "p99")})


@REGISTRY.add("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every later row that repeats an accepted one, batch after batch against the index of what is accepted."""
    return replay_batches(rows_of(table(spark, folder, "golden"), table(spark, folder, "multi_round_tools")))


@REGISTRY.add("p4_found", P4_SQL)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five worst regressions of every prompt and evaluator."""
    rows = table(spark, folder, "top_regressions")
    keep = ["prompt_id", "evaluator_name", "example_id", "delta"]
    once = first_of_repeats(rows.where("prompt_id is not null and evaluator_name is not null and delta is not null and not isnan(delta)"), "reg_id", keep)
    best = top_n(once, ["prompt_id", "evaluator_name"], "delta", "example_id", "reg_id", 5)
    return best.select("prompt_id", "evaluator_name", "rank_no", F.col("reg_id").cast("bigint").alias("reg_id"))


@REGISTRY.add("p5_percentiles", P5_SQL)
def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and upper percentiles of latency and cost a prompt, within one per cent, merged from sketches a run."""
    runs = call_sketches(table(spark, folder, "raw_calls"))
    keys = ["prompt_id", "metric"]
    out = percentiles(merge(runs, keys), keys, {"p50": 500, "p90": 900, "p95": 950, "p99": 990})
    # Ten digits, so that logarithms of other libraries compare; that is far below the stated error.
    return out.select(*keys, "n", *[F.format_string("%.9e", p).try_cast("double").alias(p) for p in ("p50", "p90", "p95", "p99")])


@REGISTRY.add("p6_found", P6_SQL)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of every sound conversation."""
    return sound_turns(table(spark, folder, "multi_round_tools"), table(spark, folder, "chat_messages"))


@REGISTRY.add("p6_dialogues", P6_DIALOGUES_SQL)
def p6_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of the sound conversations, in order and with clean roles; tool calls by their number."""
    whole = whole_dialogues(table(spark, folder, "multi_round_tools"), table(spark, folder, "chat_messages"))
    return whole.withColumn("tool_requests", F.greatest(F.coalesce(F.size("tool_calls"), F.lit(0)), F.lit(0)).cast("bigint")).drop("tool_calls")


@REGISTRY.add("p6_messages")
def p6_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every message of the sound conversations, in order, requests for tools without content included."""
    return whole_dialogues(table(spark, folder, "multi_round_tools"), table(spark, folder, "chat_messages"))


@REGISTRY.add("p6_sessions")
def p6_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of the sessions that times and a calibrated silence give."""
    return by_time.sessions(table(spark, folder, "multi_round_tools"), table(spark, folder, "chat_messages"), table(spark, folder, "recorders"))


@REGISTRY.add("p6_session_agreement")
def p6_session_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the sound conversations the sessions by time give back."""
    return by_time.agreement(table(spark, folder, "multi_round_tools"), table(spark, folder, "chat_messages"), table(spark, folder, "recorders"))


@REGISTRY.add("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, folder, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id", "text")


@REGISTRY.add("p9_mix")
def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of every mix and how often each is used."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@REGISTRY.add("p9_shares")
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached share of every source in every mix."""
    targets = table(spark, folder, "mix_targets")
    return shares(mix(table(spark, folder, "documents"), targets), targets)


@REGISTRY.add("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of English prose that need band 4 or 5."""
    levels = reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))
    return levels.where("prose and level >= 4").select(F.col("doc_id").cast("bigint").alias("doc_id"))


@REGISTRY.add("p10_levels")
def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Profile of the corpus: English prose documents of each source by reading level."""
    documents = table(spark, folder, "documents")
    levels = reading_levels(documents, table(spark, folder, "reading_labels")).where("prose")
    return levels.join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"))
