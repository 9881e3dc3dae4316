"""Queries through sources, sinks, cache and streams: tables go out to files in the scratch folder and come back.

Each uses its reader or writer on whole tables; the files lie in the shared folder and are deleted by nobody but the
session's owner, as results may be read lazily.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.captures import retained
from pairloom.plans.registry import Registry
from pairloom.scratch import new_path
from pairloom.session import table
from pairloom.sources import cache, jsonl
from pairloom.streaming import calls as ST

REGISTRY = Registry()

BODY = "capture_id string, suite string, conversation_id string, schema_version string"


@REGISTRY.add("sc2_tolerant_lines", """
SELECT suite, count(*) AS records, count(capture_id) AS named FROM (SELECT json_extract_string(body, '$.suite') AS suite, json_extract_string(body, '$.capture_id') AS capture_id FROM capture_files WHERE json_valid(body)) GROUP BY ALL""")
def sc2_tolerant_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Records of JSON lines of which some are cut off, by suite; those are left out."""
    path = new_path(spark, "lines")
    table(spark, folder, "capture_files").where("body is not null").select("body").write.text(path)
    return jsonl.read_tolerant(spark, path, BODY).groupBy("suite").agg(F.count("*").alias("records"), F.count("capture_id").alias("named"))


@REGISTRY.add("sc4_bad_lines", "SELECT json_valid(body) AS good, count(*) AS lines, CAST(sum(length(body)) AS BIGINT) AS chars FROM capture_files WHERE trim(body) <> '' GROUP BY ALL")
def sc4_bad_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that parse and lines that do not, counted from the reporting reader."""
    path = new_path(spark, "lines")
    table(spark, folder, "capture_files").where("trim(body) <> ''").select("body").write.text(path)
    good, bad = jsonl.read_reporting(spark, path, "schema_version string")
    whole = spark.read.text(path).where("trim(value) <> ''").agg(F.sum(F.char_length("value")).alias("chars"))
    lost = bad.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.char_length(jsonl.BAD)), F.lit(0)).alias("chars"))
    kept = good.agg(F.count("*").alias("lines"))
    fine = kept.join(whole.withColumnRenamed("chars", "all")).join(lost.select(F.col("chars").alias("gone"))).select(F.lit(True).alias("good"), "lines", (F.col("all") - F.col("gone")).alias("chars"))
    return fine.unionByName(lost.select(F.lit(False).alias("good"), "lines", "chars")).where("lines > 0")


@REGISTRY.add("sc1_suite_problems", """
WITH n AS (SELECT id, count(*) AS c FROM golden WHERE id IS NOT NULL GROUP BY ALL)
SELECT 3 AS priority, 'duplicate' AS problem, id AS what FROM n WHERE c > 1 UNION ALL SELECT 2, 'schema', 'inputs' FROM golden WHERE inputs IS NULL UNION ALL SELECT 2, 'schema', 'id' FROM golden WHERE id IS NULL
UNION ALL SELECT 2, 'schema', 'expected_no_tools' FROM golden WHERE expected_no_tools AND len(expected_tools) > 0""")
def sc1_suite_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of the suite, written as JSON lines and read strictly by schema: what fails first comes first."""
    path = new_path(spark, "suite")
    table(spark, folder, "golden").select("id", "inputs", "tags", "expected", "expected_tools", "expected_tool_count", "expected_no_tools").write.json(path)
    good, bad = jsonl.read_reporting(spark, path, jsonl.EXAMPLE)
    return jsonl.suite_problems(good, bad)


@REGISTRY.add("sk5_golden_index", "SELECT id, row_number() OVER (ORDER BY id NULLS FIRST, row_id) AS place FROM golden WHERE id IS NOT NULL")
def sk5_golden_index(spark: SparkSession, folder: str) -> DataFrame:
    """The suite written in order of its ids and read again: the place of every row, in ranges."""
    from pairloom.operators.ranking import global_rank

    path = new_path(spark, "index")
    jsonl.write_sorted(table(spark, folder, "golden").where("id is not null").select("id", "row_id"), path, ["id", "row_id"])
    return global_rank(jsonl.read_strict(spark, path, "id string, row_id bigint"), [F.col("id").asc(), F.col("row_id").asc()], "place").select("id", "place")


@REGISTRY.add("sk6_new_rows", "SELECT DISTINCT id FROM golden WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM golden WHERE id IS NOT NULL AND batch_no = 0)")
def sk6_new_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Suite rows that later batches add to a file that holds the first one."""
    path = new_path(spark, "cases")
    rows = table(spark, folder, "golden").where("id is not null")
    jsonl.append_rows(rows.where("batch_no = 0").select("id"), path)
    return jsonl.write_new(rows.where("batch_no > 0").select("id").distinct(), path, ["id"], "id string")


NOW = "2026-03-01 00:00:00"


@REGISTRY.add("sc14_cache_look_up", f"""
WITH l AS (SELECT suite AS cache_key, max(collected_at) AS created_at FROM documents WHERE suite IS NOT NULL GROUP BY ALL)
SELECT DISTINCT m.suite, l.created_at IS NOT NULL AND l.created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS hit FROM multi_round_tools m LEFT JOIN l ON l.cache_key = m.suite""")
def sc14_cache_look_up(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the latest entry of a key is young enough, by suite; entries are upserted in two parts first."""
    d = table(spark, folder, "documents").where("suite is not null").select(F.col("suite").alias("cache_key"), F.col("collected_at").cast("timestamp").alias("created_at"), "doc_id")
    entries = cache.put(d.where("source is null"), d.where("source is not null"))
    asked = table(spark, folder, "multi_round_tools").select(F.col("suite").alias("cache_key")).distinct()
    return cache.look_up(asked, entries, NOW).select(F.col("cache_key").alias("suite"), "hit")


@REGISTRY.add("st2_synced_calls", """
SELECT DISTINCT prompt_id, example_id, role, sample_index FROM raw_calls WHERE prompt_id IS NOT NULL AND example_id IS NOT NULL AND role IS NOT NULL AND sample_index IS NOT NULL""")
def st2_synced_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of a call log that was streamed into a table in two runs, the second one going on where the first ended."""
    path, held, mark = (new_path(spark, n) for n in ("log", "held", "mark"))
    rows = table(spark, folder, "raw_calls").where(" and ".join(f"{k} is not null" for k in ST.CALL_KEY)).select(*ST.CALL_KEY)
    for part in (F.col("role") == "source", F.col("role") != "source"):
        jsonl.append_rows(rows.where(part), path)
        ST.sync_new(ST.call_stream(spark, path), held, ST.CALL_KEY, mark).awaitTermination()
    return spark.read.parquet(held).select(*ST.CALL_KEY)


@REGISTRY.add("w12_retention", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY row_id DESC) AS i FROM multi_round_tools)
SELECT row_id, i <= 3 OR capture_id IN (SELECT capture_id FROM chat_messages WHERE capture_id IS NOT NULL) AND batch_no = 9 AS kept FROM r""")
def w12_retention(spark: SparkSession, folder: str) -> DataFrame:
    """What a retention of three a suite keeps, besides captures of the last batch that have messages."""
    rows = table(spark, folder, "multi_round_tools")
    busy = table(spark, folder, "chat_messages").where("capture_id is not null").select("capture_id").distinct().withColumn("busy", F.lit(True))
    marked = rows.select("row_id", "suite", "batch_no", "capture_id").join(busy, "capture_id", "left").withColumn("keep", F.coalesce(F.col("busy") & (F.col("batch_no") == 9), F.lit(False)))
    return retained(marked, "suite", F.col("row_id").desc(), 3, F.col("keep")).select("row_id", "kept")
