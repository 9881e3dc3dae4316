"""JSON line files with declared schemas: strict, tolerant and reporting readers, and the matching writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.scratch import spool

CALL = (
    "run_id string, prompt_id string, example_id string, model_id string, role string, sample_index int, text string, input_tokens int, "
    "output_tokens int, cost_usd double, latency_ms int, cached boolean, cached_rounds int, error string, finish_reason string"
)
SCORE = (
    "run_id string, prompt_id string, example_id string, evaluator_name string, kind string, source_score double, target_score double, "
    "delta double, explanation string, metadata string, error string, blocking boolean"
)
TOOL_CALL = "struct<name:string,arguments:string,call_id:string>"
EVENT = (
    "struct<type:string,sequence_index:int,timestamp:string,metadata:string,model_id:string,input:string,output:string,input_tokens:int,"
    "output_tokens:int,cost_usd:double,latency_ms:int,toolset_ref:string,tools_offered:array<string>,requested_tool_calls:array<" + TOOL_CALL + ">,"
    "name:string,arguments:string,call_id:string,parent_call_id:string,result:string,error:string,source:string,query:string,"
    "documents:array<string>,verdict:string,reason:string,text:string,message:string,category:string>"
)
TRACE = f"run_id string, prompt_id string, example_id string, role string, events array<{EVENT}>"
EXAMPLE = (
    "id string, inputs string, tags array<string>, expected string, expected_tools array<struct<tool_name:string,arguments:string,match_strategy:string,"
    "provenance:string>>, expected_tool_count int, expected_no_tools boolean, history array<struct<role:string,content:string,tool_calls:array<"
    + TOOL_CALL
    + ">,tool_call_id:string>>, generation_config string, toolset_ref string"
)
BAD = "_bad_line"


def _with_bad(schema: str) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(BAD, T.StringType())])


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that parse; malformed and cut-off lines are left out. Objects under a string field stay JSON text."""
    return spark.read.schema(T.StructType.fromDDL(schema)).option("mode", "DROPMALFORMED").json(path)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files in which every line must parse; the first bad line fails the job that reads it."""
    return spark.read.schema(T.StructType.fromDDL(schema)).option("mode", "FAILFAST").json(path)


def read_reporting(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with their file). Lines are read as text and parsed in the plan, as Spark's JSON source
    refuses queries on bad lines alone; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("_metadata.file_path", "value")
    parsed = lines.select("file_path", F.from_json("value", _with_bad(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    return parsed.where(f"r.{BAD} is null").select("r.*").drop(BAD), parsed.where(f"r.{BAD} is not null").select("file_path", f"r.{BAD}")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a path that may not exist yet; a missing one is empty."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return read_tolerant(spark, path, schema)


def read_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One JSON document a file, with its path; documents that do not parse have null fields and ``parsed`` false."""
    both = spark.read.schema(_with_bad(schema)).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(glob)
    return both.select("*", F.col("_metadata.file_path").alias("file_path"), F.col(BAD).isNull().alias("parsed")).drop(BAD)


def suite_problems(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """Problems of a suite by priority: 1 lines that do not parse; 2 rows without id or inputs, or that expect both no
    tools and some; 3 ids that come again; 4 no rows at all."""
    lines = bad.select(F.lit(1).alias("priority"), F.lit("parse").alias("problem"), F.col(BAD).alias("what"))
    both = F.coalesce(F.col("expected_no_tools") & (F.size("expected_tools") > 0), F.lit(False))
    wrong = F.array_compact(F.array(F.when(F.col("id").isNull(), "id"), F.when(F.col("inputs").isNull(), "inputs"), F.when(both, "expected_no_tools")))
    nameless = rows.select(F.lit(2).alias("priority"), F.lit("schema").alias("problem"), F.explode(wrong).alias("what"))
    empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(4).alias("priority"), F.lit("empty").alias("problem"), F.lit("").alias("what"))
    again = rows.where("id is not null").groupBy("id").count().where("count > 1").select(F.lit(3).alias("priority"), F.lit("duplicate").alias("problem"), F.col("id").alias("what"))
    return lines.unionByName(nameless).unionByName(again).unionByName(empty)


def append_rows(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; a job that fails leaves earlier files as they are."""
    df.write.mode("append").json(path)


def write_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """Write JSON lines in a global order (range-partitioned, so no single task sorts everything)."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_new(df: DataFrame, path: str, key: list[str], schema: str) -> DataFrame:
    """Append only rows whose key is not there yet; returns those (stored, so that they stay what was appended)."""
    fresh = spool(df.join(read_or_empty(df.sparkSession, path, schema).select(*key), key, "left_anti"), "fresh-rows")
    fresh.write.mode("append").json(path)
    return fresh
