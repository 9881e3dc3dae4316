"""Queries of suite rows, their toolsets, recorded arguments and transcripts, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators import dispatch as D
from pairloom.operators import slicing as L
from pairloom.operators import statistics as T
from pairloom.operators import suites as U
from pairloom.operators import traces as A
from pairloom.plans import views as V
from pairloom.plans.reference import CALLS, EVENTS, EXAMPLES, SAMPLES, SLICED, comparisons
from pairloom.plans.registry import Registry
from pairloom.session import table

REGISTRY = Registry()

TOOLSETS = """ts AS (
  SELECT toolset_ref, arg_min(tools, (row_id, q)) AS tools FROM (
    SELECT row_id, u.sequence_index AS q, u.toolset_ref AS toolset_ref, list_sort(list_distinct(u.tools_offered)) AS tools FROM (SELECT row_id, unnest(trace.events) AS u FROM multi_round_tools) WHERE u.toolset_ref IS NOT NULL AND len(u.tools_offered) > 0
  ) GROUP BY ALL)"""


@REGISTRY.add("j5_example_toolsets", f"WITH {TOOLSETS}, {EXAMPLES} SELECT e.id, e.toolset_ref, array_to_string(ts.tools, ',') AS tools, coalesce(len(ts.tools) > 0, false) AS offers_tools FROM examples e LEFT JOIN ts ON ts.toolset_ref = e.toolset_ref")
def j5_example_toolsets(spark: SparkSession, folder: str) -> DataFrame:
    """The tools of every example, by its reference to a toolset that captures saw."""
    rows = U.with_toolsets(V.examples(spark, folder, "toolset_ref"), U.toolsets(table(spark, folder, "multi_round_tools")))
    return rows.select("id", "toolset_ref", F.array_join("tools", ",").alias("tools"), "offers_tools")


@REGISTRY.add("x21_built_tags", "SELECT row_id, concat_ws(',', 'captured', nullif(suite, 'captured'), CASE WHEN code_version IS DISTINCT FROM suite AND code_version <> 'captured' THEN code_version END) AS tags FROM multi_round_tools")
def x21_built_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags that a row made from a capture gets; the code version stands for the user's extra tags."""
    extra = F.array_compact(F.array("code_version", F.lit(U.CAPTURED)))
    return table(spark, folder, "multi_round_tools").select("row_id", F.array_join(U.built_tags(F.col("suite"), extra), ",").alias("tags"))


DECLARED = """pk AS (SELECT u.name AS tool, json_keys(CASE WHEN json_type(u.arguments) = 'VARCHAR' THEN u.arguments ->> '$' ELSE u.arguments END) AS ks FROM (SELECT unnest(events) AS u FROM source_traces) WHERE u.type = 'tool_call' AND json_valid(u.arguments)),
pn AS (SELECT tool, unnest(ks) AS p FROM pk WHERE len(ks) > 1),
dc AS (SELECT tool, list(DISTINCT p) AS declared FROM pn WHERE tool IS NOT NULL GROUP BY ALL)"""


@REGISTRY.add("x13_unwrapped_arguments", f"""WITH {DECLARED}, w AS (SELECT row_id, unnest(range(len(expected_tools))) AS place, unnest(expected_tools) AS t FROM golden),
a AS (SELECT row_id, place, t.tool_name AS tool, CASE WHEN json_type(t.arguments) = 'VARCHAR' THEN t.arguments ->> '$' ELSE t.arguments END AS args FROM w WHERE json_valid(t.arguments)),
k AS (SELECT *, json_keys(args)[1] AS key FROM a WHERE json_type(args) = 'OBJECT' AND len(json_keys(args)) = 1), v AS (SELECT *, json_extract(args, '$."' || key || '"') AS inner_value FROM k)
SELECT row_id, CAST(place AS INTEGER) AS place, tool, key FROM v JOIN dc USING (tool) WHERE NOT list_contains(declared, key) AND json_type(inner_value) = 'OBJECT' AND len(list_filter(json_keys(inner_value), lambda x: NOT list_contains(declared, x))) = 0""")
def x13_unwrapped_arguments(spark: SparkSession, folder: str) -> DataFrame:
    """Expected calls whose arguments are wrapped once more than the tool's properties allow; these are taken from traces,
    from calls with several arguments, as single ones may be wrapped there too."""
    made = table(spark, folder, "source_traces").select(F.explode(A.calls_of("events")).alias("c")).where("c.name is not null")
    named = made.select(F.col("c.name").alias("tool"), F.map_keys(A.argument_fields(F.col("c.arguments"))).alias("names")).where(F.size("names") > 1)
    declared = named.select("tool", F.explode("names").alias("p")).groupBy("tool").agg(F.collect_set("p").alias("declared"))
    wanted = table(spark, folder, "golden").select("row_id", F.posexplode("expected_tools").alias("place", "t")).select("row_id", "place", F.col("t.tool_name").alias("tool"), F.col("t.arguments").alias("arguments"))
    return wanted.join(declared, "tool").withColumn("key", U.unwrapped(F.col("arguments"), F.col("declared"))).where("key is not null").select("row_id", "place", "tool", "key")


SPOKEN = """ms AS (SELECT DISTINCT ON (message_id) message_id, capture_id, seq, lower(trim(role)) AS role, content FROM chat_messages WHERE capture_id IS NOT NULL ORDER BY message_id, capture_id, seq, content),
ln AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY seq NULLS FIRST, message_id) - 1 AS place, '[' || coalesce(role, '') || '] ' || coalesce(content, '') AS line FROM ms)"""


@REGISTRY.add("w15_transcripts", f"""WITH {SPOKEN}, al AS (SELECT capture_id, sum(length(line) + 1) AS total, max(CASE WHEN place = 0 AND role = 'system' THEN length(line) END) AS sys FROM ln GROUP BY ALL),
bk AS (SELECT *, total - 1 + 79 > 300 AS over, place = 0 AND sys IS NOT NULL AS led, greatest(0, 300 - 79 - coalesce(sys + 1, 0) - 20) AS budget, row_number() OVER w AS i FROM ln JOIN al USING (capture_id) WINDOW w AS (PARTITION BY capture_id ORDER BY place DESC)),
us AS (SELECT *, sum(CASE WHEN NOT led THEN length(line) + 1 END) OVER (PARTITION BY capture_id ORDER BY place DESC) AS used FROM bk)
SELECT capture_id, count(*) AS kept, bool_or(over) AS cut, CAST(79 + sum(CASE WHEN over AND i = 1 AND length(line) + 1 > budget THEN greatest(0, budget - 1) ELSE length(line) END) + count(*) - 1 + CASE WHEN bool_or(over) THEN 20 ELSE 0 END AS BIGINT) AS chars
FROM us WHERE NOT over OR led OR used <= budget OR i = 1 GROUP BY ALL""")
def w15_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Size of the transcript of every capture's messages within 300 characters, whole lines from the end."""
    role = F.lower(F.trim("role"))
    once = table(spark, folder, "chat_messages").where("capture_id is not null").groupBy("message_id").agg(F.min(F.struct("capture_id", "seq", "content", role.alias("role"))).alias("m")).select("message_id", "m.*")
    place = F.row_number().over(Window.partitionBy("capture_id").orderBy("seq", "message_id")) - 1
    lines = once.withColumn("place", place).withColumn("line", F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("] "), F.coalesce("content", F.lit(""))))
    return U.transcripts(lines, "capture_id", 300).select("capture_id", "kept", "cut", F.char_length("text").cast("bigint").alias("chars"))


@REGISTRY.add("j18_missing_pairs", f"""WITH {CALLS}, kn AS (SELECT prompt_id, example_id FROM calls WHERE prompt_id IS NOT NULL AND example_id IS NOT NULL GROUP BY ALL HAVING bool_or(role = 'source') AND bool_or(role = 'target')),
hv AS (SELECT prompt_id, example_id, bool_or(role = 'source') AS s, bool_or(role = 'target') AS t FROM source_traces GROUP BY ALL)
SELECT prompt_id, example_id, concat_ws(',', CASE WHEN NOT coalesce(s, false) THEN 'source' END, CASE WHEN NOT coalesce(t, false) THEN 'target' END) AS lacks FROM kn LEFT JOIN hv USING (prompt_id, example_id) WHERE NOT (coalesce(s, false) AND coalesce(t, false))""")
def j18_missing_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of calls for which imported traces are lacking, and of which role."""
    calls = table(spark, folder, "raw_calls").where("prompt_id is not null and example_id is not null")
    return U.missing_pairs(calls, table(spark, folder, "source_traces"))


@REGISTRY.add("r18_capture_clean", "SELECT row_id, capture_id FROM multi_round_tools WHERE capture_id IN (SELECT capture_id FROM chat_messages WHERE capture_id IS NOT NULL AND batch_no = 0)")
def r18_capture_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Captures that a sweep takes because their messages are in the accepted batch."""
    done = table(spark, folder, "chat_messages").where("capture_id is not null and batch_no = 0").select("capture_id")
    return table(spark, folder, "multi_round_tools").select("row_id", "capture_id").join(done, "capture_id", "left_semi").select("row_id", "capture_id")


@REGISTRY.add("kind_match", f"""WITH {SAMPLES} SELECT evaluator_name, kind, CASE WHEN kind <> '' THEN kind = 'tool_selection.divergence' ELSE starts_with(evaluator_name, 'tool_') END AS hit, count(*) AS n FROM samples GROUP BY ALL""")
def kind_match(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a kind; those without one are told by the beginning of their evaluator's name."""
    hit = D.is_kind(F.col("evaluator_name"), F.col("kind"), "tool_selection.divergence", "tool_")
    return V.samples(spark, folder).groupBy("evaluator_name", "kind", hit.alias("hit")).agg(F.count("*").alias("n"))


@REGISTRY.add("a6_silent_comparisons", f"WITH {SLICED} SELECT slice_name, prompt_id, evaluator_name, kind, count(*) FILTER (error IS NULL) AS n, CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN 'nothing measured: ' || count(*) || ' failed' ELSE '' END AS note FROM sliced GROUP BY ALL")
def a6_silent_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    """All comparisons, those in which nothing was measured included."""
    rows = L.slice_rows(L.reduce_samples(V.samples(spark, folder)), V.examples(spark, folder, "tags"))
    return T.with_silent(comparisons(spark, folder), rows).select(*T.GROUP, "n", F.array_join("notes", ",").alias("note"))


@REGISTRY.add("unmeasured_gates", f"WITH {SLICED} SELECT DISTINCT evaluator_name FROM (SELECT evaluator_name FROM sliced GROUP BY slice_name, prompt_id, evaluator_name, kind HAVING count(*) FILTER (error IS NULL) = 0) WHERE evaluator_name NOT IN (SELECT evaluator_name FROM scores WHERE kind LIKE '%conformance')")
def unmeasured_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Gating evaluators with a comparison that measured nothing; conformance stands for what only advises."""
    scores = L.reduce_samples(V.samples(spark, folder))
    rows = L.slice_rows(scores, V.examples(spark, folder, "tags"))
    return D.unmeasured_gates(T.with_silent(comparisons(spark, folder), rows), scores.withColumn("blocking", ~F.col("kind").like("%conformance")))
