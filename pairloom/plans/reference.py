"""Queries of the engine's own operators, each with the SQL that must give the same rows.

Averages are rounded to ten places on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import captures as C
from pairloom.operators import pairing as P
from pairloom.operators import reports as R
from pairloom.operators import scoring as S
from pairloom.operators import slicing as L
from pairloom.operators import statistics as T
from pairloom.operators.ranking import global_rank
from pairloom.plans import views as V
from pairloom.plans.registry import Registry
from pairloom.session import table

REGISTRY = Registry()

# Parameters of the queries on risky tools; any other lists do.
DANGEROUS = ["grant_credit", "transfer_credit", "cancel_slot", "update_lease", "mark_paid"]
VERIFYING = ["get_balance", "list_invoices", "find_folders", "lookup_tenant", "check_credit_rules"]


def rounded(*names: str) -> list[Column]:
    return [F.round(n, 10).alias(n) for n in names]


# ---------------------------------------------------------------- shared SQL

CALLS = """
calls AS (SELECT DISTINCT ON (run_id, prompt_id, example_id, role, sample_index) * FROM raw_calls)
"""
EXAMPLES = """
examples AS (SELECT DISTINCT ON (id) * FROM golden WHERE id IS NOT NULL ORDER BY id, row_id)
"""
SAMPLES = """
samples AS (
  SELECT reg_id, prompt_id, example_id, evaluator_name, coalesce(kind, '') AS kind, source_score, target_score,
    CASE WHEN NOT (delta IS NULL OR isnan(delta)) THEN delta + 0.0 END AS delta, explanation,
    CASE WHEN delta IS NULL OR isnan(delta) THEN 'unscored' END AS error
  FROM top_regressions WHERE prompt_id IS NOT NULL AND evaluator_name IS NOT NULL
)
"""
SCORES = SAMPLES + """, scores AS (
  SELECT prompt_id, example_id, evaluator_name, kind, count(*) AS samples, count(*) FILTER (error IS NULL) AS scored,
    avg(source_score) FILTER (error IS NULL) AS source_score, avg(target_score) FILTER (error IS NULL) AS target_score,
    avg(delta) FILTER (error IS NULL) AS delta, coalesce(var_samp(delta) FILTER (error IS NULL), 0) AS delta_variance,
    CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN 'unscored' END AS error
  FROM samples GROUP BY ALL
)
"""
SLICED = SCORES + "," + EXAMPLES + """, sliced AS (
  SELECT s.*, unnest(list_concat(['all'], coalesce(e.tags, []))) AS slice_name FROM scores s LEFT JOIN examples e ON e.id = s.example_id
)
"""
EVENTS = """
e AS (
  SELECT row_id, capture_id, suite, u.sequence_index AS q, u.type AS type, u.name AS name, u.call_id AS call_id, u.arguments AS arguments,
    u.result AS result, u.error AS error, u.input AS input, u.output AS output, u.text AS text, u.input_tokens AS input_tokens, u.output_tokens AS output_tokens, u.toolset_ref AS toolset_ref,
    u.requested_tool_calls AS asked
  FROM (SELECT row_id, capture_id, suite, unnest(trace.events) AS u FROM multi_round_tools)
), er AS (
  SELECT *, CAST(count(*) FILTER (type = 'model_call') OVER (PARTITION BY row_id ORDER BY q ROWS UNBOUNDED PRECEDING) AS BIGINT) AS round FROM e
)
"""
SIDES = EVENTS + """, x AS (
  SELECT row_id, coalesce(list(name ORDER BY q) FILTER (type = 'tool_call'), []) AS executed FROM e GROUP BY row_id
), a AS (
  SELECT row_id, list(n ORDER BY q, i) AS requested FROM (
    SELECT row_id, q, unnest(asked).name AS n, unnest(range(len(asked))) AS i FROM e WHERE type = 'model_call' AND asked IS NOT NULL
  ) GROUP BY row_id
), sides AS (
  SELECT m.row_id, coalesce(a.requested, []) AS requested, coalesce(x.executed, []) AS executed
  FROM multi_round_tools m LEFT JOIN a USING (row_id) LEFT JOIN x USING (row_id)
)
"""

# ---------------------------------------------------------------- calls and pairs


@REGISTRY.add("j1_pair_calls", f"""WITH {CALLS}
SELECT s.run_id, s.prompt_id, s.example_id, s.sample_index, s.text AS source_text, t.text AS target_text, t.latency_ms - s.latency_ms AS latency_change
FROM calls s JOIN calls t ON s.run_id IS NOT DISTINCT FROM t.run_id AND s.prompt_id IS NOT DISTINCT FROM t.prompt_id
  AND s.example_id IS NOT DISTINCT FROM t.example_id AND s.sample_index IS NOT DISTINCT FROM t.sample_index
WHERE s.role = 'source' AND t.role = 'target'""")
def j1_pair_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Source and target calls of one key."""
    pairs = P.pair_roles(V.calls(spark, folder, "text", "latency_ms"))
    return pairs.select(*P.CALL_KEY, F.col("source.text").alias("source_text"), F.col("target.text").alias("target_text"), (F.col("target.latency_ms") - F.col("source.latency_ms")).alias("latency_change"))


@REGISTRY.add("j2_pairs_with_examples", f"""WITH {CALLS}, {EXAMPLES}, p AS (
  SELECT run_id, prompt_id, example_id, sample_index FROM calls GROUP BY ALL HAVING count(DISTINCT role) FILTER (role IN ('source', 'target')) = 2
)
SELECT p.*, e.id IS NOT NULL AS known, e.expected_tool_count, e.toolset_ref FROM p LEFT JOIN examples e ON e.id = p.example_id""")
def j2_pairs_with_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with their suite example, unknown ones kept."""
    pairs = P.with_examples(P.pair_roles(V.calls(spark, folder, "model_id")).select(*P.CALL_KEY), V.examples(spark, folder, "expected_tool_count", "toolset_ref"))
    return pairs.select(*P.CALL_KEY, "known", "example.expected_tool_count", "example.toolset_ref")


@REGISTRY.add("call_flags", f"""WITH {CALLS}
SELECT role, model_id, count(*) AS calls, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (finish_reason = 'length') AS truncated,
  count(*) FILTER (coalesce(cached_rounds > 0, false) OR coalesce(cached, false)) AS replayed,
  count(*) FILTER (text = '' AND output_tokens > 0 AND error IS NULL AND finish_reason = 'stop') AS empty
FROM calls GROUP BY ALL""")
def call_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Calls that succeeded, were truncated, replayed or came out empty, by role and model."""
    flags = ["succeeded", "truncated", "replayed", "empty"]
    return P.call_flags(V.calls(spark, folder, "model_id", "text", "output_tokens", "error", "finish_reason", "cached", "cached_rounds")).groupBy("role", "model_id").agg(F.count("*").alias("calls"), *[F.count_if(f).alias(f) for f in flags])


@REGISTRY.add("representative_calls", f"WITH {CALLS} SELECT run_id, prompt_id, example_id, role, model_id FROM calls WHERE sample_index = 0")
def representative_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of the first sample."""
    return P.representative(V.calls(spark, folder, "model_id")).select("run_id", "prompt_id", "example_id", "role", "model_id")


WORK = f"""WITH {CALLS}, {EXAMPLES}, p AS (SELECT DISTINCT suite AS prompt_id FROM multi_round_tools WHERE suite IS NOT NULL),
w AS (SELECT prompt_id, id AS example_id, sample_index, role FROM p, examples, (VALUES (0), (1)) AS v(sample_index), (VALUES ('source'), ('target')) AS r(role))
"""


@REGISTRY.add("j20_work_list", WORK + "SELECT prompt_id, sample_index, role, count(*) AS cells FROM w GROUP BY ALL")
def j20_work_list(spark: SparkSession, folder: str) -> DataFrame:
    """Size of the work of every prompt, sample and role."""
    prompts = table(spark, folder, "multi_round_tools").where("suite is not null").select(F.col("suite").alias("prompt_id"))
    return P.work_list(prompts, V.examples(spark, folder, "toolset_ref"), 2).groupBy("prompt_id", "sample_index", "role").agg(F.count("*").alias("cells"))


@REGISTRY.add("pending_work", f"""WITH {CALLS}, {EXAMPLES}, w AS (SELECT DISTINCT prompt_id, example_id, sample_index, r.role FROM calls, (VALUES ('source'), ('target')) AS r(role) WHERE prompt_id IS NOT NULL)
SELECT prompt_id, role, count(*) AS pending FROM w WHERE NOT EXISTS (
  SELECT 1 FROM calls c WHERE c.prompt_id = w.prompt_id AND c.example_id = w.example_id AND c.sample_index = w.sample_index AND c.role = w.role) GROUP BY ALL""")
def pending_work(spark: SparkSession, folder: str) -> DataFrame:
    """Counterparts that no run has made yet, by prompt and role."""
    calls = V.calls(spark, folder, "model_id").where("prompt_id is not null")
    work = calls.select("prompt_id", "example_id", "sample_index").distinct().select("*", F.explode(F.array(F.lit("source"), F.lit("target"))).alias("role"))
    return P.pending(work, calls).groupBy("prompt_id", "role").agg(F.count("*").alias("pending"))


@REGISTRY.add("j18_role_coverage", """
SELECT prompt_id, example_id, bool_or(role = 'source') AS has_source, bool_or(role = 'target') AS has_target FROM source_traces GROUP BY ALL""")
def j18_role_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Imported traces: which roles each prompt and example has."""
    return P.role_coverage(table(spark, folder, "source_traces"), ["prompt_id", "example_id"])


@REGISTRY.add("j4_duplicate_traces", "SELECT prompt_id, example_id, role, count(*) AS n FROM source_traces GROUP BY ALL HAVING count(*) > 1")
def j4_duplicate_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Traces imported twice."""
    return P.duplicates(table(spark, folder, "source_traces"), ["prompt_id", "example_id", "role"])


@REGISTRY.add("suite_duplicate_ids", "SELECT id, count(*) AS n FROM golden GROUP BY ALL HAVING count(*) > 1")
def suite_duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Suite ids that come again."""
    return P.duplicates(table(spark, folder, "golden"), ["id"])


@REGISTRY.add("suite_validation", """
SELECT row_id, coalesce(list_contains(tags, 'overall'), false) AS reserved_tag, coalesce(expected_no_tools, false) AND coalesce(len(expected_tools), 0) > 0 AS contradiction,
  coalesce(expected_tool_count < 0, false) AS negative_count, coalesce(len(list_filter(history, lambda h: h.role = 'system')) > 1, false) AS several_systems
FROM golden""")
def suite_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Rules across the fields of suite rows."""
    off = lambda c: F.coalesce(c, F.lit(False))
    return table(spark, folder, "golden").select(
        "row_id", off(F.array_contains("tags", "overall")).alias("reserved_tag"), (off(F.col("expected_no_tools")) & off(F.size("expected_tools") > 0)).alias("contradiction"),
        off(F.col("expected_tool_count") < 0).alias("negative_count"), off(F.size(F.filter("history", lambda h: h["role"] == "system")) > 1).alias("several_systems"),
    )


@REGISTRY.add("sc17_detect_provider", """
WITH m AS (SELECT model_id, count(*) AS calls FROM raw_calls GROUP BY ALL
  UNION ALL SELECT unnest(['bedrock/us.anthropic.claude-3', 'gptish', 'GPT-4o', 'openai/x', 'o1-mini', 'o11', 'vertex/Gemini-2', 'azure_ai/DeepSeek-V3', 'Anthropic/x', '']), 0),
p AS (SELECT *, CASE WHEN starts_with(model_id, 'anthropic/') OR contains(lower(model_id), 'claude') THEN 'anthropic'
  WHEN starts_with(model_id, 'openai/') OR regexp_matches(lower(model_id), '^(gpt|o1|o3)-') THEN 'openai'
  WHEN starts_with(model_id, 'gemini/') OR contains(lower(model_id), 'gemini') THEN 'gemini' WHEN contains(lower(model_id), 'deepseek') THEN 'openai' END AS provider FROM m)
SELECT *, CASE WHEN provider IS NULL THEN 'cannot detect provider for model id: ' || coalesce(model_id, 'null') END AS error FROM p""")
def sc17_detect_provider(spark: SparkSession, folder: str) -> DataFrame:
    """Response shape of every model, with some ids that no table has, and the error of those that no rule knows."""
    counts = table(spark, folder, "raw_calls").groupBy("model_id").agg(F.count("*").alias("calls"))
    more = ["bedrock/us.anthropic.claude-3", "gptish", "GPT-4o", "openai/x", "o1-mini", "o11", "vertex/Gemini-2", "azure_ai/DeepSeek-V3", "Anthropic/x", ""]
    counts = counts.unionByName(spark.createDataFrame([(m, 0) for m in more], "model_id string, calls bigint"))
    return counts.withColumns({"provider": P.detect_provider(F.col("model_id")), "error": P.provider_error(F.col("model_id"))})


# ---------------------------------------------------------------- scores and slices


@REGISTRY.add("a1_sample_reduction", f"""WITH {SCORES}
SELECT prompt_id, example_id, evaluator_name, kind, samples, scored, round(source_score, 10) AS source_score, round(target_score, 10) AS target_score,
  round(delta, 10) AS delta, round(delta_variance, 10) AS delta_variance, error FROM scores""")
def a1_sample_reduction(spark: SparkSession, folder: str) -> DataFrame:
    """One score a cell from its samples."""
    s = L.reduce_samples(V.samples(spark, folder))
    return s.select(*L.SCORE_KEY, "samples", "scored", *rounded("source_score", "target_score", "delta", "delta_variance"), "error")


@REGISTRY.add("a2_coverage", f"""WITH {SCORES}
SELECT evaluator_name, kind, count(*) AS attempted, count(*) FILTER (error IS NULL) AS recorded, count(*) FILTER (error IS NOT NULL) AS unmeasured FROM scores GROUP BY ALL""")
def a2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Attempted, recorded and unmeasured cells by evaluator and kind."""
    return L.coverage(V.samples(spark, folder))


@REGISTRY.add("a3_slices", f"WITH {SLICED} SELECT slice_name, prompt_id, evaluator_name, kind, count(*) AS n FROM sliced WHERE error IS NULL GROUP BY ALL")
def a3_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Scores by overlapping slice."""
    rows = L.slice_rows(L.reduce_samples(V.samples(spark, folder)), V.examples(spark, folder, "tags"))
    return rows.where("error is null").groupBy("slice_name", "prompt_id", "evaluator_name", "kind").agg(F.count("*").alias("n"))


@REGISTRY.add("a4_unmeasured", f"WITH {SLICED} SELECT slice_name, prompt_id, evaluator_name, kind, count(*) AS unmeasured FROM sliced WHERE error IS NOT NULL GROUP BY ALL")
def a4_unmeasured(spark: SparkSession, folder: str) -> DataFrame:
    """Unmeasured cells by slice."""
    return L.unmeasured_by_slice(L.reduce_samples(V.samples(spark, folder)), V.examples(spark, folder, "tags"))


@REGISTRY.add("a5_slice_aggregates", f"""WITH {SLICED}
SELECT slice_name, count(*) AS n, round(avg(source_score), 10) AS source_mean, round(avg(target_score), 10) AS target_mean, round(avg(delta), 10) AS delta_mean,
  round(min(delta), 10) AS delta_min, round(max(delta), 10) AS delta_max, round(coalesce(stddev_samp(delta), 0), 10) AS delta_std FROM sliced WHERE error IS NULL GROUP BY ALL""")
def a5_slice_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates of every slice."""
    rows = L.slice_rows(L.reduce_samples(V.samples(spark, folder)), V.examples(spark, folder, "tags"))
    return L.slice_aggregates(rows).select("slice_name", "n", *rounded("source_mean", "target_mean", "delta_mean", "delta_min", "delta_max", "delta_std"))


@REGISTRY.add("o1_dedupe_slices", f"""WITH {SLICED}, g AS (
  SELECT slice_name, count(*) AS n, list((prompt_id, evaluator_name, kind, example_id) ORDER BY prompt_id, evaluator_name, kind, example_id) AS rows FROM sliced WHERE error IS NULL GROUP BY ALL
), h AS (SELECT slice_name, n, md5(CAST(rows AS VARCHAR)) AS sig FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY n, sig ORDER BY CASE slice_name WHEN 'all' THEN 0 WHEN 'captured' THEN 3 ELSE 2 END, slice_name) AS k FROM h)
SELECT a.slice_name, a.n, (SELECT count(*) FROM r b WHERE b.n = a.n AND b.sig = a.sig AND b.k > 1) AS collapsed FROM r a WHERE k = 1""")
def o1_dedupe_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Slices with the same content collapsed."""
    rows = L.slice_rows(L.reduce_samples(V.samples(spark, folder)), V.examples(spark, folder, "tags"))
    return L.dedupe_slices(rows).select("slice_name", "n", F.size("collapsed").cast("bigint").alias("collapsed"))


@REGISTRY.add("tag_examples", f"WITH {EXAMPLES} SELECT id, toolset_ref FROM examples WHERE list_contains(tags, 'travel')")
def tag_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Examples with a tag."""
    return L.with_tag(V.examples(spark, folder, "tags", "toolset_ref"), "travel").select("id", "toolset_ref")


MOMENTS = SLICED + """, m AS (
  SELECT slice_name, prompt_id, evaluator_name, kind, count(*) AS n, avg(delta) AS mean_delta, stddev_samp(delta) AS sd FROM sliced WHERE error IS NULL GROUP BY ALL
), dd AS (
  SELECT *, CASE WHEN coalesce(sd < 1e-9, true) THEN 0 ELSE mean_delta / sd END AS d,
    CASE WHEN NOT coalesce(sd < 1e-9, true) THEN mean_delta / (sd / sqrt(n)) END AS t,
    CASE WHEN n < 5 THEN 'insufficient' WHEN coalesce(sd < 1e-9, true) THEN 'skipped' ELSE 'tested' END AS gate FROM m
)
"""


def comparisons(spark: SparkSession, folder: str) -> DataFrame:
    return T.moments(L.slice_rows(L.reduce_samples(V.samples(spark, folder)), V.examples(spark, folder, "tags")))


@REGISTRY.add("a6_comparisons", f"""WITH {MOMENTS}
SELECT slice_name, prompt_id, evaluator_name, kind, n, round(mean_delta, 10) AS mean_delta, round(sd, 10) AS sd, round(d, 10) AS d, round(t, 10) AS t,
  round(d - 1.96 * sqrt(1 / n + d * d / (2 * n)), 10) AS d_low, round(d + 1.96 * sqrt(1 / n + d * d / (2 * n)), 10) AS d_high, gate FROM dd""")
def a6_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    """Paired comparison of every slice, prompt, evaluator and kind: moments, effect size, interval, t statistic."""
    return comparisons(spark, folder).select(*T.GROUP, "n", *rounded("mean_delta", "sd", "d", "t", "d_low", "d_high"), "gate")


def tested_severities(spark: SparkSession, folder: str) -> DataFrame:
    """Every comparison with its paired test, q over all tests, and severity."""
    rows = L.slice_rows(L.reduce_samples(V.samples(spark, folder)), V.examples(spark, folder, "tags"))
    tested = T.paired_tests(rows).select(*T.GROUP, "test", "statistic", "p", F.col("d_low").alias("low"), F.col("d_high").alias("high"))
    every = T.moments(rows).join(tested, T.GROUP, "left")
    q = T.benjamini_hochberg(every, "p", T.GROUP)
    return q.withColumn("severity", T.severity(F.col("n"), F.col("q"), F.col("mean_delta"), F.col("d")))


@REGISTRY.add("a7_paired_tests")
def a7_paired_tests(spark: SparkSession, folder: str) -> DataFrame:
    """p-values of the paired tests, false-discovery correction and severity (SQL has no rank test)."""
    return tested_severities(spark, folder).select(*T.GROUP, "n", "test", *rounded("p", "q", "d", "low", "high"), "severity")


# A p-value that both engines can compute: a stand-in that falls with the t statistic.
STAND_IN = "round(1 / (1 + t * t), 6)"


@REGISTRY.add("a8_benjamini_hochberg", f"""WITH {MOMENTS}, p AS (SELECT slice_name, prompt_id, evaluator_name, kind, {STAND_IN} AS p FROM dd WHERE gate = 'tested'),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM p),
s AS (SELECT p, max(i) AS i, max(n) AS n FROM r GROUP BY p)
SELECT r.slice_name, r.prompt_id, r.evaluator_name, r.kind, p, round(q, 10) AS q FROM r JOIN (
  SELECT p, least(1, min(p * n / i) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM s) USING (p)""")
def a8_benjamini_hochberg(spark: SparkSession, folder: str) -> DataFrame:
    """False-discovery correction over all comparisons."""
    tests = comparisons(spark, folder).where("gate = 'tested'").select(*T.GROUP, F.expr(STAND_IN).alias("p"))
    return T.benjamini_hochberg(tests, "p", T.GROUP).select(*T.GROUP, "p", *rounded("q"))


SEVERITY_SQL = f"""WITH {MOMENTS}, v AS (
  SELECT *, CASE WHEN gate = 'tested' THEN {STAND_IN} END AS q FROM dd
), s AS (
  SELECT *, CASE WHEN n < 5 THEN 'insufficient' WHEN q IS NULL OR q >= 0.05 THEN 'none' WHEN mean_delta > 0 THEN 'improved'
    WHEN q < 0.01 AND abs(d) > 0.8 THEN 'critical' WHEN abs(d) > 0.5 THEN 'high' WHEN abs(d) > 0.2 THEN 'medium' ELSE 'low' END AS severity FROM v
)
"""


def severities(spark: SparkSession, folder: str) -> DataFrame:
    rows = comparisons(spark, folder).withColumn("q", F.when(F.col("gate") == "tested", F.expr(STAND_IN)))
    return rows.withColumn("severity", T.severity(F.col("n"), F.col("q"), F.col("mean_delta"), F.col("d")))


@REGISTRY.add("a9_severity", SEVERITY_SQL + "SELECT slice_name, prompt_id, evaluator_name, kind, n, severity FROM s")
def a9_severity(spark: SparkSession, folder: str) -> DataFrame:
    """Severity of every comparison by the stand-in."""
    return severities(spark, folder).select(*T.GROUP, "n", "severity")


@REGISTRY.add("a9_tested_severity")
def a9_tested_severity(spark: SparkSession, folder: str) -> DataFrame:
    """Severity of every comparison by its paired test."""
    return tested_severities(spark, folder).select(*T.GROUP, "n", "severity")


@REGISTRY.add("t1_comparison_order", SEVERITY_SQL + """, k AS (SELECT *, list_position(['critical', 'high', 'medium', 'low', 'improved', 'none', 'insufficient'], severity) AS sr, round(abs(d), 10) AS size FROM s)
SELECT slice_name, place, prompt_id, evaluator_name, kind, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY slice_name ORDER BY sr, size DESC, prompt_id, evaluator_name, kind) AS place FROM k)""")
def t1_comparison_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order of the comparisons of every slice, by severity by the stand-in and effect."""
    return ordered(severities(spark, folder))


@REGISTRY.add("t1_tested_order")
def t1_tested_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order of the comparisons of every slice, by severity by the paired test and effect."""
    return ordered(tested_severities(spark, folder))


def ordered(rows: DataFrame) -> DataFrame:
    """Place of every comparison in its slice: a slice's comparisons are its prompts and evaluators, not its examples."""
    from pyspark.sql import Window

    order = Window.partitionBy("slice_name").orderBy(T.severity_rank(F.col("severity")), F.desc(F.round(F.abs("d"), 10)), "prompt_id", "evaluator_name", "kind")
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).select("slice_name", "place", "prompt_id", "evaluator_name", "kind", "severity")


@REGISTRY.add("a10_multi_axis", f"""WITH {SLICED}, g AS (SELECT DISTINCT slice_name, prompt_id, evaluator_name, kind FROM sliced WHERE error IS NULL)
SELECT slice_name, prompt_id, evaluator_name, kind, CASE WHEN (SELECT count(*) FROM g b WHERE b.slice_name = a.slice_name AND b.prompt_id = a.prompt_id AND b.evaluator_name = a.evaluator_name) > 1 THEN kind END AS axis FROM g a""")
def a10_multi_axis(spark: SparkSession, folder: str) -> DataFrame:
    """Comparisons of evaluators with several axes."""
    return T.multi_axis(comparisons(spark, folder)).select(*T.GROUP, "axis")


@REGISTRY.add("a34_executive_summary", SEVERITY_SQL + """
SELECT prompt_id, min(list_position(['critical', 'high', 'medium', 'low', 'improved', 'none', 'insufficient'], severity)) - 1 AS worst, count(*) AS comparisons,
  count(*) FILTER (severity IN ('critical', 'high')) AS blocking FROM s WHERE slice_name = 'all' GROUP BY ALL""")
def a34_executive_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Worst severity by the stand-in and blocking comparisons of every prompt."""
    return summary(severities(spark, folder))


@REGISTRY.add("a34_tested_summary")
def a34_tested_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Worst severity by the paired test and blocking comparisons of every prompt."""
    return summary(tested_severities(spark, folder))


def summary(rows: DataFrame) -> DataFrame:
    rank = T.severity_rank(F.col("severity"))
    return rows.where("slice_name = 'all'").groupBy("prompt_id").agg(F.min(rank).cast("bigint").alias("worst"), F.count("*").alias("comparisons"), F.count_if(F.col("severity").isin("critical", "high")).alias("blocking"))


@REGISTRY.add("a33_headline", SEVERITY_SQL + """, k AS (SELECT *, round(abs(d), 10) AS size FROM s WHERE gate = 'tested')
SELECT slice_name, prompt_id, evaluator_name, kind, size FROM (
  SELECT *, row_number() OVER (PARTITION BY slice_name ORDER BY size DESC, prompt_id, evaluator_name, kind) AS i FROM k) WHERE i = 1""")
def a33_headline(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison with the largest effect of every slice: one aggregation, no sort."""
    k = severities(spark, folder).where("gate = 'tested'").withColumn("size", F.round(F.abs("d"), 10))
    best = F.min_by(F.struct("prompt_id", "evaluator_name", "kind", "size"), F.struct(-F.col("size"), "prompt_id", "evaluator_name", "kind"))
    return k.groupBy("slice_name").agg(best.alias("b")).select("slice_name", "b.*")


# ---------------------------------------------------------------- rates and economics

RATES = f"""WITH {SCORES}, ev AS (
  SELECT * FROM scores WHERE error IS NULL AND NOT coalesce(delta = 0 AND kind = 'tool_selection.conformance' AND source_score < 1 AND target_score < 1, false)
), g AS (
  SELECT evaluator_name, kind, count(*) AS n, count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta = 0) AS equivalent, count(*) FILTER (delta < 0) AS regressed FROM ev GROUP BY ALL
)
"""


@REGISTRY.add("a11_score_rates", RATES + "SELECT * FROM g")
def a11_score_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Improved, equivalent and regressed scores by evaluator and kind."""
    return R.score_rates(L.reduce_samples(V.samples(spark, folder)), ["evaluator_name", "kind"])


@REGISTRY.add("a13_wilson", RATES + """, z AS (SELECT *, 1.959963984540054e0 AS z, regressed * 1e0 / n AS p FROM g)
SELECT evaluator_name, kind, n, regressed, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 10) AS low,
  round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 10) AS high FROM z""")
def a13_wilson(spark: SparkSession, folder: str) -> DataFrame:
    """Wilson interval of the regression rate."""
    rates = R.score_rates(L.reduce_samples(V.samples(spark, folder)), ["evaluator_name", "kind"])
    low, high = T.wilson(F.col("regressed"), F.col("n"))
    return rates.select("evaluator_name", "kind", "n", "regressed", F.round(low, 10).alias("low"), F.round(high, 10).alias("high"))


@REGISTRY.add("a18_category_counts", f"""WITH {SAMPLES}, c AS (SELECT explanation AS category, count(*) AS n FROM samples WHERE explanation IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY n DESC, category) AS place FROM c""")
def a18_category_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Failure labels by frequency."""
    counts = R.category_counts(V.samples(spark, folder), F.array_compact(F.array("explanation")))
    return counts.withColumn("place", F.col("place").cast("bigint"))


ECONOMICS = """
SELECT {by} role, count(*) AS calls, count(error) AS failed, count(*) FILTER (cached) AS cached,
  round(coalesce(sum(CASE WHEN isnan(cost_usd) THEN NULL ELSE cost_usd END), 0), 10) AS cost, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  round(avg(latency_ms) FILTER (live), 10) AS latency_mean,
  list_sort(list(latency_ms) FILTER (live))[CAST(greatest(1, round_even(0.95 * count(*) FILTER (live), 0)) AS BIGINT)] AS latency_p95
FROM (SELECT *, error IS NULL AND NOT coalesce(cached, false) AND coalesce(latency_ms >= 0, false) AS live FROM calls) GROUP BY ALL"""


@REGISTRY.add("a20_role_economics", f"WITH {CALLS} {ECONOMICS.format(by='')}")
def a20_role_economics(spark: SparkSession, folder: str) -> DataFrame:
    """Economics of each role over the run."""
    out = R.role_economics(V.calls(spark, folder, "error", "cached", "latency_ms", "cost_usd", "input_tokens", "output_tokens"))
    return out.withColumns({"cost": F.round("cost", 10), "latency_mean": F.round("latency_mean", 10)})


@REGISTRY.add("a20_prompt_economics", f"WITH {CALLS} {ECONOMICS.format(by='prompt_id,')}")
def a20_prompt_economics(spark: SparkSession, folder: str) -> DataFrame:
    """Economics of each role by prompt."""
    out = R.role_economics(V.calls(spark, folder, "error", "cached", "latency_ms", "cost_usd", "input_tokens", "output_tokens"), ["prompt_id"])
    return out.withColumns({"cost": F.round("cost", 10), "latency_mean": F.round("latency_mean", 10)})


@REGISTRY.add("a22_latency_ranks", f"""WITH {CALLS}, v AS (SELECT model_id, role, latency_ms AS v, row_number() OVER (PARTITION BY model_id, role ORDER BY latency_ms) AS i,
  count(*) OVER (PARTITION BY model_id, role) AS n FROM calls WHERE latency_ms >= 0)
SELECT model_id, role, n, max(v) FILTER (i = greatest(1, (n * 50 + 99) // 100)) AS p50, max(v) FILTER (i = greatest(1, (n * 95 + 99) // 100)) AS p95 FROM v GROUP BY ALL""")
def a22_latency_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank latency percentiles by model and role."""
    return R.nearest_rank(V.calls(spark, folder, "model_id", "latency_ms").where("latency_ms >= 0"), F.col("latency_ms"), ["model_id", "role"], {"p50": 50, "p95": 95})


@REGISTRY.add("a15_relative_increase", f"""WITH {CALLS}, m AS (
  SELECT run_id, avg(latency_ms) FILTER (error IS NULL AND role = 'source') AS s, avg(latency_ms) FILTER (error IS NULL AND role = 'target') AS t FROM calls WHERE latency_ms >= 0 GROUP BY ALL)
SELECT run_id, round(CASE WHEN coalesce(s, 0) > 0 THEN greatest(0, coalesce(t, 0) / s - 1) WHEN coalesce(t, 0) > 0 THEN 1 ELSE 0 END, 10) AS increase,
  s IS NOT NULL AND t IS NOT NULL AND (s <> 0 OR t <> 0) AS measured FROM m""")
def a15_relative_increase(spark: SparkSession, folder: str) -> DataFrame:
    """Latency increase of every run."""
    return R.relative_increase(V.calls(spark, folder, "error", "latency_ms").where("latency_ms >= 0"), F.col("latency_ms"), ["run_id"]).select("run_id", *rounded("increase"), "measured")


@REGISTRY.add("a24_run_totals", f"""WITH {CALLS}
SELECT run_id, count(*) AS calls, count(*) FILTER (cached) AS cached, count(error) AS failed, count(*) FILTER (finish_reason = 'length') AS truncated,
  round(sum(CASE WHEN isnan(cost_usd) THEN NULL ELSE cost_usd END), 10) AS cost FROM calls GROUP BY ALL""")
def a24_run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Header totals of every run."""
    cost = F.when(~F.isnan("cost_usd"), F.col("cost_usd"))
    return V.calls(spark, folder, "cost_usd", "cached", "error", "finish_reason").groupBy("run_id").agg(F.count("*").alias("calls"), F.count_if("cached").alias("cached"), F.count("error").alias("failed"), F.count_if(F.col("finish_reason") == "length").alias("truncated"), F.round(F.sum(cost), 10).alias("cost"))


@REGISTRY.add("t2_worst_regressions", f"""WITH {SCORES}
SELECT prompt_id, rank, example_id, evaluator_name, kind, round(delta, 10) AS delta FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY round(delta, 10), example_id, evaluator_name, kind) AS rank FROM scores WHERE delta IS NOT NULL
) WHERE rank <= 5 AND delta < 0 AND error IS NULL""")
def t2_worst_regressions(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five worst scores of every prompt, of which only regressions stay."""
    s = L.reduce_samples(V.samples(spark, folder)).withColumn("delta", F.round("delta", 10))
    return R.worst_rows(s, 5, ["prompt_id"], [F.col("example_id"), F.col("evaluator_name"), F.col("kind")]).select("prompt_id", F.col("rank").cast("bigint").alias("rank"), "example_id", "evaluator_name", "kind", "delta")


PASSES = f"""WITH {SCORES}, ep AS (
  SELECT prompt_id, example_id, count(*) AS scores, bool_and(error IS NULL AND coalesce(delta >= 0, false)) AS passed, min(delta) AS worst FROM scores GROUP BY ALL)
"""


@REGISTRY.add("a23_example_pass", PASSES + "SELECT prompt_id, example_id, scores, passed, round(worst, 10) AS worst FROM ep")
def a23_example_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each example passed, and its worst delta."""
    return R.example_pass(L.reduce_samples(V.samples(spark, folder)), ["prompt_id", "example_id"]).select("prompt_id", "example_id", "scores", F.coalesce("passed", F.lit(False)).alias("passed"), *rounded("worst"))


@REGISTRY.add("a21_pass_rates", PASSES + "SELECT prompt_id, count(*) AS total, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 10) AS pass_rate FROM ep GROUP BY ALL")
def a21_pass_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Pass rate of every prompt."""
    return R.pass_rates(R.example_pass(L.reduce_samples(V.samples(spark, folder)), ["prompt_id", "example_id"]), ["prompt_id"]).select("prompt_id", "total", "passed", *rounded("pass_rate"))


@REGISTRY.add("t3_example_rows", f"""WITH {SCORES}, w AS (SELECT example_id, round(coalesce(min(delta), 0), 10) AS worst, count(*) AS scores FROM scores GROUP BY ALL)
SELECT example_id, worst, scores, row_number() OVER (ORDER BY worst, example_id) AS place FROM w""")
def t3_example_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All examples, worst first: ranked in ranges, so no task sorts them all."""
    w = L.reduce_samples(V.samples(spark, folder)).groupBy("example_id").agg(F.round(F.coalesce(F.min("delta"), F.lit(0.0)), 10).alias("worst"), F.count("*").alias("scores"))
    return global_rank(w, [F.col("worst").asc(), F.col("example_id").asc_nulls_last()], "place")


@REGISTRY.add("t4_regression_samples", f"""WITH {SCORES}
SELECT prompt_id, example_id, evaluator_name, kind, round(delta, 10) AS delta FROM scores WHERE delta < 0 ORDER BY round(delta, 10), example_id, prompt_id, evaluator_name, kind LIMIT 8""")
def t4_regression_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The eight strongest regressions: a top-k report."""
    s = L.reduce_samples(V.samples(spark, folder)).where("delta < 0").withColumn("delta", F.round("delta", 10))
    return s.orderBy("delta", "example_id", "prompt_id", "evaluator_name", "kind").limit(8).select("prompt_id", "example_id", "evaluator_name", "kind", "delta")


@REGISTRY.add("a25_insight_facts", PASSES + "SELECT prompt_id, round(min(worst), 10) AS least, round(median(worst), 10) AS middle, round(max(worst), 10) AS most, count(*) AS examples FROM ep GROUP BY ALL")
def a25_insight_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Spread of the examples' worst deltas by prompt."""
    e = R.example_pass(L.reduce_samples(V.samples(spark, folder)), ["prompt_id", "example_id"])
    spread = e.groupBy("prompt_id").agg(F.round(F.min("worst"), 10).alias("least"), F.round(F.max("worst"), 10).alias("most"), F.count("*").alias("examples"))
    middle = R.medians(e, "worst", ["prompt_id"]).select("prompt_id", F.round("median", 10).alias("middle"))
    return spread.join(middle, "prompt_id", "left").select("prompt_id", "least", "middle", "most", "examples")


@REGISTRY.add("j11_bundle_rows", f"""WITH {CALLS}, k AS (SELECT run_id, prompt_id, example_id, bool_or(role = 'source') AS has_source, bool_or(role = 'target') AS has_target, count(*) AS calls FROM calls GROUP BY ALL),
{SCORES}, sc AS (SELECT prompt_id, example_id, count(*) AS scores FROM scores GROUP BY ALL), {EXAMPLES}
SELECT k.*, coalesce(sc.scores, 0) AS scores, e.id IS NOT NULL AS known FROM k LEFT JOIN sc USING (prompt_id, example_id) LEFT JOIN examples e ON e.id = k.example_id""")
def j11_bundle_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every called example of a run, with either role, its scores and whether the suite knows it."""
    k = V.calls(spark, folder, "model_id").groupBy("run_id", "prompt_id", "example_id").agg(F.bool_or(F.col("role") == "source").alias("has_source"), F.bool_or(F.col("role") == "target").alias("has_target"), F.count("*").alias("calls"))
    sc = L.reduce_samples(V.samples(spark, folder)).groupBy("prompt_id", "example_id").agg(F.count("*").alias("scores"))
    known = V.examples(spark, folder, "toolset_ref").select(F.col("id").alias("example_id"), F.lit(True).alias("known"))
    return k.join(sc, ["prompt_id", "example_id"], "left").join(known, "example_id", "left").na.fill(0, ["scores"]).na.fill(False, ["known"])


# ---------------------------------------------------------------- evaluators


@REGISTRY.add("e3_length", """
SELECT doc_id, round(CASE WHEN n < 400 THEN greatest(0, 1 - (400 - n) / 400e0) WHEN n > 1200 THEN greatest(0, 1 - (n - 1200) / 1200e0) ELSE 1 END, 10) AS score
FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)""")
def e3_length(spark: SparkSession, folder: str) -> DataFrame:
    """Length score of every document."""
    return table(spark, folder, "documents").select("doc_id", F.round(S.length_score(F.col("text"), 400, 1200), 10).alias("score"))


@REGISTRY.add("e2_regex", "SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]{3,}') THEN 1.0 ELSE 0.0 END AS score FROM documents")
def e2_regex(spark: SparkSession, folder: str) -> DataFrame:
    """Regex score of every document."""
    return table(spark, folder, "documents").select("doc_id", S.regex_score(F.col("text"), "[0-9]{3,}").alias("score"))


@REGISTRY.add("e1_json", "SELECT row_id, CASE WHEN json_valid(inputs) THEN 1.0 ELSE 0.0 END AS score FROM golden")
def e1_json(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the inputs of suite rows parse as JSON."""
    return table(spark, folder, "golden").select("row_id", S.json_score(F.col("inputs")).alias("score"))


@REGISTRY.add("e4_cosine", """
WITH p AS (SELECT vec_id // 2 AS pair, any_value(embedding) FILTER (vec_id % 2 = 0) AS a, any_value(embedding) FILTER (vec_id % 2 = 1) AS b FROM embeddings GROUP BY ALL)
SELECT pair, round(greatest(0, least(1, list_dot_product(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) / sqrt(list_dot_product(CAST(a AS DOUBLE[]), CAST(a AS DOUBLE[])) * list_dot_product(CAST(b AS DOUBLE[]), CAST(b AS DOUBLE[]))))), 4) AS score
FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def e4_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine score of paired embeddings."""
    v = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    side = lambda k: F.first(F.when(F.col("vec_id") % 2 == k, F.col("e")), ignorenulls=True)
    p = v.groupBy(F.expr("vec_id div 2").alias("pair")).agg(side(0).alias("a"), side(1).alias("b")).where("a is not null and b is not null")
    return p.select("pair", F.round(S.cosine(F.col("a"), F.col("b")), 4).alias("score"))


def sides(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, requested and executed tool names of every capture."""
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<name:string,arguments:string,call_id:string,q:int>>")), lambda x: x["name"])
    return V.capture_calls(spark, folder).select("row_id", names("requested").alias("requested"), names("executed").alias("executed"))


@REGISTRY.add("e9_divergence", f"""WITH {SIDES}
SELECT row_id, CASE WHEN requested = executed THEN 1.0 ELSE 0.0 END AS exact,
  round(CASE WHEN len(list_distinct(list_concat(requested, executed))) = 0 THEN 1 ELSE len(list_intersect(list_distinct(requested), list_distinct(executed))) / len(list_distinct(list_concat(requested, executed))) END, 10) AS jaccard,
  CASE WHEN coalesce(requested[1] = executed[1], false) THEN 1.0 ELSE 0.0 END AS first FROM sides""")
def e9_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Requested against executed tool names: exact, set and first."""
    a, b = F.col("requested"), F.col("executed")
    return sides(spark, folder).select("row_id", S.exact_match(a, b).alias("exact"), F.round(S.jaccard(a, b), 10).alias("jaccard"), S.first_match(a, b).alias("first"))


@REGISTRY.add("e7_sequence_match", f"""WITH RECURSIVE {SIDES}, w AS (
  SELECT row_id, requested, executed, 0 AS j, 0 AS i FROM sides
  UNION ALL SELECT row_id, requested, executed, j + 1, CASE WHEN coalesce(requested[i + 1] = executed[j + 1], false) THEN i + 1 ELSE i END FROM w WHERE j < len(executed)
)
SELECT row_id, round(CASE WHEN len(requested) = 0 THEN 1 ELSE max(i) / len(requested) END, 10) AS score, CASE WHEN len(executed) = 0 THEN 1.0 ELSE 0.0 END AS no_tools FROM w GROUP BY row_id, requested, executed""")
def e7_sequence_match(spark: SparkSession, folder: str) -> DataFrame:
    """In-order prefix match of requested names in the executed ones, and the no-tools score."""
    return sides(spark, folder).select("row_id", F.round(S.sequence_match(F.col("requested"), F.col("executed")), 10).alias("score"), S.no_tools_score(F.col("executed")).alias("no_tools"))


@REGISTRY.add("e8_multiset_recall", f"""WITH {SIDES}, c AS (
  SELECT row_id, n, count(*) FILTER (s = 0) AS a, count(*) FILTER (s = 1) AS b FROM (
    SELECT row_id, unnest(requested) AS n, 0 AS s FROM sides UNION ALL SELECT row_id, unnest(executed), 1 FROM sides) GROUP BY ALL)
SELECT s.row_id, round(CASE WHEN len(requested) = 0 THEN 1 ELSE coalesce(h, 0) / len(requested) END, 10) AS score FROM sides s LEFT JOIN (SELECT row_id, sum(least(a, b)) AS h FROM c GROUP BY ALL) USING (row_id)""")
def e8_multiset_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of requested names among the executed ones."""
    return sides(spark, folder).select("row_id", F.round(S.multiset_recall(F.col("requested"), F.col("executed")), 10).alias("score"))


@REGISTRY.add("e19_structure", f"""WITH {SIDES}, n AS (SELECT row_id, len(requested) AS s, len(executed) AS t FROM sides)
SELECT row_id, s, t, round(CASE WHEN abs(t - s) - 1 <= 0 THEN 1 ELSE greatest(0, 1 - (abs(t - s) - 1) / greatest(s, 1)) END, 10) AS score FROM n""")
def e19_structure(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of call counts, with a tolerance of one."""
    n = sides(spark, folder).select("row_id", F.size("requested").alias("s"), F.size("executed").alias("t"))
    return n.select("row_id", "s", "t", F.round(S.count_decay(F.col("s"), F.col("t"), 1), 10).alias("score"))


@REGISTRY.add("e11_selection_tags", f"""WITH {SCORES}, t AS (
  SELECT *, CASE WHEN target_score < source_score THEN 'TOOL_SELECTION_DRIFT' END AS a,
    CASE WHEN kind = 'tool_selection.conformance' AND source_score < 1 AND target_score < 1 THEN 'TOOL_GROUND_TRUTH_MISS' END AS b FROM scores WHERE evaluator_name = 'tool_selection' AND error IS NULL)
SELECT kind, count(a) AS drift, count(b) AS shared_or_missed, count(*) AS n FROM t GROUP BY ALL""")
def e11_selection_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Failure labels of tool-selection scores."""
    s = L.reduce_samples(V.samples(spark, folder)).where("evaluator_name = 'tool_selection' and error is null")
    tags = s.select("kind", S.selection_tags(F.col("source_score"), F.col("target_score"), True).alias("both"), S.selection_tags(F.col("source_score"), F.col("target_score"), False).alias("drift"))
    miss = F.array_contains("both", "TOOL_GROUND_TRUTH_MISS") & (F.col("kind") == "tool_selection.conformance")
    return tags.groupBy("kind").agg(F.count_if(F.size("drift") > 0).alias("drift"), F.count_if(miss).alias("shared_or_missed"), F.count("*").alias("n"))


@REGISTRY.add("e16_numeric", f"""WITH {CALLS}, p AS (
  SELECT s.run_id, s.prompt_id, s.example_id, s.sample_index, CAST(s.output_tokens AS DOUBLE) AS a, CAST(t.output_tokens AS DOUBLE) AS b FROM calls s JOIN calls t
  ON s.run_id = t.run_id AND s.prompt_id = t.prompt_id AND s.example_id = t.example_id AND s.sample_index = t.sample_index WHERE s.role = 'source' AND t.role = 'target')
SELECT *, round(CASE WHEN a = 0 AND b = 0 THEN 1 ELSE greatest(0, 1 - abs(a - b) / greatest(abs(a), abs(b), 1e-9) / 0.5e0) END, 10) AS score FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def e16_numeric(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric closeness of the token counts of a pair."""
    p = P.pair_roles(V.calls(spark, folder, "output_tokens").where("prompt_id is not null"))
    a, b = F.col("source.output_tokens").cast("double"), F.col("target.output_tokens").cast("double")
    return p.select(*P.CALL_KEY, a.alias("a"), b.alias("b")).where("a is not null and b is not null").withColumn("score", F.round(S.numeric_score(F.col("a"), F.col("b"), 0.5), 10))


@REGISTRY.add("j6_occurrence_pairs", f"""WITH {EVENTS}, a AS (
  SELECT row_id, n AS name, row_number() OVER (PARTITION BY row_id, n ORDER BY q * 1000 + i) AS k, q * 1000 + i AS left_at FROM (
    SELECT row_id, q, unnest(asked).name AS n, unnest(range(len(asked))) AS i FROM e WHERE type = 'model_call' AND asked IS NOT NULL)
), b AS (SELECT row_id, name, row_number() OVER (PARTITION BY row_id, name ORDER BY q) AS k, q AS right_at FROM e WHERE type = 'tool_call')
SELECT a.row_id, a.name, a.k, a.left_at, b.right_at FROM a LEFT JOIN b ON a.row_id = b.row_id AND a.name = b.name AND a.k = b.k""")
def j6_occurrence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The k-th requested call of a name with the k-th executed one."""
    rows = table(spark, folder, "multi_round_tools")
    z = F.arrays_zip(F.col("trace.events.type").alias("t"), F.col("trace.events.sequence_index").alias("q"), F.col("trace.events.requested_tool_calls").alias("r"))
    asked = rows.select("row_id", F.explode(z).alias("e")).where("e.t = 'model_call'").select("row_id", F.col("e.q").alias("q"), F.posexplode("e.r").alias("i", "c"))
    left = asked.select("row_id", F.col("c.name").alias("name"), (F.col("q").cast("bigint") * 1000 + F.col("i")).alias("at"))
    right = C.events(rows, "type", "name").where("type = 'tool_call'").select("row_id", "name", F.col("q").alias("at"))
    return S.occurrence_pairs(left, right, ["row_id", "name"], "at").withColumn("k", F.col("k").cast("bigint"))


@REGISTRY.add("o6_count_differences", f"""WITH {SIDES}, c AS (
  SELECT row_id, n AS name, count(*) FILTER (s = 0) AS a, count(*) FILTER (s = 1) AS b FROM (
    SELECT row_id, unnest(requested) AS n, 0 AS s FROM sides UNION ALL SELECT row_id, unnest(executed), 1 FROM sides) GROUP BY ALL)
SELECT row_id, name, greatest(a - b, 0) AS missing, greatest(b - a, 0) AS extra FROM c WHERE a <> b AND name IS NOT NULL""")
def o6_count_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Tools requested more often than executed, or the other way round."""
    s = sides(spark, folder)
    one = lambda c: s.select("row_id", F.explode(c).alias("name")).where("name is not null")
    return S.count_differences(one("requested"), one("executed"), ["row_id", "name"])


# ---------------------------------------------------------------- captures


@REGISTRY.add("w1_rounds", f"WITH {EVENTS} SELECT row_id, round, count(*) AS events, count(*) FILTER (type = 'tool_call') AS calls FROM er GROUP BY ALL")
def w1_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Events and calls of every agent round."""
    return C.rounds(C.events(table(spark, folder, "multi_round_tools"), "type")).groupBy("row_id", "round").agg(F.count("*").alias("events"), F.count_if(F.col("type") == "tool_call").alias("calls"))


@REGISTRY.add("w3_wire_rounds", f"WITH {EVENTS} SELECT row_id, greatest(round - 1, 0) AS wire_round, count(*) AS events FROM er GROUP BY ALL")
def w3_wire_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Events of every round as they are sent."""
    return C.wire_rounds(C.events(table(spark, folder, "multi_round_tools"), "type")).groupBy("row_id", "wire_round").agg(F.count("*").alias("events"))


@REGISTRY.add("w2_tool_rounds", f"""WITH {EVENTS}, c AS (SELECT row_id, round, list(name ORDER BY q) AS calls FROM er WHERE type = 'tool_call' GROUP BY ALL)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY round) - 1 AS tool_round, array_to_string(calls, ',') AS calls FROM c""")
def w2_tool_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Rounds with calls, renumbered."""
    return C.tool_rounds(C.events(table(spark, folder, "multi_round_tools"), "type", "name")).select("row_id", F.col("tool_round").cast("bigint").alias("tool_round"), F.array_join("calls", ",").alias("calls"))


@REGISTRY.add("j9_pair_results", f"""WITH {EVENTS}, c AS (SELECT *, row_number() OVER (PARTITION BY row_id, round, call_id ORDER BY q) AS k FROM er WHERE type = 'tool_call'),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id, round, call_id ORDER BY q) AS k FROM er WHERE type = 'tool_result'),
f AS (SELECT c.row_id, c.round, c.q AS call_q, r.q AS result_q FROM c JOIN r ON c.row_id = r.row_id AND c.round = r.round AND c.call_id = r.call_id WHERE c.k = 1 AND r.k = 1),
c2 AS (SELECT *, row_number() OVER (PARTITION BY row_id, round, name ORDER BY q) AS j FROM c WHERE (row_id, q) NOT IN (SELECT (row_id, call_q) FROM f)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY row_id, round, name ORDER BY q) AS j FROM r WHERE (row_id, q) NOT IN (SELECT (row_id, result_q) FROM f))
SELECT * FROM f UNION ALL SELECT c2.row_id, c2.round, c2.q, r2.q FROM c2 LEFT JOIN r2 ON c2.row_id = r2.row_id AND c2.round = r2.round AND c2.name = r2.name AND c2.j = r2.j""")
def j9_pair_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of calls within their round, by id and then by name."""
    return C.pair_results(C.events(table(spark, folder, "multi_round_tools"), "type", "name", "call_id"))


def names_sql(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


@REGISTRY.add("w7_missing_verification", f"""WITH {EVENTS}, v AS (
  SELECT *, count(*) FILTER (name IN ({names_sql(VERIFYING)})) OVER (PARTITION BY row_id ORDER BY q ROWS UNBOUNDED PRECEDING) AS seen FROM e)
SELECT row_id, q, name FROM v WHERE type = 'tool_call' AND name IN ({names_sql(DANGEROUS)}) AND seen = 0""")
def w7_missing_verification(spark: SparkSession, folder: str) -> DataFrame:
    """Dangerous calls without a verification before them."""
    return C.missing_verification(C.events(table(spark, folder, "multi_round_tools"), "type", "name"), DANGEROUS, VERIFYING)


@REGISTRY.add("r17_capture_list", """
SELECT row_id, capture_id, suite, len(trace.events) AS events, len(list_filter(trace.events, lambda x: x.type = 'tool_call')) AS tool_calls,
  len(list_filter(trace.events, lambda x: x.type = 'model_call')) AS model_calls, capture_id IN (SELECT id FROM golden WHERE id IS NOT NULL) AS promoted FROM multi_round_tools""")
def r17_capture_list(spark: SparkSession, folder: str) -> DataFrame:
    """Captures with their counts and whether the suite has them."""
    promoted = table(spark, folder, "golden").where("id is not null").select(F.col("id").alias("capture_id"))
    out = C.capture_list(table(spark, folder, "multi_round_tools"), promoted)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("events", "tool_calls", "model_calls")})


@REGISTRY.add("r20_toolset_refs", f"""WITH {EVENTS}
SELECT row_id, arg_min(toolset_ref, q) FILTER (toolset_ref IS NOT NULL) AS first_ref, count(DISTINCT toolset_ref) AS refs FROM e GROUP BY ALL""")
def r20_toolset_refs(spark: SparkSession, folder: str) -> DataFrame:
    """First toolset reference of a capture and how many it has."""
    return C.toolset_refs(table(spark, folder, "multi_round_tools")).select("row_id", "first_ref", F.size("refs").cast("bigint").alias("refs"))


@REGISTRY.add("o7_refs_in_use", f"WITH {EVENTS} SELECT DISTINCT toolset_ref FROM (SELECT toolset_ref FROM e UNION ALL SELECT toolset_ref FROM golden) WHERE toolset_ref IS NOT NULL")
def o7_refs_in_use(spark: SparkSession, folder: str) -> DataFrame:
    """Toolset references that captures or suite rows use."""
    return C.refs_in_use(C.events(table(spark, folder, "multi_round_tools"), "toolset_ref"), table(spark, folder, "golden"))


@REGISTRY.add("a27_duplicate_turns", """
SELECT conversation_id, turn_index, array_to_string(list_sort(list(DISTINCT capture_id)), ',') AS captures FROM multi_round_tools
WHERE conversation_id IS NOT NULL AND turn_index IS NOT NULL GROUP BY ALL HAVING count(DISTINCT capture_id) > 1""")
def a27_duplicate_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Places of conversations that several captures claim."""
    return C.duplicate_turns(table(spark, folder, "multi_round_tools")).withColumn("captures", F.array_join("captures", ","))


TURNS = """t AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_index NULLS LAST, created_at NULLS FIRST, capture_id, row_id) - 1 AS place
  FROM multi_round_tools WHERE conversation_id IS NOT NULL)"""


@REGISTRY.add("w4_turn_order", f"WITH {TURNS} SELECT row_id, conversation_id, place, coalesce(turn_index, place) AS turn FROM t")
def w4_turn_order(spark: SparkSession, folder: str) -> DataFrame:
    """Order of the turns of every conversation."""
    out = C.turn_order(table(spark, folder, "multi_round_tools").where("conversation_id is not null"))
    return out.select("row_id", "conversation_id", F.col("place").cast("bigint").alias("place"), F.col("turn").cast("bigint").alias("turn"))


FINAL = r""", o AS (
  SELECT row_id, CASE WHEN count(*) FILTER (type = 'final_output') > 0 THEN (list(text ORDER BY q) FILTER (type = 'final_output'))[-1]
    ELSE regexp_replace((list(output ORDER BY q) FILTER (type = 'model_call' AND regexp_matches(output, '\S')))[-1], '^\s+|\s+$', '', 'g') END AS reply FROM e GROUP BY ALL
), fi AS (SELECT DISTINCT ON (row_id) row_id, input AS first_input FROM e WHERE type = 'model_call' ORDER BY row_id, q)
"""


@REGISTRY.add("x14_recovered_texts", f"WITH {EVENTS} {FINAL} SELECT m.row_id, md5(first_input) AS first_input, md5(reply) AS final_text FROM multi_round_tools m LEFT JOIN o USING (row_id) LEFT JOIN fi USING (row_id)")
def x14_recovered_texts(spark: SparkSession, folder: str) -> DataFrame:
    """First input and final text of every capture (as digests)."""
    return C.recovered_texts(table(spark, folder, "multi_round_tools")).select("row_id", F.md5("first_input").alias("first_input"), F.md5("final_text").alias("final_text"))


@REGISTRY.add("w5_history", f"""WITH {EVENTS} {FINAL}, {TURNS}, u AS (SELECT t.conversation_id, t.place, o.reply FROM t LEFT JOIN o USING (row_id))
SELECT conversation_id, place, count(reply) OVER w AS turns, CAST(coalesce(sum(length(reply)) OVER w, 0) AS BIGINT) AS chars FROM u
WINDOW w AS (PARTITION BY conversation_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w5_history(spark: SparkSession, folder: str) -> DataFrame:
    """Replies that each turn has before it, all of its conversation."""
    rows = table(spark, folder, "multi_round_tools")
    texts = C.recovered_texts(rows).select("row_id", F.col("final_text").alias("reply"))
    turns = C.turn_order(rows.where("conversation_id is not null").select("row_id", "conversation_id", "turn_index", "created_at", "capture_id")).join(texts, "row_id")
    return C.replies_before(turns).withColumn("place", F.col("place").cast("bigint"))


@REGISTRY.add("w5_full_history")
def w5_full_history(spark: SparkSession, folder: str) -> DataFrame:
    """Whole history that each turn sees, recorded or rebuilt: its messages and their characters."""
    return C.full_history(table(spark, folder, "multi_round_tools")).withColumn("place", F.col("place").cast("bigint"))


@REGISTRY.add("o2_content_duplicates", """
WITH f AS (SELECT tags, toolset_ref, expected_tool_count, min(row_id) AS first_owner FROM golden WHERE tags IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT row_id, first_owner FROM golden g JOIN f ON g.tags = f.tags AND g.toolset_ref IS NOT DISTINCT FROM f.toolset_ref AND g.expected_tool_count IS NOT DISTINCT FROM f.expected_tool_count
WHERE row_id <> first_owner""")
def o2_content_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Suite rows whose tags, toolset and call count another row has."""
    return C.content_duplicates(table(spark, folder, "golden").where("tags is not null"), ["tags", "toolset_ref", "expected_tool_count"], "row_id", [])


@REGISTRY.add("context_loss", rf"""WITH {EVENTS}, f AS (SELECT DISTINCT ON (row_id) row_id, input, input_tokens AS t FROM e WHERE type = 'model_call' ORDER BY row_id, q),
m AS (SELECT row_id, input, t, CASE WHEN json_valid(input) AND json_type(input) = 'ARRAY' THEN CAST(from_json(input, '[{{"role":"VARCHAR","content":"VARCHAR"}}]') AS STRUCT("role" VARCHAR, "content" VARCHAR)[]) END AS said FROM f WHERE t > 0),
u AS (SELECT *, list_max(list_transform(range(1, len(said) + 1), lambda i: CASE WHEN said[i].role = 'user' THEN i END)) AS pos FROM m),
c AS (SELECT row_id, t, CASE WHEN pos IS NOT NULL THEN length(regexp_replace(regexp_replace(to_json(struct_pack(query := said[pos].content)), '[\x{{10000}}-\x{{10FFFF}}]', '############', 'g'), '[^\x00-\x7F]', '######', 'g')) + 1 + coalesce(list_sum(list_transform(said[:pos - 1], lambda x: length(x.content))), 0)
  WHEN said IS NOT NULL OR input IS NULL THEN 2 ELSE length(regexp_replace(regexp_replace(to_json(struct_pack(query := input)), '[\x{{10000}}-\x{{10FFFF}}]', '############', 'g'), '[^\x00-\x7F]', '######', 'g')) + 1 END AS chars FROM u)
SELECT row_id, CAST(greatest(1, chars // 4) AS BIGINT) AS estimate, CAST(t AS BIGINT) AS input_tokens FROM c WHERE t >= 1.1 * greatest(1, chars // 4) AND t - greatest(1, chars // 4) > 20""")
def context_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Captures billed for clearly more input than was recovered; stricter than the usual four times, which none has here."""
    return C.context_loss(table(spark, folder, "multi_round_tools"), ratio=1.1, gap=20)


@REGISTRY.add("w14_cap_stream")
def w14_cap_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a capture as they are sent: results and streams within the usual budgets of escaped JSON."""
    return C.cap_streams(table(spark, folder, "multi_round_tools"))


@REGISTRY.add("e23_requested_disagreement", f"WITH {SIDES} SELECT row_id FROM sides WHERE requested <> executed AND len(requested) > 0")
def e23_requested_disagreement(spark: SparkSession, folder: str) -> DataFrame:
    """Captures that executed something else than was requested."""
    return sides(spark, folder).where("requested <> executed and size(requested) > 0").select("row_id")


# ---------------------------------------------------------------- further rollups and functions


@REGISTRY.add("failed_scores", f"WITH {SAMPLES} SELECT prompt_id, evaluator_name, count(*) AS n, count(error) AS errors FROM samples WHERE delta < 0 OR error IS NOT NULL GROUP BY ALL")
def failed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores that regressed or failed, by prompt and evaluator."""
    return V.samples(spark, folder).where("delta < 0 or error is not null").groupBy("prompt_id", "evaluator_name").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


@REGISTRY.add("a12_divergence_counts", f"""WITH {SCORES} SELECT prompt_id, count(*) AS total, count(*) FILTER (delta < 0) AS diverged, count(*) FILTER (target_score < 0.5) AS below_floor
FROM scores WHERE error IS NULL AND kind = 'tool_selection.divergence' GROUP BY ALL""")
def a12_divergence_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Diverging tool selections of every prompt."""
    s = L.reduce_samples(V.samples(spark, folder)).where("error is null and kind = 'tool_selection.divergence'")
    return s.groupBy("prompt_id").agg(F.count("*").alias("total"), F.count_if(F.col("delta") < 0).alias("diverged"), F.count_if(F.col("target_score") < 0.5).alias("below_floor"))


@REGISTRY.add("a26_source_conformance", f"""WITH {SCORES} SELECT prompt_id, count(*) AS n, round(count(*) FILTER (source_score < 1) / count(*), 10) AS missed
FROM scores WHERE error IS NULL AND kind = 'tool_selection.conformance' GROUP BY ALL HAVING count(*) >= 4""")
def a26_source_conformance(spark: SparkSession, folder: str) -> DataFrame:
    """How often the source itself misses the expected tools, for prompts with four rows or more."""
    s = L.reduce_samples(V.samples(spark, folder)).where("error is null and kind = 'tool_selection.conformance'")
    return s.groupBy("prompt_id").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("source_score") < 1) / F.count("*"), 10).alias("missed")).where("n >= 4")


@REGISTRY.add("t9_tag_list", "SELECT DISTINCT unnest(tags) AS tag FROM golden")
def t9_tag_list(spark: SparkSession, folder: str) -> DataFrame:
    """All tags of the suite."""
    return table(spark, folder, "golden").select(F.explode("tags").alias("tag")).distinct()


@REGISTRY.add("o10_unique_tags", "SELECT row_id, len(list_distinct(tags)) AS tags, len(tags) - len(list_distinct(tags)) AS repeats FROM golden WHERE tags IS NOT NULL")
def o10_unique_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct tags of a row and how many it repeats."""
    d = F.size(F.array_distinct("tags")).cast("bigint")
    return table(spark, folder, "golden").where("tags is not null").select("row_id", d.alias("tags"), (F.size("tags") - d).alias("repeats"))


@REGISTRY.add("r11_calls_by_tool", f"WITH {EVENTS} SELECT name, count(*) AS calls, count(DISTINCT row_id) AS captures, count(call_id) AS identified FROM e WHERE type = 'tool_call' GROUP BY ALL")
def r11_calls_by_tool(spark: SparkSession, folder: str) -> DataFrame:
    """Executed calls of every tool; captures are counted from per-capture partial counts."""
    ev = C.events(table(spark, folder, "multi_round_tools"), "type", "name", "call_id").where("type = 'tool_call'")
    per = ev.groupBy("name", "row_id").agg(F.count("*").alias("c"), F.count("call_id").alias("i"))
    return per.groupBy("name").agg(F.sum("c").alias("calls"), F.count("*").alias("captures"), F.sum("i").alias("identified"))


@REGISTRY.add("w13_merged_rounds", f"""WITH {EVENTS} SELECT row_id, count(*) FILTER (type = 'model_call') AS model_calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, count(error) AS errors FROM e GROUP BY ALL""")
def w13_merged_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and errors of a capture, summed inside the row (no shuffle)."""
    z = table(spark, folder, "multi_round_tools")
    total = lambda c: F.aggregate(F.col(f"trace.events.{c}"), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return z.where(F.size("trace.events.type") > 0).select(
        "row_id", F.size(F.filter("trace.events.type", lambda t: t == "model_call")).cast("bigint").alias("model_calls"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"),
        F.size(F.filter("trace.events.error", lambda x: x.isNotNull())).cast("bigint").alias("errors"),
    )


@REGISTRY.add("w12_newest_captures", """SELECT suite, row_id, place FROM (
  SELECT suite, row_id, row_number() OVER (PARTITION BY suite ORDER BY row_id DESC) AS place FROM multi_round_tools) WHERE place <= 3""")
def w12_newest_captures(spark: SparkSession, folder: str) -> DataFrame:
    """The three newest captures of every suite: what a retention of three keeps."""
    from pyspark.sql import Window

    w = Window.partitionBy("suite").orderBy(F.desc("row_id"))
    return table(spark, folder, "multi_round_tools").select("suite", "row_id", F.row_number().over(w).cast("bigint").alias("place")).where("place <= 3")


@REGISTRY.add("a31_generation_params", """SELECT k AS param, count(*) AS rows FROM (SELECT unnest(json_keys(generation_config)) AS k FROM golden WHERE json_valid(generation_config)) GROUP BY ALL""")
def a31_generation_params(spark: SparkSession, folder: str) -> DataFrame:
    """Generation parameters that suite rows ask for."""
    return table(spark, folder, "golden").select(F.explode(F.json_object_keys("generation_config")).alias("param")).groupBy("param").agg(F.count("*").alias("rows"))


@REGISTRY.add("x24_provenance", """SELECT row_id, CASE len(p) WHEN 0 THEN NULL WHEN 1 THEN p[1] ELSE 'mixed' END AS provenance FROM (
  SELECT row_id, list_distinct(list_transform(expected_tools, lambda t: t.provenance)) AS p FROM golden WHERE expected_tools IS NOT NULL)""")
def x24_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Where the expected tools of a row come from: one origin, or mixed."""
    p = F.array_distinct(F.filter("expected_tools.provenance", lambda x: x.isNotNull()))
    return table(spark, folder, "golden").where("expected_tools is not null").select("row_id", F.when(F.size(p) == 1, F.get(p, F.lit(0))).when(F.size(p) > 1, "mixed").alias("provenance"))


@REGISTRY.add("a30_suite_evaluators", """SELECT coalesce(bool_or(len(expected_tools) > 0 OR toolset_ref IS NOT NULL), false) AS selection,
  coalesce(bool_or(len(list_filter(expected_tools, lambda t: t.arguments IS NOT NULL)) > 0), false) AS arguments, count(*) AS rows FROM golden""")
def a30_suite_evaluators(spark: SparkSession, folder: str) -> DataFrame:
    """Which evaluators a suite calls for."""
    tools = (F.size("expected_tools") > 0) | F.col("toolset_ref").isNotNull()
    with_arguments = F.size(F.filter("expected_tools", lambda t: t["arguments"].isNotNull())) > 0
    off = F.lit(False)
    return table(spark, folder, "golden").agg(F.coalesce(F.bool_or(tools), off).alias("selection"), F.coalesce(F.bool_or(with_arguments), off).alias("arguments"), F.count("*").alias("rows"))


@REGISTRY.add("x5_slugs", "SELECT suite, regexp_replace(regexp_replace(lower(suite), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, count(*) AS documents FROM documents GROUP BY ALL")
def x5_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Names made of the documents' suites."""
    from pairloom.functions.text import slug

    return table(spark, folder, "documents").groupBy("suite").agg(F.count("*").alias("documents")).select("suite", slug(F.col("suite")).alias("slug"), "documents")


@REGISTRY.add("x7_fingerprints")
def x7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the inputs of suite rows that do not depend on key order."""
    from pairloom.functions.text import fingerprint

    return table(spark, folder, "golden").select("row_id", fingerprint(F.col("inputs")).alias("fingerprint"))
