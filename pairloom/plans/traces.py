"""Queries of agent traces, rounds, argument scores and the dispatch of evaluators, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators import captures as C
from pairloom.operators import dispatch as D
from pairloom.operators import pairing as P
from pairloom.operators import scoring as S
from pairloom.operators import slicing as L
from pairloom.operators import statistics as T
from pairloom.operators import traces as A
from pairloom.operators.arguments import argument_score, expectation_scores
from pairloom.plans import views as V
from pairloom.plans.reference import CALLS, DANGEROUS, EVENTS, EXAMPLES, SLICED, VERIFYING, comparisons, names_sql, rounded
from pairloom.plans.registry import Registry
from pairloom.session import table

REGISTRY = Registry()

# ---------------------------------------------------------------- pairs of traces


@REGISTRY.add("j4_trace_pairs", """
SELECT prompt_id, example_id, min(row_id) FILTER (role = 'source') AS source_row, min(row_id) FILTER (role = 'target') AS target_row,
  count(*) FILTER (role = 'source') AS source_imports, count(*) FILTER (role = 'target') AS target_imports,
  CASE WHEN count(*) FILTER (role = 'source') > 1 OR count(*) FILTER (role = 'target') > 1 THEN 'duplicate trace' END AS error
FROM source_traces GROUP BY prompt_id, example_id HAVING count(*) FILTER (role = 'source') > 0 AND count(*) FILTER (role = 'target') > 0""")
def j4_trace_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Imported traces of both roles of a prompt and example, with the error of those imported twice."""
    return A.trace_pairs(table(spark, folder, "source_traces"))


REPLAYS = """f AS (
  SELECT *, row_number() OVER (PARTITION BY prompt_id, example_id ORDER BY CASE WHEN role = 'source' THEN 0 ELSE 1 END, row_id) AS i,
    row_number() OVER (PARTITION BY prompt_id, example_id ORDER BY CASE WHEN coalesce(role = 'source', true) THEN 1 ELSE 0 END, CASE WHEN role = 'source' THEN -row_id ELSE row_id END) AS j
  FROM source_traces
), pr AS (SELECT a.prompt_id, a.example_id, a.row_id AS a, b.row_id AS b FROM f a JOIN f b ON a.prompt_id IS NOT DISTINCT FROM b.prompt_id AND a.example_id IS NOT DISTINCT FROM b.example_id
  WHERE a.i = 1 AND b.j = 1 AND a.row_id <> b.row_id
), tc AS (
  SELECT row_id, u.sequence_index AS q, u.name AS name, CASE WHEN json_type(u.arguments) = 'VARCHAR' THEN u.arguments ->> '$' ELSE u.arguments END AS args,
    row_number() OVER (PARTITION BY row_id, u.name ORDER BY u.sequence_index) AS k, count(*) OVER (PARTITION BY row_id, u.name) AS n
  FROM (SELECT row_id, unnest(events) AS u FROM source_traces) WHERE u.type = 'tool_call'
), met AS (
  SELECT pr.a, pr.b, s.q AS sq, t.q AS tq, s.name, s.args AS sa, t.args AS ta FROM pr JOIN tc s ON s.row_id = pr.a JOIN tc t ON t.row_id = pr.b AND t.name = s.name AND t.k = s.k
), fields AS (
  SELECT a, b, sq, tq, name, field, json_extract(sa, '$."' || field || '"') IS NOT DISTINCT FROM json_extract(ta, '$."' || field || '"') AS same
  FROM (SELECT *, unnest(list_distinct(list_concat(json_keys(sa), json_keys(ta)))) AS field FROM met)
)"""


@REGISTRY.add("e22_trace_diff", f"""WITH {REPLAYS}
SELECT prompt_id, example_id, 'missing' AS kind, 'TOOL_ORDER_DRIFT' AS category, s.q AS source_q, CAST(NULL AS INTEGER) AS target_q, s.name, CAST(NULL AS VARCHAR) AS field
FROM pr JOIN tc s ON s.row_id = a WHERE s.k > (SELECT count(*) FROM tc t WHERE t.row_id = b AND t.name = s.name)
UNION ALL SELECT prompt_id, example_id, 'extra', 'TOOL_ORDER_DRIFT', NULL, t.q, t.name, NULL FROM pr JOIN tc t ON t.row_id = b WHERE t.k > (SELECT count(*) FROM tc s WHERE s.row_id = a AND s.name = t.name)
UNION ALL SELECT prompt_id, example_id, 'reordered', 'TOOL_ORDER_DRIFT', sq, tq, name, NULL FROM pr JOIN met USING (a, b) WHERE sq <> tq
UNION ALL SELECT prompt_id, example_id, 'argument_drift', 'ARGUMENT_VALUE_DRIFT', sq, tq, name, field FROM pr JOIN fields USING (a, b) WHERE NOT same""")
def e22_trace_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of two traces of one prompt and example."""
    return A.trace_diff(A.replays(table(spark, folder, "source_traces")), ["prompt_id", "example_id"])


@REGISTRY.add("j7_met_calls", f"WITH {REPLAYS} SELECT prompt_id, example_id, name, sq AS source_q, tq AS target_q FROM pr JOIN met USING (a, b)")
def j7_met_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of two traces that meet by name and occurrence."""
    rows = A.prepared(A.replays(table(spark, folder, "source_traces")))
    return rows.select("prompt_id", "example_id", F.explode("met").alias("m")).select("prompt_id", "example_id", F.col("m.s.name").alias("name"), F.col("m.s.q").alias("source_q"), F.col("m.t.q").alias("target_q"))


# A common subsequence, cell by cell: pos runs over both sides, the row before and the row so far are lists.
LCS = """
lcs AS (
  SELECT id, x, y, 0 AS pos, list_transform(range(len(y) + 1), lambda v: CAST(0 AS BIGINT)) AS above, [CAST(0 AS BIGINT)] AS here FROM {pairs}
  UNION ALL SELECT id, x, y, pos + 1, CASE WHEN pos % len(y) = len(y) - 1 THEN list_append(here, c) ELSE above END, CASE WHEN pos % len(y) = len(y) - 1 THEN [CAST(0 AS BIGINT)] ELSE list_append(here, c) END
  FROM (SELECT *, CASE WHEN coalesce(x[pos // len(y) + 1] = y[pos % len(y) + 1], false) THEN above[pos % len(y) + 1] + 1 ELSE greatest(above[pos % len(y) + 2], here[pos % len(y) + 1]) END AS c FROM lcs WHERE pos < len(x) * len(y))
), lcs_length AS (SELECT id, len(x) AS n, len(y) AS m, above[len(y) + 1] AS lcs FROM lcs WHERE pos = len(x) * len(y))
"""


@REGISTRY.add("e20_agent_trace", f"""WITH RECURSIVE {REPLAYS}, named AS (
  SELECT (a, b) AS id, coalesce((SELECT list(name ORDER BY q) FROM tc WHERE row_id = a), []) AS x, coalesce((SELECT list(name ORDER BY q) FROM tc WHERE row_id = b), []) AS y FROM pr
), {LCS.format(pairs="named")}, fs AS (SELECT a, b, count(*) AS fields, count(*) FILTER (NOT same) AS drifts FROM fields GROUP BY ALL), mt AS (SELECT a, b, count(*) AS met FROM met GROUP BY ALL),
risk AS (SELECT a, b, count(*) AS dangerous FROM pr, (SELECT unnest([{names_sql(DANGEROUS)}]) AS tool) WHERE (SELECT count(*) FROM tc WHERE row_id = b AND name = tool) > (SELECT count(*) FROM tc WHERE row_id = a AND name = tool) GROUP BY ALL),
blind AS (SELECT a, b, count(*) AS unverified FROM pr JOIN tc t ON t.row_id = b WHERE t.name IN ({names_sql(DANGEROUS)}) AND NOT EXISTS (SELECT 1 FROM tc v WHERE v.row_id = b AND v.q <= t.q AND v.name IN ({names_sql(VERIFYING)})) GROUP BY ALL),
sc AS (
  SELECT prompt_id, example_id, CASE WHEN n = 0 AND m = 0 THEN 1 ELSE lcs / greatest(n, m) END AS o,
    CASE WHEN coalesce(met, 0) = 0 THEN CASE WHEN n = 0 AND m = 0 THEN 1 ELSE 0 END WHEN coalesce(fields, 0) = 0 THEN 1 ELSE 1 - drifts / fields END AS g,
    coalesce(drifts, 0) AS drifts, coalesce(dangerous, 0) AS dangerous, coalesce(unverified, 0) AS unverified
  FROM pr JOIN lcs_length l ON l.id = (pr.a, pr.b) LEFT JOIN fs USING (a, b) LEFT JOIN mt USING (a, b) LEFT JOIN risk USING (a, b) LEFT JOIN blind USING (a, b)
)
SELECT prompt_id, example_id, round(o, 10) AS order_score, round(g, 10) AS argument_score, drifts, dangerous, unverified,
  round((o + g) / (2 + CAST(dangerous > 0 AS INTEGER) + CAST(unverified > 0 AS INTEGER)), 10) AS target_score,
  concat_ws(',', CASE WHEN drifts > 0 THEN 'ARGUMENT_VALUE_DRIFT' END, CASE WHEN dangerous > 0 THEN 'DANGEROUS_ACTION_DRIFT' END, CASE WHEN unverified > 0 THEN 'MISSING_VERIFICATION_STEP' END,
    CASE WHEN o < 1 THEN 'TOOL_ORDER_DRIFT' END, CASE WHEN dangerous > 0 THEN 'UNNECESSARY_TOOL_CALL' END) AS categories FROM sc""")
def e20_agent_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of two traces of one prompt and example: order, arguments, risky and unverified calls."""
    scored = A.agent_trace_scores(A.replays(table(spark, folder, "source_traces")), DANGEROUS, VERIFYING)
    return scored.select("prompt_id", "example_id", *rounded("order_score", "argument_score"), *[F.col(c).cast("bigint").alias(c) for c in ("drifts", "dangerous", "unverified")], *rounded("target_score"), F.array_join("categories", ",").alias("categories"))


NAMED = """nm AS (
  SELECT m.row_id AS id, coalesce(a.requested, []) AS x, coalesce(b.executed, []) AS y FROM multi_round_tools m
  LEFT JOIN (SELECT row_id, list(n ORDER BY q, i) AS requested FROM (SELECT row_id, q, unnest(asked).name AS n, unnest(range(len(asked))) AS i FROM e WHERE type = 'model_call' AND asked IS NOT NULL) GROUP BY row_id) a USING (row_id)
  LEFT JOIN (SELECT row_id, list(name ORDER BY q) AS executed FROM e WHERE type = 'tool_call' GROUP BY row_id) b USING (row_id)
)"""


@REGISTRY.add("e21_order_score", f"""WITH RECURSIVE {EVENTS}, {NAMED}, {LCS.format(pairs="nm")}
SELECT id AS row_id, lcs, round(CASE WHEN greatest(n, m) = 0 THEN 1 ELSE lcs / greatest(n, m) END, 10) AS score FROM lcs_length""")
def e21_order_score(spark: SparkSession, folder: str) -> DataFrame:
    """Longest common subsequence of requested and executed names, over the longer."""
    from pairloom.plans.reference import sides

    a, b = F.col("requested"), F.col("executed")
    return sides(spark, folder).select("row_id", S.lcs_length(a, b).cast("bigint").alias("lcs"), F.round(S.order_score(a, b), 10).alias("score"))


SIDE_CALLS = """rq AS (SELECT row_id, list({'name': n, 'q': q, 'a': a} ORDER BY q, i) AS s FROM (
  SELECT row_id, q, unnest(asked).name AS n, unnest(asked).arguments AS a, unnest(range(len(asked))) AS i FROM e WHERE type = 'model_call' AND asked IS NOT NULL) GROUP BY row_id),
xq AS (SELECT row_id, list({'name': name, 'q': q, 'a': arguments} ORDER BY q) AS t FROM e WHERE type = 'tool_call' GROUP BY row_id)"""


@REGISTRY.add("j8_nearest_pairs", f"""WITH RECURSIVE {EVENTS}, {SIDE_CALLS}, w AS (
  SELECT row_id, s, t, 0 AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS STRUCT(d BIGINT, p BIGINT)) AS got FROM rq JOIN xq USING (row_id)
  UNION ALL SELECT row_id, s, t, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.p) END, best FROM (
    SELECT *, list_sort(list_transform(list_filter(range(len(t)), lambda p: t[p + 1].name = s[i + 1].name AND NOT list_contains(used, p)), lambda p: {{'d': CAST(abs(t[p + 1].q - s[i + 1].q) AS BIGINT), 'p': CAST(p AS BIGINT)}}))[1] AS best FROM w WHERE i < len(s)
  )
)
SELECT row_id, s[i].q AS requested_q, t[got.p + 1].q AS executed_q, CAST(got.p AS INTEGER) AS place FROM w WHERE got IS NOT NULL""")
def j8_nearest_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy nearest match of requested and executed calls of a capture."""
    c = V.capture_calls(spark, folder)
    side = lambda n: F.transform(F.col(n), lambda x: F.struct(x["name"].alias("name"), x["q"].alias("q")))
    return c.select("row_id", F.inline(S.nearest_pairs(side("requested"), side("executed")))).withColumnsRenamed({"s": "requested_q", "t": "executed_q", "i": "place"})


@REGISTRY.add("j17_positional_diff", f"""WITH {EVENTS}, {SIDE_CALLS},
p AS (SELECT row_id, i - 1 AS position, s[i] AS s, t[i] AS t FROM (SELECT row_id, s, t, unnest(range(1, greatest(coalesce(len(s), 0), coalesce(len(t), 0)) + 1)) AS i FROM rq FULL JOIN xq USING (row_id)))
SELECT row_id, CAST(position AS INTEGER) AS position, s.name AS source, t.name AS target, change FROM (
  SELECT *, CASE WHEN t IS NULL THEN 'missing' WHEN s IS NULL THEN 'extra' WHEN s.name IS DISTINCT FROM t.name THEN 'selection' WHEN s.a IS DISTINCT FROM t.a THEN 'arguments' END AS change FROM p) WHERE change IS NOT NULL""")
def j17_positional_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Position by position differences of requested and executed calls."""
    from pairloom.operators.reports import positional_diff

    return positional_diff(V.capture_calls(spark, folder), ["row_id"])


# ---------------------------------------------------------------- rounds

ROUNDS = EVENTS + """, rr AS (
  SELECT row_id, round, coalesce(list(n ORDER BY i) FILTER (n IS NOT NULL), []) AS s FROM (
    SELECT row_id, round, CASE WHEN len(asked) > 0 THEN unnest(asked).name END AS n, CASE WHEN len(asked) > 0 THEN unnest(range(len(asked))) END AS i FROM er WHERE type = 'model_call'
    UNION ALL SELECT row_id, round, NULL, NULL FROM er WHERE type IN ('model_call', 'tool_call')) GROUP BY ALL
), xx AS (SELECT row_id, round, list(name ORDER BY q) AS t FROM er WHERE type = 'tool_call' GROUP BY ALL),
rd AS (SELECT row_id, round, s, coalesce(t, []) AS t FROM rr LEFT JOIN xx USING (row_id, round))
"""


@REGISTRY.add("w8_rounds", f"""WITH {ROUNDS}
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY round) - 1 AS round, array_to_string(s, ',') AS requested, array_to_string(t, ',') AS executed FROM rd""")
def w8_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The rounds of a capture with what was requested and executed in each, numbered from 0; empty ones included."""
    rows = A.capture_rounds(table(spark, folder, "multi_round_tools"), "row_id").select("row_id", F.posexplode("rounds").alias("round", "r"))
    return rows.select("row_id", F.col("round").cast("bigint").alias("round"), F.array_join("r.requested", ",").alias("requested"), F.array_join("r.executed", ",").alias("executed"))


@REGISTRY.add("e10_round_divergence", f"""WITH {ROUNDS}, sc AS (
  SELECT row_id, CASE WHEN s = t THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN len(s) = 0 AND len(t) = 0 THEN 1 ELSE len(list_intersect(list_distinct(s), list_distinct(t))) / len(list_distinct(list_concat(s, t))) END AS jac,
    CASE WHEN coalesce(s[1] = t[1], false) THEN 1.0 ELSE 0.0 END AS first FROM rd WHERE len(s) > 0 OR len(t) > 0)
SELECT m.row_id, round(coalesce(avg(exact), 1), 10) AS exact, round(coalesce(avg(jac), 1), 10) AS overlap, round(coalesce(avg(first), 1), 10) AS first FROM multi_round_tools m LEFT JOIN sc USING (row_id) GROUP BY ALL""")
def e10_round_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Mean agreement of requested and executed tools over the rounds of a capture, exact, as sets and by the first."""
    rows = A.capture_rounds(table(spark, folder, "multi_round_tools"), "row_id")
    s, t = F.transform("rounds", lambda r: r["requested"]), F.transform("rounds", lambda r: r["executed"])
    return rows.select("row_id", *[F.round(A.round_divergence(s, t, m), 10).alias(n) for m, n in (("exact", "exact"), ("set", "overlap"), ("first", "first"))])


@REGISTRY.add("e10_round_conformance", f"""WITH {ROUNDS}, nr AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round) AS i, count(*) OVER (PARTITION BY row_id) AS n FROM rd),
w AS (SELECT row_id, i, CASE WHEN i < n THEN s ELSE [] END AS w, t, s, CAST(n > 1 AS BOOLEAN) AS several FROM nr),
u AS (SELECT row_id, i, name, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM (SELECT row_id, i, unnest(w) AS name, 0 AS side FROM w UNION ALL SELECT row_id, i, unnest(t), 1 FROM w) GROUP BY ALL),
h AS (SELECT row_id, i, sum(least(a, b)) AS hit FROM u GROUP BY ALL),
sc AS (SELECT row_id, CASE WHEN len(w) > 0 THEN coalesce(hit, 0) / len(w) WHEN len(t) = 0 THEN 1 ELSE 0 END AS c FROM w LEFT JOIN h USING (row_id, i) WHERE several AND (len(w) > 0 OR len(t) > 0 OR len(s) > 0))
SELECT row_id, round(coalesce(avg(c), 1), 10) AS score FROM (SELECT DISTINCT row_id FROM w WHERE several) LEFT JOIN sc USING (row_id) GROUP BY ALL""")
def e10_round_conformance(spark: SparkSession, folder: str) -> DataFrame:
    """Executed tools against expected rounds: all requested ones but the last round, which is to call nothing; in any order."""
    rows = A.capture_rounds(table(spark, folder, "multi_round_tools"), "row_id")
    s, t = F.transform("rounds", lambda r: r["requested"]), F.transform("rounds", lambda r: r["executed"])
    expected = F.when(F.size(s) > 1, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(F.array().cast("array<array<string>>"))
    return rows.where(F.size("rounds") > 1).select("row_id", F.round(A.round_conformance(expected, t, F.size(t), s, "multiset"), 10).alias("score"))


@REGISTRY.add("w9_replayable_rounds", f"""WITH {EVENTS}, c AS (SELECT *, row_number() OVER (PARTITION BY row_id, round, call_id ORDER BY q) AS k FROM er WHERE type = 'tool_call'),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id, round, call_id ORDER BY q) AS k FROM er WHERE type = 'tool_result'),
f AS (SELECT c.row_id, c.round, c.q AS call_q, r.q AS result_q FROM c JOIN r ON c.row_id = r.row_id AND c.round = r.round AND c.call_id = r.call_id WHERE c.k = 1 AND r.k = 1),
c2 AS (SELECT *, row_number() OVER (PARTITION BY row_id, round, name ORDER BY q) AS j FROM c WHERE (row_id, q) NOT IN (SELECT (row_id, call_q) FROM f)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY row_id, round, name ORDER BY q) AS j FROM r WHERE (row_id, q) NOT IN (SELECT (row_id, result_q) FROM f)),
a AS (SELECT * FROM f UNION ALL SELECT c2.row_id, c2.round, c2.q, r2.q FROM c2 LEFT JOIN r2 ON c2.row_id = r2.row_id AND c2.round = r2.round AND c2.name = r2.name AND c2.j = r2.j),
b AS (SELECT row_id, round, count(*) = count(result_q) AS whole FROM a GROUP BY ALL)
SELECT row_id, count(*) FILTER (round < coalesce(bad, round + 1)) AS replayable FROM b JOIN (SELECT row_id, min(round) FILTER (NOT whole) AS bad FROM b GROUP BY ALL) USING (row_id) GROUP BY ALL""")
def w9_replayable_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Leading rounds of a capture whose calls all have their results."""
    return A.covered_rounds(C.pair_results(C.events(table(spark, folder, "multi_round_tools"), "type", "name", "call_id")), "row_id")


# ---------------------------------------------------------------- arguments


@REGISTRY.add("e12_argument_agreement")
def e12_argument_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Arguments of the target's calls against the source's nearest ones of that name; SQL has no text similarity.

    Without any pair of calls the target scores 1 if it called nothing at all.
    """
    keys = ["prompt_id", "example_id"]
    pairs = A.replays(table(spark, folder, "source_traces"))
    bare = lambda c: F.transform(F.col(c), lambda x: F.struct(x["name"].alias("name"), x["q"].alias("q")))
    text = lambda c, q: F.try_element_at(F.filter(F.col(c), lambda x: x["q"] == q), F.lit(1))["arguments"]
    met = pairs.select(*keys, "source", "target", F.inline(S.nearest_pairs(bare("source"), bare("target")))).select(*keys, text("source", F.col("s")).alias("a"), text("target", F.col("t")).alias("b"))
    scored = met.withColumn("score", argument_score(F.col("a"), F.col("b"), strict=False)).groupBy(*keys).agg(F.count("*").alias("calls"), F.avg("score").alias("score"))
    alone = F.when(F.size("target") == 0, 1.0).otherwise(0.0)
    return pairs.join(scored, keys, "left").select(*keys, F.coalesce("calls", F.lit(0)).alias("calls"), F.round(F.coalesce("score", alone), 10).alias("score"))


@REGISTRY.add("e13_argument_scores")
def e13_argument_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Expected calls with arguments against what two traces of the example called, k-th by k-th name; SQL has no text similarity."""
    ex = V.examples(spark, folder, "expected_tools").select(F.col("id").alias("example_id"), F.posexplode("expected_tools").alias("at", "t")).select("example_id", "at", "t.tool_name", "t.arguments", "t.match_strategy")
    ex = ex.where(F.size(F.map_keys(A.argument_fields(F.col("arguments")))) > 0)
    ex = ex.withColumn("k", F.row_number().over(Window.partitionBy("example_id", "tool_name").orderBy("at")))
    pairs = A.replays(table(spark, folder, "source_traces")).withColumns({c: A.numbered(F.col(c)) for c in ("source", "target")})
    made = lambda c: F.try_element_at(F.filter(F.col(c), lambda x: (x["name"] == F.col("tool_name")) & (x["k"] == F.col("k"))), F.lit(1))
    met = pairs.join(ex, "example_id").withColumns({"s": made("source"), "t": made("target")})
    met = met.select("prompt_id", "example_id", "arguments", "match_strategy", *[x for r, c in (("source", "s"), ("target", "t")) for x in (F.col(f"{c}.arguments").alias(f"{r}_made"), F.col(c).isNotNull().alias(f"{r}_met"))])
    return expectation_scores(met).groupBy("prompt_id", "example_id").agg(F.count("*").alias("expected"), F.round(F.avg("source_score"), 10).alias("source_score"), F.round(F.avg("target_score"), 10).alias("target_score"))


# ---------------------------------------------------------------- dispatch and report joins


def axes() -> list[D.Axis]:
    s, t = F.col("source.text"), F.col("target.text")
    both = lambda f: (f(s), f(t))
    return [
        D.Axis("length", "structural.length", *both(lambda c: S.length_score(c, 200, 600))),
        D.Axis("digits", "structural.regex", *both(lambda c: S.regex_score(c, "[0-9]{3,}")), blocking=False),
        D.Axis("spoken", "structural.length", *both(lambda c: F.when(F.coalesce(c, F.lit("")) != "", S.length_score(c, 1, None)))),
    ]


SCORED = f"""{CALLS}, pc AS (
  SELECT s.run_id, s.prompt_id, s.example_id, s.sample_index, s.text AS a, t.text AS b, s.error AS ea, t.error AS eb, coalesce(s.finish_reason = 'length', false) OR coalesce(t.finish_reason = 'length', false) AS cut
  FROM calls s JOIN calls t ON s.run_id IS NOT DISTINCT FROM t.run_id AND s.prompt_id IS NOT DISTINCT FROM t.prompt_id AND s.example_id IS NOT DISTINCT FROM t.example_id AND s.sample_index IS NOT DISTINCT FROM t.sample_index
  WHERE s.role = 'source' AND t.role = 'target'
), er2 AS (SELECT *, CASE WHEN ea IS NOT NULL OR eb IS NOT NULL THEN 'upstream call failed: ' || concat_ws('; ', ea, eb) WHEN cut THEN 'output truncated (token cap)' END AS error FROM pc),
ln AS (SELECT *, length(coalesce(a, '')) AS na, length(coalesce(b, '')) AS nb FROM er2), rc AS (
  SELECT run_id, prompt_id, example_id, sample_index, 'length' AS evaluator_name, 'structural.length' AS kind, true AS blocking, error,
    CASE WHEN na < 200 THEN greatest(0, 1 - (200 - na) / 200e0) WHEN na > 600 THEN greatest(0, 1 - (na - 600) / 600e0) ELSE 1 END AS s, CASE WHEN nb < 200 THEN greatest(0, 1 - (200 - nb) / 200e0) WHEN nb > 600 THEN greatest(0, 1 - (nb - 600) / 600e0) ELSE 1 END AS t FROM ln
  UNION ALL SELECT run_id, prompt_id, example_id, sample_index, 'digits', 'structural.regex', false, error, CAST(regexp_matches(coalesce(a, ''), '[0-9]{{3,}}') AS INTEGER), CAST(regexp_matches(coalesce(b, ''), '[0-9]{{3,}}') AS INTEGER) FROM ln
  UNION ALL SELECT run_id, prompt_id, example_id, sample_index, 'spoken', 'structural.length', true, error, CASE WHEN na > 0 THEN 1 END, CASE WHEN nb > 0 THEN 1 END FROM ln
), cells AS (
  SELECT run_id, prompt_id, example_id, sample_index, evaluator_name, kind, blocking, error, CASE WHEN error IS NULL THEN s ELSE 0.5 END AS source_score, CASE WHEN error IS NULL THEN t ELSE 0.5 END AS target_score,
    error IS NOT NULL OR (s IS NOT NULL AND t IS NOT NULL) AS recorded FROM rc
)"""


def scored_cells(spark: SparkSession, folder: str) -> DataFrame:
    pairs = P.pair_roles(V.calls(spark, folder, "text", "error", "finish_reason"))
    return D.records(pairs, axes(), P.CALL_KEY)


@REGISTRY.add("r2_dispatch", f"""WITH {SCORED}
SELECT run_id, prompt_id, example_id, sample_index, evaluator_name, kind, blocking, round(source_score, 10) AS source_score, round(target_score, 10) AS target_score, round(target_score - source_score, 10) AS delta, error FROM cells WHERE recorded""")
def r2_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Score records of all pairs and evaluators: failed, cut off or scored."""
    rows = scored_cells(spark, folder).where("recorded")
    return rows.select(*P.CALL_KEY, "evaluator_name", "kind", "blocking", *rounded("source_score", "target_score", "delta"), "error")


@REGISTRY.add("r1_axis_cells", f"""WITH {SCORED}
SELECT evaluator_name, kind, count(*) AS attempted, count(*) FILTER (recorded) AS recorded, count(*) FILTER (error IS NOT NULL) AS failed FROM cells GROUP BY ALL""")
def r1_axis_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of every evaluator and axis: attempted, recorded and failed."""
    return scored_cells(spark, folder).groupBy("evaluator_name", "kind").agg(F.count("*").alias("attempted"), F.count_if("recorded").alias("recorded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@REGISTRY.add("blocking_split", f"""WITH {SCORED}
SELECT blocking, count(*) AS records, count(*) FILTER (error IS NULL AND target_score < source_score) AS regressed FROM cells WHERE recorded GROUP BY ALL""")
def blocking_split(spark: SparkSession, folder: str) -> DataFrame:
    """Records that gate and records that only advise."""
    rows = scored_cells(spark, folder).where("recorded")
    return rows.groupBy("blocking").agg(F.count("*").alias("records"), F.count_if(F.col("error").isNull() & (F.col("delta") < 0)).alias("regressed"))


@REGISTRY.add("j12_report_rows", f"""WITH {SCORED}, {EXAMPLES}, w AS (SELECT run_id, prompt_id, example_id, sample_index, min(target_score - source_score) AS worst FROM cells WHERE recorded AND error IS NULL GROUP BY ALL),
d AS (SELECT s.run_id, s.prompt_id, s.example_id, s.sample_index, coalesce(t.cost_usd, 0) - coalesce(s.cost_usd, 0) AS cost, coalesce(s.cached, false) OR coalesce(t.cached, false) OR coalesce(s.cached_rounds > 0, false) OR coalesce(t.cached_rounds > 0, false) AS replayed, t.latency_ms - s.latency_ms AS latency
  FROM calls s JOIN calls t ON s.run_id IS NOT DISTINCT FROM t.run_id AND s.prompt_id IS NOT DISTINCT FROM t.prompt_id AND s.example_id IS NOT DISTINCT FROM t.example_id AND s.sample_index IS NOT DISTINCT FROM t.sample_index WHERE s.role = 'source' AND t.role = 'target')
SELECT d.run_id, d.prompt_id, d.example_id, d.sample_index, NOT replayed AS latency_comparable, CASE WHEN replayed THEN 0 ELSE latency END AS latency_change, round(worst, 10) AS worst, e.id IS NOT NULL AS known
FROM d LEFT JOIN w ON w.run_id IS NOT DISTINCT FROM d.run_id AND w.prompt_id IS NOT DISTINCT FROM d.prompt_id AND w.example_id IS NOT DISTINCT FROM d.example_id AND w.sample_index IS NOT DISTINCT FROM d.sample_index LEFT JOIN examples e ON e.id = d.example_id""")
def j12_report_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Report rows of all whole pairs: change of latency where both were live, worst score, whether the suite knows the example."""
    pairs = P.pair_roles(V.calls(spark, folder, "text", "error", "finish_reason", "cached", "cached_rounds", "latency_ms"))
    worst = F.array_min(F.array(*[F.when(a.source.isNotNull() & a.target.isNotNull(), a.target.cast("double") - a.source.cast("double")) for a in axes()]))
    cut = (F.coalesce("source.finish_reason", F.lit("")) == "length") | (F.coalesce("target.finish_reason", F.lit("")) == "length")
    bad = F.col("source.error").isNotNull() | F.col("target.error").isNotNull() | cut
    again = lambda r: F.coalesce(F.col(f"{r}.cached"), F.lit(False)) | F.coalesce(F.col(f"{r}.cached_rounds") > 0, F.lit(False))
    replayed = again("source") | again("target")
    known = V.examples(spark, folder, "toolset_ref").select(F.col("id").alias("example_id"), F.lit(True).alias("known"))
    rows = pairs.select(
        *P.CALL_KEY, (~replayed).alias("latency_comparable"), F.when(replayed, 0).otherwise(F.col("target.latency_ms") - F.col("source.latency_ms")).alias("latency_change"), F.round(F.when(~bad, worst), 10).alias("worst"),
    )
    return rows.join(known, "example_id", "left").na.fill(False, ["known"])


@REGISTRY.add("j14_shared_misses", f"""WITH {SLICED}, c AS (
  SELECT slice_name, prompt_id, evaluator_name, kind, CASE WHEN count(*) OVER (PARTITION BY slice_name, prompt_id, evaluator_name) > 1 THEN kind END AS axis FROM (SELECT DISTINCT slice_name, prompt_id, evaluator_name, kind FROM sliced WHERE error IS NULL)
), m AS (SELECT *, coalesce(delta = 0 AND source_score < 1 AND target_score < 1, false) AS miss FROM scores WHERE error IS NULL)
SELECT c.*, CASE WHEN count(m.prompt_id) > 0 AND count(m.prompt_id) = count(*) FILTER (m.miss) THEN count(m.prompt_id) END AS shared_miss
FROM c LEFT JOIN m ON m.prompt_id = c.prompt_id AND m.evaluator_name = c.evaluator_name AND (c.axis IS NULL OR m.kind = c.axis) GROUP BY ALL""")
def j14_shared_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Comparisons behind which both sides missed alike, all the time."""
    scores = L.reduce_samples(V.samples(spark, folder))
    miss = F.coalesce((F.col("delta") == 0) & (F.col("source_score") < 1) & (F.col("target_score") < 1), F.lit(False))
    named = T.multi_axis(comparisons(spark, folder)).select(*T.GROUP, "axis")
    return D.shared_misses(named, scores.withColumn("miss", miss)).select(*T.GROUP, "axis", "shared_miss")


@REGISTRY.add("j16_slice_records", f"WITH {SLICED} SELECT evaluator_name, count(*) AS records FROM scores WHERE evaluator_name IN (SELECT evaluator_name FROM sliced WHERE slice_name = 'edge' AND error IS NULL) GROUP BY ALL")
def j16_slice_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the evaluators that have a comparison in the slice of edge cases."""
    rows = D.records_of_slice(L.reduce_samples(V.samples(spark, folder)), comparisons(spark, folder), "edge")
    return rows.groupBy("evaluator_name").agg(F.count("*").alias("records"))
