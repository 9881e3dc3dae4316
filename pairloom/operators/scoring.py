"""Evaluators as column expressions: text, tool-selection, structure and trace scores.

Each takes the two sides (or one) of a pair and returns scores in [0, 1]. Null means "nothing measured" and must stay a
missing row, never a number. Sequences are arrays inside one row, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_score(text: Column, low: int | None, high: int | None) -> Column:
    """1 within the bounds in characters, falling linearly outside; a null text has length 0."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(low is not None) & (n < (low or 0)), 1 - ((low or 0) - n) / F.lit(max(low or 0, 1)))
    out = out.when(F.lit(high is not None) & (n > (high or 0)), 1 - (n - (high or 0)) / F.lit(max(high or 0, 1)))
    return F.greatest(F.lit(0.0), out.otherwise(1.0).cast("double"))


def regex_score(text: Column, pattern: str) -> Column:
    """1 if the pattern is found anywhere (Java dialect), else 0; a null text scores 0."""
    return F.when(F.coalesce(text, F.lit("")).rlike(pattern), 1.0).otherwise(0.0)


def json_score(text: Column) -> Column:
    """1 if the text parses as JSON, else 0."""
    return F.when(F.try_parse_json(text).isNotNull(), 1.0).otherwise(0.0)


def format_failure(source: Column, target: Column) -> Column:
    """Whether the target side is worse formed."""
    return target < source


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; vectors of unequal length or without direction score 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * x).cast("double")))
    whole = size(a) * size(b)
    return F.when((F.size(a) == F.size(b)) & (whole > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / whole))).otherwise(0.0)


def no_tools_score(names: Column) -> Column:
    """1 if nothing was called."""
    return F.when(F.size(names) == 0, 1.0).otherwise(0.0)


def sequence_match(expected: Column, actual: Column) -> Column:
    """Share of the expected names met in order; a missing name blocks those after it. Nothing expected scores 1."""
    met = F.aggregate(actual, F.lit(0), lambda i, x: F.when((i < F.size(expected)) & F.coalesce(F.get(expected, i) == x, F.lit(False)), i + 1).otherwise(i))
    return F.when(F.size(expected) == 0, 1.0).otherwise(met / F.size(expected))


def multiset_recall(expected: Column, actual: Column) -> Column:
    """Share of the expected names found in any order, with multiplicity. Nothing expected scores 1."""
    count = lambda arr, v: F.size(F.filter(arr, lambda y: y == v))
    hit = F.aggregate(F.array_distinct(expected), F.lit(0), lambda s, v: s + F.least(count(expected, v), count(actual, v)))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hit / F.size(expected))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def first_match(source: Column, target: Column) -> Column:
    """1 if both begin with the same name; a source without calls scores 0."""
    return F.when(F.coalesce(F.get(source, F.lit(0)) == F.get(target, F.lit(0)), F.lit(False)), 1.0).otherwise(0.0)


def exact_match(source: Column, target: Column) -> Column:
    """1 if both sequences are equal."""
    return F.when(source == target, 1.0).otherwise(0.0)


def selection_tags(source_score: Column, target_score: Column, conformance: bool) -> Column:
    """Failure labels of a tool-selection record."""
    drift = F.when(target_score < source_score, "TOOL_SELECTION_DRIFT")
    miss = F.when(F.lit(conformance) & (source_score < 1) & (target_score < 1), "TOOL_GROUND_TRUTH_MISS")
    return F.array_compact(F.array(drift, miss))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of its table."""

    def next_row(row: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            hit = F.get(row, j - 1) + 1
            best = F.greatest(F.get(row, j), F.element_at(acc, -1))
            return F.concat(acc, F.array(F.when(F.get(b, j - 1) == x, hit).otherwise(best)))

        steps = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), next_row), -1)


def order_score(a: Column, b: Column) -> Column:
    """Common subsequence over the longer sequence; two empty ones score 1."""
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, 1.0).otherwise(lcs_length(a, b) / longer)


def count_decay(source: Column, target: Column, tolerance: int) -> Column:
    """1 within the tolerance, then falling with the excess over the source's count."""
    excess = F.abs(target - source) - tolerance
    return F.when(excess <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - excess / F.greatest(source, F.lit(1))))


def numeric_score(a: Column, b: Column, tolerance: float) -> Column:
    """1 less the relative difference over the tolerance; null if a side is no number."""
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / scale / tolerance))


def nearest_pairs(source: Column, target: Column) -> Column:
    """Greedy match of calls (structs of name and q): each source call in order takes the unused target call of its
    name with the least distance in q, ties to the earlier. Returns an array of structs s, t, i (target place)."""
    kind = "array<struct<s:int,t:int,i:int>>"

    def step(acc: Column, x: Column) -> Column:
        place = lambda y, i: F.when((y["name"] == x["name"]) & ~F.exists(acc, lambda u: u["i"] == i), F.struct(F.abs(y["q"] - x["q"]).alias("d"), i.alias("i"), y["q"].alias("q")))
        best = F.array_min(F.array_compact(F.transform(target, place)))
        return F.when(best.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(x["q"].alias("s"), best["q"].alias("t"), best["i"].alias("i")).cast("struct<s:int,t:int,i:int>"))))

    return F.aggregate(source, F.array().cast(kind), step)


def occurrence_pairs(left: DataFrame, right: DataFrame, key: list[str], order: str) -> DataFrame:
    """Match the k-th call of a name on one side with the k-th on the other (left outer): key, k, left and right order.

    Equals "first unused call of the same name", and is one equi-join on (key, k).
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order)
    number = lambda df, name: df.select(*key, F.row_number().over(w).alias("k"), F.col(order).alias(name))
    return number(left, "left_at").join(number(right, "right_at"), [*key, "k"], "left")


def count_differences(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Per key how many rows only the left or only the right side has: key, missing, extra."""
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    both = count(left, "l").join(count(right, "r"), key, "full_outer").na.fill(0, ["l", "r"])
    return both.select(*key, F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("missing"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("extra")).where("missing + extra > 0")
