"""Paired comparison of score deltas: moments, tests, false-discovery correction and severity.

Moments, effect sizes and intervals are SQL. Only the p-value of the rank test needs the deltas themselves; it gets
them per comparison, after the gates have dropped all groups that need none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.ranking import in_ranges

GROUP = ["slice_name", "prompt_id", "evaluator_name", "kind"]
# Gates of the tests, and the normal quantile of a 95 % interval.
FEWEST, FEW, FLAT, Z95 = 5, 20, 1e-9, 1.96
RESAMPLES = 2000
#: More deltas than this count as normal, as in the surveyed engine: the paired t test, which needs moments only.
NORMAL_BEYOND = 5000


def moments(rows: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """n, mean, sample deviation, Cohen's d of paired deltas, its analytic interval and the t statistic."""
    flat = F.coalesce(F.col("sd") < FLAT, F.lit(True))
    half = F.lit(Z95) * F.sqrt(1 / F.col("n") + F.col("d") * F.col("d") / (2 * F.col("n")))
    return (
        rows.where("error is null")
        .groupBy(*group)
        .agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd"))
        .withColumn("d", F.when(flat, 0.0).otherwise(F.col("mean_delta") / F.col("sd")))
        .withColumns({"d_low": F.col("d") - half, "d_high": F.col("d") + half})
        .withColumn("t", F.when(~flat, F.col("mean_delta") / (F.col("sd") / F.sqrt("n"))))
        .withColumn("gate", F.when(F.col("n") < FEWEST, "insufficient").when(flat, "skipped").otherwise("tested"))
    )


def with_silent(compared: DataFrame, rows: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Comparisons with n and ``notes``, and a row with n = 0 and a note for every group in which nothing was measured."""
    silent = rows.groupBy(*group).agg(F.count_if(F.col("error").isNull()).alias("n"), F.count("*").alias("all")).where("n = 0")
    note = F.concat(F.lit("nothing measured: "), F.col("all").cast("string"), F.lit(" failed"))
    heard = compared.select(*group, "n", F.array().cast("array<string>").alias("notes"))
    return heard.unionByName(silent.select(*group, "n", F.array(note).alias("notes")))


def benjamini_hochberg(tests: DataFrame, p: str, order: list[str]) -> DataFrame:
    """Add ``q``: p times the number of tests over its rank, made monotone from the right and at most 1.

    Distinct p-values with their counts are sorted in ranges; the windows over everything see one row a range.
    """
    steps = in_ranges(tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n")), [F.col(p)], "p-values")
    up = Window.partitionBy("_range").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    ranges = steps.groupBy("_range").agg(F.sum("_n").alias("_own"))
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.select("_range", F.coalesce(F.sum("_own").over(over), F.lit(0)).alias("_before"), F.sum("_own").over(Window.partitionBy()).alias("_all"))
    raw = steps.join(totals, "_range").withColumn("_raw", F.col(p) * F.col("_all") / (F.col("_before") + F.sum("_n").over(up)))
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    least = raw.groupBy("_range").agg(F.min("_raw").alias("_least")).select("_range", F.min("_least").over(later).alias("_later"))
    down = Window.partitionBy("_range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = raw.join(least, "_range").withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(down), F.col("_later")))
    return tests.join(q.select(p, "q"), p, "left").select(*tests.columns, "q")


def severity(n: Column, q: Column, mean: Column, d: Column) -> Column:
    """Severity of a comparison; an unchanged mean with a small q counts as a regression of size d."""
    size = F.abs(d)
    return (
        F.when(n < FEWEST, "insufficient")
        .when(q.isNull() | (q >= 0.05), "none")
        .when(mean > 0, "improved")
        .when((q < 0.01) & (size > 0.8), "critical")
        .when(size > 0.5, "high")
        .when(size > 0.2, "medium")
        .otherwise("low")
    )


def severity_rank(name: Column) -> Column:
    """0 for critical up to 6 for insufficient."""
    out = F.lit(7)
    for i, s in reversed(list(enumerate(("critical", "high", "medium", "low", "improved", "none", "insufficient")))):
        out = F.when(name == s, i).otherwise(out)
    return out


def multi_axis(comparisons: DataFrame) -> DataFrame:
    """Add ``axis``: the kind, where a prompt and evaluator have several kinds within a slice."""
    kinds = F.size(F.collect_set("kind").over(Window.partitionBy("slice_name", "prompt_id", "evaluator_name")))
    return comparisons.withColumn("axis", F.when(kinds > 1, F.col("kind")))


def _betacf(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300 + int(5 * math.sqrt(max(a, b)))):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def wilcoxon(x: np.ndarray) -> tuple[float, float]:
    """Signed-rank statistic min(W+, W-) and its two-sided p-value; zeros are dropped.

    Exact for up to 50 values without ties, else the normal approximation with tie correction.
    """
    x = x[x != 0]
    n = len(x)
    if not n:
        return 0.0, 1.0
    ranks = pd.Series(np.abs(x)).rank().to_numpy()
    plus = float(ranks[x > 0].sum())
    w = min(plus, n * (n + 1) / 2 - plus)
    _, ties = np.unique(np.abs(x), return_counts=True)
    if n <= 50 and (ties == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return w, min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var) if var > 0 else 0.0
    return w, min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def shapiro(x: np.ndarray) -> float:
    """p-value of the Shapiro-Wilk test by Royston's published approximation (AS R94); 3 to 5000 values."""
    x = np.sort(x)
    n = len(x)
    if n < 3 or x[-1] - x[0] < 1e-19:
        return 1.0
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = (m @ m), 1 / math.sqrt(n)
    c = m / math.sqrt(ss)
    a = np.empty(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        last = c[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
        if n > 5:
            second = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return 1e-99
        y = -math.log(gamma - y)
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = math.log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))


def paired_test(deltas: np.ndarray, seed: int) -> tuple[str, float, float, float, float]:
    """(test, statistic, p, interval of d): paired t if the deltas look normal, else the signed-rank test with a
    bootstrap interval whose generator is seeded by the comparison."""
    n, mean, sd = len(deltas), float(deltas.mean()), float(deltas.std(ddof=1))
    d = mean / sd
    if n > NORMAL_BEYOND or shapiro(deltas) > 0.05:
        half = Z95 * math.sqrt(1 / n + d * d / (2 * n))
        t = mean / (sd / math.sqrt(n))
        return "paired_t", t, t_two_sided(t, n - 1), d - half, d + half
    w, p = wilcoxon(deltas)
    rng = np.random.default_rng(seed)
    draws, block = np.empty(RESAMPLES), max(1, 1_000_000 // n)
    for i in range(0, RESAMPLES, block):
        x = deltas[rng.integers(0, n, (min(block, RESAMPLES - i), n))]
        spread = x.std(axis=1, ddof=1)
        flat = spread < FLAT
        draws[i : i + block] = np.where(flat, 0.0, x.mean(axis=1) / np.where(flat, 1.0, spread))
    low, high = np.percentile(draws, [2.5, 97.5])
    return "wilcoxon", w, p, float(low), float(high)


def paired_tests(rows: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """The paired test of every comparison that passes the gates: group, n, test, statistic, p, d_low, d_high.

    Groups up to NORMAL_BEYOND deltas are gathered and tested. Larger ones get the paired t test and its analytic
    interval, exact from the moments, so none of them is gathered.
    """
    import zlib

    passed = moments(rows, group).where("gate = 'tested'").select(*group, "n", "t", "d_low", "d_high")
    ok = rows.where("error is null").select(*group, "delta")
    # The groups are small but costly to test, so they are spread by number, not coalesced by size.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = ok.join(passed.where(F.col("n") <= NORMAL_BEYOND).select(*group), group).repartition(tasks, *group)
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf.iloc[0][group].tolist()
        x = np.sort(pdf["delta"].to_numpy(float))
        name, statistic, p, low, high = paired_test(x, zlib.crc32(repr(key).encode()))
        return pd.DataFrame([[*key, len(x), name, statistic, p, low, high]], columns=[*group, "n", "test", "statistic", "p", "d_low", "d_high"])

    tested = small.groupBy(*group).applyInPandas(test, f"{key_types}, n bigint, test string, statistic double, p double, d_low double, d_high double")

    @F.pandas_udf("double")
    def tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, k - 1) for x, k in zip(t, n)], dtype=float)

    large = passed.where(F.col("n") > NORMAL_BEYOND).withColumn("p", tail("t", "n"))
    return tested.unionByName(large.select(*group, "n", F.lit("paired_t").alias("test"), F.col("t").alias("statistic"), "p", "d_low", "d_high"))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval of a rate at 95 %; (0, 1) without observations."""
    z = 1.959963984540054
    p, size = hits / n, n.cast("double")
    middle = (p + z * z / (2 * size)) / (1 + z * z / size)
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / (1 + z * z / size)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(1.0)
