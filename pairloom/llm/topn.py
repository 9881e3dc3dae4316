"""Top N rows within every group by simultaneous bisection of a cutoff a group.

A row's rank code is a sequence of order-preserving integers: the score, then pieces of the identifier, then a final
integer. Per level one cutoff a group is refined: every pass counts the rows between evenly spaced midpoints (counts
are pre-aggregated before the shuffle, so a huge group costs no more than a small one), keeps the slot in which the
N-th row lies and tightens it to the codes really present. A level ends when the group holds exactly N rows up to its
cutoff, or all rows left share one code; only those ties go to the next level. No group is ever gathered or sorted.

Defined results: rows with a null group column, a null or NaN score are out; -0.0 equals 0.0; infinite scores are
ordinary; a null identifier follows all others; a group with fewer than N rows is kept whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.scratch import forget, spool

#: Slots a pass: eight bisection steps at once.
SLOTS = 256
#: Bytes of an identifier in one code.
PIECE = 6


def ordered_code(score: pd.Series) -> pd.Series:
    """A double's bits as an integer of the same order (the input has no nulls and no NaN)."""
    bits = (score.to_numpy("float64") + 0.0).view("int64")
    return pd.Series(bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF))


def identifier_code(identifier: Column, piece: int) -> Column:
    """Code of a piece of an identifier's bytes; a text that ends sorts before one that goes on, null last of all."""
    part = F.substring(identifier.cast("binary"), 1 + piece * PIECE, PIECE)
    value = F.conv(F.rpad(F.hex(part), 2 * PIECE, "0"), 16, 10).cast("bigint") * 8 + F.octet_length(part)
    return F.when(identifier.isNull(), F.lit(2**62)).otherwise(value)


def _slot(code: Column, low: Column, high: Column) -> Column:
    """Slot of a code within [low, high]; monotone also where the distance overflows a bigint."""
    near = (code - low).cast("double") / (high - low).cast("double")
    far = (code.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    part = F.when(F.try_subtract(high, low).isNotNull(), near).otherwise(far)
    return F.least(F.lit(SLOTS - 1), F.floor(part * SLOTS)).cast("int")


def cut_level(rows: DataFrame, groups: list[str], need: DataFrame) -> DataFrame:
    """One level of the search. ``rows`` has the groups and ``code``; ``need`` the groups and ``need``.

    Returns cuts: groups, ``low``, ``high``, ``whole`` (all rows up to high belong to the result)
    and ``rest`` (how many of the ties at low = high still do). Runs one job a pass; rows outside the slots are dropped
    from later passes, so the work shrinks by about the number of slots each time.
    """
    state = spool(
        rows.groupBy(*groups)
        .agg(F.min("code").alias("low"), F.max("code").alias("high"), F.count("*").alias("n"))
        .join(need, groups)
        .withColumn("below", F.lit(0).cast("bigint")),
        "topn-state",
    )
    done = []
    active, used = rows, None
    closed = (F.col("n") <= F.col("need") - F.col("below")) | (F.col("low") == F.col("high"))
    while True:
        done.append(state.where(closed))
        state = state.where(~closed)
        if state.isEmpty():
            break
        slotted = active.join(state, groups).where("code between low and high").withColumn("slot", _slot(F.col("code"), F.col("low"), F.col("high")))
        counts = slotted.groupBy(*groups, "slot").agg(F.min("code").alias("s_low"), F.max("code").alias("s_high"), F.count("*").alias("s_n"))
        upto = Window.partitionBy(*groups).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        reached = counts.withColumn("s_before", F.coalesce(F.sum("s_n").over(upto), F.lit(0)))
        # The slot that holds the N-th row: fewer than N rows before it, N or more with it. When the rows before and
        # in it are exactly N, the test for a closed group ends the search.
        hit = reached.join(state.select(*groups, "need", "below"), groups).where("below + s_before < need and below + s_before + s_n >= need")
        state = spool(hit.select(*groups, F.col("s_low").alias("low"), F.col("s_high").alias("high"), F.col("s_n").alias("n"), "need", (F.col("below") + F.col("s_before")).alias("below")), "topn-state")
        inside = active.join(state.select(*groups, "low", "high"), groups).where("code between low and high").drop("low", "high")
        active = spool(inside, "topn-active")
        if used is not None:
            forget(used)
        used = active
    if used is not None:
        forget(used)
    cuts = done[0]
    for part in done[1:]:
        cuts = cuts.unionByName(part)
    whole = F.col("n") <= F.col("need") - F.col("below")
    return cuts.select(*groups, "low", "high", whole.alias("whole"), (F.col("need") - F.col("below")).alias("rest"))


def top_n(df: DataFrame, groups: list[str], score: str, identifier: str, last: str, n: int) -> DataFrame:
    """The ``n`` rows of every group with the smallest (score, identifier, last), ranked from 1 in ``rank_no``.

    ``last`` is a unique integer column. Returns the groups, score, identifier, last and rank_no. Needs a scratch
    folder (:mod:`pairloom.scratch`); runs a few small jobs a level.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    kept = df.where(" and ".join(f"`{c}` is not null" for c in [*groups, score])).where(~F.isnan(F.col(score).cast("double")))
    own = {c: f"g{i}" for i, c in enumerate(groups)}
    gs = list(own.values())
    rows = spool(
        kept.select(*[F.col(c).alias(g) for c, g in own.items()], F.col(score).cast("double").alias("score"), F.col(identifier).alias("identifier"), F.col(last).cast("bigint").alias("last"))
        .withColumn("score_code", F.pandas_udf(ordered_code, "bigint")("score")),
        "topn-rows",
    )
    longest = rows.agg(F.max(F.octet_length("identifier"))).first()[0] or 0
    pieces = -(-longest // PIECE)
    levels = [F.col("score_code"), *[identifier_code(F.col("identifier"), i) for i in range(max(pieces, 1))], F.col("last")]
    need = rows.select(*gs).distinct().withColumn("need", F.lit(n).cast("bigint"))
    chosen = None
    for i, code in enumerate(levels):
        coded = rows.withColumn("code", code)
        cuts = cut_level(coded, gs, need)
        at = coded.join(cuts, gs)
        taken = at.where(F.when(F.col("whole"), F.col("code") <= F.col("high")).otherwise(F.col("code") < F.col("low")))
        taken = taken.select(*gs, "score", "identifier", "last")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        ties = at.where(~F.col("whole") & (F.col("code") == F.col("low")))
        rows = spool(ties.select(*gs, "score", "identifier", "last", "score_code", "rest"), "topn-ties")
        if rows.isEmpty():
            break
        need = rows.groupBy(*gs).agg(F.max("rest").alias("need"))
        rows = rows.drop("rest")
    order = Window.partitionBy(*gs).orderBy("score", F.col("identifier").asc_nulls_last(), "last")
    ranked = chosen.withColumn("rank_no", F.row_number().over(order).cast("bigint"))
    return ranked.select(*[F.col(g).alias(c) for c, g in own.items()], F.col("score").alias(score), F.col("identifier").alias(identifier), F.col("last").alias(last), "rank_no")


def first_of_repeats(df: DataFrame, unique: str, keep: list[str]) -> DataFrame:
    """Rows equal in all columns but ``unique`` count once, by the smallest ``unique``; returns ``keep`` and it.

    The other columns meet as two independent 64-bit hashes, so long texts are not shuffled; -0.0 equals 0.0 and NaN
    equals NaN.
    """
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    values = [(F.when(F.isnan(c), F.lit(float("nan"))).otherwise(F.col(c) + F.lit(0.0)) if c in doubles else F.col(c)) for c in df.columns if c not in {unique, *keep}]
    present = [F.col(c).isNull() for c in df.columns if c not in {unique, *keep}]
    kept = [(F.col(c) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in keep]
    hashed = df.select(*kept, unique, F.xxhash64(F.lit(1), *values, *present).alias("_a"), F.xxhash64(F.lit(2), *present, *reversed(values)).alias("_b"))
    return hashed.groupBy(*keep, "_a", "_b").agg(F.min(unique).alias(unique)).drop("_a", "_b")
