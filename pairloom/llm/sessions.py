"""Sessions of message rows by time: an independent reading of conversations, beside the one by links and indexes.

The captures of a channel (conversation_id) are put in order of their normalised times and split wherever the silence is
longer than a gap that is calibrated on the data: the QUANTILE of the silences between captures and the parents they
name. Roles are inferred from their spellings, and sessions in which not every capture has a user and an assistant
message are dropped. ``agreement`` says how far the sessions are the conversations that links and indexes give.

Order and silences are found in ranges of (channel, time), so a channel with a third of all rows is spread over tasks.

Defined results: captures without a channel or without a readable time are in no session; repeated captures count once,
by their earliest time; equal times go by capture_id; without any linked silence nothing is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.dialogues import answered, sound_turns
from pairloom.operators.ranking import in_ranges
from pairloom.operators.timestamps import normalise
from pairloom.scratch import spool

QUANTILE = 0.99
#: Accuracy of the calibrated gap: the error of its rank is below one in ACCURACY.
ACCURACY = 10_000


def timed_captures(captures: DataFrame, recorders: DataFrame) -> DataFrame:
    """Every capture of a channel once: capture_id, conversation_id, parent, at (microseconds)."""
    sources = recorders.select(F.col("recorder_id").alias("source_id"), F.col("tz_name").alias("zone"), F.col("date_order").alias("declared"))
    rows = captures.where("capture_id is not null and conversation_id is not null").select("capture_id", "conversation_id", "parent_capture_id", F.col("recorder_id").alias("source_id"), F.col("created_at").alias("text"))
    read = normalise(rows, sources).where("status = 'ok'")
    return read.groupBy("capture_id").agg(F.min("conversation_id").alias("conversation_id"), F.min("parent_capture_id").alias("parent"), F.min("utc_us").alias("at"))


def calibrated_gap(timed: DataFrame) -> int | None:
    """The silence (microseconds) that linked captures exceed only in 1 - QUANTILE of all cases."""
    before = timed.select(F.col("capture_id").alias("parent"), F.col("at").alias("parent_at"), F.col("conversation_id").alias("c"))
    silence = timed.join(before, "parent").where(F.col("c") == F.col("conversation_id")).select(F.abs(F.col("at") - F.col("parent_at")).alias("silence"))
    return silence.agg(F.percentile_approx("silence", QUANTILE, ACCURACY)).first()[0]


def sessions(captures: DataFrame, messages: DataFrame, recorders: DataFrame) -> DataFrame:
    """Turns of the sessions that are kept: conversation_id, session_no, turn_no (both from 0), capture_id."""
    timed = spool(timed_captures(captures, recorders), "timed-captures")
    gap = calibrated_gap(timed)
    order = ["conversation_id", "at", "capture_id"]
    rows = in_ranges(timed.join(answered(messages).withColumn("answered", F.lit(True)), "capture_id", "left"), [F.col(c).asc() for c in order], "session-ranges")
    within = Window.partitionBy("_range", "conversation_id").orderBy("at", "capture_id")
    # The row before the first of a channel in a range is the last that the channel has in an earlier range.
    ends = rows.groupBy("conversation_id", "_range").agg(F.max("at").alias("_last"))
    earlier = ends.select("conversation_id", "_range", F.last("_last").over(Window.partitionBy("conversation_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_end"))
    before = F.coalesce(F.lag("at").over(within), F.col("_end"))
    split = F.lit(False) if gap is None else F.coalesce(F.col("at") - before > gap, F.lit(False))
    marked = spool(rows.join(earlier, ["conversation_id", "_range"]).withColumn("_split", split.cast("bigint")), "session-splits")
    parts = marked.groupBy("conversation_id", "_range").agg(F.sum("_split").alias("_own"))
    passed = parts.select("conversation_id", "_range", F.coalesce(F.sum("_own").over(Window.partitionBy("conversation_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_passed"))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    numbered = spool(marked.join(passed, ["conversation_id", "_range"]).withColumn("session_no", F.col("_passed") + F.sum("_split").over(upto)), "sessions")
    session = ["conversation_id", "session_no"]
    sound = numbered.groupBy(*session).agg(F.bool_and(F.coalesce("answered", F.lit(False))).alias("whole")).where("whole").select(*session)
    # Places: those in the range, and what the session has in earlier ranges.
    held = numbered.groupBy(*session, "_range").agg(F.count("*").alias("_n"))
    offset = held.select(*session, "_range", F.coalesce(F.sum("_n").over(Window.partitionBy(*session).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*session, "_range").orderBy("at", "capture_id")) - 1
    placed = numbered.withColumn("_place", place).join(offset, [*session, "_range"]).join(sound, session)
    return placed.select(*session, (F.col("_before") + F.col("_place")).cast("bigint").alias("turn_no"), "capture_id")


def agreement(captures: DataFrame, messages: DataFrame, recorders: DataFrame) -> DataFrame:
    """Sessions against the sound conversations of links and indexes, in one row: conversations, in_one_session (all their
    turns in one session), same_order (and in the same order), same (and nothing else in the session)."""
    turns = sessions(captures, messages, recorders)
    sizes = turns.groupBy("conversation_id", "session_no").agg(F.count("*").alias("size"))
    linked = sound_turns(captures, messages).withColumnRenamed("turn_no", "place")
    met = linked.join(turns.withColumnRenamed("conversation_id", "channel"), "capture_id", "left")
    shift = F.col("turn_no") - F.col("place")
    per = met.groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.count("turn_no").alias("timed"), F.min("session_no").alias("a"), F.max("session_no").alias("b"), F.min("channel").alias("c"), F.max("channel").alias("d"), F.min(shift).alias("lo"), F.max(shift).alias("hi"),
    )
    one = (F.col("n") == F.col("timed")) & (F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))
    per = per.join(sizes.select(F.col("conversation_id").alias("c"), F.col("session_no").alias("a"), "size"), ["c", "a"], "left").withColumn("one", F.coalesce(one, F.lit(False)))
    ordered = F.col("one") & (F.col("lo") == F.col("hi"))
    return per.agg(F.count("*").alias("conversations"), F.count_if("one").alias("in_one_session"), F.count_if(ordered).alias("same_order"), F.count_if(ordered & (F.col("size") == F.col("n"))).alias("same"))
