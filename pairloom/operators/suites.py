"""Suite rows and what captures say about them: toolsets, tags, recorded arguments, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.traces import argument_fields

# Tag of rows made from captures, budget of a transcript, its head, foot and mark of a cut.
CAPTURED = "captured"
MOST_TRANSCRIPT = 4000
HEAD, FOOT, CUT = 'Conversation context (both outputs respond to the final user message):\n"""\n', '\n"""', "[... truncated ...]"


def toolsets(captures: DataFrame) -> DataFrame:
    """The tools behind every toolset reference, as the first capture that offers some under it saw them: toolset_ref, tools."""
    z = F.arrays_zip(F.col("trace.events.toolset_ref").alias("ref"), F.col("trace.events.sequence_index").alias("q"), F.col("trace.events.tools_offered").alias("tools"))
    seen = captures.select("row_id", F.explode(z).alias("e")).where("e.ref is not null and size(e.tools) > 0")
    return seen.groupBy(F.col("e.ref").alias("toolset_ref")).agg(F.min_by(F.array_sort(F.array_distinct("e.tools")), F.struct("row_id", "e.q")).alias("tools"))


def with_toolsets(examples: DataFrame, sets: DataFrame) -> DataFrame:
    """Examples with ``tools`` of their reference (null if it is unknown) and ``offers_tools``."""
    return examples.join(sets, "toolset_ref", "left").withColumn("offers_tools", F.coalesce(F.size("tools") > 0, F.lit(False)))


def built_tags(suite: Column, extra: Column) -> Column:
    """Tags of a row made from a capture: the capture tag, the suite, then the others once each."""
    own = F.array_compact(F.array(F.lit(CAPTURED), suite))
    return F.array_distinct(F.concat(own, F.coalesce(extra, F.array().cast("array<string>"))))


def unwrapped(arguments: Column, declared: Column) -> Column:
    """The wrapper key around recorded arguments, where the declared properties confirm that it is one; else null.

    An object with one field that is no declared property, whose value is an object with declared properties only.
    """
    fields = argument_fields(arguments)
    key = F.try_element_at(F.map_keys(fields), F.lit(1))
    inner = F.try_element_at(fields, key)
    inside = F.map_keys(argument_fields(inner))
    fits = (F.size(fields) == 1) & (F.size(declared) > 0) & ~F.array_contains(declared, key) & inner.startswith("{") & F.forall(inside, lambda k: F.array_contains(declared, k))
    return F.when(F.coalesce(fits, F.lit(False)), key)


def transcripts(messages: DataFrame, key: str, most: int = MOST_TRANSCRIPT) -> DataFrame:
    """Messages of a conversation as one labelled text each: key, text, kept, cut.

    ``messages``: key, place (from 0, without gap), role, line. If the text would pass ``most`` characters, a leading
    system message stays, a mark follows, and whole lines from the end that fit; a last line that is too long alone is
    clipped. Lines are counted from the end by a running sum, and only those that stay are put together.
    """
    back = Window.partitionBy(key).orderBy(F.desc("place"))
    whole = messages.groupBy(key).agg(F.sum(F.char_length("line") + 1).alias("_all"), F.count("*").alias("_n"), F.max(F.when((F.col("place") == 0) & (F.col("role") == "system"), F.char_length("line"))).alias("_system"))
    fixed = len(HEAD) + len(FOOT)
    rows = messages.join(whole, key).withColumn("_over", F.col("_all") - 1 + fixed > most)
    led = (F.col("place") == 0) & F.col("_system").isNotNull()
    budget = F.greatest(F.lit(0), most - fixed - F.coalesce(F.col("_system") + 1, F.lit(0)) - len(CUT) - 1)
    rows = rows.withColumn("_budget", budget).withColumn("_used", F.sum(F.when(~led, F.char_length("line") + 1)).over(back)).withColumn("_i", F.row_number().over(back))
    kept = rows.where(~F.col("_over") | led | (F.col("_used") <= F.col("_budget")) | (F.col("_i") == 1))
    alone = F.col("_over") & (F.col("_i") == 1) & (F.char_length("line") + 1 > F.col("_budget"))
    text = F.when(alone, F.substring(F.col("line"), F.lit(1), F.greatest(F.lit(0), F.col("_budget") - 1).cast("int"))).otherwise(F.col("line"))
    marked = kept.select(key, F.struct("place", text.alias("line")).alias("e"), "_over", "_n", led.alias("led"))
    cut = F.when(F.col("_over"), F.array(F.lit(CUT))).otherwise(F.array().cast("array<string>"))
    made = marked.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("led") & F.col("_over"), F.col("e")))).alias("a"), F.array_sort(F.collect_list(F.when(~(F.col("led") & F.col("_over")), F.col("e")))).alias("b"), F.max("_over").alias("_over"), F.count("*").cast("bigint").alias("kept"))
    lines = lambda c: F.transform(F.col(c), lambda x: x["line"])
    return made.select(key, F.concat(F.lit(HEAD), F.array_join(F.concat(lines("a"), cut, lines("b")), "\n"), F.lit(FOOT)).alias("text"), "kept", F.col("_over").alias("cut"))


def missing_pairs(calls: DataFrame, traces: DataFrame) -> DataFrame:
    """Prompts and examples with calls of both roles for which a trace of a role is lacking: prompt_id, example_id, lacks."""
    roles = lambda df: df.where(F.col("role").isin("source", "target")).groupBy("prompt_id", "example_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    known = roles(calls).where(F.size("roles") == 2).select("prompt_id", "example_id")
    have = roles(traces).withColumnRenamed("roles", "have")
    lacks = F.array_except(F.array(F.lit("source"), F.lit("target")), F.coalesce("have", F.array().cast("array<string>")))
    return known.join(have, ["prompt_id", "example_id"], "left").select("prompt_id", "example_id", F.array_join(lacks, ",").alias("lacks")).where("lacks <> ''")
