"""Captures (event logs) towards suite examples: rounds, results, history, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FIELDS = ("type", "name", "call_id", "arguments", "result", "error", "input_tokens", "output_tokens", "toolset_ref")


def events(captures: DataFrame, *fields: str) -> DataFrame:
    """One row an event: row_id, q (sequence_index) and ``fields`` (FIELDS if none); only these are read."""
    fields = fields or FIELDS
    zipped = F.arrays_zip(F.col("trace.events.sequence_index").alias("q"), *[F.col(f"trace.events.{f}").alias(f) for f in fields])
    return captures.select("row_id", F.explode(zipped).alias("e")).select("row_id", "e.*")


def rounds(ev: DataFrame) -> DataFrame:
    """Add ``round``: the number of model calls up to and with the event; events before any are in round 0."""
    w = Window.partitionBy("row_id").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    return ev.withColumn("round", F.sum(F.when(F.col("type") == "model_call", 1).otherwise(0)).over(w))


def wire_rounds(ev: DataFrame) -> DataFrame:
    """Add ``wire_round``: like :func:`rounds`, but leading events share round 0 with the first model call."""
    return rounds(ev).withColumn("wire_round", F.greatest(F.col("round") - 1, F.lit(0)))


def tool_rounds(ev: DataFrame) -> DataFrame:
    """Rounds that executed a call, renumbered densely: row_id, tool_round, calls (names in order)."""
    called = rounds(ev).where("type = 'tool_call'").groupBy("row_id", "round").agg(F.array_sort(F.collect_list(F.struct("q", "name"))).alias("c"))
    number = F.row_number().over(Window.partitionBy("row_id").orderBy("round")) - 1
    return called.select("row_id", number.alias("tool_round"), F.transform("c", lambda x: x["name"]).alias("calls"))


def pair_results(ev: DataFrame) -> DataFrame:
    """Results of the calls of a round: row_id, round, call_q, result_q (null if none).

    First by call id (the first result and the first call of an id), then, among what is left, the k-th call of a name
    with the k-th result of that name; never across rounds.
    """
    r = rounds(ev).where("type in ('tool_call', 'tool_result')")
    key = ["row_id", "round"]
    nth = lambda df, by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("q")))
    calls, results = r.where("type = 'tool_call'"), r.where("type = 'tool_result'")
    by_id = [*key, "call_id"]
    first = nth(calls.where("call_id is not null"), by_id).where("k = 1").select(*by_id, F.col("q").alias("call_q")).join(
        nth(results.where("call_id is not null"), by_id).where("k = 1").select(*by_id, F.col("q").alias("result_q")), by_id
    )
    left = calls.join(first.select(*key, F.col("call_q").alias("q")), [*key, "q"], "left_anti")
    over = results.join(first.select(*key, F.col("result_q").alias("q")), [*key, "q"], "left_anti")
    by_name = [*key, "name", "k"]
    second = nth(left, [*key, "name"]).select(*by_name, F.col("q").alias("call_q")).join(nth(over, [*key, "name"]).select(*by_name, F.col("q").alias("result_q")), by_name, "left")
    return first.select(*key, "call_q", "result_q").unionByName(second.select(*key, "call_q", "result_q"))


def missing_verification(ev: DataFrame, dangerous: list[str], verifying: list[str]) -> DataFrame:
    """Dangerous calls with no verifying call before or at them: row_id, q, name."""
    w = Window.partitionBy("row_id").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.col("name").isin(verifying)).over(w)
    return ev.where("type = 'tool_call'").withColumn("seen", seen).where(F.col("name").isin(dangerous) & ~F.coalesce("seen", F.lit(False))).select("row_id", "q", "name")


def capture_list(captures: DataFrame, promoted: DataFrame | None = None) -> DataFrame:
    """Per capture: counts of events by kind, and whether it is among ``promoted`` (capture_id)."""
    types = F.col("trace.events.type")
    count = lambda t: F.size(F.filter(types, lambda x: x == t))
    out = captures.select("row_id", "capture_id", "suite", F.size(types).alias("events"), count("tool_call").alias("tool_calls"), count("model_call").alias("model_calls"))
    if promoted is None:
        return out
    return out.join(promoted.select("capture_id").distinct().withColumn("promoted", F.lit(True)), "capture_id", "left").na.fill(False, ["promoted"])


def toolset_refs(captures: DataFrame) -> DataFrame:
    """Toolset references of a capture: row_id, first_ref (of its first model call that has one), refs (all, sorted)."""
    z = F.filter(F.arrays_zip(F.col("trace.events.sequence_index").alias("q"), F.col("trace.events.toolset_ref").alias("r")), lambda x: x["r"].isNotNull())
    ordered = F.array_sort(F.transform(z, lambda x: F.struct(x["q"].alias("q"), x["r"].alias("r"))))
    return captures.select("row_id", F.try_element_at(ordered, F.lit(1))["r"].alias("first_ref"), F.array_sort(F.array_distinct(F.transform(ordered, lambda x: x["r"]))).alias("refs"))


def refs_in_use(*sources: DataFrame) -> DataFrame:
    """Distinct toolset references over several tables with a column toolset_ref."""
    out = sources[0].select("toolset_ref")
    for s in sources[1:]:
        out = out.unionByName(s.select("toolset_ref"))
    return out.where("toolset_ref is not null").distinct()


def duplicate_turns(captures: DataFrame) -> DataFrame:
    """Places of a conversation held by several captures: conversation_id, turn_index, captures (sorted ids)."""
    found = captures.where("conversation_id is not null and turn_index is not null").groupBy("conversation_id", "turn_index").agg(F.array_sort(F.collect_set("capture_id")).alias("captures"))
    return found.where(F.size("captures") > 1)


def turn_order(captures: DataFrame) -> DataFrame:
    """Add ``place``: order in the conversation by index (null last), creation text and id, and the index it implies."""
    w = Window.partitionBy("conversation_id").orderBy(F.col("turn_index").asc_nulls_last(), "created_at", "capture_id", "row_id")
    return captures.withColumn("place", F.row_number().over(w) - 1).withColumn("turn", F.coalesce("turn_index", "place"))


def replies_before(turns: DataFrame) -> DataFrame:
    """Replies of all turns before each turn: conversation_id, place, turns (those with a reply), chars.

    ``turns``: conversation_id, place, reply. Running sums, so a long conversation costs nothing more.
    """
    w = Window.partitionBy("conversation_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.coalesce(F.sum(F.char_length("reply")).over(w), F.lit(0))
    return turns.select("conversation_id", "place", F.count("reply").over(w).alias("turns"), chars.cast("bigint").alias("chars"))


def full_history(captures: DataFrame) -> DataFrame:
    """Messages before each turn: conversation_id, place, recorded, messages, chars.

    A turn whose first input is a list of messages with a user message has what it recorded before that message.
    Others get all turns before that are not blocked: their user texts, their replies where there are any, and first
    the earliest system message that one of them recorded. Blocked are turns with an error event, without a toolset on
    their first model call, or with several toolsets. Running sums, so the length of a conversation costs nothing.
    """
    z = F.arrays_zip(*[F.col(f"trace.events.{f}").alias(f) for f in ("sequence_index", "type", "toolset_ref")])
    ordered = F.array_sort(F.transform(z, lambda x: F.struct(x["sequence_index"].alias("q"), x["type"].alias("type"), x["toolset_ref"].alias("ref"))))
    refs = F.transform(F.filter(ordered, lambda x: x["type"] == "model_call"), lambda x: x["ref"])
    failed = F.coalesce(F.exists(ordered, lambda x: x["type"] == "error"), F.lit(False))
    blocked = failed | F.try_element_at(refs, F.lit(1)).isNull() | (F.size(F.array_distinct(F.array_compact(refs))) > 1)
    turns = turn_order(captures.where("conversation_id is not null").select("row_id", "conversation_id", "turn_index", "created_at", "capture_id"))
    m = F.when(F.col("first_input").rlike(r"^\s*\["), F.from_json("first_input", "array<struct<role string, content string>>"))
    # Up to the last user message: the place of the first one in the reversed list, counted from the end.
    upto = F.size("m") - F.array_position(F.transform(F.reverse("m"), lambda x: F.coalesce(x["role"], F.lit(""))), "user") + 1
    parsed = captures.select("row_id", blocked.alias("blocked")).join(recovered_texts(captures), "row_id").withColumn("m", m)
    listed = F.size("m") > 0
    parsed = parsed.withColumn("recorded", F.coalesce(F.exists("m", lambda x: x["role"] == "user"), F.lit(False))).withColumn("upto", F.when(F.col("recorded"), upto.cast("int")))
    kept = F.filter(F.slice("m", F.lit(1), F.col("upto") - 1), lambda x: x["role"].isin("system", "user", "assistant", "model", "tool"))
    parsed = parsed.withColumn("own", F.when(F.col("recorded"), kept))
    user = F.when(F.col("recorded"), F.get("m", F.col("upto") - 1)["content"]).when(F.coalesce(listed, F.lit(False)) | (F.coalesce("first_input", F.lit("")) == ""), "{}").otherwise(F.col("first_input"))
    first = F.get("own", F.lit(0))
    own_chars = F.aggregate("own", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(F.char_length(x["content"]), F.lit(0)))
    sized = parsed.select(
        "row_id", "blocked", "recorded", F.size("own").cast("bigint").alias("own_n"), own_chars.alias("own_chars"), F.when(first["role"] == "system", F.coalesce(F.char_length(first["content"]), F.lit(0))).alias("system"),
        (1 + F.col("final_text").isNotNull().cast("bigint")).alias("n"), (F.coalesce(F.char_length(user), F.lit(0)) + F.coalesce(F.char_length("final_text"), F.lit(0))).cast("bigint").alias("chars"),
    )
    w = Window.partitionBy("conversation_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.when(~F.col("blocked"), F.col(c))
    before = F.first(seen("system"), ignorenulls=True).over(w)
    run = turns.join(sized, "row_id").withColumns({"_s": before, "_n": F.sum(seen("n")).over(w), "_c": F.sum(seen("chars")).over(w)})
    none = F.lit(0).cast("bigint")
    return run.select(
        "conversation_id", "place", "recorded",
        F.when(F.col("recorded"), F.col("own_n")).otherwise(F.coalesce("_n", none) + F.col("_s").isNotNull().cast("bigint")).alias("messages"),
        F.when(F.col("recorded"), F.col("own_chars")).otherwise(F.coalesce("_c", none) + F.coalesce("_s", none)).alias("chars"),
    )


def content_duplicates(rows: DataFrame, key: list[str], owner: str, within: list[str]) -> DataFrame:
    """Rows whose content another owns: owner, first_owner. Content is hashed, so long texts are not shuffled twice."""
    content = F.sha2(F.to_json(F.struct(*key)), 256)
    keyed = rows.select(*within, owner, content.alias("content"))
    first = keyed.groupBy(*within, "content").agg(F.min(owner).alias("first_owner"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first.drop("n"), [*within, "content"]).where(F.col(owner) != F.col("first_owner")).select(owner, "first_owner")


def retained(rows: DataFrame, group: str, newest: Column, most: int, held: Column) -> DataFrame:
    """Add ``kept``: whether a row is among the ``most`` first of its group by ``newest``, or held for another reason."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(newest))
    return rows.withColumn("kept", (place <= most) | held)


def ascii_length(text: Column) -> Column:
    """Characters of a JSON text once everything beyond ASCII is escaped."""
    return F.char_length(F.regexp_replace(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "x" * 12), r"[^\x00-\x7F]", "x" * 6))


def context_loss(captures: DataFrame, variable: str = "query", ratio: float = 4, gap: int = 300) -> DataFrame:
    """Captures whose first model call was billed far more input than was recovered of it: row_id, estimate, input_tokens.

    Recovered are the inputs (an object with the last user message under ``variable``) and the messages before it; an
    input that is no list of messages is the input itself. Four characters count as a token.
    """
    z = F.arrays_zip(*[F.col(f"trace.events.{f}").alias(f) for f in ("sequence_index", "type", "input", "input_tokens")])
    ordered = F.array_sort(F.transform(F.filter(z, lambda x: x["type"] == "model_call"), lambda x: F.struct(x["sequence_index"].alias("q"), x["input"].alias("input"), x["input_tokens"].alias("t"))))
    first = captures.select("row_id", F.try_element_at(ordered, F.lit(1)).alias("e")).where("e.t > 0").select("row_id", F.col("e.input").alias("input"), F.col("e.t").alias("input_tokens"))
    m = F.when(F.col("input").rlike(r"^\s*\["), F.from_json("input", "array<struct<role string, content string>>"))
    upto = F.size("m") - F.array_position(F.transform(F.reverse("m"), lambda x: F.coalesce(x["role"], F.lit(""))), "user")
    known = F.exists("m", lambda x: x["role"] == "user")
    parsed = first.withColumn("m", m).withColumn("known", F.coalesce(known, F.lit(False))).withColumn("upto", F.when(F.col("known"), upto.cast("int")))
    text = F.when(F.col("known"), F.get("m", F.col("upto"))["content"]).when(F.col("m").isNull(), F.col("input"))
    inputs = F.when(text.isNull(), 2).otherwise(ascii_length(F.to_json(F.struct(text.alias(variable)))) + 1)
    before = F.when(F.col("known"), F.aggregate(F.slice("m", F.lit(1), F.col("upto")), F.lit(0), lambda s, x: s + F.coalesce(F.char_length(x["content"]), F.lit(0)))).otherwise(0)
    estimate = F.greatest(F.lit(1), F.expr("(chars div 4)"))
    sized = parsed.withColumn("chars", inputs + before).select("row_id", estimate.cast("bigint").alias("estimate"), F.col("input_tokens").cast("bigint").alias("input_tokens"))
    return sized.where((F.col("input_tokens") >= ratio * F.col("estimate")) & (F.col("input_tokens") - F.col("estimate") > gap))


# Characters of escaped JSON that a result and a stream may have, and the fields of an event that are sent.
MOST_RESULT, MOST_STREAM = 16_384, 262_144
SENT = {
    "model_call": ["model_id", "input_tokens", "output_tokens", "cost_usd", "latency_ms"],
    "tool_call": ["name", "arguments", "call_id", "parent_call_id"],
    "tool_result": ["name", "call_id", "result", "error"],
    "final_output": ["text"],
    "error": ["message", "category"],
    "retrieval": ["source", "query", "documents"],
    "guardrail": ["name", "verdict", "reason"],
}


def cap_streams(captures: DataFrame, most_result: int = MOST_RESULT, most_stream: int = MOST_STREAM) -> DataFrame:
    """The events of a capture as they are sent: row_id, kept, dropped, truncated (any result or the stream), size.

    An oversized result becomes a marker with its size and beginning; once a stream is over its budget, it ends before
    the first event that would pass it. Sizes are those of JSON with escapes and blanks after separators. All inside
    the row, so no event is exchanged.
    """
    names = sorted({n for fields in SENT.values() for n in fields})
    z = F.arrays_zip(*[F.col(f"trace.events.{n}").alias(n) for n in ("sequence_index", "type", "timestamp", *names)])
    ordered = F.array_sort(z, lambda a, b: F.when(a["sequence_index"].eqNullSafe(b["sequence_index"]), 0).when(a["sequence_index"].isNull() | (a["sequence_index"] > b["sequence_index"]), 1).otherwise(-1))
    full = {"ignoreNullFields": "false"}
    # A string's JSON is that of a list of it, less the brackets.
    text_size = lambda c: F.when(c.isNull(), 4).otherwise(ascii_length(F.to_json(F.array(c))) - 2)

    def sized(e: Column, i: Column) -> Column:
        """Size of an event and whether its result is cut."""
        models = F.col("_models")
        number = F.greatest(F.size(F.filter(models, lambda k: k <= i)) - 1, F.lit(0))
        head = lambda kind: F.char_length(F.format_string('{"type": "' + kind + '", "sequence_index": %d, "round": %d, "timestamp": ', i, number)) + text_size(e["timestamp"]) + 1
        out, cut = F.lit(None).cast("int"), F.lit(False)
        for kind, fields in SENT.items():
            size = head(kind)
            for n in fields:
                value = e[n]
                if n == "documents":
                    one = F.when(value.isNull(), 4).otherwise(ascii_length(F.to_json(value)) + F.greatest(F.size(value) - 1, F.lit(0)))
                elif n in ("input_tokens", "output_tokens", "latency_ms", "cost_usd"):
                    one = F.coalesce(F.char_length(value.cast("string")), F.lit(4))
                elif n == "result":
                    whole = text_size(value)
                    start = F.substring(F.regexp_replace(F.regexp_replace(F.to_json(F.array(value)), r"[\x{10000}-\x{10FFFF}]", "x" * 12), r"[^\x00-\x7F]", "x" * 6), 2, most_result)
                    marker = F.char_length(F.format_string('{"_truncated": true, "_original_bytes": %d, "preview": ""}', whole)) + ascii_length(F.to_json(F.array(start))) - 4
                    one = F.when(whole > most_result, marker).otherwise(whole) + F.when(whole > most_result, len(', "truncated": true')).otherwise(len(', "truncated": false'))
                    cut = F.when(e["type"] == "tool_result", whole > most_result).otherwise(cut)
                else:
                    one = text_size(value)
                size = size + one + len(f', "{n}": ')
            out = F.when(e["type"] == kind, size).otherwise(out)
        other = F.char_length(F.format_string('{"type": "%s", "sequence_index": %d, "round": %d, "timestamp": ', e["type"], i, number)) + text_size(e["timestamp"]) + 1
        return F.struct(F.coalesce(out, other).cast("bigint").alias("n"), cut.alias("cut"))

    rows = captures.select("row_id", ordered.alias("_e")).where("size(_e) > 0")
    rows = rows.withColumn("_models", F.filter(F.transform("_e", lambda e, i: F.when(e["type"] == "model_call", i)), lambda k: k.isNotNull()))
    rows = rows.select("row_id", F.transform("_e", sized).alias("s"))
    whole = F.aggregate("s", F.lit(0).cast("bigint"), lambda t, x: t + x["n"]) + 2 * F.size("s")
    start = F.struct(F.lit(2).cast("bigint").alias("size"), F.lit(0).alias("kept"), F.lit(False).alias("over"))

    def step(t: Column, x: Column) -> Column:
        over = t["over"] | (t["size"] + x["n"] + 1 > most_stream)
        return F.struct(F.when(over, t["size"]).otherwise(t["size"] + x["n"] + 1).alias("size"), F.when(over, t["kept"]).otherwise(t["kept"] + 1).alias("kept"), over.alias("over"))

    all_kept = F.struct(whole.alias("size"), F.size("s").alias("kept"), F.lit(False).alias("over"))
    rows = rows.withColumn("r", F.when(whole <= most_stream, all_kept).otherwise(F.aggregate("s", start, step)))
    return rows.select("row_id", F.col("r.kept").cast("bigint").alias("kept"), (F.size("s") - F.col("r.kept")).cast("bigint").alias("dropped"), (F.exists("s", lambda x: x["cut"]) | F.col("r.over")).alias("truncated"), F.col("r.size").alias("size"))


def recovered_texts(captures: DataFrame) -> DataFrame:
    """First recorded input and final text of a capture: row_id, first_input, final_text.

    The final text is that of the last final_output event, null included; without one, the last output of a model call
    that is not blank, less the white space around it.
    """
    z = F.arrays_zip(*[F.col(f"trace.events.{f}").alias(f) for f in ("sequence_index", "type", "input", "output", "text")])
    ordered = F.array_sort(F.transform(z, lambda x: F.struct(x["sequence_index"].alias("q"), x["type"].alias("type"), x["input"].alias("input"), x["output"].alias("output"), x["text"].alias("text"))))
    models = F.filter("o", lambda x: x["type"] == "model_call")
    finals = F.filter("o", lambda x: x["type"] == "final_output")
    spoken = F.filter(models, lambda x: F.coalesce(x["output"], F.lit("")).rlike(r"(?U)\S"))
    said = F.regexp_replace(F.try_element_at(spoken, F.lit(-1))["output"], r"(?U)^\s+|\s+$", "")
    last = F.when(F.size(finals) > 0, F.try_element_at(finals, F.lit(-1))["text"]).otherwise(said)
    return captures.select("row_id", ordered.alias("o")).select("row_id", F.try_element_at(models, F.lit(1))["input"].alias("first_input"), last.alias("final_text"))
