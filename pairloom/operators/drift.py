"""Schema drift: ingestion with a rescue column, replay of rescued values, and the report of changes.

``ingest`` holds every JSON record to a target schema. What fits becomes a typed column; a field the schema does not
know, a value it cannot cast, and a null are kept as JSON in ``rescued``, so nothing is lost. ``leaves`` takes the
stored table apart again into its fields, and ``changes`` compares consecutive files on them. ``replay`` turns approved
rescued fields (new ones, or old ones under a new name) into typed columns.

Defined results: a line that is not one JSON object is ``parsed = false`` with all else null; a null value counts as
present; a repeated key keeps its last value; an object is not a field, its leaves are; an empty object has none;
NaN and infinities are no JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.scratch import spool

# The target schema of a capture envelope.
TARGET: dict[str, str] = {
    "schema_version": "string",
    "code_version": "string",
    "capture_id": "string",
    "suite": "string",
    "input_hash": "string",
    "created_at": "string",
    "conversation_id": "string",
    "turn_index": "bigint",
    "model_id": "string",
    "usage.input_tokens": "bigint",
    "usage.output_tokens": "bigint",
    "cost_usd": "double",
    "latency_ms": "bigint",
    "cached": "boolean",
    "finish_reason": "string",
    "tags": "array<string>",
}

#: A rename needs this much common content, or this much together with a related name.
SAME_CONTENT, SAME_CONTENT_NAMED, RELATED_NAME = 0.6, 0.2, 0.5
#: Two names that share more than this part of the rarer one's files stand for different things.
TOGETHER = 0.02

def column_of(path: str) -> str:
    """Flat column name of a path."""
    return path.replace(".", "__")


def ingest(files: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """Hold ``files`` (stream, file_no, line_no, body) to ``target``.

    Returns stream, file_no, line_no, parsed, one typed column a target path, and ``rescued`` (JSON object by path,
    null if empty).
    """
    kinds = dict(target)
    typed = ",".join(f"`{column_of(p)}` {t}" for p, t in kinds.items())
    schema = f"stream string, file_no bigint, line_no bigint, parsed boolean, {typed}, rescued string"

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import math

        def no_number(text: str) -> None:
            raise ValueError(text)

        def leaves(value: dict, path: str, out: dict) -> None:
            for key, item in value.items():
                here = f"{path}.{key}" if path else key
                if isinstance(item, dict):
                    leaves(item, here, out)
                else:
                    out[here] = item

        def cast(value, kind: str) -> tuple[object, bool]:
            """The typed value and whether it fits; a number in digits fits a number, never the other way round a guess."""
            if value is None:
                return None, False
            if kind == "string":
                return (value, True) if isinstance(value, str) else (None, False)
            if kind == "boolean":
                return (value, True) if isinstance(value, bool) else (None, False)
            if kind.startswith("array"):
                return (value, True) if isinstance(value, list) and all(x is None or isinstance(x, str) for x in value) else (None, False)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                return None, False
            if kind == "double":
                return float(value), True
            return (int(value), True) if value == int(value) and abs(value) < 2**63 else (None, False)

        for part in parts:
            columns: dict[str, list] = {c: [] for c in ("parsed", *kinds, "rescued")}
            for body in part["body"]:
                try:
                    record = json.loads(body, parse_constant=no_number) if body is not None else None
                except (ValueError, RecursionError):
                    record = None
                good = isinstance(record, dict)
                flat: dict = {}
                if good:
                    leaves(record, "", flat)
                rest = {p: v for p, v in flat.items() if p not in kinds}
                columns["parsed"].append(good)
                for path, kind in kinds.items():
                    value, fits = cast(flat.get(path), kind)
                    columns[path].append(value)
                    if not fits and path in flat:
                        rest[path] = flat[path]
                columns["rescued"].append(json.dumps(rest, ensure_ascii=False) if rest else None)
            out = part[["stream", "file_no", "line_no"]].reset_index(drop=True)
            for name, values in columns.items():
                kind = {"bigint": "Int64", "boolean": "boolean"}.get(kinds.get(name, ""), object)
                out[column_of(name)] = pd.Series(values, dtype=kind)
            yield out

    return files.select("stream", F.col("file_no").cast("bigint").alias("file_no"), F.col("line_no").cast("bigint").alias("line_no"), "body").mapInPandas(read, schema)


def replay(rows: DataFrame, approved: dict[str, str], target: dict[str, str] = TARGET) -> DataFrame:
    """Turn rescued values into typed columns.

    ``approved`` maps a rescued path to the target path it fills (an alias), or to itself (a retyped value or a new
    field, then typed by ``target`` or as text). A typed value that is there already wins; text that casts is taken,
    and so are the one element of an array, a number with its unit "ms", and text between commas as a list.
    """
    rescued = F.from_json("rescued", "map<string,string>")
    out = rows
    for path, onto in approved.items():
        kind = target.get(onto, "string")
        raw = F.try_element_at(rescued, F.lit(path))
        if kind.startswith("array"):
            value: Column = F.when(raw.startswith("["), F.from_json(raw, kind)).otherwise(F.split(raw, r"\s*,\s*"))
        else:
            plain = r"regexp_replace(_raw, '^\\[\"?([^\",\\[\\]{}]*)\"?\\]$', '$1')"
            plain = f"regexp_replace({plain}, '^([0-9.]+) ?ms$', '$1')" if kind in ("bigint", "double") else plain
            value = F.expr(f"try_cast({plain} as {kind})")
        name = column_of(onto)
        filled = F.coalesce(F.col(name), value) if name in out.columns else value
        out = out.withColumn("_raw", raw).withColumn(name, filled).drop("_raw")
    return out


def approve(changed: DataFrame, target: dict[str, str] = TARGET) -> dict[str, str]:
    """What :func:`replay` may take, from the report of changes: renamed fields and retyped target fields.

    Paths linked by renames are one field, whatever the stream; its aliases fill the one target path among them. A
    group with no or several target paths stays rescued. Collects the distinct renames, as small as the schemas.
    """
    groups: dict[str, set[str]] = {}
    for r in changed.where("change = 'renamed'").select("field", "new_field").distinct().collect():
        both = groups.get(r.field, {r.field}) | groups.get(r.new_field, {r.new_field})
        groups.update(dict.fromkeys(both, both))
    retyped = {r.field for r in changed.where("change = 'retyped'").select("field").distinct().collect()}
    out = {p: p for p in sorted(retyped & set(target))}
    for path in sorted(set(groups) - set(target)):
        onto = groups[path] & set(target)
        if len(onto) == 1:
            out[path] = onto.pop()
    return out


def promote(rows: DataFrame, approved: dict[str, str], target: dict[str, str] = TARGET) -> DataFrame:
    """:func:`replay`, with what was taken removed from ``rescued``; a null under an approved alias is taken too.

    A value stays rescued unless its column was empty, is filled now, and no other approved value could have filled it.
    """
    columns = sorted({column_of(p) for p in approved.values()})
    if not columns:
        return rows
    was = rows.withColumn("_was", F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])))
    now = replay(was, approved, target).withColumn("_now", F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])))

    @F.pandas_udf("string")
    def left(rescued: pd.Series, filled: pd.Series) -> pd.Series:
        import json

        def one(text: str | None, new) -> str | None:
            if text is None:
                return None
            rest = json.loads(text)
            rest = {p: v for p, v in rest.items() if v is not None or p not in approved}
            known = [p for p in rest if p in approved]
            for onto in new:
                takers = [p for p in known if column_of(approved[p]) == onto]
                if len(takers) == 1:
                    del rest[takers[0]]
            return json.dumps(rest, ensure_ascii=False) if rest else None

        return pd.Series([one(t, n) for t, n in zip(rescued, filled)], dtype=object)

    return now.withColumn("rescued", left("rescued", F.array_except("_now", "_was"))).drop("_was", "_now")


def leaves(rows: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """The fields of an ingested table: stream, file_no, path, type (JSON type, null for null), value (text).

    Typed columns give their path and value, ``rescued`` gives the rest, so this is every leaf of every record.
    """
    json_type = {"string": "string", "boolean": "boolean", "bigint": "number", "double": "number"}
    typed = [
        F.struct(F.lit(p).alias("path"), F.lit(json_type.get(t, "array")).alias("type"), (F.to_json(column_of(p)) if t.startswith("array") else F.col(column_of(p)).cast("string")).alias("value"))
        for p, t in target.items()
    ]
    rest = F.coalesce(F.map_entries(F.try_parse_json("rescued").cast("map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))

    def other(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        named = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind != "VOID", "number")
        return F.struct(e["key"].alias("path"), named.alias("type"), F.when(kind == "STRING", e["value"].cast("string")).otherwise(F.to_json(e["value"])).alias("value"))

    kept = F.filter(F.array(*typed), lambda x: x["value"].isNotNull())
    return rows.where("parsed").select("stream", "file_no", F.inline(F.concat(kept, F.transform(rest, other))))


def marks_of(kinds: pd.Series, values: pd.Series) -> pd.Series:
    """Content marks of field values: what a value looks like, so that the same information has the same marks.

    Words stay, numbers and codes become their kind and length, a number its magnitude; an array has the marks of all
    its elements.
    """
    import json
    import math
    import re

    piece, word = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Za-z]+$")

    def shape(m: re.Match) -> str:
        token = m[0]
        return token if word.match(token) else "9" if token.isdigit() else f"<{len(token)}>"

    def mark(value) -> list[str]:
        if value is None:
            return []
        if isinstance(value, bool):
            return [str(value)]
        if isinstance(value, (int, float)):
            size = 0 if not value or not math.isfinite(value) else math.floor(math.log2(abs(value)) / 2)
            return [f"{'-' if value < 0 else ''}{'.' if value != value // 1 else ''}{size}"]
        if isinstance(value, str):
            return [piece.sub(shape, value)]
        if isinstance(value, dict):
            return [f"{{{','.join(sorted(value))}}}"]
        return [f"[{m}" for x in value for m in mark(x)] or ["[]"]

    return pd.Series([mark(v if k == "string" else json.loads(v)) if v is not None and k is not None else [] for k, v in zip(kinds, values)], dtype=object)


def presence(fields: DataFrame) -> DataFrame:
    """One row a field and file: stream, file_no, path, types (sorted JSON types of its non-null values)."""
    return fields.groupBy("stream", "file_no", "path").agg(F.array_sort(F.collect_set("type")).alias("types"))


def boundaries(files: DataFrame) -> DataFrame:
    """stream, file_no, before: every file but a stream's first, with the file number before it."""
    order = Window.partitionBy("stream").orderBy("file_no")
    numbers = files.select("stream", F.col("file_no").cast("bigint").alias("file_no")).distinct()
    return numbers.withColumn("before", F.lag("file_no").over(order)).where("before is not null")


def changes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Every change between consecutive files: stream, file_no, change, field, new_field.

    ``rows`` is what :func:`ingest` gave for ``files``; it is read several times, so hand in a stored table. A field
    that goes and one that comes are one rename if both carry the same information: their contents agree over the
    whole corpus, and they do not stand side by side in other files, as different fields would.
    """
    fields = leaves(rows)
    there = spool(presence(fields), "drift-presence")
    steps = spool(boundaries(files), "drift-steps")
    now = there.join(steps.select("stream", "file_no"), ["stream", "file_no"])
    old = there.withColumnRenamed("file_no", "before").withColumnRenamed("types", "types_before").join(steps, ["stream", "before"]).drop("before")
    diff = spool(old.join(now, ["stream", "file_no", "path"], "full_outer").where("types is null or types_before is null or types <> types_before"), "drift-differences")
    gone = diff.where("types is null").select("stream", "file_no", F.col("path").alias("field"))
    come = diff.where("types_before is null").select("stream", "file_no", F.col("path").alias("new_field"))
    retyped = diff.where("types is not null and types_before is not null and types <> types_before")

    renames = match_renames(gone.join(come, ["stream", "file_no"]), fields, there)
    names = ["stream", "file_no", "change", "field", "new_field"]
    parts = [
        renames.select("stream", "file_no", F.lit("renamed").alias("change"), "field", "new_field"),
        gone.join(renames, ["stream", "file_no", "field"], "left_anti").select("stream", "file_no", F.lit("removed").alias("change"), "field", F.lit("").alias("new_field")),
        come.join(renames, ["stream", "file_no", "new_field"], "left_anti").select("stream", "file_no", F.lit("added").alias("change"), F.col("new_field").alias("field"), F.lit("").alias("new_field")),
        retyped.select("stream", "file_no", F.lit("retyped").alias("change"), F.col("path").alias("field"), F.lit("").alias("new_field")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*names)


def match_renames(candidates: DataFrame, fields: DataFrame, there: DataFrame) -> DataFrame:
    """Which of the candidates (stream, file_no, field, new_field) are renames, one to one in each file.

    Only fields that are candidates somewhere are looked into, and only their marks are counted; everything else here
    is as small as the schemas, not as the records.
    """
    pairs = spool(candidates.select("field", "new_field").distinct(), "drift-pairs")
    files_of = there.select("stream", "file_no", "path")
    support = files_of.groupBy("path").agg(F.count("*").alias("n"))
    side_by_side = (
        pairs.join(files_of.withColumnRenamed("path", "field"), "field")
        .join(files_of.withColumnRenamed("path", "new_field"), ["stream", "file_no", "new_field"])
        .groupBy("field", "new_field")
        .agg(F.count("*").alias("together"))
    )
    asked = pairs.select(F.explode(F.array("field", "new_field")).alias("path")).distinct()
    marked = fields.where("type is not null").join(asked, "path").select("path", F.explode(F.pandas_udf(marks_of, "array<string>")("type", "value")).alias("mark"))
    counts = spool(marked.groupBy("path", "mark").agg(F.count("*").alias("c")), "drift-marks")
    share = counts.join(counts.groupBy("path").agg(F.sum("c").alias("all")), "path").select("path", "mark", (F.col("c") / F.col("all")).alias("share"))
    content = (
        pairs.join(share.select(F.col("path").alias("field"), "mark", F.col("share").alias("a")), "field")
        .join(share.select(F.col("path").alias("new_field"), "mark", F.col("share").alias("b")), ["new_field", "mark"])
        .groupBy("field", "new_field")
        .agg(F.sum(F.least("a", "b")).alias("content"))
    )

    def words(name: str) -> Column:
        spaced = F.regexp_replace(F.element_at(F.split(name, r"\."), -1), "([a-z0-9])([A-Z])", "$1_$2")
        return F.array_distinct(F.split(F.lower(spaced), "[_-]+"))

    related = F.size(F.array_intersect(words("field"), words("new_field"))) / F.size(F.array_union(words("field"), words("new_field")))
    scored = (
        pairs.join(side_by_side, ["field", "new_field"], "left")
        .join(content, ["field", "new_field"], "left")
        .join(support.select(F.col("path").alias("field"), F.col("n").alias("n_old")), "field")
        .join(support.select(F.col("path").alias("new_field"), F.col("n").alias("n_new")), "new_field")
        .withColumn("related", related)
        .withColumn("content", F.coalesce("content", F.lit(0.0)))
        .where(F.coalesce("together", F.lit(0)) <= TOGETHER * F.least("n_old", "n_new"))
        .where((F.col("content") >= SAME_CONTENT) | ((F.col("content") >= SAME_CONTENT_NAMED) & (F.col("related") >= RELATED_NAME)))
        .select("field", "new_field", (F.col("content") + F.col("related")).alias("score"))
    )
    open_pairs = spool(candidates.join(scored, ["field", "new_field"]), "drift-open")
    found = open_pairs.select("stream", "file_no", "field", "new_field").limit(0)
    while not open_pairs.isEmpty():  # mutual best choice, then again among what is left; every round takes the best of all
        best_new = F.row_number().over(Window.partitionBy("stream", "file_no", "field").orderBy(F.desc("score"), "new_field"))
        best_old = F.row_number().over(Window.partitionBy("stream", "file_no", "new_field").orderBy(F.desc("score"), "field"))
        ranked = open_pairs.withColumn("_n", best_new).withColumn("_o", best_old)
        chosen = spool(ranked.where("_n = 1 and _o = 1").select("stream", "file_no", "field", "new_field"), "drift-renames")
        found = found.unionByName(chosen)
        open_pairs = spool(open_pairs.join(chosen.select("stream", "file_no", "field"), ["stream", "file_no", "field"], "left_anti").join(chosen.select("stream", "file_no", "new_field"), ["stream", "file_no", "new_field"], "left_anti"), "drift-open")
    return found
