"""Scalar functions on text and JSON: slugs, template variables, labels, canonical JSON and digests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def template_variables(template: Column) -> Column:
    """Root names of the fields of a format template, distinct, in order; doubled braces and numbers are no fields."""
    bare = F.regexp_replace(template, r"\{\{|\}\}", "")
    names = F.regexp_extract_all(bare, F.lit(r"\{([A-Za-z_][A-Za-z_0-9]*)[^{}]*\}"), 1)
    return F.array_distinct(names)


def missing_variables(template: Column, inputs: Column) -> Column:
    """Variables of a template that a JSON object lacks."""
    return F.array_except(template_variables(template), F.coalesce(F.json_object_keys(inputs), F.array().cast("array<string>")))


def signed(value: Column, digits: int = 2) -> Column:
    """A number with its sign; zero and what is not below it has a plus, the minus is U+2212."""
    body = F.format_string(f"%.{digits}f", F.abs(value))
    return F.when(value.isNotNull(), F.concat(F.when(value < 0, "−").otherwise("+"), body))


def per_cent(value: Column, digits: int = 1) -> Column:
    """A rate as per cent."""
    return F.concat(F.format_string(f"%.{digits}f", value * 100), F.lit("%"))


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, never below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / 1e6)


def canonical(text: str | None, compact: bool = True) -> str | None:
    """JSON with sorted keys: compact and unescaped, or with default separators and ASCII only. Null if no JSON."""
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if text is None:
        return None
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if compact else json.dumps(value, sort_keys=True)


def canonical_json(text: Column, compact: bool = True) -> Column:
    """Column form of :func:`canonical`."""

    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda t: canonical(t, compact))

    return F.pandas_udf(run, "string")(text)


def fingerprint(text: Column) -> Column:
    """Digest of a JSON text that does not depend on key order or spacing."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text), 256))


def tools_fingerprint(tools: Column) -> Column:
    """Digest of an array of structs (name, spec as JSON text) that does not depend on their order."""
    ordered = F.array_sort(F.transform(tools, lambda t: F.struct(t["name"].alias("name"), t["spec"].alias("spec"))))
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(ordered), 256))
