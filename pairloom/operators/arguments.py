"""Scores of tool arguments: typed comparison of JSON values, field by field.

JSON equality, containment and text similarity need typed values, so this is one Arrow function over pairs of JSON
texts; what pairs with what, and what a pair's score counts for, is SQL.

Which rule compares a field: a rule named for the field, else the default. ``auto`` takes texts that differ in case and
white space only as equal, then asks the tool's schema (see :func:`schema_rule`), and without an answer compares texts
by their longest common blocks, numbers by relative distance, containers by containment and all else by equality.

Defined results: a null or empty text is an object without fields; text that is no JSON object (doubly encoded ones are
decoded) scores 0, even against itself; keys that begin with an underscore are ignored; no keys left to compare score 1;
a rule without a name here means equality; ``semantic`` compares as text when there are no embeddings.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.05
# Formats of texts that are read by machines, and names of fields that hold identifiers.
EXACT_FORMATS = {"date", "date-time", "time", "uuid", "email", "uri"}
IDENTIFIER = re.compile(r"(?:^|_)ids?$", re.I)


def decoded(text: str | None) -> dict | None:
    """The object in a JSON text, once more decoded if it is a text itself; None if it is none."""
    value: object = text or "{}"
    for _ in range(2):
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                return None
    return value if isinstance(value, dict) else None


def contained(part: object, whole: object) -> bool:
    """Recursive containment; items of a list may find the same match twice."""
    match part, whole:
        case dict(), dict():
            return part.keys() <= whole.keys() and all(contained(v, whole[k]) for k, v in part.items())
        case list(), list():
            return not [x for x in part if not any(contained(x, y) for y in whole)]
    return part == whole


def closeness(a: object, b: object, tolerance: float) -> float:
    """1 less the relative difference over the tolerance; what does not read as a number scores 0."""
    try:
        x, y = (float(v) for v in (a, b))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0
    gap = abs(x - y) / max(abs(x), abs(y), 1e-9)
    return max(0.0, 1 - gap / max(tolerance, 1e-9))


def kind_of(value: object) -> str:
    """What ``auto`` goes by: text, number (no booleans), container or other."""
    if isinstance(value, str):
        return "text"
    if isinstance(value, (dict, list)):
        return "container"
    return "number" if isinstance(value, (int, float)) and value is not True and value is not False else "other"


def similarity(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def folded(text: str) -> str:
    return " ".join(text.split()).casefold()


RULES = {
    "exact": lambda a, b, tolerance: float(a == b),
    "subset": lambda a, b, tolerance: float(contained(a, b)),
    "numeric": closeness,
    "semantic": lambda a, b, tolerance: float(str(a) == str(b)),
}


def schema_rule(schema: dict | None, field: str) -> str | None:
    """The rule that a field's JSON schema asks for; None if it says nothing (no schema, or free text)."""
    if not isinstance(schema, dict):
        return None
    kinds = schema.get("type")
    kind = next((k for k in ([kinds] if isinstance(kinds, str) else kinds or []) if isinstance(k, str) and k != "null"), None)
    if kind in ("object", "array"):
        return "subset"
    if schema.get("enum") is not None or kind == "boolean" or schema.get("format") in EXACT_FORMATS or IDENTIFIER.search(field):
        return "exact"
    return "numeric" if kind in ("integer", "number") else None


def field_score(a: object, b: object, strategy: str = "auto", tolerance: float = TOLERANCE, strict: bool = True, schema: dict | None = None, field: str = "") -> float:
    """Score of one field; a side that lacks the value scores 0, or a half if not strict."""
    if a is None or b is None:
        return 1.0 if a is b else 0.0 if strict else 0.5
    if strategy != "auto":
        return RULES.get(strategy, RULES["exact"])(a, b, tolerance)
    texts = kind_of(a) == kind_of(b) == "text"
    if texts and folded(a) == folded(b):
        return 1.0
    if named := schema_rule(schema, field):
        return RULES[named](a, b, tolerance)
    if texts:
        return similarity(a, b)
    both = {"number": "numeric", "container": "subset"}.get(kind_of(a)) if kind_of(a) == kind_of(b) else None
    return RULES[both or "exact"](a, b, tolerance)


def call_score(
    a: str | None, b: str | None, strategy: str = "auto", tolerance: float = TOLERANCE, strict: bool = True,
    rules: dict[str, str] | None = None, only: set[str] | None = None, without: set[str] | None = None, schemas: dict[str, dict] | None = None,
) -> float:
    """Mean field score over the keys of either side, or over ``only`` these, less those in ``without``."""
    x, y = decoded(a), decoded(b)
    if x is None or y is None:
        return 0.0
    keys = sorted(k for k in (x.keys() | y.keys() if only is None else only) if not k.startswith("_") and k not in (without or ()))
    scores = [field_score(x.get(k), y.get(k), (rules or {}).get(k, strategy), tolerance, strict, (schemas or {}).get(k), k) for k in keys]
    return sum(scores) / len(scores) if scores else 1.0


def argument_score(a: Column, b: Column, strategy: str = "auto", tolerance: float = TOLERANCE, strict: bool = True, rules: dict[str, str] | None = None) -> Column:
    """Column form of :func:`call_score`."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([call_score(p, q, strategy, tolerance, strict, rules) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def expectation_scores(met: DataFrame, strategy: str = "auto", tolerance: float = TOLERANCE, strict: bool = False, rules: dict[str, str] | None = None) -> DataFrame:
    """Add source_score and target_score to expected calls (arguments, match_strategy) met by source_made and target_made
    (argument texts; null if the call was not made; with source_met and target_met telling which).

    A call that was not made scores 0. Fields that neither side produced are a stale expectation and count for neither;
    unless the expectation is ``exact``, only its own fields are compared.
    """

    @F.pandas_udf("source_score double, target_score double")
    def score(wanted: pd.Series, how: pd.Series, source: pd.Series, source_met: pd.Series, target: pd.Series, target_met: pd.Series) -> pd.DataFrame:
        out = []
        for w, h, s, s_met, t, t_met in zip(wanted, how, source, source_met, target, target_met):
            recorded = {k for k in decoded(w) or {} if not k.startswith("_")}
            produced = {k for text, there in ((s, s_met), (t, t_met)) if there for k in decoded(text) or {}}
            only = None if h == "exact" else recorded
            out.append([call_score(w, text, strategy, tolerance, strict, rules, only, recorded - produced) if there else 0.0 for text, there in ((s, s_met), (t, t_met))])
        return pd.DataFrame(out, columns=["source_score", "target_score"], dtype="float64")

    return met.withColumn("_s", score("arguments", "match_strategy", "source_made", "source_met", "target_made", "target_met")).select("*", "_s.*").drop("_s")
