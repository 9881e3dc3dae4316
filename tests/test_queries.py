"""Every core query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import DATA, duck, duck_rows, rows

from pairloom.plans import io, reference, suites, traces, training

FOLDER = f"{DATA}/sf0.001"
REGISTRIES = [training.REGISTRY, reference.REGISTRY, traces.REGISTRY, io.REGISTRY, suites.REGISTRY]
BOTH = [(r, n) for r in REGISTRIES for n in r.sql]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize(("registry", "name"), BOTH, ids=[n for _, n in BOTH])
def test_query_matches_sql(spark, con, registry, name):
    df = registry.queries[name](spark, FOLDER)
    names, want = duck_rows(con, registry.sql[name])
    assert sorted(df.columns) == names
    assert rows(df) == want


WITHOUT = [(r, n) for r in REGISTRIES for n in r.queries if n not in r.sql]


@pytest.mark.parametrize(("registry", "name"), WITHOUT, ids=[n for _, n in WITHOUT])
def test_query_without_sql_has_whole_rows(spark, registry, name):
    df = registry.queries[name](spark, f"{DATA}/sf0.01")
    got = rows(df)
    assert got and len(df.columns) == len(set(df.columns)) and any(v is not None for v in got[0])


def test_entry_works_without_the_optional_part(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "pairloom.llm", None)
    entry = importlib.reload(__spark_entry__)
    assert entry.entry(spark).count() > 0
    assert not any(n.startswith(("p1_", "p8_")) for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
