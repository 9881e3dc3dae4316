"""Shared session and helpers of the tests."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pairloom.session import build_session

    folder = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": f"file://{folder}",
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value that compares alike from both engines."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float):
        return round(value, 8) + 0.0
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return value


def rows(df):
    """Sorted rows with columns in order of their names."""
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
