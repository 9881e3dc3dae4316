"""Timestamp normalisation against an independent reading of each form."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows

from pairloom.operators.timestamps import _reader, capture_timestamps, normalise, slash_orders


def us(*parts, offset=0.0, micro=0):
    moment = datetime(*parts, tzinfo=timezone.utc) - timedelta(hours=offset)
    return int((moment - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000 + micro


CASES = [
    ("2026-06-03 14:11:00.83Z", None, None, us(2026, 6, 3, 14, 11, micro=830000)),
    ("2026-06-21T18:14:53.187829+09:00", None, None, us(2026, 6, 21, 18, 14, 53, offset=9, micro=187829)),
    ("2026-04-07t20:45:41.683530417z", None, None, us(2026, 4, 7, 20, 45, 41, micro=683530)),
    ("2026-09-05 10:00:00 +0545", None, None, us(2026, 9, 5, 10, offset=5.75)),
    ("2026-09-05T10:00:00-07", None, None, us(2026, 9, 5, 10, offset=-7)),
    ("20250415T085923Z", None, None, us(2025, 4, 15, 8, 59, 23)),
    ("20260518T181512.361Z", None, None, us(2026, 5, 18, 18, 15, 12, micro=361000)),
    ("1784691814", None, None, 1784691814_000000),
    ("1784691814.1234567", None, None, 1784691814_123456),
    ("1781579562690", None, None, 1781579562690_000),
    ("1761631431458100", None, None, 1761631431458100),
    ("Thu, 12 Mar 2026 00:20:52 +0100", None, None, us(2026, 3, 12, 0, 20, 52, offset=1)),
    ("Thu, 01 Jan 2026 07:32:51 GMT", "Asia/Tokyo", None, us(2026, 1, 1, 7, 32, 51)),
    ("2025-12-09 14:10:54 PST", "America/Los_Angeles", None, us(2025, 12, 9, 14, 10, 54, offset=-8)),
    ("2026-11-01 01:36:26 CDT", "America/Chicago", None, us(2026, 11, 1, 1, 36, 26, offset=-5)),
    ("2026-11-01 01:36:26 CST", "America/Chicago", None, us(2026, 11, 1, 1, 36, 26, offset=-6)),
    ("2026-01-02T03:51:46[Europe/Helsinki]", "Asia/Tokyo", None, us(2026, 1, 2, 3, 51, 46, offset=2)),
    ("2025-10-15 17:16:59 America/Chicago", None, None, us(2025, 10, 15, 17, 16, 59, offset=-5)),
    ("2026-04-28 14:17:53,875", "Europe/London", None, us(2026, 4, 28, 14, 17, 53, offset=1, micro=875000)),
    ("22/03/2025 23:54:44", "UTC", "dmy", us(2025, 3, 22, 23, 54, 44)),
    ("9/2/2026 4:21:04 PM", "UTC", "mdy", us(2026, 9, 2, 16, 21, 4)),
    ("3/9/2025 12:44:12 AM", "UTC", "mdy", us(2025, 3, 9, 0, 44, 12)),
    ("2026/10/05 23:09:47", "UTC", "ymd", us(2026, 10, 5, 23, 9, 47)),
]
NONE = [
    ("", "UTC", "dmy", "unreadable"), ("n/a", "UTC", "dmy", "unreadable"), (None, "UTC", "dmy", "unreadable"), ("x" * 5000, "UTC", "dmy", "unreadable"),
    ("2025-06-31 12:00:00", "UTC", None, "unreadable"), ("2026-13-05T08:00:00Z", None, None, "unreadable"), ("123456789012", None, None, "unreadable"),
    ("Fri, 12 Mar 2026 00:20:52 +0100", None, None, "unreadable"), ("9/2/2026 14:21:04 PM", "UTC", "mdy", "unreadable"), ("22/03/2025 23:54:44", "UTC", "mdy", "unreadable"),
    ("2026-03-29 02:30:00", "Europe/Berlin", None, "never"), ("2026-10-25 02:30:00", "Europe/Berlin", None, "twice"),
    ("2026-03-29 05:30:00", None, None, "no_zone"), ("2026-03-29 05:30:00 PST", "Asia/Tokyo", None, "no_zone"), ("2026-03-29 05:30:00 No/Where", "UTC", None, "no_zone"),
    ("03/04/2025 01:02:03", "UTC", None, "order_open"),
]


@pytest.mark.parametrize(("text", "zone", "order", "want"), CASES)
def test_reads(text, zone, order, want):
    status, _, got = _reader()(text, zone, order)
    assert (status, got) == ("ok", want)


@pytest.mark.parametrize(("text", "zone", "order", "status"), NONE)
def test_names_no_instant(text, zone, order, status):
    assert _reader()(text, zone, order)[::2] == (status, None)


def test_orders_come_from_the_declaration_or_the_values(spark):
    texts = spark.createDataFrame([(1, "25/01/2025 1:00:00"), (1, "03/04/2025 1:00:00"), (2, "01/25/2025 1:00:00"), (3, "03/04/2025 1:00:00"), (4, "25/01/2025 1:00:00"), (4, "01/25/2025 1:00:00"), (5, "03/04/2025 1:00:00"), (None, "03/04/2025 1:00:00")], "source_id int, text string")
    sources = spark.createDataFrame([(1, None), (2, None), (3, None), (4, None), (5, "mdy"), (6, None)], "source_id int, declared string")
    got = {r.source_id: r.order for r in slash_orders(texts, sources).collect()}
    assert got == {1: "dmy", 2: "mdy", 3: None, 4: None, 5: "mdy", 6: None}


def test_extra_columns_unknown_sources_and_empty_tables(spark):
    texts = spark.createDataFrame([(1, "03/04/2025 01:00:00", "kept", "other"), (9, "2026-01-01 00:00:00", "kept", "other"), (9, "2026-01-01 00:00:00 UTC", None, None)], "source_id int, text string, zone string, declared string")
    sources = spark.createDataFrame([(1, "UTC", "dmy"), (2, None, None)], "source_id int, zone string, declared string")
    got = normalise(texts, sources)
    assert [r["status"] for r in sorted(got.collect(), key=lambda r: (r.source_id, r.text))] == ["ok", "no_zone", "ok"]
    assert rows(normalise(texts.limit(0), sources)) == []
    assert {r.status for r in normalise(texts, sources.limit(0)).collect()} == {"order_open", "no_zone", "ok"}


def test_both_tables_are_read(spark):
    event = "array<struct<sequence_index:int,timestamp:string>>"
    captures = spark.createDataFrame([(1, 1, "2026-01-01T00:00:00Z", ([(0, "1784691814"), (1, None)],)), (2, 1, None, (None,)), (3, None, "1784691814", None)], f"row_id int, recorder_id int, created_at string, trace struct<events:{event}>")
    traces = spark.createDataFrame([(7, 1, [(4, "1784691814"), (4, "1784691814")])], f"row_id int, recorder_id int, events {event}")
    recorders = spark.createDataFrame([(1, "UTC", "dmy")], "recorder_id int, tz_name string, date_order string")
    got = sorted((r.table_name, r.row_id, r.sequence_index, r.utc_us) for r in capture_timestamps(captures, traces, recorders).collect())
    assert got == [("multi_round_tools", 1, 0, 1784691814_000000), ("multi_round_tools", 3, -1, 1784691814_000000)] + [("source_traces", 7, 4, 1784691814_000000)] * 2


def test_the_estimate_decides_without_a_declaration(spark):
    either = "03/04/2025 1:00:00"
    texts = [(1, "25/01/2025 1:00:00")] + [(1, either)] * 99  # one value settles the order of all
    texts += [(2, "25/01/2025 1:00:00"), (2, "01/25/2025 1:00:00"), (2, either)]  # both orders in use: only what is certain
    texts += [(3, "01/25/2025 1:00:00"), (3, either)]  # against the declaration
    texts += [(4, either), (5, "45/45/2025 1:00:00"), (6, " " * 90 + "2024-01-01   10:00:00")]
    df = spark.createDataFrame(texts, "source_id int, text string")
    sources = spark.createDataFrame([(1, "UTC", None), (2, "UTC", None), (3, "UTC", "dmy"), (4, "UTC", None), (5, "UTC", "dmy"), (6, "UTC", None)], "source_id int, zone string, declared string")
    got = normalise(df, sources).collect()
    status = lambda i, t=None: {r.status for r in got if r.source_id == i and (t is None or r.text == t)}
    assert status(1) == {"ok"} and {r.utc_us for r in got if r.source_id == 1 and r.text == either} == {us(2025, 4, 3, 1)}
    assert status(2, either) == {"order_open"} and status(2, "25/01/2025 1:00:00") == status(2, "01/25/2025 1:00:00") == {"ok"}
    assert status(3, either) == {"ok"} and status(3, "01/25/2025 1:00:00") == {"order_open"}
    assert status(4) == {"order_open"} and status(5) == {"unreadable"} and status(6) == {"ok"}
    assert all(r.posterior >= 0.99 for r in got if r.status == "ok") and [r.posterior for r in got if r.source_id == 4][0] < 0.6
