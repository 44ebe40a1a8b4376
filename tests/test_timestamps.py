"""Dates of every habit, against instants worked out by hand and by the standard library."""

import datetime as dt
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.operators import timestamps as ts

SOURCES = [("us", "America/New_York", False), ("de", "Europe/Berlin", True), ("in", "Asia/Kolkata", True), ("utc", "UTC", False)]


def run(spark, rows, extra=()):
    cfg = spark.createDataFrame(SOURCES, "source string, tz_name string, day_first boolean")
    df = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(rows)], "row_id bigint, source string, date string")
    for c in extra:
        df = df.withColumn(c, df.row_id)
    return {r.row_id: r for r in ts.to_utc(df, cfg).collect()}


def micros(text):
    return int((dt.datetime.fromisoformat(text) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))


CASES = [
    ("de", "2023-01-04T05:06:07Z", "2023-01-04T05:06:07+00:00"),
    ("de", "2023-01-04 05:06:07", "2023-01-04T04:06:07+00:00"),
    ("de", " 04/01/2023 05:06:07", "2023-01-04T04:06:07+00:00"),
    ("us", "04/01/2023 05:06:07", "2023-04-01T09:06:07+00:00"),
    ("us", "15.01.2023 04:09", "2023-01-15T09:09:00+00:00"),
    ("in", "2023-01-09T23:00:00.123456789", "2023-01-09T17:30:00.123456+00:00"),
    (" DE ", "Mon, 16 Jan 2023 14:25:29 GMT", "2023-01-16T14:25:29+00:00"),
    ("de", "Sun, 15 Jan 2023 23:12:28 -0330", "2023-01-16T02:42:28+00:00"),
    ("us", "Jan 1, 2023 12:05:00 AM", "2023-01-01T05:05:00+00:00"),
    ("us", "Jan 1, 2023 12:05:00 PM", "2023-01-01T17:05:00+00:00"),
    ("de", "20230113T182607Z", "2023-01-13T18:26:07+00:00"),
    ("de", "2023-01-13t18:26:07.5z", "2023-01-13T18:26:07.500000+00:00"),
    ("de", "2023-07-01 10:00:00 CEST", "2023-07-01T08:00:00+00:00"),
    ("us", "2023-01-23T15:29:31+05:30[Asia/Kolkata]", "2023-01-23T09:59:31+00:00"),
    ("de", "4 Mar 2023, 22:56", "2023-03-04T21:56:00+00:00"),
    ("de", "2023-01-06", "2023-01-05T23:00:00+00:00"),
    ("de", "2023-03-26 02:30:00", "2023-03-26T01:30:00+00:00"),  # skipped
    ("de", "2023-10-29 02:30:00", "2023-10-29T00:30:00+00:00"),  # twice
    ("nobody", "2023-01-06 00:00", "2023-01-06T00:00:00+00:00"),
    (None, "2023-01-06 00:00", "2023-01-06T00:00:00+00:00"),
    ("us", "2024-07-01T10:00:00[America/Denver]", "2024-07-01T16:00:00+00:00"),
    ("us", "2024-07-01 10:00:00 Europe/Lisbon", "2024-07-01T09:00:00+00:00"),
    ("us", "Mon Jan 02 2023 15:04:05 GMT+0100 (CET)", "2023-01-02T14:04:05+00:00"),
    ("us", "Mon Jan  2 15:04:05 2023", "2023-01-02T20:04:05+00:00"),
    ("us", "Mon Jan  2 15:04:05 UTC 2023", "2023-01-02T15:04:05+00:00"),
    ("us", "[10/Oct/2000:13:55:36 -0700]", "2000-10-10T20:55:36+00:00"),
    ("us", "2023-01-02 15:04 UTC+2", "2023-01-02T13:04:00+00:00"),
    ("us", "2016-12-31T23:59:60Z", "2017-01-01T00:00:00+00:00"),
    ("utc", "20240305", "2024-03-05T00:00:00+00:00"),
    ("us", "1672611734.5094071", "2023-01-01T22:22:14.509407+00:00"),
    ("utc", "2020-W53-7", "2021-01-03T00:00:00+00:00"),
    ("utc", "2026W01", "2025-12-29T00:00:00+00:00"),
    ("utc", "2024-366T10:00", "2024-12-31T10:00:00+00:00"),
    ("utc", "2nd March 2023 at 10:00", "2023-03-02T10:00:00+00:00"),
    ("us", "2023-01-02T15:04:05−05:00", "2023-01-02T20:04:05+00:00"),
    ("de", "1672611734", "2023-01-01T22:22:14+00:00"),
    ("de", "1672611734509", "2023-01-01T22:22:14.509000+00:00"),
    ("de", "1672611734509407", "2023-01-01T22:22:14.509407+00:00"),
]
NOTHING = [None, "", " ", "-", "N/A", "unknown", "2025-02-30", "0000-00-00 00:00:00", "31/31/2024", "2023-01-01 25:00:00", "2023-01-01 10:00:00 XYZ", "Jan 1, 2023 13:05:00 AM", "12345", "x" * 100_000, "2021-W53", "2023-366", "2023-01-01T23:59:60Z", "2024-07-01T10:00:00[Nowhere/City]", "20241305", "2023-W00-1"]


def test_cases(spark):
    got = run(spark, [(s, d) for s, d, _ in CASES], extra=("wall", "zone"))
    for i, (s, d, want) in enumerate(CASES):
        assert got[i].utc_micros == micros(want), (s, d)
    assert [got[i].wall for i in (16, 17, 0, 1)] == ["skipped", "twice", "exact", "once"]


def test_no_instant(spark):
    assert all(r.utc_micros is None for r in run(spark, [("de", d) for d in NOTHING]).values())


def test_empty_table_and_exact_form(spark):
    assert run(spark, []) == {}
    cfg = spark.createDataFrame(SOURCES, "source string, tz_name string, day_first boolean")
    df = spark.createDataFrame([(1, "de", "2023-01-05T03:05:35.510650Z"), (2, "de", " 2023-01-05T03:05:35.510650Z"), (2, "de", " 2023-01-05T03:05:35.510650Z")], "row_id bigint, source string, date string")
    assert [r.row_id for r in ts.found(df, cfg).collect()] == [2, 2]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1971, 1, 1), dt.datetime(2099, 1, 1)), min_size=200, max_size=200), st.sampled_from(SOURCES))
def test_against_zoneinfo(spark, times, source):
    name, zone, _ = source
    got = run(spark, [(name, t.strftime("%Y-%m-%d %H:%M:%S.%f") if t.year > 999 else None) for t in times])
    for i, t in enumerate(times):
        want = t.replace(tzinfo=ZoneInfo(zone), fold=0)
        assert got[i].utc_micros == int((want - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1)), t
