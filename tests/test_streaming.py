"""A stream run to its end gives what the batch form gives."""

import pytest
from pyspark.sql import functions as F

from netloom.streaming import index

ROWS = [("f1", "a.com", f"2023-01-0{1 + i % 3} {i % 24:02d}:00:00") for i in range(30)] + [("f2", "b.com", "2023-01-02 10:00:00"), ("f1", "c.com", "2023-01-03 10:00:00"), ("f2", "b.com", "2023-01-04 10:00:00")]
SCHEMA = "feed string, domain string, t string, ts timestamp"


@pytest.fixture
def both(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "feed string, domain string, t string").withColumn("ts", F.to_timestamp("t"))
    for day in sorted({r[2][:10] for r in ROWS}):
        df.where(F.col("t").startswith(day)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, lambda: index.file_stream(spark, str(tmp_path / "in"), SCHEMA), tmp_path


def drain(spark, stream, name, path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_new_entries(spark, both):
    df, stream, path = both
    got = drain(spark, index.new_entries(stream()), "entries", path)
    assert sorted((r.feed, r.domain) for r in got.collect()) == sorted((r.feed, r.domain) for r in index.new_entries(df).collect())
    assert {(r.feed, r.domain) for r in index.after_baseline(index.new_entries(df)).collect()} == {("f1", "c.com")}


def test_daily_counts(spark, both):
    df, stream, path = both
    got = drain(spark, index.daily_counts(stream(), "feed"), "days", path, "complete")
    key = lambda d: sorted((r.feed, r.day, r.n) for r in d.collect())
    assert key(got) == key(index.daily_counts(df, "feed"))


def test_token_bucket(spark, both):
    df, stream, path = both
    got = drain(spark, index.token_bucket(stream(), "feed", "ts", 3, 1e-5), "bucket", path)
    key = lambda d: sorted((r.key, r.ts, r.allowed) for r in d.collect())
    assert key(got) == key(index.token_bucket(df, "feed", "ts", 3, 1e-5))


def test_expiry_and_recent(spark, both):
    df, _, _ = both
    now = F.lit("2023-01-04 12:00:00").cast("timestamp")
    assert {r.domain for r in index.live_values(df, "domain", "ts", now, 21_600).collect()} == {"b.com"}
    assert index.recent(df, now, 6, "ts").count() == 1
