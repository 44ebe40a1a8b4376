"""Incremental operators: the first-seen index, baseline differences, counters, rate limits and expiring values.

Every stream operator has a batch form that gives the same rows once all input
is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netloom.functions import urls as U
from netloom.schema import FEED_INDEX
from netloom.sources.sinks import load_version, save_version

INDEX = [c.split()[0] for c in FEED_INDEX.split(", ")]


def join_sources(lists: Column) -> Column:
    """Sorted comma list of all sources in an array of comma lists."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(lists, lambda s: F.split(s, ","))), lambda s: s != ""))), ",")


def batch_rows(batch: DataFrame, seen_at: Column) -> DataFrame:
    """One index row for each address of a delivery; the first row by batch_row (or url) gives the texts."""
    order = F.col("batch_row") if "batch_row" in batch.columns else F.col("url")
    b = batch.where("url is not null").withColumn("url_norm", U.normalize_url(F.col("url"))).withColumn("_o", order)
    g = b.groupBy("url_norm").agg(
        F.min_by("url", "_o").alias("url"), F.max("label").cast("tinyint").alias("label"), F.min("label").alias("lo"),
        F.min_by("threat", F.when(F.col("threat").isNotNull(), F.col("_o"))).alias("threat"), join_sources(F.collect_set("source")).alias("sources"),
        F.min("feed_time").alias("feed_time"), F.min_by("target", F.when(F.col("target").isNotNull(), F.col("_o"))).alias("target"),
    )
    return g.select("url_norm", "url", "label", "threat", "sources", seen_at.alias("first_seen"), seen_at.alias("last_seen"), "feed_time", "target", (F.col("label") != F.col("lo")).alias("label_conflict"))


def merge(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with new rows: a known address keeps its texts and first_seen; label rises, conflicts stick, sources add up."""
    n = rows.select("url_norm", *[F.col(c).alias(f"n_{c}") for c in INDEX if c != "url_norm"])
    m = index.join(n, "url_norm", "full_outer")
    old, new = F.col("first_seen").isNotNull(), F.col("n_first_seen").isNotNull()
    both = old & new
    keep = lambda c: F.when(old, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c)
    return m.select(
        "url_norm", keep("url"), F.greatest("label", "n_label").alias("label"), keep("threat"),
        F.when(both, join_sources(F.array("sources", "n_sources"))).otherwise(F.coalesce("sources", "n_sources")).alias("sources"),
        keep("first_seen"), F.coalesce("n_last_seen", "last_seen").alias("last_seen"), keep("feed_time"), keep("target"),
        F.when(both, F.col("label_conflict") | F.col("n_label_conflict") | (F.col("label") != F.col("n_label"))).otherwise(F.coalesce("label_conflict", "n_label_conflict")).alias("label_conflict"),
    )


def build_index(batches: DataFrame, day: str = "batch_day") -> DataFrame:
    """The index after all deliveries, in one pass: per day first, then over the days.

    Equal to merging the days one after another in order.
    """
    b = batches.where("url is not null").withColumn("url_norm", U.normalize_url(F.col("url")))
    at = F.col(day).cast("timestamp")
    order = F.struct(F.col(day), F.col("batch_row"))
    # the first day of an address gives its texts; within that day the first row that has one
    first = b.groupBy("url_norm").agg(F.min(day).alias("_d"))
    d0 = b.join(first, "url_norm").where(F.col(day) == F.col("_d")).groupBy("url_norm").agg(
        F.min_by("url", "batch_row").alias("url"), F.min_by("threat", F.when(F.col("threat").isNotNull(), F.col("batch_row"))).alias("threat"),
        F.min("feed_time").alias("feed_time"), F.min_by("target", F.when(F.col("target").isNotNull(), F.col("batch_row"))).alias("target"),
    )
    g = b.groupBy("url_norm").agg(
        F.max("label").cast("tinyint").alias("label"), join_sources(F.collect_set("source")).alias("sources"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"),
        (F.min("label") != F.max("label")).alias("label_conflict"), F.min(order).alias("_o"),
    ).drop("_o")
    return g.join(d0, "url_norm").select(*INDEX)


def run_index_stream(stream: DataFrame, path: str, checkpoint: str, seen: Column | None = None) -> StreamingQuery:
    """Merges every micro-batch into the versioned index under ``path``; a batch that is replayed writes the same version."""
    spark = stream.sparkSession

    def upsert(batch: DataFrame, version: int) -> None:
        at = seen if seen is not None else F.current_timestamp()
        index = load_version(spark, path, FEED_INDEX)
        save_version(merge(index, batch_rows(batch, at)), path, version)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_entries(stream: DataFrame, feed: str = "feed", key: str = "domain", at: str = "ts", late: str = "7 days") -> DataFrame:
    """Entries of each feed not seen before; works on streams (state within the watermark) and on tables."""
    if stream.isStreaming:
        return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([feed, key])
    return stream.groupBy(feed, key).agg(F.min(at).alias(at))


def after_baseline(entries: DataFrame, feed: str = "feed", at: str = "ts") -> DataFrame:
    """Without what a feed's first poll already held (batch form)."""
    base = entries.groupBy(feed).agg(F.min(at).alias("_first"))
    return entries.join(F.broadcast(base), feed).where(F.col(at) > F.col("_first")).drop("_first")


def recent(df: DataFrame, now: Column, hours: float, at: str = "first_seen") -> DataFrame:
    return df.where(F.unix_micros(at) >= F.unix_micros(now) - F.lit(int(hours * 3.6e9)))


def daily_counts(df: DataFrame, key: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """(key, day, n) per UTC day; on a stream a day closes when the watermark passes it."""
    d = df.withWatermark(at, late) if df.isStreaming else df
    return d.groupBy(F.col(key), F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n")).select(key, F.to_date("w.start").alias("day"), "n")


BUCKET_OUT = "key string, ts timestamp, allowed boolean, tokens double, retry_after_s double"
BUCKET_STATE = "tokens double, last double"


def token_bucket(events: DataFrame, key: str, at: str, capacity: float, refill_per_s: float) -> DataFrame:
    """Each event of a key with the verdict of its token bucket; state on a stream, one pass by time on a table."""

    def walk(pdf: pd.DataFrame, tokens: float, last: float | None) -> tuple[pd.DataFrame, float, float | None]:
        pdf = pdf.sort_values("ts", kind="stable")
        rows = []
        for k, ts in zip(pdf.key, pdf.ts):
            now = pd.Timestamp(ts).timestamp()
            tokens = capacity if last is None else min(capacity, tokens + max(0.0, now - last) * refill_per_s)
            ok = tokens >= 1.0
            tokens -= ok
            rows.append((k, ts, ok, tokens, 0.0 if ok else (1.0 - tokens) / refill_per_s))
            last = now if last is None else max(last, now)
        return pd.DataFrame(rows, columns=["key", "ts", "allowed", "tokens", "retry_after_s"]), tokens, last

    d = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("ts"))
    if not d.isStreaming:
        # one client's events are few against a task's memory; clients are spread by key
        return d.groupBy("key").applyInPandas(lambda pdf: walk(pdf, capacity, None)[0], BUCKET_OUT)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        for pdf in frames:
            out, tokens, last = walk(pdf, tokens, last)
            yield out
        state.update((float(tokens), None if last is None else float(last)))  # the state's fields take no whole numbers

    return d.groupBy("key").applyInPandasWithState(step, BUCKET_OUT, BUCKET_STATE, "append", GroupStateTimeout.NoTimeout)


def live_values(df: DataFrame, key: str, at: str, now: Column, ttl_s: float) -> DataFrame:
    """(key, at): the newest time of each key that hasn't expired by ``now``; a repeated put starts it anew."""
    return df.groupBy(key).agg(F.max(at).alias(at)).where(F.unix_micros(now) - F.unix_micros(at) < F.lit(int(ttl_s * 1e6)))


def capture_state(records: DataFrame, max_failures: int = 3) -> DataFrame:
    """(host, done, failures): whether a host has a good capture, and whether it may be tried again."""
    good = F.coalesce(F.col("dns.resolves"), F.lit(False))
    g = records.groupBy("host").agg(F.max(good).alias("done"), F.count_if(~good).alias("failures"), F.max("captured_at").alias("last_at"))
    return g.withColumn("retry", ~F.col("done") & (F.col("failures") < max_failures))


def plan_captures(targets: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """The next hosts to capture: new or retryable, phishing first, newest first, one of each domain marked for registration data."""
    from pyspark.sql import Window

    t = targets.join(state.select("host", "done", "retry"), "host", "left").where(F.col("done").isNull() | F.col("retry"))
    order = [F.col("label").desc_nulls_last(), F.col("first_seen").desc_nulls_last(), F.col("host")]
    t = t.dropDuplicates(["host"]).withColumn("with_domain", F.row_number().over(Window.partitionBy("domain").orderBy(*order)) == 1)
    return t.orderBy(*order).limit(cap).drop("done", "retry")


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New parquet files of a folder as a stream; finished files aren't read again after a restart."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
