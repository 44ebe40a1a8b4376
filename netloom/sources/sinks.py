"""Writers: typed tables with atomic commits, parts, cards, versioned indexes and list documents."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.schema import validate


def write_interim(df: DataFrame, path: str) -> None:
    """Validated rows as zstd parquet; a failed job leaves no ``_SUCCESS``."""
    validate(df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_parts(rows: DataFrame, corpus: DataFrame, path: str) -> None:
    """Full rows of the corpus' uids, a folder for each part; html joins only here."""
    rows.join(corpus.select("uid", "part", "weight"), "uid").write.mode("overwrite").partitionBy("part").parquet(path)


def write_meta(df: DataFrame, path: str) -> None:
    df.drop("html").write.mode("overwrite").parquet(path)


def write_daily(df: DataFrame, path: str, day: str, source: str) -> None:
    """Appends a feed's delivery under its day and source."""
    df.withColumn("day", F.lit(day)).withColumn("source", F.lit(source)).write.mode("append").partitionBy("day", "source").parquet(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def write_table_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A report table (small by nature) as one csv with header and ISO times."""
    d = df.orderBy(*order) if order else df
    times = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]
    d.select(*times).coalesce(1).write.mode("overwrite").options(header="true", lineSep="\n").csv(path)


def write_card(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        write_table_csv(df, f"{path}/{name}")


def save_version(df: DataFrame, path: str, version: int) -> str:
    """A full rewrite under a new version; readers switch when the pointer table says so."""
    at = f"{path}/v={version:06d}"
    df.write.mode("overwrite").parquet(at)
    df.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").json(f"{path}/_versions")
    return at


def load_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version, or an empty table where none was ever written; a pointer that can't be read is an error."""
    jvm = spark.sparkContext._jvm
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    if not pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(pointer):
        return spark.createDataFrame([], schema)
    lines = spark.read.schema("version int, _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{path}/_versions").select("version", "_bad").collect()
    if not lines or any(r["_bad"] is not None or r["version"] is None for r in lines):
        raise ValueError(f"damaged version pointer in {path}/_versions")
    return spark.read.schema(schema).parquet(f"{path}/v={max(r['version'] for r in lines):06d}")


def canonical_json(doc: dict) -> bytes:
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode("utf-8")


def write_lists(entries: DataFrame, path: str) -> None:
    """List entries sorted within range partitions of each list; a client reads the files of a list in order."""
    entries.repartitionByRange("list", "entry").sortWithinPartitions("list", "entry").write.mode("overwrite").partitionBy("list").text(path)


def write_seeds(df: DataFrame, path: str, skip: Sequence[str] = ()) -> None:
    d = df.where((F.col("label") == 0) & ~F.col("source").isin(list(skip) or [""])).select("domain").distinct()
    d.sortWithinPartitions("domain").write.mode("overwrite").text(path)


def render_index(sample: DataFrame, statuses: DataFrame) -> DataFrame:
    """Sample rows with the newest status of each page; pages without one are pending."""
    s = statuses.groupBy("page_id").agg(F.max_by("status", "at").alias("status"))
    return sample.join(s, "page_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def todo(sample: DataFrame, statuses: DataFrame, retry_failed: bool = False) -> DataFrame:
    done = render_index(sample, statuses).where(F.col("status") != "pending")
    done = done.where(F.col("status") != "failed") if retry_failed else done
    return sample.join(done.select("page_id"), "page_id", "left_anti")
