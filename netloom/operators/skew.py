"""Joins that survive keys holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
SALTS = 32
#: A key is hot from this share of the rows on, so at most 1/share keys can be.
HOT_SHARE = 1 / 500


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> list[tuple]:
    """All keys with at least ``share`` of the rows of ``df``; at most ``1/share`` by construction.

    First the rows are counted in ``BUCKETS`` hash buckets (a result of bounded
    size); only rows of buckets that can hold a hot key are then grouped by key.
    Null keys never match in a join and don't count.
    """
    own = df.select(*keys).dropna()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    sizes = {r[0]: r[1] for r in own.groupBy(bucket.alias("b")).count().collect()}
    least = max(2, share * sum(sizes.values()))
    heavy = [b for b, n in sizes.items() if n >= max(least, 10_000)]
    if not heavy:
        return []
    found = own.where(bucket.isin(heavy)).groupBy(*keys).count().where(F.col("count") >= least)
    return [tuple(r)[:-1] for r in found.collect()]


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot: list[tuple] | None = None, hint: str | None = None) -> DataFrame:
    """Equi-join where the rows of ``left`` with a hot key are spread over ``SALTS`` tasks.

    ``right`` rows with such a key are repeated once per salt; all others move
    as in a plain join.  ``how`` may be inner, left, left_semi or left_anti.
    ``hint`` is the join hint of ``right``, such as merge where its columns are
    wider than the planner can tell, so that it would be broadcast.
    """
    hinted = lambda d: d.hint(hint) if hint else d
    hot = hot_keys(left, keys) if hot is None else hot
    if not hot:
        return left.join(hinted(right), list(keys), how)
    spark = left.sparkSession
    schema = T.StructType([left.schema[k] for k in keys])
    flags = F.broadcast(spark.createDataFrame(hot, schema).withColumn("_hot", F.lit(True)))
    spread: Column = F.pmod(F.xxhash64(*[c for c in left.columns if not isinstance(left.schema[c].dataType, T.MapType)]), F.lit(SALTS)).cast("int")
    a = left.join(flags, list(keys), "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot")
    b = right.join(flags, list(keys), "left")
    b = b.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(hinted(b), [*keys, "_salt"], how).drop("_salt")
