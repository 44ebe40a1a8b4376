"""Columns that are worked out once, whatever is done with them afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns behind a generator.

    The optimizer merges neighbouring projections and pushes filters through
    them, which repeats a costly expression for each of its uses; it doesn't
    look through the generator of a one-element array.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(packed).alias("_once")).select(*kept, "_once.*")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, for values that an expression names several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; a table read in more stays as it is, without a shuffle."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df
