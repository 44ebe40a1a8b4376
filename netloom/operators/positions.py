"""Exact positions within groups of any size by one global range sort.

The rows are range-partitioned and sorted by group and order; every partition
numbers its rows and notes where the run of each group begins.  A prefix sum
over the partitions' counts (as many numbers as there are partitions) turns
this into global positions, and subtracting the group's start gives the
position in the group.  A group that holds most of the rows is spread over
many partitions like any other stretch of the order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.plans.materialise import materialise


def _number(group: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, last, run_start, any_row = TaskContext.get().partitionId(), 0, None, 0, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = batch.column(batch.schema.get_field_index(group)).dictionary_encode()
            first = codes.dictionary[codes.indices[0].as_py()].as_py()
            idx = codes.indices.to_numpy(zero_copy_only=False)
            new = np.empty(n, dtype=bool)
            new[1:] = idx[1:] != idx[:-1]
            new[0] = not any_row or first != last
            starts = np.where(new, np.arange(at, at + n), -1)
            starts[0] = max(starts[0], run_start) if not new[0] else starts[0]
            starts = np.maximum.accumulate(starts)
            run_start, last, any_row = int(starts[-1]), codes.dictionary[int(idx[-1])].as_py(), True
            columns = [*batch.columns, pa.array(np.full(n, pid, dtype=np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64)), pa.array(starts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_pid", "_idx", "_run"])
            at += n

    return run


def positions(df: DataFrame, group: str, order: Sequence[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with the 0-based ``name`` of each row in its group (a string or number, not null) by ``order``.

    ``order`` should be total; rows that tie in all of it are numbered in any order.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_idx", T.LongType()), T.StructField("_run", T.LongType())])
    ordered = df.repartitionByRange(n, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    numbered = materialise(ordered.mapInArrow(_number(group), schema), "positions")
    ends = numbered.groupBy("_pid").agg(
        F.count("*").alias("n"), F.min_by(group, "_idx").alias("first"), F.max_by(group, "_idx").alias("last"), F.max("_run").alias("run")
    )
    offset, carried, before = 0, 0, None
    rows = []
    for r in sorted(ends.collect(), key=lambda r: r["_pid"]):
        same = before is not None and r["first"] == before
        first_start = carried if same else offset
        rows.append((r["_pid"], offset, first_start))
        carried = first_start if r["run"] == 0 else offset + r["run"]
        offset, before = offset + r["n"], r["last"]
    starts = F.broadcast(spark.createDataFrame(rows, "_pid int, _off bigint, _first bigint"))
    start = F.when(F.col("_run") == 0, F.col("_first")).otherwise(F.col("_off") + F.col("_run"))
    return numbered.join(starts, "_pid").withColumn(name, F.col("_off") + F.col("_idx") - start).drop("_pid", "_idx", "_run", "_off", "_first")


#: A group's rows are ranked in so many parts before the best of each part meet.
PARTS = 64


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int | Column, name: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each group by a total ``order``, with their rank (from 1) as ``name``.

    Ranked within hash parts of each group first, so a group that holds much
    of the table is cut down in parallel; then within the group.
    """
    part = df.withColumn("_part", F.pmod(F.xxhash64(*[c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), F.lit(PARTS)))
    few = part.withColumn(name, F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))).where(F.col(name) <= k)
    return few.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= k).drop("_part")
