"""Connected components by union-find in local forests that are merged level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.skew import SALTS, hot_keys, salted_join
from netloom.plans.materialise import materialise


class Forest:
    """Union-find with path halving; the smallest node of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        r = up.setdefault(x, x)
        while r != up[r]:
            up[r] = up[up[r]]
            r = up[r]
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of one partition as a forest (node, root)."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy().tolist()):
            forest.join(a, b)
    nodes = np.fromiter(forest.up, dtype=np.int64, count=len(forest.up))
    roots = np.fromiter((forest.find(int(x)) for x in nodes), dtype=np.int64, count=len(nodes))
    for at in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000]), pa.array(roots[at : at + 100_000])], names=["node", "root"])


#: A task of a level gets about so many links at most.
LINKS = 1_000_000


def components(edges: DataFrame, fan_in: int = 4, levels: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: bigint) by union-find in local forests that are merged level by level.

    Each level joins the edges of a partition in a local forest.  Nodes that
    got several roots link these roots; the links are the edges of the next
    level, which has fewer partitions and only the roots still to be joined.
    The edges of a node with a large share of them are spread over
    ``SALTS`` partitions; each makes a star of its own, and the links of the
    next level tie the stars together.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = None
    for level in range(levels):
        spread: Column = F.lit(0)
        if hot := [k for (k,) in hot_keys(edges, ["a"])]:
            spread = F.when(F.col("a").isin(hot), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        local = edges.select("a", "b", spread.alias("salt")).repartition(n, "a", "salt").select("a", "b").mapInArrow(_local_forest, "node bigint, root bigint")
        forest = materialise(local, f"forest-{level}")
        best = forest.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
        split = best.where("root <> other").select("node", F.col("root").alias("low"))
        links = materialise(forest.join(split, "node").where("root <> low").select(F.col("low").alias("a"), F.col("root").alias("b")).distinct(), f"links-{level}")
        step = best.select("node", "root")
        top = step if top is None else salted_join(top, step.select(F.col("node").alias("root"), F.col("root").alias("up")), ["root"], "left").select("node", F.coalesce("up", "root").alias("root"))
        left = links.count()
        if not left:
            return top
        top = materialise(top, f"roots-{level}")
        edges, n = links, max(1, n // fan_in, -(-left // LINKS))
    raise RuntimeError(f"components didn't settle in {levels} levels")
