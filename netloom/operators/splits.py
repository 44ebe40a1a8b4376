"""Domain-grouped splits by hash rank, folds, and proofs that sides don't overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import urls as U
from netloom.operators.positions import top_per_group

TRAIN, CAL, TEST = "train", "cal", "test"


class LeakageError(AssertionError):
    """Two sides of a split share a domain or a page."""


def _take(domains: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Domains (domain, n, stratum) taken in hash order until each stratum's rows reach ``fraction``; the crossing one too.

    The running sum is over 256 hash slices first, then inside the one slice
    per stratum in which the target is crossed, so no window holds a stratum.
    """
    h = U.unit_hash(F.col("domain"), seed)
    d = domains.withColumn("_h", h).withColumn("_slice", F.floor(h * 256).cast("int"))
    slices = d.groupBy("stratum", "_slice").agg(F.sum("n").alias("m"))
    w = Window.partitionBy("stratum").orderBy("_slice")
    before = slices.select("stratum", "_slice", (F.sum("m").over(w) - F.col("m")).alias("_before"), F.sum("m").over(Window.partitionBy("stratum")).alias("_all"))
    inside = Window.partitionBy("stratum", "_slice").orderBy("_h", "domain").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = d.join(F.broadcast(before), ["stratum", "_slice"]).withColumn("_run", F.col("_before") + F.sum("n").over(inside) - F.col("n"))
    return run.where(F.col("_run") < F.lit(fraction) * F.col("_all")).select("domain")


def domain_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("domain").agg(F.count("*").alias("n"), (F.avg("label") >= 0.5).cast("int").alias("stratum"))


def grouped_split(df: DataFrame, test_fraction: float = 0.2, cal_fraction: float = 0.15, seed: int = 0) -> DataFrame:
    """(domain, split): test, then cal out of the rest, both stratified by the domain's majority label."""
    sizes = domain_sizes(df)
    test = _take(sizes, test_fraction, seed).withColumn("_t", F.lit(True))
    rest = sizes.join(test, "domain", "left_anti")
    cal = _take(rest, cal_fraction, seed + 1000).withColumn("_c", F.lit(True))
    out = sizes.join(test, "domain", "left").join(cal, "domain", "left")
    return out.select("domain", F.when(F.col("_t"), TEST).when(F.col("_c"), CAL).otherwise(TRAIN).alias("split"))


def grouped_splits(df: DataFrame, n: int = 10, test_fraction: float = 0.2, cal_fraction: float = 0.15, seed: int = 0) -> DataFrame:
    """(domain, split_0 .. split_{n-1}); seeds change the partition only."""
    out = domain_sizes(df).select("domain")
    for k in range(n):
        out = out.join(grouped_split(df, test_fraction, cal_fraction, seed + k).withColumnRenamed("split", f"split_{k}"), "domain")
    return out


def hash_split(key: Column, seed: int, shares: Sequence[tuple[str, float]]) -> Column:
    """Split by the unit hash of a key against cumulated shares; the last takes the rest."""
    h, at, out = U.unit_hash(key, seed), 0.0, F.lit(shares[-1][0])
    edges = []
    for name, share in shares[:-1]:
        at += share
        edges.append((name, at))
    for name, edge in reversed(edges):
        out = F.when(h < edge, F.lit(name)).otherwise(out)
    return out


def grouped_folds(domain: Column, n: int, seed: int = 0) -> Column:
    return F.pmod(F.conv(F.substring(U.rank_hash(domain, seed), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def shared_between(df: DataFrame, part: str = "part") -> DataFrame:
    """(kind, key, n_parts) of domains and page keys that occur on more than one side; empty if the split is clean."""
    d = df.where(F.col(part).isNotNull()).groupBy(F.lit("domain").alias("kind"), F.col("domain").alias("key")).agg(F.countDistinct(part).alias("n_parts"))
    u = df.where(F.col(part).isNotNull()).groupBy(F.lit("url").alias("kind"), U.url_key(F.col("url")).alias("key")).agg(F.countDistinct(part).alias("n_parts"))
    return d.unionByName(u).where("n_parts > 1")


def assert_disjoint(df: DataFrame, part: str = "part") -> None:
    bad = shared_between(df, part).limit(1).collect()
    if bad:
        raise LeakageError(f"{bad[0]['kind']} {bad[0]['key']!r} is on {bad[0]['n_parts']} sides")


def assert_no_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    if not a.select(*keys).intersect(b.select(*keys)).isEmpty():
        raise LeakageError("the two tables share keys")


def top_hashed(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """A fixed random sample of k rows (a top-k report, so the limit is the feature)."""
    return df.orderBy(U.rank_hash(F.col(key).cast("string"), seed), F.col(key)).limit(k)


def band_sample(df: DataFrame, bands: Sequence[tuple[int, int, int]], seed: int, rank: str = "rank", key: str = "domain") -> DataFrame:
    """``quota`` rows of each rank band (lo, hi, quota) by hash rank."""
    band = F.lit(None).cast("int")
    quota = F.lit(0)
    for i, (lo, hi, q) in enumerate(bands):
        inside = F.col(rank).between(lo, hi)
        band, quota = F.when(inside, F.lit(i)).otherwise(band), F.when(inside, F.lit(q)).otherwise(quota)
    banded = df.withColumn("band", band).withColumn("_q", quota).where("band is not null")
    return top_per_group(banded, ["band"], [U.rank_hash(F.col(key), seed), F.col(key)], F.col("_q")).drop("_rank", "_q")


def band_quotas(shares: Sequence[float], n: int) -> list[int]:
    """Whole quotas by share; the last band takes the rounding."""
    out = [int(n * s) for s in shares[:-1]]
    return [*out, n - sum(out)]


def round_robin(df: DataFrame, size: int, per_site: int, seed: int, site: str = "domain", key: str = "url") -> DataFrame:
    """Every site's first page before any site's second, up to ``size`` pages."""
    ranked = top_per_group(df, [site], [U.rank_hash(F.col(key), seed), F.col(key)], per_site, "page_rank")
    return ranked.orderBy("page_rank", U.rank_hash(F.col(key), seed), F.col(key)).limit(size)


def newest_days(df: DataFrame, share: float, ts: str = "first_seen") -> DataFrame:
    """Rows of the newest days until ``share`` of the rows is reached; days are few, so a window over them is small."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = days.select("day", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return df.join(F.broadcast(run.where(F.col("before") < share * F.col("total")).select("day")), F.to_date(ts) == F.col("day"), "left_semi")
