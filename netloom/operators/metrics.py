"""Metrics of scored rows: exact curves with ties, operating points, calibration, intervals, weights.

A scored table has ``label`` (0 or 1) and ``score``; a metric that is not
defined is null.  Curves are built from one row per distinct score; where those
are many, their running sums are prefix sums over range partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_ALARM = 1.7976931348623157e308


def _share(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def tag(target: float) -> str:
    return f"{target * 100:g}pct".replace(".", "p")


def curve(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per group and distinct score, highest first: negatives and positives at it and at or above it, and totals.

    Running sums are taken in two steps: over score slices (quantile edges, a
    bounded number), then inside each slice.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    s = df.groupBy(*by, "score").agg(F.sum(F.when(F.col("label") == 0, w).otherwise(0.0)).alias("neg"), F.sum(F.when(F.col("label") == 1, w).otherwise(0.0)).alias("pos"))
    edges = F.broadcast(df.groupBy(*by).agg(F.percentile_approx("score", [i / 64 for i in range(1, 64)], 1000).alias("_edges"))) if by else F.broadcast(df.agg(F.percentile_approx("score", [i / 64 for i in range(1, 64)], 1000).alias("_edges")))
    s = (s.join(edges, list(by)) if by else s.join(edges)).withColumn("_slice", F.size(F.filter("_edges", lambda e: e < F.col("score")))).drop("_edges")
    sums = s.groupBy(*by, "_slice").agg(F.sum("neg").alias("_n"), F.sum("pos").alias("_p"))
    over = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = sums.select(*by, "_slice", F.coalesce(F.sum("_n").over(over), F.lit(0.0)).alias("_n"), F.coalesce(F.sum("_p").over(over), F.lit(0.0)).alias("_p"), F.sum("_n").over(whole).alias("n_neg"), F.sum("_p").over(whole).alias("n_pos"))
    inside = Window.partitionBy(*by, "_slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = s.join(F.broadcast(sums), [*by, "_slice"])
    return out.select(*by, "score", "neg", "pos", (F.col("_n") + F.sum("neg").over(inside)).alias("fp"), (F.col("_p") + F.sum("pos").over(inside)).alias("tp"), "n_neg", "n_pos")


def roc_auc(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by.., roc_auc, pr_auc): rank-sum area with ties, and average precision; null with one class only."""
    c = curve(df, by, weight)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    precision = F.sum(F.col("pos") * _share(F.col("tp"), F.col("tp") + F.col("fp")))
    n, p = F.max("n_neg"), F.max("n_pos")
    both = (n > 0) & (p > 0)
    return c.groupBy(*by).agg(F.when(both, area / F.nullif(n * p, F.lit(0.0))).alias("roc_auc"), F.when(both, precision / F.nullif(p, F.lit(0.0))).alias("pr_auc"))


def operating_point(df: DataFrame, target: float, by: Sequence[str] = (), min_negatives: int = 10, weight: str | None = None) -> DataFrame:
    """The threshold of the largest recall with a false-positive rate up to ``target``; ties go to the highest.

    Without a usable threshold the recall is 0 and the threshold the largest
    double.
    """
    return point(curve(df, by, weight), target, by, min_negatives)


def point(c: DataFrame, target: float, by: Sequence[str] = (), min_negatives: int = 10) -> DataFrame:
    """The same from a :func:`curve`."""
    ok = (F.col("fp") <= target * F.col("n_neg") + 1e-9 * F.greatest(F.col("n_neg"), F.lit(1.0))) & (F.col("tp") > 0)
    best = F.max(F.when(ok, F.struct(F.col("tp"), F.col("score"), F.col("fp"))))
    n, p = F.max("n_neg"), F.max("n_pos")
    out = c.groupBy(*by).agg(best.alias("_best"), n.alias("n_neg"), p.alias("n_pos"))
    both = (F.col("n_neg") > 0) & (F.col("n_pos") > 0)
    return out.select(
        *by,
        F.col("n_neg").cast("bigint").alias("n_neg"),
        _share(F.lit(1.0), F.col("n_neg")).alias("resolution"),
        (F.floor(F.lit(target) * F.col("n_neg")) < min_negatives).alias("granularity_limited"),
        F.when(both, F.coalesce(F.col("_best.tp"), F.lit(0.0)) / F.nullif(F.col("n_pos"), F.lit(0.0))).alias("recall"),
        F.when(both, F.coalesce(F.col("_best.fp"), F.lit(0.0)) / F.nullif(F.col("n_neg"), F.lit(0.0))).alias("achieved_fpr"),
        F.when(both, F.coalesce(F.col("_best.score"), F.lit(NO_ALARM))).alias("threshold"),
    )


def at_threshold(df: DataFrame, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts, recall, false-positive rate, precision and F1 at ``score >= threshold``."""
    hit = F.col("score") >= threshold
    tp, fp = F.count_if(hit & (F.col("label") == 1)), F.count_if(hit & (F.col("label") == 0))
    p, n = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    out = df.groupBy(*by).agg(F.count("*").alias("n_urls"), p.alias("n_pos"), n.alias("n_neg"), tp.alias("tp"), fp.alias("fp"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("n_pos") - F.col("tp"))).otherwise(F.lit(0.0))
    return out.select(*by, "n_urls", "n_pos", "n_neg", "tp", "fp", _share(F.col("tp"), F.col("n_pos")).alias("recall"), _share(F.col("fp"), F.col("n_neg")).alias("fpr"), _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), f1.alias("f1"))


def evaluate(df: DataFrame, targets: Sequence[float], by: Sequence[str], min_negatives: int = 10) -> DataFrame:
    """One metric row a group: areas and the operating point of each target."""
    out = roc_auc(df, by)
    for t in targets:
        op = operating_point(df, t, by, min_negatives)
        out = out.join(op.select(*by, *[F.col(c).alias(f"op_{tag(t)}_{c}") for c in ("recall", "achieved_fpr", "threshold")]), list(by))
    return out


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2.0))).alias("brier"))


def calibration_error(df: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over equal bins; a score on an inner edge falls in the upper bin."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    cells = df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("p"), F.avg("label").alias("y"))
    return cells.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(lo, hi) of the 95 % interval of a rate."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.struct(F.greatest(F.lit(0.0), mid - half).alias("lo"), F.least(F.lit(1.0), mid + half).alias("hi"))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * f


def clopper_pearson_upper(k: int | None, n: int | None, confidence: float = 0.95) -> float | None:
    """One-sided upper bound of a rate by bisection of the beta distribution."""
    if k is None or not n:
        return None
    if k >= n:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_cdf(mid, k + 1, n - k) < confidence else (lo, mid)
    return (lo + hi) / 2


def max_false_positives(n: int, target: float, confidence: float = 0.95) -> int:
    """Most false positives of ``n`` negatives whose upper bound stays within ``target``; -1 if none may be."""
    lo, hi = -1, int(target * n)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if clopper_pearson_upper(mid, n, confidence) <= target else (lo, mid - 1)
    return lo if n > 0 else -1


def cp_upper_udf(confidence: float):
    @F.pandas_udf(T.DoubleType())
    def upper(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([clopper_pearson_upper(None if pd.isna(a) else int(a), None if pd.isna(b) else int(b), confidence) for a, b in zip(k, n)], dtype="float64")

    return upper


def eta_squared(df: DataFrame, value: str, group: str, within: str | None = None, min_rows: int = 1) -> DataFrame:
    """Share of the variance that lies between groups; ``within`` a class, the mean weighted by rows."""
    keys = [within] if within else []
    d = df.where(F.col(value).isNotNull())
    v = F.col(value)
    g = d.groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).where(F.col("n") >= min_rows)
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    per = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.when(total > 0, between / total).otherwise(F.lit(0.0)).alias("eta"))
    return per.agg((F.sum(F.col("eta") * F.col("n")) / F.sum("n")).alias("eta_squared"))


def depth_weights(df: DataFrame, top: int = 4) -> DataFrame:
    """``df`` with ``weight`` that gives both classes the same depth profile over buckets that both have."""
    from netloom.operators.corpus import depth_bucket

    b = depth_bucket(F.col("depth"), top)
    cells = df.groupBy(b.alias("bucket")).agg(F.count_if(F.col("label") == 0).cast("double").alias("n0"), F.count_if(F.col("label") == 1).cast("double").alias("n1"))
    cells = cells.withColumn("goal", F.col("n0") + F.col("n1")).where("n0 > 0 and n1 > 0")
    total = cells.agg(F.sum("goal").alias("all"))
    cells = cells.join(F.broadcast(total))
    w = F.when(F.col("label") == 0, F.col("goal") / F.col("all") / F.col("n0")).when(F.col("label") == 1, F.col("goal") / F.col("all") / F.col("n1"))
    return df.withColumn("bucket", b).join(F.broadcast(cells), "bucket", "left").withColumn("weight", F.coalesce(w, F.lit(0.0))).drop("bucket", "n0", "n1", "goal", "all")


def propensity_weighted_mean(df: DataFrame, value: str, propensity: str, clip: float = 0.05) -> DataFrame:
    """Mean under clipped inverse-propensity weights, and the effective sample size."""
    w = 1 / F.greatest(F.col(propensity), F.lit(clip))
    s = df.select(w.alias("w"), F.col(value).alias("x")).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("swx"), F.sum(F.col("w") * F.col("w")).alias("sw2"))
    return s.select((F.col("swx") / F.col("sw")).alias("mean"), (F.col("sw") * F.col("sw") / F.col("sw2")).alias("effective_n"))


def medians(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Median, least and greatest of each value by group."""
    return df.groupBy(*by).agg(*[f(F.col(v)).alias(f"{v}_{n}") for v in values for n, f in (("median", F.median), ("min", F.min), ("max", F.max))])


def sign_test(df: DataFrame, by: Sequence[str], effect: str = "effect", null: float = 0.0) -> DataFrame:
    """Effects above and below ``null`` and the 95 % quantile interval."""
    e = F.col(effect)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(e > null).alias("n_above"), F.count_if(e < null).alias("n_below"), F.percentile(e, 0.025).alias("lo"), F.percentile(e, 0.975).alias("hi"))


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    return df.where(F.col(before) != F.col(after)).groupBy(before, after).agg(F.count("*").alias("n"))
