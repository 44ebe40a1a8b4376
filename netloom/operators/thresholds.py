"""Rules that turn calibration scores into one threshold, and what they cost elsewhere."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.urls import unit_hash
from netloom.operators import metrics as M
from netloom.operators.skew import salted_join
from netloom.plans.materialise import materialise
from netloom.plans.stages import once


class Cuts:
    """What the rules of every target are read from: totals of each source, and of each set of negatives the highest score with too many at or above it.

    The sets are all rows, each source, and sources that weigh alike.  A cut is
    a number for each set and target, so the rules themselves are arithmetic on
    a few numbers: the thresholds are the lowest positives above the cuts.
    Rows without a source count in the pooled set alone.
    """

    def __init__(self, cal: DataFrame, targets: Sequence[float], confidence: float = 0.95, balance_negatives: int = 100) -> None:
        spark = cal.sparkSession
        self.cal, self.targets = cal, list(targets)
        self.counts = materialise(cal.where("label IN (0, 1)").groupBy("source", "label", "score").agg(F.count("*").cast("double").alias("n")), "rule-counts")
        totals = {(r["source"], r["label"]): int(r["n"]) for r in self.counts.groupBy("source", "label").agg(F.sum("n").alias("n")).collect()}
        self.n_neg, self.n_pos = (sum(n for (_, y), n in totals.items() if y == label) for label in (0, 1))
        self.negatives, self.positives = ({s: n for (s, y), n in totals.items() if y == label and s is not None} for label in (0, 1))
        self.balanced = sorted(s for s, n in self.negatives.items() if n >= balance_negatives)
        #: Most false positives that certify each set (a source, or None for all) and target; -1 if none may be.
        self.allowed = {(s, t): M.max_false_positives(n, t, confidence) if n else -1 for s, n in [(None, self.n_neg), *self.negatives.items()] for t in targets}

        # sources are a handful
        weight = F.lit(0.0)
        for name in self.balanced:
            weight = F.when(F.col("source") == name, F.lit(1.0 / self.negatives[name])).otherwise(weight)
        sets = F.array(F.struct(F.lit("pooled").alias("set_by"), F.col("n").alias("w")), F.struct(F.lit("alike").alias("set_by"), (F.col("n") * weight).alias("w")), F.struct(F.concat(F.lit("source "), "source").alias("set_by"), F.col("n").alias("w")))
        neg = self.counts.where("label = 0").select("label", "score", F.explode(sets).alias("s")).select("label", "score", "s.*").where("set_by is not null and w > 0")
        limits = spark.createDataFrame([("pooled" if s is None else f"source {s}", [self.allowed[s, t] for t in targets]) for s in [None, *self.negatives]], "set_by string, most array<int>")
        over = [(F.max(F.when(_too_many(t), F.col("score"))).alias(f"p{i}"), F.max(F.when(F.col("fp") > F.col("most")[i], F.col("score"))).alias(f"c{i}")) for i, t in enumerate(targets)]
        found = M.curve(neg, ["set_by"], "w").join(F.broadcast(limits), "set_by", "left").groupBy("set_by").agg(*[x for pair in over for x in pair]).collect()
        at = {r["set_by"]: r for r in found}
        of = lambda name, column: at[name][column] if name in at else None
        key = lambda s: "pooled" if s is None else f"source {s}"
        #: The cut of each set and target for its rate, and for its certified rate.
        self.rate = {(s, t): of(key(s), f"p{i}") for s in [None, *self.negatives] for i, t in enumerate(targets)}
        self.certified = {(s, t): of(key(s), f"c{i}") for s in [None, *self.negatives] for i, t in enumerate(targets)}
        alike = {t: of("alike", f"p{i}") for i, t in enumerate(targets)}

        # of the positives of one source, or of those that weigh alike
        own = [(s, f"source {s}", i, self.rate[s, t]) for s in self.negatives for i, t in enumerate(targets)] + [(s, "alike", i, alike[t]) for s in self.balanced for i, t in enumerate(targets)]
        need = F.broadcast(spark.createDataFrame(own, "source string, set_by string, i int, cut double"))
        lows = self.counts.where("label = 1").join(need, "source").where("cut is null or score > cut").groupBy("set_by", "i").agg(F.min("score").alias("low")).collect()
        self.low = {(r["set_by"], targets[r["i"]]): r["low"] for r in lows if r["low"] is not None}

        #: The lowest positive of all above a cut; more cuts are added by :meth:`place`.
        self.above: dict[float | None, float] = {}

    def place(self, cuts: Sequence[float | None] = ()) -> None:
        """Find the lowest positives above the cuts, those of this object among them, in one pass."""
        every = {*cuts, *self.rate.values(), *self.certified.values()}
        self.above = first_above(self.counts.where("label = 1 and score is not null").select("score").distinct(), [x for x in every if x is not None])

    def granular(self, source: str, target: float, min_negatives: int) -> bool:
        """Whether the target allows a source too few false positives."""
        return math.floor(target * float(self.negatives[source])) < min_negatives


def _too_many(target: float) -> Column:
    return F.col("fp") > F.lit(target) * F.col("n_neg") + 1e-9 * F.greatest(F.col("n_neg"), F.lit(1.0))


#: A threshold, null where it isn't defined, and what it was set by.
Set = tuple[float | None, str]


def _highest(sets: Sequence[Set]) -> Set:
    return max(sets, key=lambda x: (x[0] is not None, x[0] or 0.0, x[1]))


def pooled(c: Cuts, target: float) -> Set:
    return (c.above[c.rate[None, target]] if c.n_neg and c.n_pos else None), "pooled"


def by_source(c: Cuts, target: float, min_negatives: int = 10) -> list[Set]:
    """The threshold of each source with both classes and enough negatives."""
    return [(c.low.get((f"source {s}", target), M.NO_ALARM), s) for s in c.negatives if c.positives.get(s) and not c.granular(s, target, min_negatives)]


def worst_source(c: Cuts, target: float, min_negatives: int = 10) -> Set:
    """The highest of the pooled and the sources' own thresholds; the pooled one if they tie."""
    best, whole = _highest([(None, ""), *by_source(c, target, min_negatives)]), pooled(c, target)
    return best if best[0] is not None and (whole[0] is None or best[0] > whole[0]) else whole


def balanced(c: Cuts, target: float) -> Set:
    """Each source with enough negatives weighs the same; without any, the pooled rule."""
    if not c.balanced:
        return pooled(c, target)[0], "pooled (no source eligible)"
    both = any(c.positives.get(s) for s in c.balanced)
    return (c.low.get(("alike", target), M.NO_ALARM) if both else None), ",".join(c.balanced)


def ucb_binom(c: Cuts, target: float) -> Set:
    """The highest threshold with as few false positives as the bound allows, of any source or all, over all positives."""
    sets = [(c.above[c.certified[s, target]], "pooled" if s is None else s) for s in [None, *c.negatives] if c.allowed[s, target] >= 0]
    best = _highest(sets) if sets else (M.NO_ALARM, "")
    return best if best[0] < M.NO_ALARM else (M.NO_ALARM, "uncertifiable (cal too small)")


def boot_cuts(cal: DataFrame, targets: Sequence[float], n_boot: int = 200, seed: int = 7) -> dict[tuple[str, float], list[float | None]]:
    """For each source and target, of every replicate of a domain bootstrap the highest score at which too many negatives are at or above it.

    Each domain gets a Poisson(1) count from the hash of replicate and domain,
    which stands for drawing domains with replacement.  Rows are counted by
    source, domain and score before replicates are drawn; what comes back is a
    number for each source, replicate and target.
    """
    targets = list(dict.fromkeys(targets))
    domain = F.coalesce("domain", F.lit(""))
    neg = materialise(cal.where("label = 0").groupBy("source", domain.alias("domain"), "score").agg(F.count("*").alias("n")), "boot-cells")

    def count(u: Column) -> Column:
        out, edge, p = F.lit(0).cast("byte"), 0.36787944117144233, 0.36787944117144233
        for k in range(1, 8):
            out = F.when(u >= edge, F.lit(k).cast("byte")).otherwise(out)
            p /= k
            edge += p
        return out

    # one hash a domain and replicate, whatever the number of its scores
    draws = once(neg.select("domain").distinct(), us=F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda b: unit_hash(F.col("domain"), b + F.lit(seed * 1000))))
    draws = draws.select("domain", F.transform("us", count).alias("draws"))
    # the planner takes an array of all replicates for one number and would broadcast them: never through the driver
    drawn = salted_join(neg, draws, ["domain"], hint="merge").select("source", "score", "n", F.posexplode("draws").alias("b", "k")).where("k > 0")
    weights = materialise(drawn.groupBy("source", "b", "score").agg(F.sum(F.col("n") * F.col("k")).cast("double").alias("w")), "boot-negatives")
    # a replicate of a source is one window: nothing of each replicate and slice of scores is sent to the driver
    whole = Window.partitionBy("source", "b")
    down = whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = weights.withColumns({"fp": F.sum("w").over(down), "n_neg": F.sum("w").over(whole)})
    out: dict[tuple[str, float], list[float | None]] = {}
    for r in c.groupBy("source", "b").agg(*[F.max(F.when(_too_many(t), F.col("score"))).alias(f"c{i}") for i, t in enumerate(targets)]).collect():
        for i, t in enumerate(targets):
            out.setdefault((r["source"], t), []).append(r[f"c{i}"])
    return out


def first_above(positives: DataFrame, cuts: Sequence[float]) -> dict[float | None, float]:
    """The lowest positive score above each cut, and above none; by one pass in which every score finds its place among the cuts."""
    edges = np.array(sorted(set(cuts)), dtype=float)

    @F.pandas_udf(T.IntegerType())
    def place(score: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, score.to_numpy(), side="left").astype(np.int32), index=score.index)

    lows = {r["at"]: r["low"] for r in positives.groupBy(place("score").alias("at")).agg(F.min("score").alias("low")).collect()}
    out: dict[float | None, float] = {}
    best = M.NO_ALARM
    for i in range(len(edges), -1, -1):
        best = min(best, lows.get(i, M.NO_ALARM))
        out[float(edges[i - 1]) if i else None] = best
    return out


def ucb_boot(c: Cuts, cuts: dict[tuple[str, float], list[float | None]], target: float, confidence: float = 0.95, min_negatives: int = 10) -> Set:
    """Per source the upper quantile of the thresholds of its resamples (:func:`boot_cuts`), the highest of them and of the pooled one."""
    upper = [pooled(c, target)]
    for (source, t), xs in cuts.items():
        if t == target and source is not None and not c.granular(source, t, min_negatives):
            own = sorted(c.above[x] for x in xs)
            upper.append((own[min(len(own) - 1, math.ceil(confidence * (len(own) - 1)))], source))
    return _highest(upper)


def rules(cal: DataFrame, targets: Sequence[float], min_negatives: int = 10, confidence: float = 0.95, n_boot: int = 200) -> DataFrame:
    """(target_fpr, rule, threshold, set_by) of all five rules."""
    cal = materialise(cal.select("source", "domain", "label", "score"), "cal")
    c = Cuts(cal, targets, confidence)
    cuts = boot_cuts(cal, targets, n_boot)
    c.place([x for xs in cuts.values() for x in xs])
    out = []
    for t in targets:
        found = {"ucb_boot": ucb_boot(c, cuts, t, confidence, min_negatives), "pooled": pooled(c, t), "worst_source": worst_source(c, t, min_negatives), "balanced": balanced(c, t), "ucb_binom": ucb_binom(c, t)}
        out += [(float(t), rule, *found[rule]) for rule in found]
    return cal.sparkSession.createDataFrame(out, "target_fpr double, rule string, threshold double, set_by string").coalesce(1)


def evaluate_rules(rows: DataFrame, thresholds: DataFrame, confidence: float = 0.95, min_negatives: int = 10) -> DataFrame:
    """What each threshold does to ``rows``: counts, rates and the upper bound of the false-positive rate."""
    # counted by score before the few thresholds meet them; the domains don't depend on a threshold
    counts = rows.groupBy("label", "score").agg(F.count("*").alias("n"))
    domains = rows.agg(F.countDistinct("domain").alias("n_domains"), F.countDistinct(F.when(F.col("label") == 0, F.col("domain"))).alias("n_neg_domains"))
    d = counts.join(F.broadcast(thresholds.select("target_fpr", "rule", "threshold")))
    hit, neg, pos = F.col("score") >= F.col("threshold"), F.col("label") == 0, F.col("label") == 1
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    out = d.groupBy("target_fpr", "rule").agg(F.sum("n").alias("n_urls"), of(pos).alias("n_pos"), of(neg).alias("n_neg"), of(hit & neg).alias("fp"), of(hit & pos).alias("tp")).join(F.broadcast(domains))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))
    return out.select(
        "target_fpr", "rule", "n_urls", "n_pos", "n_neg", "n_domains", "n_neg_domains", "fp", ratio("fp", "n_neg").alias("fpr"),
        M.cp_upper_udf(confidence)("fp", "n_neg").alias("fpr_upper"), ratio("tp", "n_pos").alias("recall"),
        (F.floor(F.col("target_fpr") * F.col("n_neg")) < min_negatives).alias("granularity_limited"),
    )
