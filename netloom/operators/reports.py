"""Joins and summaries of scored runs: everything combines before it shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.skew import salted_join


class NotUnique(ValueError):
    """A key that should be unique isn't."""


def check_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise NotUnique(f"{what}: {bad[0].asDict()}")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", complete: bool = False) -> DataFrame:
    """An equi-join whose keys are unique on both sides; ``complete``: every left row must have a partner."""
    check_unique(left, keys, "left")
    check_unique(right, keys, "right")
    out = left.join(right.withColumn("_partner", F.lit(True)), list(keys), how)
    if complete and not left.join(right, list(keys), "left_anti").isEmpty():
        raise ValueError("rows without a partner")
    return out.drop("_partner")


def with_pages(rows: DataFrame, pages: DataFrame, key: str, usable: Column) -> DataFrame:
    """``rows`` with the features of usable pages, null elsewhere, and ``has_page``; ``pages``: key, features.."""
    good = pages.where(usable).withColumn("has_page", F.lit(True))
    return salted_join(rows, good, [key], "left").withColumn("has_page", F.coalesce("has_page", F.lit(False)))


def only_pages(rows: DataFrame, pages: DataFrame, key: str, usable: Column) -> DataFrame:
    """Rows with a usable page, with its features."""
    return salted_join(rows, pages.where(usable), [key])


def twins(test: DataFrame, train: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Rows of ``test`` whose rounded feature vector occurs in ``train``; nulls equal nulls."""
    text = F.concat_ws("|", *[F.coalesce(F.round(F.col(c).cast("double"), digits).cast("string"), F.lit("")) for c in columns])
    key = lambda d: d.withColumn("_v", F.md5(text))
    return salted_join(key(test), key(train).select("_v").distinct(), ["_v"], "left_semi").drop("_v")


def unordered_pairs(df: DataFrame, name: str, within: Sequence[str] = ()) -> DataFrame:
    """(within.., a, b) with a < b of the distinct names of each group; for tables of populations or models, which are few."""
    d = df.select(*within, F.col(name).alias("a")).where("a is not null").distinct()
    listed = d.groupBy(*within).agg(F.sort_array(F.collect_set("a")).alias("all"))
    first = listed.select(*within, F.posexplode("all").alias("i", "a"), "all")
    return first.select(*within, "a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))


def spread(df: DataFrame, by: Sequence[str], split: str, metrics: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """Per group: distinct splits, median counts, and median, least and most of each metric."""
    out = [F.countDistinct(split).alias("n_splits"), *[F.percentile(c, 0.5).alias(c) for c in counts]]
    for m in metrics:
        out += [F.percentile(m, 0.5).alias(f"{m}_median"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return df.groupBy(*by).agg(*out)


def spread_texts(summary: DataFrame, by: Sequence[str], metrics: Sequence[str], percent: bool = True) -> DataFrame:
    """The medians as ``12.3 [10.0, 15.1]``, in percent with one digit or as they are with four."""
    form, scale, digits = ("%.1f [%.1f, %.1f]", 100, 1) if percent else ("%.4f [%.4f, %.4f]", 1, 4)
    return summary.select(*by, "n_splits", *[F.when(F.col(f"{m}_median").isNotNull(), F.format_string(form, *[F.bround(F.col(f"{m}_{k}") * scale, digits) for k in ("median", "min", "max")])).alias(m) for m in metrics])


def testable(df: DataFrame, cell: str, minima: Mapping[str, float]) -> DataFrame:
    """(cell) whose median counts over the splits reach the minima."""
    medians = df.groupBy(cell).agg(*[F.percentile(c, 0.5).alias(c) for c in minima])
    ok = F.lit(True)
    for c, least in minima.items():
        ok = ok & (F.col(c) >= least)
    return medians.where(ok).select(cell)


def replication(df: DataFrame, by: Sequence[str], holds: Column, min_settings: int = 3, replicated: float = 0.75, partly: float = 0.5) -> DataFrame:
    """(by.., n, share, verdict): how many settings an effect holds in."""
    d = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(holds, F.lit(False)).cast("double")).alias("share"))
    v = F.when(F.col("n") < min_settings, "not testable").when(F.col("share") >= replicated, "replicated").when(F.col("share") >= partly, "partly replicated").otherwise("not replicated")
    return d.withColumn("verdict", v)


def by_split(df: DataFrame, by: Sequence[str], split: str, value: str) -> DataFrame:
    """(by.., values): the values of each group in the order of the splits."""
    return df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(split).alias("s"), F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def wide(df: DataFrame, by: Sequence[str], column: str, values: Sequence[str], metric: str) -> DataFrame:
    """Medians of a metric with one column for each value of ``column``."""
    return df.groupBy(*by).agg(*[F.percentile(F.when(F.col(column) == v, F.col(metric)), 0.5).alias(v) for v in values])


def feature_check(df: DataFrame, features: Sequence[str], label: str = "label", source: str = "source", least: float = 0.1, ratio: float = 2.0) -> DataFrame:
    """Per feature: share of nulls, means of both classes, eta squared of label, of source, and of source within the classes, and whether the feature tells the source rather than the class.

    One pass over the rows; features become rows only after they are summed.
    """
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.col(source).alias("s"), F.explode(F.array(*parts)).alias("p")).select("y", "s", "p.*")
    cells = long.groupBy("feature", "y", "s").agg(F.count("*").alias("rows"), F.count("x").alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("t"), F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("q"))

    def between(d: DataFrame, key: Sequence[str], within: Sequence[str], name: str) -> DataFrame:
        """Eta squared of ``key``: between-group over total squares, in each class of ``within``, weighed by rows."""
        g = d.groupBy("feature", *within, *key).agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("q").alias("q")).where("n > 0")
        w = g.groupBy("feature", *within).agg(F.sum("n").alias("n"), F.sum(F.col("t") * F.col("t") / F.col("n")).alias("b"), F.sum("t").alias("t"), F.sum("q").alias("q"))
        centre = F.col("t") * F.col("t") / F.col("n")
        total = F.col("q") - centre
        eta = F.when(total > 1e-12, (F.col("b") - centre) / total).otherwise(F.lit(0.0))
        return w.groupBy("feature").agg((F.sum(eta * F.col("n")) / F.sum("n")).alias(name))

    mean = lambda k: (F.sum(F.when(F.col("y") == k, F.col("t"))) / F.nullif(F.sum(F.when(F.col("y") == k, F.col("n"))).cast("double"), F.lit(0.0)))
    base = cells.groupBy("feature").agg((1 - F.sum("n") / F.sum("rows")).alias("null_rate"), mean(0).alias("mean_benign"), mean(1).alias("mean_phishing"))
    out = base
    for key, within, name in ((["y"], [], "eta2_label"), (["s"], [], "eta2_source"), (["s"], ["y"], "eta2_source_within")):
        out = out.join(between(cells, key, within, name), "feature", "left")
    return out.withColumn("flag", (F.col("eta2_source_within") >= least) & (F.col("eta2_source_within") > ratio * F.col("eta2_label")))


def crosstab(df: DataFrame, row: Column, status: Column, values: Sequence[str], success: str) -> DataFrame:
    """(row, one count for each status, total, success_pct)."""
    d = df.select(row.alias("row"), status.alias("st")).groupBy("row").agg(*[F.count_if(F.col("st") == v).alias(v) for v in values], F.count("*").alias("total"))
    return d.withColumn("success_pct", F.bround(100 * F.col(success) / F.col("total"), 2))


def over_thresholds(df: DataFrame, score: str, thresholds: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows at or over each threshold: the false-positive rate on pages known to be harmless."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg((F.col(score) >= t).cast("double")).alias(k) for k, t in thresholds.items()])


def gain_share(df: DataFrame, model: str = "model", feature: str = "feature", gain: str = "gain") -> DataFrame:
    """(feature, share): mean over the models of a feature's share of the model's gain; a model that lacks it counts as 0."""
    whole = df.groupBy(model).agg(F.sum(gain).alias("_all"))
    n = df.select(model).distinct().count()
    shared = df.join(F.broadcast(whole), model).withColumn("_s", F.col(gain) / F.nullif(F.col("_all"), F.lit(0.0)))
    return shared.groupBy(feature).agg((F.sum(F.coalesce("_s", F.lit(0.0))) / n).alias("share"))


def top_changes(before: DataFrame, after: DataFrame, key: str, features: Sequence[str], n: int = 10) -> DataFrame:
    """(feature, changed, mean_change) of the ``n`` features that differ most between two captures of the same pages (a top-k report)."""
    other = after.select(key, *[F.col(f).alias(f"_{f}") for f in features])
    parts = [F.struct(F.lit(f).alias("feature"), (F.col(f"_{f}").cast("double") - F.col(f).cast("double")).alias("d")) for f in features]
    d = before.select(key, *features).join(other, key).select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    per = d.groupBy("feature").agg(F.avg((F.coalesce(F.col("d"), F.lit(0.0)) != 0).cast("double")).alias("changed"), F.avg("d").alias("mean_change"))
    return per.orderBy(F.abs("mean_change").desc_nulls_last(), "feature").limit(n)


def suffix_baseline(df: DataFrame, risk: str = "tld_risk", label: str = "label") -> DataFrame:
    """``df`` with ``score``: the risk of the suffix, the base rate where it is unknown."""
    base = df.agg(F.avg(label).alias("_base"))
    return df.join(F.broadcast(base)).withColumn("score", F.coalesce(F.col(risk), F.col("_base"))).drop("_base")


def age_baseline(df: DataFrame, age: str = "domain_age_days") -> DataFrame:
    """``df`` with ``score``: younger is more suspicious, an unknown age most of all."""
    return df.withColumn("score", F.coalesce(-F.col(age).cast("double"), F.lit(0.0)))


def merge_allowlist(synced: DataFrame, bundled: DataFrame) -> DataFrame:
    """(list, entry): the synced lists with the bundled allow entries that neither occur there nor are blocked."""
    new = bundled.select("entry").distinct().join(synced.where("list in ('allow', 'block_domain')").select("entry").distinct(), "entry", "left_anti")
    return synced.select("list", "entry").unionByName(new.select(F.lit("allow").alias("list"), "entry"))


def due_feeds(feeds: DataFrame, polls: DataFrame, now: Column) -> DataFrame:
    """(feed) to be fetched now: never polled, or last polled at least ``every_s`` seconds ago; ``feeds``: feed, every_s; ``polls``: feed, at."""
    last = polls.groupBy("feed").agg(F.max("at").alias("last"))
    waited = (F.unix_micros(now) - F.unix_micros("last")) / F.lit(1e6)
    return feeds.join(last, "feed", "left").where(F.col("last").isNull() | (waited >= F.col("every_s"))).select("feed")
