"""The corpus build: from interim rows to parts, splits, weights and a data card.

Random choices are ranks of a hash of seed and key, so they are the same on
every run and in SQL.  Each step takes and gives rows with uid, url, domain,
label, date (timestamp), source, depth, origin and html_simhash; steps that
don't look at dates need no date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import urls as U
from netloom.functions.text import plain_domain, plain_name
from netloom.operators import dedup
from netloom.operators.positions import positions, top_per_group
from netloom.operators.skew import salted_join
from netloom.operators.timestamps import to_utc

POOL, HELDOUT, TIME_SLICE, EVAL_ONLY, OVERLAP = "pool", "heldout_source", "time_slice", "eval_only", "holdout_domain_overlap"


def corpus_rows(interim: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Interim rows with uid, plain source and, given the source configuration, dates of any writing as timestamps.

    Without ``sources`` there is no date, so that a step that needs one fails.
    """
    source = plain_name(F.col("source"))
    date = []
    if sources is not None:
        interim = to_utc(interim.select("row_id", "url", "domain", "label", "date", "source", "depth", "origin", "html_simhash"), sources)
        date = [F.timestamp_micros("utc_micros").alias("date")]
    return interim.select(
        F.concat(source, F.lit(":"), F.col("row_id").cast("string")).alias("uid"),
        "row_id",
        "url",
        plain_domain(F.col("domain")).alias("domain"),
        F.col("label").cast("int").alias("label"),
        *date,
        source.alias("source"),
        F.col("depth").cast("int").alias("depth"),
        "origin",
        "html_simhash",
    )


def rank_of(source: Column, priority: Sequence[str]) -> Column:
    """Place of a source in the priority list; unknown ones come last."""
    out = F.lit(len(priority))
    for i, s in reversed(list(enumerate(priority))):
        out = F.when(source == s, F.lit(i)).otherwise(out)
    return out


def keep_order(priority: Sequence[str]) -> list[Column]:
    """Earliest first, rows without a date last, then source priority, then uid."""
    return [F.col("date").asc_nulls_last(), rank_of(F.col("source"), priority).asc(), F.col("uid").asc()]


def dedup_urls(df: DataFrame, priority: Sequence[str]) -> DataFrame:
    """One row per page key; keys with both labels go altogether.

    The first row of a key is found by an aggregate, which combines before the
    shuffle, so a key of many rows is no problem.
    """
    keyed = df.withColumn("_key", U.url_key(F.col("url")))
    first = F.struct(F.col("date").isNull().alias("undated"), F.col("date").alias("date"), rank_of(F.col("source"), priority).alias("prio"), F.col("uid").alias("uid"))
    best = keyed.groupBy("_key").agg(F.min(first).alias("_first"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    keep = best.where("_lo = _hi or _lo is null").select(F.col("_first.uid").alias("uid"))
    return df.join(keep, "uid", "left_semi")


def near_dup_pages(df: DataFrame, priority: Sequence[str], most: int = 3) -> DataFrame:
    """Without near-duplicate pages: per label, the first row of each cluster of close simhashes stays."""
    hashed = df.where("html_simhash is not null")
    roots = dedup.near_dup_clusters(hashed.select("html_simhash", "label"), most, within="label")
    first = F.struct(F.col("date").isNull().alias("undated"), F.col("date").alias("date"), rank_of(F.col("source"), priority).alias("prio"), F.col("uid").alias("uid"))
    keep = salted_join(hashed, roots, ["html_simhash", "label"]).groupBy("label", "root").agg(F.min(first).alias("f")).select("f.uid")
    return df.where("html_simhash is null").unionByName(hashed.join(keep, "uid", "left_semi"))


def shared_phishing_domains(df: DataFrame) -> DataFrame:
    """(domain, n_sources) of domains that are phishing in more than one source."""
    return df.where("label = 1").groupBy("domain").agg(F.countDistinct("source").alias("n_sources")).where("n_sources > 1")


def drop_shared_domains(df: DataFrame) -> DataFrame:
    return salted_join(df, shared_phishing_domains(df), ["domain"], "left_anti")


def domain_owner(df: DataFrame, priority: Sequence[str]) -> DataFrame:
    """(domain, source) where each domain was seen first; ties by priority, then name."""
    first = F.struct(F.col("date").isNull().alias("undated"), F.col("date").alias("date"), rank_of(F.col("source"), priority).alias("prio"), F.col("source").alias("source"))
    return df.groupBy("domain").agg(F.min(first)["source"].alias("source"))


def assign_domain_owner(df: DataFrame, priority: Sequence[str]) -> DataFrame:
    return salted_join(df, domain_owner(df, priority), ["domain", "source"], "left_semi")


def cap_per_domain(df: DataFrame, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of a domain, by hash rank."""
    return top_per_group(df, ["domain"], [U.rank_hash(F.col("uid"), seed), F.col("uid")], cap).drop("_rank")


def newest_cutoffs(df: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """(source, cutoff_us): the interpolated quantile of each listed source's dates."""
    dated = df.where("date is not null").select("source", F.unix_micros("date").alias("us"))
    out = None
    for source, fraction in sorted(fractions.items()):
        one = dated.where(F.col("source") == source).groupBy("source").agg(F.percentile("us", 1 - fraction).alias("cutoff_us"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else dated.sparkSession.createDataFrame([], "source string, cutoff_us double")


def carve_holdouts(df: DataFrame, heldout: str, eval_only: Sequence[str], origins: Sequence[str], fractions: dict[str, float]) -> DataFrame:
    """``df`` with ``part``; pool rows of a domain that also occurs in a holdout are marked as overlap."""
    cut = F.broadcast(newest_cutoffs(df, fractions))
    newest = F.col("origin").isin(list(origins)) | (F.unix_micros("date") >= F.col("cutoff_us"))
    part = F.when(F.col("source").isin(list(eval_only)), EVAL_ONLY).when(F.col("source") == heldout, HELDOUT).when(newest, TIME_SLICE).otherwise(POOL)
    marked = df.join(cut, "source", "left").withColumn("part", part).drop("cutoff_us")
    held = marked.where(F.col("part") != POOL).select("domain").distinct().withColumn("_held", F.lit(True))
    return salted_join(marked, held, ["domain"], "left").withColumn("part", F.when((F.col("part") == POOL) & F.col("_held"), OVERLAP).otherwise(F.col("part"))).drop("_held")


def depth_bucket(depth: Column, top: int = 4) -> Column:
    return F.when(depth >= top, F.lit(f"{top}+")).otherwise(depth.cast("string"))


def depth_table(df: DataFrame, top: int = 4) -> DataFrame:
    """Rows of each class by depth, the share of the larger class, and percentages of each class."""
    t = df.groupBy(depth_bucket(F.col("depth"), top).alias("bucket")).agg(F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("phishing"))
    totals = t.agg(F.sum("benign").alias("b"), F.sum("phishing").alias("p"))
    t = t.join(F.broadcast(totals)).withColumn("total", F.col("benign") + F.col("phishing"))
    pct = lambda n, d: F.bround(100 * F.col(n) / F.greatest(F.col(d), F.lit(1)), 2)
    return t.select(
        "bucket", "benign", "phishing", "total", F.bround(F.greatest("benign", "phishing") / F.col("total"), 4).alias("majority_share"),
        pct("benign", "b").alias("benign_pct_of_class"), pct("phishing", "p").alias("phishing_pct_of_class"),
    )


def depth_failures(df: DataFrame, fail_share: float = 0.9, top: int = 4) -> DataFrame:
    return depth_table(df, top).where(F.col("majority_share") > fail_share).select("bucket", "majority_share")


class DepthImbalance(RuntimeError):
    """A depth bucket holds almost one class only."""


def enforce_depth(df: DataFrame, fail_share: float = 0.9, top: int = 4) -> None:
    bad = depth_failures(df, fail_share, top).orderBy("bucket").collect()
    if bad:
        raise DepthImbalance(", ".join(f"{r['bucket']}: {r['majority_share']:.1%}" for r in bad))


def balance_depth(df: DataFrame, target: float = 0.7, min_minority: int = 20, seed: int = 42, top: int = 4) -> DataFrame:
    """In buckets where one class exceeds ``target``, rows of it are dropped by hash rank until it doesn't."""
    b = depth_bucket(F.col("depth"), top)
    counts = df.groupBy(b.alias("bucket")).agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    few, many = F.least("n0", "n1"), F.greatest("n0", "n1")
    act = (few >= min_minority) & (few > 0) & (many / (few + many) > target)
    plan = counts.where(act).select("bucket", F.when(F.col("n0") >= F.col("n1"), F.lit(0)).otherwise(F.lit(1)).alias("major"), F.floor(few * (target / (1 - target))).alias("keep_n"))
    marked = df.withColumn("bucket", b).join(F.broadcast(plan), "bucket", "left")
    cut = F.coalesce(F.col("label") == F.col("major"), F.lit(False))
    # a bucket may hold much of the corpus, so its rows are placed by a global sort of their keys alone
    keys = marked.where(cut).select("uid", "bucket", "keep_n", U.rank_hash(F.col("uid"), seed).alias("_h"))
    kept = positions(keys, "bucket", [F.col("_h"), F.col("uid")]).where(F.col("position") < F.col("keep_n")).select("uid")
    return marked.where(~cut).unionByName(marked.where(cut).join(kept, "uid", "left_semi")).drop("bucket", "major", "keep_n")


def source_shares(df: DataFrame, max_share: float) -> dict[str, float]:
    """Shares of the sources (a handful) by size, those over ``max_share`` cut and the rest raised in turn."""
    n = {r["source"]: float(r["n"]) for r in df.groupBy("source").agg(F.count("*").alias("n")).collect()}
    whole = sum(n.values())
    share = {s: x / whole for s, x in n.items()}
    for _ in share:
        over = {s for s, x in share.items() if x > max_share + 1e-15}
        if not over or len(over) == len(share):
            break
        excess = sum(share[s] - max_share for s in over)
        rest = sum(x for s, x in share.items() if s not in over)
        share = {s: max_share if s in over else x + excess * x / rest for s, x in share.items()}
    return share


def source_weights(df: DataFrame, max_share: float = 0.35) -> DataFrame:
    """``df`` with ``weight``: classes weigh alike within a source, sources by their capped share; the mean is 1."""
    share = source_shares(df, max_share)
    spark = df.sparkSession
    cells = df.groupBy("source", "label").agg(F.count("*").alias("n"))
    k = cells.groupBy("source").agg(F.count("*").alias("k"))
    whole = df.count()
    table = cells.join(F.broadcast(k), "source").join(F.broadcast(spark.createDataFrame(list(share.items()) or [("", 0.0)], "source string, share double")), "source")
    table = table.select("source", "label", (F.col("share") * whole / (F.col("k") * F.col("n"))).alias("weight"), "n")
    mean = table.agg((F.sum(F.col("weight") * F.col("n")) / F.sum("n")).alias("mean"))
    table = table.join(F.broadcast(mean)).select("source", "label", (F.col("weight") / F.col("mean")).alias("weight"))
    return df.join(F.broadcast(table), ["source", "label"])


def removed(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(step, source, n) of the rows that each step took; ``steps``: the rows after each, the first being the input."""
    out = None
    for (_, before), (name, after) in zip(steps, steps[1:]):
        a = before.groupBy("source").agg(F.count("*").alias("n"))
        b = after.groupBy("source").agg(F.count("*").alias("m"))
        one = a.join(b, "source", "left").select(F.lit(name).alias("step"), "source", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")
        out = one if out is None else out.unionByName(one)
    return out


def build(df: DataFrame, priority: Sequence[str], cap: int = 20, seed: int = 42, heldout: str = "", eval_only: Sequence[str] = (), origins: Sequence[str] = (), fractions: dict[str, float] | None = None, near_dup: bool = True, balance: bool = True, max_share: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """All steps; (rows with part and weight, rows removed by step and source).

    Steps whose result is used twice are written to the shared folder.
    """
    from netloom.plans.materialise import materialise

    steps = [("input", df)]
    step = lambda name, d: steps.append((name, materialise(d, name))) or steps[-1][1]
    d = step("url_dedup", dedup_urls(df, priority))
    if near_dup:
        d = step("near_dup_html", near_dup_pages(d, priority))
    d = step("shared_phishing_domains", drop_shared_domains(d))
    d = step("domain_ownership", assign_domain_owner(d, priority))
    d = step("domain_cap", cap_per_domain(d, cap, seed))
    d = step("holdout_domain_overlap", carve_holdouts(d, heldout, eval_only, origins, fractions or {}).where(F.col("part") != OVERLAP))
    if balance:
        d = step("depth_balance", balance_depth(d.where(F.col("part") == POOL), seed=seed).unionByName(d.where(F.col("part") != POOL)))
    pool = source_weights(d.where(F.col("part") == POOL), max_share)
    rest = d.where(F.col("part") != POOL).withColumn("weight", F.lit(1.0))
    return pool.unionByName(rest, allowMissingColumns=True), removed(steps)


def part_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, domains, phishing share, html share and date range of each group."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("domain").alias("n_domains"),
        F.bround(100 * F.avg("label"), 2).alias("phishing_pct"),
        F.bround(100 * F.avg(F.col("html_simhash").isNotNull().cast("double")), 2).alias("hashed_pct"),
        F.unix_micros(F.min("date")).alias("first_us"),
        F.unix_micros(F.max("date")).alias("last_us"),
    )


def removals_pivot(removals: DataFrame, steps: Sequence[str]) -> DataFrame:
    return removals.groupBy("source").pivot("step", list(steps)).agg(F.sum("n")).na.fill(0)
