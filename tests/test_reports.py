"""Brand joins and report operators against brute force and at the edges."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import brands, reports


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_neighbours_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(0, 7)))
    labels, names = {word() for _ in range(150)} | {"x" * 60}, {word() for _ in range(40)}
    a = spark.createDataFrame([(x,) for x in [*labels, None]], "label string").withColumn("v", F.lit(1))
    b = spark.createDataFrame([(x,) for x in [*names, None, *names]], "name string").withColumn("size", F.lit(1))
    got = {(r.label, r.name, r.distance) for r in brands.neighbours(a, b).collect()}
    assert got == {(x, y, levenshtein(x, y)) for x in labels for y in names if levenshtein(x, y) <= 2}
    near = {(r.label, r.name) for r in brands.one_edit(a, b).collect()}
    swap = lambda x, y: len(x) == len(y) and any(x[:i] + x[i + 1] + x[i] + x[i + 2 :] == y for i in range(len(x) - 1)) and x != y
    assert near == {(x, y) for x in labels for y in names if x and y and x[0] == y[0] and (levenshtein(x, y) == 1 or swap(x, y))}
    assert brands.neighbours(a.limit(0), b).count() == 0


def test_mismatch(spark):
    sites = [("paypal", "paypal.com"), ("paypal", "paypal.xyz"), ("pay-pal", "pay-pal.test"), ("paypa1", "paypa1.com"), ("xn--pypal-4ve", "xn--pypal-4ve.com"), ("paypall", "paypall.com"), ("paypla", "paypla.com"), ("shop", "shop.com"), (None, None), ("citibank", "c1tibank.com")]
    df = spark.createDataFrame(sites + sites, "label string, domain string").withColumn("official", F.lit(1))
    b = spark.createDataFrame([("paypal", ["paypal.com"]), ("sbi", ["sbi.test"]), ("citibank", None)], "brand string, domains array<string>")
    got = {r.domain: tuple(int(r[c]) for c in brands.SIGNALS) for r in brands.mismatch(df, b).collect()}
    assert got == {
        "paypal.com": (0, 0, 0, 1), "paypal.xyz": (0, 0, 1, 0), "pay-pal.test": (0, 0, 1, 0), "paypa1.com": (1, 0, 0, 0), "xn--pypal-4ve.com": (1, 0, 0, 0), "paypall.com": (0, 0, 0, 0), "paypla.com": (0, 1, 0, 0),
        "shop.com": (0, 0, 0, 0), "c1tibank.com": (0, 0, 0, 0),
    }


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    assert reports.one_to_one(a, a.select("k", F.lit(1).alias("w")).where("k = 1"), ["k"], "left").count() == 3
    with pytest.raises(reports.NotUnique):
        reports.one_to_one(a, a.unionByName(a), ["k"])
    with pytest.raises(ValueError):
        reports.one_to_one(a, a.where("k = 1").select("k"), ["k"], "left", complete=True)
    t = spark.createDataFrame([(1.0000001, None), (2.0, 3.0)], "p double, q double")
    assert reports.twins(t, spark.createDataFrame([(1.0, None)], "p double, q double"), ["p", "q"]).count() == 1
    assert [tuple(r) for r in reports.unordered_pairs(a, "v").orderBy("a", "b").collect()] == [("x", "y"), ("x", "z"), ("y", "z")]


def test_small_reports(spark):
    g = spark.createDataFrame([("m", "a", 3.0), ("m", "b", 1.0), ("n", "a", 1.0), ("o", "a", 0.0)], "model string, feature string, gain double")
    assert {r.feature: round(r.share, 6) for r in reports.gain_share(g).collect()} == {"a": round(1.75 / 3, 6), "b": round(0.25 / 3, 6)}
    x = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, None)], "k int, p double, q double")
    y = spark.createDataFrame([(1, 1.0, 9.0), (2, 3.0, None)], "k int, p double, q double")
    assert [r.feature for r in reports.top_changes(x, y, "k", ["p", "q"], 1).collect()] == ["q"]
    s = spark.createDataFrame([(0.9, 1), (None, 0)], "tld_risk double, label int")
    assert sorted(r.score for r in reports.suffix_baseline(s).collect()) == [0.5, 0.9]
    assert sorted(r.score for r in reports.age_baseline(spark.createDataFrame([(5.0,), (None,)], "domain_age_days double")).collect()) == [-5.0, 0.0]
    synced = spark.createDataFrame([("allow", "a"), ("block_domain", "b")], "list string, entry string")
    merged = reports.merge_allowlist(synced, spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "entry string"))
    assert sorted(map(tuple, merged.collect())) == [("allow", "a"), ("allow", "c"), ("block_domain", "b")]
    feeds = spark.createDataFrame([("f", 60), ("g", 60), ("h", 60)], "feed string, every_s int")
    polls = spark.createDataFrame([("f", "2023-01-01 00:00:00"), ("g", "2023-01-01 00:00:50"), ("g", "2022-01-01 00:00:00")], "feed string, at string").select("feed", F.to_timestamp("at").alias("at"))
    assert {r.feed for r in reports.due_feeds(feeds, polls, F.to_timestamp(F.lit("2023-01-01 00:01:00"))).collect()} == {"f", "h"}
