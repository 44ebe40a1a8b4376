"""Exported trees, contributions, calibration and out-of-fold scores."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.plans import models as M


@pytest.fixture(scope="module")
def data(spark):
    x = spark.range(600).select(F.col("id").alias("row_id"), (F.rand(1) * 4).alias("a"), F.when(F.rand(2) > 0.2, F.rand(3)).alias("b"), F.concat(F.lit("d"), (F.col("id") % 40).cast("string")).alias("domain"))
    df = x.withColumn("label", ((F.col("a") + F.coalesce("b", F.lit(0.0)) + F.rand(4)) > 2.8).cast("int")).withColumn("text", F.when(F.col("label") == 1, "verify login now").otherwise("news of the day"))
    return spark.createDataFrame(df.collect(), df.schema)


def test_exported_trees_score_and_explain(spark, data):
    df, names = M.with_missing(data, ["a", "b"])
    model = M.trees(names, rounds=5, depth=3).fit(df)
    bundle = M.export_trees(model)
    got = M.score_trees(df, bundle, names)
    want = model.transform(df).select("row_id", F.col("rawPrediction"))
    both = got.join(want, "row_id").collect()
    assert all(abs(r.raw - r.rawPrediction[1]) < 1e-4 for r in both)
    row = np.array([2.0, 0.5, 0.0, 0.0])
    assert abs(M.tree_contributions(bundle, row[None]).sum() - M.tree_scores(bundle, row[None])[0]) < 1e-9
    top = M.explain(df, bundle, names, top=2).collect()
    assert all(len(r.reasons) <= 2 for r in top)


def known_value(tree, row, known, at=0):
    """The mean of a tree for a row of which only some features are known, by walking it."""
    f = tree["feature"][at]
    if f < 0:
        return tree["value"][at]
    a, b = tree["left"][at], tree["right"][at]
    if f in known:
        return known_value(tree, row, known, a if np.float32(row[f]) <= np.float32(tree["threshold"][at]) else b)
    n = tree["cover"][a] + tree["cover"][b]
    return (known_value(tree, row, known, a) * tree["cover"][a] + known_value(tree, row, known, b) * tree["cover"][b]) / n


def test_contributions_are_shapley_values():
    def grow(rng, depth):
        rows = []

        def node(d):
            at = len(rows)
            rows.append([-1, 0.0, -1, -1, rng.normal(), float(rng.integers(1, 50))])
            if d and rng.random() < 0.85:
                rows[at][0], rows[at][1] = int(rng.integers(0, 4)), rng.normal()
                rows[at][2], rows[at][3] = node(d - 1), node(d - 1)
            return at

        node(depth)
        return {k: np.array(v) for k, v in zip(("feature", "threshold", "left", "right", "value", "cover"), zip(*rows))}

    rng = np.random.default_rng(3)
    bundle, x = [grow(rng, 4) for _ in range(6)], rng.normal(size=(5, 4))
    got = M.tree_contributions(bundle, x)
    for r, row in enumerate(x):
        value = lambda known: sum(known_value(t, row, known) for t in bundle)
        for i in range(4):
            others = [j for j in range(4) if j != i]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (value({*s, i}) - value(set(s))) for k in range(4) for s in itertools.combinations(others, k))
            assert abs(got[r, i] - want) < 1e-9
        assert abs(got[r, -1] - value(set())) < 1e-9


def test_hybrid_and_propensity(spark, data):
    h = M.Hybrid(["a", "b"], {"words": lambda: M.word_ngrams(min_df=1)}, make=lambda names: M.trees(names, rounds=3, depth=2), folds=2).fit(data)
    got = h.score(data)
    assert got.columns == [*data.columns, "score"] and got.where("b is null").count() == data.where("b is null").count()
    m = {r.label: r.s for r in got.groupBy("label").agg(F.avg("score").alias("s")).collect()}
    assert m[1] > 0.7 > 0.3 > m[0]
    seen = data.withColumn("has_page", F.col("a") > 2)
    p = M.propensity(seen, ["a"], make=lambda names: M.trees(names, rounds=2, depth=2))(seen)
    mean = {r.has_page: r.p for r in p.groupBy("has_page").agg(F.avg("propensity").alias("p")).collect()}
    assert p.count() == 600 and mean[True] > 0.75 and mean[False] < 0.25


def test_out_of_fold_and_calibration(spark, data):
    s = M.out_of_fold(data, lambda: M.word_ngrams(min_df=1), folds=2)
    assert s.count() == 600
    m = s.groupBy("label").agg(F.avg("score").alias("s")).collect()
    assert {r.label: r.s > 0.5 for r in m} == {0: False, 1: True}
    _, apply = M.calibrate(s)
    c = apply(s).orderBy("score").select("calibrated").collect()
    assert all(a.calibrated <= b.calibrated + 1e-12 for a, b in zip(c, c[1:]))


def test_interpolate(spark):
    f = M.interpolate(F.col("x"), [(0.0, 0.0), (1.0, 0.5), (2.0, 1.0)])
    got = spark.createDataFrame([(-1.0,), (0.5,), (1.5,), (9.0,)], "x double").select(f.alias("y")).collect()
    assert [r.y for r in got] == [0.0, 0.25, 0.75, 1.0]
