"""Learners as spark.ml pipelines, out-of-fold stacking, calibration, and scoring of exported trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Imputer, NGram, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators.splits import grouped_folds


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def with_missing(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Nulls become -1 beside a flag that says so, since the trees take no nulls."""
    flags = [f"{c}_missing" for c in features]
    out = df.withColumns({f: F.col(c).isNull().cast("double") for c, f in zip(features, flags)}).na.fill(-1.0, list(features))
    return out, [*features, *flags]


def probability(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    keep = df.columns
    return model.transform(df).select(*[c for c in keep if c != name], vector_to_array("probability")[1].alias(name))


def trees(features: Sequence[str], rounds: int = 20, depth: int = 5, seed: int = 1) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="x"), GBTClassifier(featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed)])


def linear(features: Sequence[str]) -> Pipeline:
    """Median imputation, scaling, logistic regression."""
    filled = [f"{c}_f" for c in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="x0"), StandardScaler(inputCol="x0", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="label", regParam=0.001)])


def _vocabulary(stages: list, column: str, min_df: float, weight: str | None) -> Pipeline:
    lr = LogisticRegression(featuresCol="tfidf", labelCol="label", regParam=0.01)
    return Pipeline(stages=[*stages, CountVectorizer(inputCol=column, outputCol="tf", minDF=min_df, vocabSize=500_000), IDF(inputCol="tf", outputCol="tfidf"), lr.setWeightCol(weight) if weight else lr])


def char_ngrams(text: str = "text", lo: int = 3, hi: int = 5, min_df: float = 2, weight: str | None = None) -> Pipeline:
    """TF-IDF of character n-grams with logistic regression."""
    chars = RegexTokenizer(inputCol=text, outputCol="chars", pattern="(?s).", gaps=False, toLowercase=True)
    grams = [NGram(n=n, inputCol="chars", outputCol=f"g{n}") for n in range(lo, hi + 1)]
    joined = SQLTransformer(statement=f"SELECT *, concat({', '.join(f'g{n}' for n in range(lo, hi + 1))}) AS grams FROM __THIS__")
    return _vocabulary([chars, *grams, joined], "grams", min_df, weight)


def word_ngrams(text: str = "text", min_df: float = 2, weight: str | None = None) -> Pipeline:
    """TF-IDF of words and pairs of words with logistic regression."""
    words = RegexTokenizer(inputCol=text, outputCol="g1", pattern="[^a-z0-9]+", toLowercase=True, minTokenLength=1)
    joined = SQLTransformer(statement="SELECT *, concat(g1, g2) AS grams FROM __THIS__")
    return _vocabulary([words, NGram(n=2, inputCol="g1", outputCol="g2"), joined], "grams", min_df, weight)


def text_model(spec: dict) -> Pipeline:
    kind = {"char": char_ngrams, "word": word_ngrams}[spec["kind"]]
    return kind(**{k: v for k, v in spec.items() if k != "kind"})


def out_of_fold(df: DataFrame, make: Callable[[], Pipeline], folds: int = 3, seed: int = 0, name: str = "score") -> DataFrame:
    """Every row scored by a model that didn't see its domain; the number of folds is fixed and small."""
    df = df.withColumn("_fold", grouped_folds(F.col("domain"), folds, seed))
    out = None
    for k in range(folds):
        model = make().fit(df.where(F.col("_fold") != k))
        one = probability(model, df.where(F.col("_fold") == k), name)
        out = one if out is None else out.unionByName(one)
    return out.drop("_fold")


def stack(df: DataFrame, makers: dict[str, Callable[[], Pipeline]], folds: int = 3, key: str = "row_id") -> DataFrame:
    """(key, label, domain, one score a learner, stacked): a logistic regression over out-of-fold log-odds."""
    base = df.select(key, "label", "domain")
    for name, make in makers.items():
        base = base.join(out_of_fold(df, make, folds, name=name).select(key, name), key)
    base = base.withColumns({f"{n}_l": logit(F.col(n)) for n in makers})
    meta = Pipeline(stages=[VectorAssembler(inputCols=[f"{n}_l" for n in makers], outputCol="x"), LogisticRegression(featuresCol="x", labelCol="label")]).fit(base)
    return probability(meta, base, "stacked").drop(*[f"{n}_l" for n in makers])


def calibrate(df: DataFrame, score: str = "score") -> tuple[object, Callable[[DataFrame], DataFrame]]:
    """Isotonic calibration; the returned function adds ``calibrated``, ties broken by the raw score."""
    model = IsotonicRegression(featuresCol=score, labelCol="label").fit(df.select(F.col(score).cast("double").alias(score), F.col("label").cast("double").alias("label")))
    return model, lambda d: model.transform(d).withColumn("calibrated", F.col("prediction") + 1e-9 * F.col(score)).drop("prediction")


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear map through sorted knots, flat outside."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        y = F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)
        out = F.when(x < x1, y).otherwise(out)
    return F.when(x <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)


def verdict_of(score: Column, suspicious: float, dangerous: float) -> Column:
    return F.when(score >= dangerous, F.lit(2)).when(score >= suspicious, F.lit(1)).otherwise(F.lit(0))


def export_trees(model: PipelineModel) -> list[dict]:
    """The ensemble as arrays: feature (-1 at a leaf), threshold, left, right, value, cover."""
    out = []
    gbt = model.stages[-1]
    for tree, weight in zip(gbt.trees, gbt.treeWeights):
        rows: list[list] = []

        def walk(node, rows=rows, weight=weight) -> int:
            at = len(rows)
            cover = float(node.impurityStats().count())
            rows.append([-1, 0.0, -1, -1, weight * node.prediction(), cover])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][0], rows[at][1] = split.featureIndex(), split.threshold()
                rows[at][2] = walk(node.leftChild())
                rows[at][3] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        cols = list(zip(*rows))
        out.append({"feature": np.array(cols[0]), "threshold": np.array(cols[1]), "left": np.array(cols[2]), "right": np.array(cols[3]), "value": np.array(cols[4]), "cover": np.array(cols[5])})
    return out


def tree_scores(bundle: list[dict], x: np.ndarray) -> np.ndarray:
    """Summed leaf values, all rows of a batch walking each tree together; float32 comparisons."""
    x = x.astype(np.float32)
    total = np.zeros(len(x))
    for t in bundle:
        at = np.zeros(len(x), dtype=int)
        threshold = t["threshold"].astype(np.float32)
        while (inner := t["feature"][at] >= 0).any():
            f = np.where(inner, t["feature"][at], 0)
            go_left = x[np.arange(len(x)), f] <= threshold[at]
            at = np.where(inner, np.where(go_left, t["left"][at], t["right"][at]), at)
        total += t["value"][at]
    return total


def score_trees(df: DataFrame, bundle: list[dict], features: Sequence[str], name: str = "raw") -> DataFrame:
    """``df`` with the raw score of an exported ensemble (a few MB, sent to all tasks)."""
    shared = df.sparkSession.sparkContext.broadcast(bundle)

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(tree_scores(shared.value, x.to_numpy(dtype=float)))

    return df.withColumn(name, score(F.struct(*[F.col(c).cast("double") for c in features])))


def _leaves(tree: dict) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(value, {feature: (above, up to, share)}) of each leaf: the interval of a feature that leads there, and the share of rows that its splits let through."""
    out = []
    stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while stack:
        at, path = stack.pop()
        f = int(tree["feature"][at])
        if f < 0:
            out.append((float(tree["value"][at]), path))
            continue
        cut, sides = np.float32(tree["threshold"][at]), (int(tree["left"][at]), int(tree["right"][at]))
        whole = tree["cover"][sides[0]] + tree["cover"][sides[1]]
        above, upto, share = path.get(f, (-np.inf, np.inf, 1.0))
        for side, child in enumerate(sides):
            part = tree["cover"][child] / whole if whole else 0.5
            new = (above, min(upto, cut), share * part) if side == 0 else (max(above, cut), upto, share * part)
            stack.append((child, {**path, f: new}))
    return out


def tree_contributions(bundle: list[dict], x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values of each row's features, with the ensemble's mean as last column; they add up to the score.

    A leaf's value counts, for a set of known features, as far as the row goes
    towards it in them, times the shares of rows that go there in the others.
    So every leaf is a product over the few features of its path; their Shapley
    values are sums over the elementary polynomials of the others, for all rows
    of the batch at once.  Features off the path add nothing.
    """
    x = x.astype(np.float32)
    out = np.zeros((len(x), x.shape[1] + 1))
    for tree in bundle:
        for value, path in _leaves(tree):
            names = list(path)
            d = len(names)
            share = np.array([path[f][2] for f in names])
            out[:, -1] += value * share.prod()
            if not d:
                continue
            goes = np.stack([(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in names], axis=1).astype(float)
            for i, f in enumerate(names):
                # coefficient k: the sum over sets of k known others
                poly = np.zeros((len(x), d))
                poly[:, 0] = 1.0
                for j in range(d):
                    if j != i:
                        poly[:, 1:] = poly[:, 1:] * share[j] + poly[:, :-1] * goes[:, j : j + 1]
                        poly[:, 0] *= share[j]
                weights = np.array([1 / (d * math.comb(d - 1, k)) for k in range(d)])
                out[:, f] += value * (goes[:, i] - share[i]) * (poly @ weights)
    return out


def explain(df: DataFrame, bundle: list[dict], features: Sequence[str], top: int = 3, least: float = 0.0) -> DataFrame:
    """``df`` with ``reasons``: the features that add most to the score, with how much."""
    shared = df.sparkSession.sparkContext.broadcast(bundle)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def parts(x: pd.DataFrame) -> pd.Series:
        return pd.Series(tree_contributions(shared.value, x.to_numpy(dtype=float)).tolist())

    d = df.withColumn("_phi", parts(F.struct(*[F.col(c).cast("double") for c in features])))
    names = F.array(*[F.lit(c) for c in features])
    pairs = F.transform(names, lambda n, i: F.struct(F.get("_phi", i).alias("phi"), n.alias("feature")))
    return d.withColumn("reasons", F.slice(F.sort_array(F.filter(pairs, lambda p: p["phi"] > least), asc=False), 1, top)).drop("_phi")


class Hybrid:
    """Trees on features and on the log-odds of text models, which score the training rows out of fold and others by a model of all rows.

    With the features of a page and text models of its text beside those of the
    address this is the page model as well; nulls (no page) are flagged.
    """

    def __init__(self, features: Sequence[str], texts: dict[str, Callable[[], Pipeline]], make: Callable[[Sequence[str]], Pipeline] = trees, folds: int = 3) -> None:
        self.features, self.texts, self.make, self.folds = list(features), texts, make, folds

    def fit(self, df: DataFrame, key: str = "row_id") -> Hybrid:
        """``df``: key, label, domain, features and the texts' columns."""
        base = df
        for name, make in self.texts.items():
            own = out_of_fold(df, make, self.folds, name=f"{name}_p").select(key, f"{name}_p")
            base = base.join(own, key)
        self.models = {name: make().fit(df) for name, make in self.texts.items()}
        ready, names = self._columns(base)
        self.top = self.make(names).fit(ready)
        return self

    def _columns(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        df = df.withColumns({f"{n}_l": logit(F.col(f"{n}_p")) for n in self.texts})
        ready, names = with_missing(df, self.features)
        return ready, [*names, *[f"{n}_l" for n in self.texts]]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        columns = [c for c in df.columns if c != name]
        out = df
        for text, model in self.models.items():
            out = probability(model, out, f"{text}_p")
        ready, _ = self._columns(out)
        scored = probability(self.top, ready, name)
        # nulls come back where they stood
        undo = [F.when(F.col(f"{c}_missing") == 0, F.col(c)).alias(c) if c in self.features else F.col(c) for c in columns]
        return scored.select(*undo, name)


def propensity(df: DataFrame, features: Sequence[str], seen: str = "has_page", make: Callable[[Sequence[str]], Pipeline] = trees) -> Callable[[DataFrame], DataFrame]:
    """Fits, for each class, the chance that a row has a page; the returned function adds ``propensity`` by a row's own class."""
    ready, names = with_missing(df.withColumn("_class", F.col("label")).withColumn("label", F.col(seen).cast("int")), features)
    models = {y: make(names).fit(ready.where(F.col("_class") == y)) for y in (0, 1)}

    def apply(rows: DataFrame) -> DataFrame:
        marked, _ = with_missing(rows, features)
        out = None
        for y, model in models.items():
            one = probability(model, marked.where(F.col("label") == y), "propensity")
            out = one if out is None else out.unionByName(one)
        return out.drop(*[f"{c}_missing" for c in features])

    return apply


def leave_one_source_out(df: DataFrame, make: Callable[[], Pipeline], sources: Sequence[str]) -> DataFrame:
    """Every listed source scored by a model trained without it."""
    out = None
    for s in sources:
        one = probability(make().fit(df.where(F.col("source") != s)), df.where(F.col("source") == s))
        out = one if out is None else out.unionByName(one)
    return out
