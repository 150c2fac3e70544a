"""Supervised detection: gradient-boosted trees, a tuned threshold, and exact tree SHAP explanations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.functions.columns import flag
from quaylight.functions.samples import lowest
from quaylight.operators.blocks import blocks, dropped, entries, matrix, quantile_cuts, summed
from quaylight.operators.metrics import best_threshold, classification_metrics, scale_pos_weight
from quaylight.operators.trees import GBTClassifier, RandomForestClassifier, Tree, bins_of, cuts_of

#: Values of features that the driver holds at most. Models are fitted on all rows; more of them stay on the executors.
CELLS = 2**23


@dataclass(frozen=True)
class Booster:
    """Boosted trees with their features, and what the explanations need of them."""

    trees: list[Tree]
    features: list

    @property
    def leaves(self) -> list[dict]:
        return [leaf for tree in self.trees for leaf in tree.leaves()]

    def margin_base(self) -> float:
        return sum(leaf["value"] * np.prod(leaf["zero"]) for leaf in self.leaves)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum(tree.apply(x) for tree in self.trees)))


@dataclass(frozen=True)
class Forest:
    """The trees of a random forest with their features."""

    trees: list[Tree]
    features: list

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sum(tree.apply(x) for tree in self.trees) / len(self.trees)


@dataclass(frozen=True)
class Logistic:
    """A logistic regression: a weight for each feature, and the margin of zeros."""

    weights: np.ndarray
    base: float
    features: list

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.base, -500, 500)))


def _sample(train: DataFrame, features: list[str], label: str, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most `rows` rows as features, label and weight, those of lowest hash; positives have the weight of all negatives per positive. Fits ask for all rows."""
    own = train.select(F.xxhash64(*[F.col(f"`{c}`") for c in train.columns]).alias("_hash"), F.col(label).cast("double").alias("_y"), *[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(features)])
    found = lowest(own, "_hash", rows)
    y, x = found[:, 0], np.ascontiguousarray(found[:, 1:])
    return x, y, np.where(y == 1, scale_pos_weight(train, label).first()[0], 1.0)


def _columns(train: DataFrame, features: list[str], label: str) -> DataFrame:
    return train.select(F.col(label).cast("double").alias("_y"), *[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(features)])


def _fit_trees(model: GBTClassifier | RandomForestClassifier, train: DataFrame, features: list[str], label: str, cells: int) -> list[Tree]:
    """The model's trees on all rows: on the driver if their values are few or, after equal rows are counted, their bins are at most `cells`."""
    n, width = train.count(), len(features)
    if n * width <= cells // 8:
        x, y, weight = _sample(train, features, label, n)
        cuts = [cuts_of(c) for c in x.T]
        return model.fit(bins_of(x, cuts), cuts, y, weight)
    own, positive = _columns(train, features, label), scale_pos_weight(train, label).first()[0]
    cuts = quantile_cuts(own.drop("_y"), width)
    different = entries(own, cuts)
    n = different.count()
    if n * width <= cells:
        bins, y, times = matrix(different, width)
        dropped(different)
        return model.fit(bins, cuts, y, np.where(y == 1, positive, 1.0), times)
    made = blocks(different, width, n)
    dropped(different)
    return model.fit_blocks(made, cuts, positive)


def fit_booster(train: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 5, rate: float = 0.1, cells: int = CELLS) -> Booster:
    """Boosted trees on features without NULLs, on all rows, positives weighted by the negatives per positive. Beyond `cells` values train is read in several passes."""
    return Booster(_fit_trees(GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate), train, features, label, cells), features)


def fit_random_forest(train: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 5, seed: int = 42, cells: int = CELLS) -> Forest:
    """A random forest with sqrt(features) a split, on all rows, positives weighted; passes as in fit_booster()."""
    return Forest(_fit_trees(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed), train, features, label, cells), features)


def _newton(p: np.ndarray, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient and second derivatives of a batch, one below the other."""
    return np.vstack([z.T @ (weight * (y - p)), (z * (weight * p * (1 - p))[:, None]).T @ z])


def fit_logistic(train: DataFrame, features: list[str], label: str, iterations: int = 1000, cells: int = CELLS) -> Logistic:
    """Logistic regression on standardised features by Newton steps, on all rows, positives weighted. Beyond `cells` values each step is a pass over train."""
    n, width = train.count(), len(features)
    if local := n * width <= cells:
        x, y, weight = _sample(train, features, label, n)
        mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(width), np.ones(width))
        whole = weight.sum()
    else:
        own, positive = _columns(train, features, label), scale_pos_weight(train, label).first()[0]
        first = summed(own, lambda m: np.append((m[:, 1:]).sum(0), (m[:, 0] == 1).sum()), width + 1)
        mean, whole = first[:-1] / n, n + (positive - 1) * first[-1]
        scale = np.sqrt(summed(own, lambda m: ((m[:, 1:] - mean) ** 2).sum(0), width) / n)
    scale = np.where(scale > 0, scale, 1.0)
    beta, ridge = np.zeros(width + 1), 1e-6 * max(1.0, whole) * np.eye(width + 1)
    made = lambda x: np.column_stack([(x - mean) / scale, np.ones(len(x))])
    told = lambda z, beta: 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
    if local:
        z = made(x)
    for _ in range(iterations):
        if local:
            sums = _newton(told(z, beta), z, y, weight)
        else:

            def add(m: np.ndarray, beta=beta) -> np.ndarray:
                z = made(m[:, 1:])
                return _newton(told(z, beta), z, m[:, 0], np.where(m[:, 0] == 1, positive, 1.0)).ravel()

            sums = summed(own, add, (width + 2) * (width + 1)).reshape(width + 2, width + 1)
        step = np.linalg.solve(sums[1:] + ridge, sums[0] - ridge @ beta)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return Logistic(beta[:-1] / scale, float(beta[-1] - (beta[:-1] * mean / scale).sum()), features)


def predict(df: DataFrame, model: Booster | Forest | Logistic, out: str = "fraud_probability") -> DataFrame:
    """df with the probability of a positive. A model is arrays of bounded size that travel with the task."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.probability(np.column_stack([c.to_numpy(float) for c in batch])))

    return df.withColumn(out, scored(*[F.col(f"`{c}`").cast("double") for c in model.features]))


def _tables(leaves: list) -> list:
    """For each leaf the Shapley values of its features, by which of them a row meets (one row of the table for each pattern)."""
    made = []
    for leaf in leaves:
        zero, k = leaf["zero"], len(leaf["feature"])
        table = np.zeros((1 << k, k))
        for pattern in range(1 << k):
            one = [pattern >> j & 1 for j in range(k)]
            for i in range(k):
                others = [j for j in range(k) if j != i]
                for size in range(k):
                    share = factorial(size) * factorial(k - size - 1) / factorial(k)
                    for inside in combinations(others, size):
                        table[pattern, i] += share * np.prod([one[j] if j in inside else zero[j] for j in others])
                table[pattern, i] *= leaf["value"] * (one[i] - zero[i])
        made.append((np.array(leaf["feature"], int), np.array(leaf["low"]), np.array(leaf["high"]), table))
    return made


def shap_values(df: DataFrame, booster: Booster, out: str = "shap_values") -> DataFrame:
    """df with the exact path-dependent tree SHAP values of each row (array<double>, in the order of the features).

    They add up to the row's margin (log odds) less the margin's mean over the training rows.
    """
    tables, width = _tables([leaf for leaf in booster.leaves if leaf["feature"]]), len(booster.features)

    @F.pandas_udf("array<double>")
    def explained(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(float) for c in batch])
            total = np.zeros((len(x), width))
            for feature, low, high, table in tables:
                own = x[:, feature]
                pattern = ((own > low) & (own <= high)) @ (1 << np.arange(len(feature)))
                total[:, feature] += table[pattern]
            yield pd.Series(list(total))

    return df.withColumn(out, explained(*[F.col(c).cast("double") for c in booster.features]))


def top_features(df: DataFrame, features: list[str], n: int = 3, values: str = "shap_values", out: str = "top_shap_features") -> DataFrame:
    """The n features with the largest absolute values as "name(+0.123)", joined by ", "; of equal ones the later feature first."""
    names = F.array(*[F.lit(f) for f in features])
    ranked = F.expr(f"array_sort(zip_with({values}, sequence(0, size({values}) - 1), (v, i) -> struct(-abs(v) as a, -i as b, v as v)))")
    df = df.withColumn("_names", names).withColumn("_ranked", ranked)
    said = F.expr(f"array_join(transform(slice(_ranked, 1, {n}), x -> format_string('%s(%+.3f)', _names[-x.b], x.v)), ', ')")
    return df.withColumn(out, said).drop("_names", "_ranked")


def global_top_features(df: DataFrame, features: list[str], n: int = 10, values: str = "shap_values") -> DataFrame:
    """(feature, importance): the n largest mean absolute values."""
    names = F.array(*[F.lit(f) for f in features])
    each = df.select(F.posexplode(values).alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("importance"))
    return each.select(names[F.col("i")].alias("feature"), "importance").orderBy(F.desc("importance"), "feature").limit(n)


def detection_report(train: DataFrame, test: DataFrame, features: list[str], label: str = "analyst_confirmed_label", trees: int = 100, depth: int = 5, rate: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train and test rows with fraud_probability and fraud_prediction_flag, the test rows with top_shap_features too, and one row of the test's metrics.

    The threshold is the train's best.
    """
    booster = fit_booster(train, features, label, trees, depth, rate)
    known = predict(train, booster)
    threshold = best_threshold(known, label, "fraud_probability").first()
    cut = threshold.threshold if threshold else 0.5
    flagged = lambda rows: rows.withColumn("fraud_prediction_flag", flag(F.col("fraud_probability") >= cut))
    scored = flagged(predict(test, booster))
    return flagged(known), top_features(shap_values(scored, booster), features), classification_metrics(scored, label, "fraud_probability", cut)


def supervised_detection(train: DataFrame, test: DataFrame, features: list[str], label: str = "analyst_confirmed_label", trees: int = 100, depth: int = 5, rate: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The test rows and the metrics of detection_report()."""
    return detection_report(train, test, features, label, trees, depth, rate)[1:]
