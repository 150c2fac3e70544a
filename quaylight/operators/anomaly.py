"""Unsupervised detection: an isolation forest and a one-class model, scored in Arrow batches.

Neither model is in Spark's library. A tree of the forest is grown from 256 rows, which is the method's own subsample, drawn
from all training rows; trees share rows only if there are fewer than all of them ask for. The one-class model starts from
the solution over a bounded sample (START_ROWS), and PASSES gradient steps over all training rows follow; its offset is the
exact quantile of all their scores. Samples are taken by the hash of the whole row, so they don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from quaylight.functions.columns import flag
from quaylight.functions.quantiles import quantile
from quaylight.operators.components import stored
from quaylight.operators.stats import Scaler, minmax_invert

SUBSAMPLE, TREES, START_ROWS, PASSES = 256, 100, 8192, 10


def sample(df: DataFrame, columns: list[str], rows: int, seed: int = 42) -> np.ndarray:
    """At most `rows` rows as a matrix, the lowest hashes of whole rows first.

    Rows that can't be among them stay on the executors: only a share that holds twice as many as asked for is sorted.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    some = df.select(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *plain), 1).alias("_place"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    n, share = some.count(), 2.0
    while True:
        near = some if share * rows >= n else some.where(F.col("_place") < int(share * rows / n * 2**63))
        found = near.orderBy(*near.columns).limit(rows).drop("_place").collect()
        if len(found) == min(n, rows):
            return np.array([tuple(r) for r in found], float).reshape(-1, len(columns))
        share *= 4


def _average_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n keys."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


@dataclass(frozen=True)
class IsolationForest:
    """Trees as flat arrays; an inner node sends a row left if its feature is under the cut."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    size: int

    @staticmethod
    def fit(rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 42) -> IsolationForest:
        """rows: trees * subsample training rows, which the trees divide among themselves, or all if there are fewer, from which each tree draws."""
        rng = np.random.default_rng(seed)
        nodes: list[list] = []
        n = min(subsample, len(rows))
        most = int(np.ceil(np.log2(max(n, 2))))

        def grow(x: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + _average_path(len(x))])
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else []
            if depth < most and len(x) > 1 and len(spread):
                f = rng.choice(spread)
                c = rng.uniform(x[:, f].min(), x[:, f].max())
                below = x[:, f] < c
                nodes[me][:2] = [int(f), float(c)]
                nodes[me][2] = grow(x[below], depth + 1)
                nodes[me][3] = grow(x[~below], depth + 1)
            return me

        if len(rows) >= trees * n:
            own = rng.permutation(len(rows))[: trees * n].reshape(trees, n)
        else:
            own = [rng.choice(len(rows), n, replace=False) for _ in range(trees)]
        roots = [grow(rows[i], 0) for i in own]
        f, c, l, r, d = zip(*nodes)
        return IsolationForest(np.array(f), np.array(c), np.array(l), np.array(r), np.array(d), np.array(roots), n)

    @staticmethod
    def fit_table(train: DataFrame, columns: list[str], seed: int = 42) -> IsolationForest:
        return IsolationForest.fit(sample(train, columns, TREES * SUBSAMPLE, seed), seed=seed)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean depth / expected depth): near 1 is anomalous."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(self.feature[at] >= 0)
                if not inner.size:
                    break
                node = at[inner]
                at[inner] = np.where(x[inner, self.feature[node]] < self.cut[node], self.left[node], self.right[node])
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / max(_average_path(self.size), 1e-12))


@dataclass(frozen=True)
class OneClass:
    """A one-class machine with a Gaussian kernel in random Fourier features, trained by averaged subgradient steps."""

    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    rho: float

    @staticmethod
    def fit(rows: np.ndarray, nu: float = 0.1, features: int = 256, steps: int = 300, seed: int = 42) -> OneClass:
        rng = np.random.default_rng(seed)
        d = rows.shape[1]
        gamma = 1.0 / (d * (rows.var() or 1.0))
        waves, phase = rng.normal(scale=np.sqrt(2 * gamma), size=(d, features)), rng.uniform(0, 2 * np.pi, features)
        z = np.sqrt(2.0 / features) * np.cos(rows @ waves + phase)
        w = z.mean(0)
        total = np.zeros_like(w)
        for t in range(1, steps + 1):
            s = z @ w
            inside = s < np.quantile(s, nu)
            w = w - (w - z[inside].sum(0) / max(1.0, nu * len(z))) / np.sqrt(t + 1)
            total += w
        w = total / steps
        return OneClass(waves, phase, w, float(np.quantile(z @ w, nu)))

    @staticmethod
    def fit_table(train: DataFrame, columns: list[str], nu: float = 0.1, passes: int = PASSES, seed: int = 42) -> OneClass:
        """fit() on a sample, then `passes` averaged subgradient steps whose sums are over all rows of train.

        A step's border between rows inside and outside is that of the sample; the final offset is exact.
        """
        rows = sample(train, columns, START_ROWS, seed)
        if not len(rows):
            rows = np.zeros((1, len(columns)))
        model = OneClass.fit(rows, nu, seed=seed)
        w, mean = model.weights, np.zeros_like(model.weights)
        for t in range(passes):
            step = replace(model, weights=w, rho=0.0)
            step = replace(step, rho=float(np.quantile(step.score(rows), nu)))
            n, total = step.outside(train, columns)
            w = w - (w - total / max(n, 1)) / (t + 2)
            mean += w / passes
        model = replace(model, weights=mean if passes else w, rho=0.0)
        scores = stored(score_with(train, model, columns, "_score").select("_score"), "scores")  # a quantile takes many passes
        return replace(model, rho=quantile(scores, "_score", nu) or 0.0)

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / self.waves.shape[1]) * np.cos(x @ self.waves + self.phase)

    def outside(self, df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
        """How many rows of df score under 0, and the sum of their features; summed on the executors."""

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(self.weights.size + 1)
            for batch in batches:
                z = self.features(batch.to_numpy(float))
                z = z[z @ self.weights < self.rho]
                total += np.append(z.sum(0), len(z))
            yield pd.DataFrame({"at": np.arange(total.size), "value": total})

        rows = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).mapInPandas(sums, "at long, value double")
        total = np.zeros(self.weights.size + 1)
        for at, value in rows.groupBy("at").agg(F.sum("value")).collect():
            total[at] = value
        return int(total[-1]), total[:-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Signed distance: under 0 is anomalous."""
        return self.features(x) @ self.weights - self.rho


def score_with(df: DataFrame, model, columns: list[str], out: str) -> DataFrame:
    """df with the model's score; the model is small and of fixed size, so it travels with the task."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in batch])))

    return df.withColumn(out, scored(*[F.col(c).cast("double") for c in columns]))


def unsupervised_detection(train: DataFrame, df: DataFrame, columns: list[str], contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """df with isolation_forest_score, ocsvm_score, their mean unsupervised_anomaly_score (0..1), and the flag at the train's top share.

    Features must not be NULL. Both scores are scaled by the train's range, 1 being the most anomalous.
    """
    scaler = Scaler.fit(train, columns)
    forest = IsolationForest.fit_table(train, columns, seed=seed)
    machine = OneClass.fit_table(scaler.apply(train), columns, nu=contamination, seed=seed)

    def scored(rows: DataFrame) -> DataFrame:
        raw = score_with(rows, forest, columns, "_forest").withColumn("_forest", -F.col("_forest"))
        scaled = {f"_z_{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.stats.items()}
        return score_with(raw.withColumns(scaled), machine, list(scaled), "_machine").drop(*scaled)

    # The ranges and the quantile take many passes; stored, each row of train is scored once for them.
    fitted = stored(scored(train).select("_forest", "_machine"), "scores")
    lo_f, hi_f, lo_m, hi_m = fitted.agg(F.min("_forest"), F.max("_forest"), F.min("_machine"), F.max("_machine")).first()

    def combined(rows: DataFrame) -> DataFrame:
        out = minmax_invert(minmax_invert(rows, "_forest", lo_f, hi_f, "isolation_forest_score"), "_machine", lo_m, hi_m, "ocsvm_score")
        return out.withColumn("unsupervised_anomaly_score", (F.col("isolation_forest_score") + F.col("ocsvm_score")) / 2).drop("_forest", "_machine")

    cut = quantile(combined(fitted), "unsupervised_anomaly_score", 1 - contamination)
    return combined(scored(df)).withColumn("unsupervised_anomaly_flag", flag(F.col("unsupervised_anomaly_score") >= F.lit(cut).cast("double")))
