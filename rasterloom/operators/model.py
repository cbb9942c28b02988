"""Estimators of the window classifier on Spark ML: imputed forests, novelty, application."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a feature table that a model must not see, as they tell direction or size and not kind.
NOT_FEATURES = ("mean_angle_deg", "n_fiber_px")


def model_features(names: Sequence[str]) -> list[str]:
    return sorted(n for n in names if n not in NOT_FEATURES)


def with_indicators(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """With a column for each feature that says whether it is missing."""
    return df.withColumns({f"{f}_isnan": (F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).cast("double") for f in features})


def _fit(train: DataFrame, features: Sequence[str], label: str, estimator):
    """The estimator over median-imputed features and their indicators."""
    imputed = [f"{f}_imp" for f in features]
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=imputed),
              VectorAssembler(inputCols=imputed + [f"{f}_isnan" for f in features], outputCol="features"), estimator]
    return Pipeline(stages=stages).fit(with_indicators(train.withColumn(label, F.col(label).cast("double")), features))


def fit_boosting(train: DataFrame, features: Sequence[str], label: str = "y", rounds: int = 20, seed: int = 0):
    """Boosted trees over histograms of the features, one class against the rest; classes are 0, 1 and so on."""
    return _fit(train, features, label, OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=3, seed=seed), labelCol=label))


def apply_boosting(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with proba, predicted, max_proba and margin: each class's odds against the rest, brought to a sum of 1."""
    found = model.transform(with_indicators(df, features))
    odds = F.transform(vector_to_array("rawPrediction"), lambda margin: 1 / (1 + F.exp(-2 * margin)))
    found = found.withColumn("odds", odds).withColumn("total", F.aggregate("odds", F.lit(0.0), lambda a, x: a + x))
    return _judged(found.withColumn("proba", F.transform("odds", lambda x: x / F.col("total"))).drop("odds", "total"), features)


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "y", trees: int = 50, seed: int = 0):
    """A forest over median-imputed features and their indicators."""
    return _fit(train, features, label, RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed))


def apply_forest(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with proba (an array by class), predicted, max_proba and margin."""
    return _judged(model.transform(with_indicators(df, features)).withColumn("proba", vector_to_array("probability")), features)


def _judged(found: DataFrame, features: Sequence[str]) -> DataFrame:
    order = F.sort_array("proba", asc=False)
    return (found.withColumns({"max_proba": order[0], "margin": order[0] - order[1], "predicted": (F.array_position("proba", order[0]) - 1).cast("long")})
            .drop("features", "rawPrediction", "probability", "prediction", *(c for f in features for c in (f"{f}_imp", f"{f}_isnan"))))


def _moments(rows: DataFrame, features: Sequence[str]) -> tuple[int, list[float], list[list[float]]]:
    """Number, means and covariances of the rows: sums on the executors, of which a small matrix comes to the driver."""
    n = len(features)
    sums = rows.agg(F.count("*").alias("n"), *(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)),
                    *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j <= i)).first()
    return sums["n"], [sums[f"m{i}"] for i in range(n)], [[sums[f"c{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)]


def _distance(features: Sequence[str], means: list[float], cov):
    """The squared Mahalanobis distance as a column."""
    import numpy as np
    inverse = np.linalg.pinv(np.array(cov))
    gap = [F.col(f) - F.lit(float(m)) for f, m in zip(features, means)]
    terms = [gap[i] * gap[j] * float(inverse[i, j]) for i in range(len(gap)) for j in range(len(gap))]
    return sum(terms[1:], terms[0])


def chi_square_point(share: float, k: int) -> float:
    """Where the chi-square with k degrees has this share below it (cube of a normal)."""
    from statistics import NormalDist
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(share) * math.sqrt(2 / (9 * k))) ** 3


def robust_moments(train: DataFrame, features: Sequence[str], steps: int = 6) -> tuple[list[float], list[list[float]]] | None:
    """Means and covariances of the half of the rows that lie closest together, scaled to all, then of all rows that are not outliers of these.

    Each step takes the half nearest to the last one's means and covariances, in
    one pass; distances are ranked by an approximate quantile. None for under two rows a feature.
    """
    count, means, cov = _moments(train, features)
    if count < 2 * len(features):
        return None
    for _ in range(steps):
        d2 = train.withColumn("_d2", _distance(features, means, cov))
        middle = d2.approxQuantile("_d2", [0.5], 0.005)[0]
        _, means, cov = _moments(d2.where(F.col("_d2") <= middle), features)
    middle = train.withColumn("_d2", _distance(features, means, cov)).approxQuantile("_d2", [0.5], 0.005)[0]
    scaled = [[c * middle / chi_square_point(0.5, len(features)) for c in row] for row in cov]
    inside = train.withColumn("_d2", _distance(features, means, scaled)).where(F.col("_d2") <= chi_square_point(0.975, len(features)))
    _, means, cov = _moments(inside, features)
    return means, cov


def novelty(train: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with novelty_p: the tail of the chi-square of the robust Mahalanobis distance to the training rows.

    Outliers among the training rows do not stretch it. Too few rows (under two a feature) give nulls.
    """
    found = robust_moments(train, features)
    if found is None:
        return df.withColumn("novelty_p", F.lit(None).cast("double"))
    return df.withColumn("d2", _distance(features, *found)).withColumn("novelty_p", chi_square_tail(F.col("d2"), len(features))).drop("d2")


def chi_square_tail(x, k: int):
    """P(chi-square with k degrees > x) as a finite sum of terms; odd k by the normal tail's rational fit."""
    half = F.greatest(x, F.lit(0.0)) / 2
    if k % 2 == 0:
        terms = [F.pow(half, i) / math.factorial(i) for i in range(k // 2)]
        return F.exp(-half) * sum(terms[1:], terms[0])
    root = F.sqrt(2 * half)
    t = 1 / (1 + 0.3275911 * root / math.sqrt(2))
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-half)
    found = erfc
    for i in range(1, (k - 1) // 2 + 1):
        found = found + F.pow(half, i - 0.5) * F.exp(-half) / math.gamma(i + 0.5)
    return found
