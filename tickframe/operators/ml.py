"""Regression models, cross-validation and parameter search on Spark MLlib."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.forests import MAX_DEPTH, fit_large, forest_search, spread
from tickframe.operators.impute import fill_zero
from tickframe.operators.indicators import lag_features, row_tail
from tickframe.operators.search import Space, draw_settings, every_setting
from tickframe.operators.stats import regression_metrics
from tickframe.session import broadcast_if_small

#: Usual names of forest settings and what MLlib calls them. ``min_samples_split`` has no
#: counterpart: MLlib splits any node of two rows or more. Searches with other values go to
#: :mod:`tickframe.operators.forests`, which reads them off grown trees.
PARAM_NAMES = {
    "n_estimators": "numTrees",
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "min_samples_split": None,
}
#: Folds that cross-validation accepts, as each is fitted on its own.
MOST_FOLDS = 200


def features(df: DataFrame, cols: Sequence[str], label: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """``features`` vector and ``label``, missing numbers as 0."""
    filled = fill_zero(df.select(*dict.fromkeys([*keep, *cols, label])), [*cols, label])
    out = VectorAssembler(inputCols=list(cols), outputCol="features").transform(filled)
    return out.select(*keep, "features", F.col(label).cast("double").alias("label"))


def forest(**params) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", labelCol="label", **{"seed": 42, **params})


def fit_forest(train: DataFrame, **params) -> Model:
    """A forest grown on prepared features: a large one from sums by cell, others in partitions of bounded size.

    See :func:`~tickframe.operators.forests.fit_large` and :func:`~tickframe.operators.forests.spread`.
    """
    learner = forest(**params)
    return fit_large(train, learner) or learner.fit(spread(train, learner.getNumTrees()))


def random_forest_regression(train: DataFrame, test: DataFrame, **params) -> tuple[Model, DataFrame, DataFrame]:
    """``(model, predictions on test, metrics)`` of a forest on prepared features."""
    model = fit_forest(train, **params)
    predicted = model.transform(test)
    return model, predicted, regression_metrics(predicted, "label", "prediction")


# --- parameter settings -----------------------------------------------------


def _in_mllib(setting: Mapping) -> dict:
    named = {}
    for name, value in setting.items():
        to = PARAM_NAMES.get(name, name)
        if to is not None:
            named[to] = MAX_DEPTH if value is None and to == "maxDepth" else value
        elif value != 2:
            raise ValueError(f"{name}={value} can't be honoured: MLlib has no such parameter")
    return named


def settings(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of a grid, with MLlib's parameter names; settings it lacks are an error."""
    named = [_in_mllib(one) for one in every_setting(grid)]
    return [one for i, one in enumerate(named) if one not in named[:i]]


def sample_settings(space: Space, n: int, seed: int) -> list[dict]:
    """Settings drawn from lists or distributions, with MLlib's parameter names."""
    return [_in_mllib(one) for one in draw_settings(space, n, seed)]


def _param_maps(estimator: Estimator, chosen: Iterable[dict]) -> list[dict]:
    return [{estimator.getParam(name): value for name, value in one.items()} for one in chosen]


# --- cross-validation -------------------------------------------------------


def _evaluator(metric: str) -> RegressionEvaluator:
    return RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName=metric)


def fold_pairs(df: DataFrame, *, fold: str = "fold", role: str = "role"):
    """``(fold, train, test)`` frames: by role for expanding folds, else one fold against the rest."""
    numbers = sorted(r[0] for r in df.select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if len(numbers) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} values of {fold}: these are no folds")
    for f in numbers:
        if role in df.columns:
            part = df.where(F.col(fold) == f)
            yield f, part.where(F.col(role) == "train"), part.where(F.col(role) == "test")
        else:
            yield f, df.where(F.col(fold) != f), df.where(F.col(fold) == f)


def cross_validate(
    estimator: Estimator,
    df: DataFrame,
    *,
    metric: str = "r2",
    grid: Mapping[str, Sequence] | None = None,
    inner_folds: int = 3,
    parallelism: int = 4,
) -> DataFrame:
    """Score per fold, as rows ``(fold, score, mean_score)``.

    ``df`` has ``features``, ``label``, ``fold`` and maybe ``role``. With a ``grid``
    each training part is searched first, on the folds of a column ``inner`` (0 to
    ``inner_folds`` - 1) if there is one, else on inner folds by hash of the row.
    """
    used = [c for c in ("features", "label", "fold", "role", "inner") if c in df.columns]
    data = df.select(*used).persist()
    scores = []
    try:
        for f, train, test in fold_pairs(data):
            if grid:
                hashed = F.pmod(F.xxhash64("label", "features", F.lit(f)), F.lit(inner_folds))
                part = F.col("inner") if "inner" in train.columns else hashed
                inner = train.withColumn("fold", part.cast("int"))
                model = _search(estimator, settings(grid), inner, inner_folds, metric, parallelism).bestModel
            else:
                model = estimator.fit(train)
            scores.append((int(f), float(_evaluator(metric).evaluate(model.transform(test)))))
    finally:
        data.unpersist()
    mean = float(np.mean([s for _, s in scores])) if scores else None
    return df.sparkSession.createDataFrame(
        [(f, s, mean) for f, s in scores], "fold int, score double, mean_score double"
    )


def _search(estimator, chosen, df, k, metric, parallelism) -> CrossValidatorModel:
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=_param_maps(estimator, chosen),
        evaluator=_evaluator(metric),
        numFolds=k,
        foldCol="fold",
        parallelism=parallelism,
    ).fit(df)


def _run_search(estimator, asked, df, k, metric, save_path, parallelism) -> tuple[dict, DataFrame]:
    if isinstance(estimator, RandomForestRegressor) and any(one.get("min_samples_split", 2) != 2 for one in asked):
        return forest_search(df, asked, metric=metric, seed=estimator.getSeed(), save_path=save_path)
    named = [_in_mllib(one) for one in asked]
    chosen = [one for i, one in enumerate(named) if one not in named[:i]]
    fitted = _search(estimator, chosen, df, k, metric, parallelism)
    better = max if _evaluator(metric).isLargerBetter() else min
    best = fitted.avgMetrics.index(better(fitted.avgMetrics))
    if save_path:
        fitted.bestModel.write().overwrite().save(save_path)
    rows = [
        (i, {k: str(v) for k, v in one.items()}, float(score), i == best)
        for i, (one, score) in enumerate(zip(chosen, fitted.avgMetrics, strict=True))
    ]
    schema = "setting int, params map<string,string>, mean_score double, best boolean"
    return chosen[best], df.sparkSession.createDataFrame(rows, schema)


def grid_search(
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    df: DataFrame,
    k: int = 5,
    metric: str = "r2",
    save_path: str | None = None,
    parallelism: int = 4,
) -> tuple[dict, DataFrame]:
    """Best setting and mean score of every setting; ``df`` has a ``fold`` column 0..k-1."""
    return _run_search(estimator, every_setting(grid), df, k, metric, save_path, parallelism)


def random_search(
    estimator: Estimator,
    space: Space,
    df: DataFrame,
    k: int = 5,
    metric: str = "r2",
    save_path: str | None = None,
    n_iter: int = 10,
    seed: int = 42,
    parallelism: int = 4,
) -> tuple[dict, DataFrame]:
    """As :func:`grid_search`, over ``n_iter`` settings drawn from lists or distributions."""
    return _run_search(estimator, draw_settings(space, n_iter, seed), df, k, metric, save_path, parallelism)


# --- one model per symbol ---------------------------------------------------


def per_symbol_linear(
    df: DataFrame, xs: Sequence[str], y: str, *, key: str = "symbol", ridge: float = 0.0
) -> DataFrame:
    """Least squares per symbol: ``(symbol, intercept, coef, r2, n)``.

    The rows are reduced to means and covariances with partial aggregation; Python
    sees one row of them per symbol.
    """
    names = [*xs, y]
    complete = df.dropna(subset=names)
    pairs = [(a, b) for a in range(len(names)) for b in range(a, len(names))]
    moments = complete.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in names]).alias("_m"),
        F.array(*[F.covar_pop(names[a], names[b]) for a, b in pairs]).alias("_c"),
    )
    p = len(xs)

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            coefs, intercepts, fits = [], [], []
            for means, flat in zip(pdf["_m"], pdf["_c"], strict=True):
                cov = np.empty((p + 1, p + 1))
                for (a, b), value in zip(pairs, flat, strict=True):
                    cov[a, b] = cov[b, a] = value
                inner = cov[:p, :p] + ridge * np.eye(p)
                beta = np.linalg.lstsq(inner, cov[:p, p], rcond=None)[0]
                explained = 2 * beta @ cov[:p, p] - beta @ cov[:p, :p] @ beta
                coefs.append(beta.tolist())
                intercepts.append(float(means[p] - beta @ np.asarray(means[:p])))
                fits.append(float(explained / cov[p, p]) if cov[p, p] > 0 else None)
            yield pd.DataFrame({key: pdf[key], "intercept": intercepts, "coef": coefs, "r2": fits, "n": pdf["n"]})

    kind = df.schema[key].dataType.simpleString()
    return moments.mapInPandas(
        solve, f"`{key}` {kind}, intercept double, coef array<double>, r2 double, n bigint"
    )


def predict_linear(df: DataFrame, models: DataFrame, xs: Sequence[str], *, key: str = "symbol") -> DataFrame:
    """Add ``prediction`` from :func:`per_symbol_linear` models."""
    fitted = F.col("intercept")
    for i, c in enumerate(xs):
        fitted = fitted + F.get("coef", F.lit(i)) * F.col(c)
    joined = df.join(broadcast_if_small(models.select(key, "intercept", "coef"), keep=True), key, "left")
    return joined.withColumn("prediction", fitted).drop("intercept", "coef")


def apply_per_symbol(df: DataFrame, fn, schema, *, key: str = "symbol") -> DataFrame:
    """The caller's pandas function on each symbol's rows.

    One symbol's rows must fit one worker: reduce first (bars, tails, sums).
    """
    return df.groupBy(key).applyInPandas(fn, schema)


# --- learned window forecast ------------------------------------------------


def window_forecast(
    df: DataFrame,
    p: int = 5,
    steps: int = 7,
    *,
    estimator: Estimator | None = None,
    price: str = "price",
    key: str = "symbol",
    ts: str = "ts",
    **layout,
) -> tuple[Model, DataFrame]:
    """Learn the next price from the ``p`` before it, over all symbols; forecast recursively.

    Returns the fitted pipeline and rows ``(symbol, step, ts, mean)``.
    """
    known = df.where(F.col(price).isNotNull()).select(key, ts, F.col(price).cast("double").alias(price))
    lagged = lag_features(known, p, price=price, key=key, ts=ts, **layout).where(F.col("lags").isNotNull())
    train = lagged.select(array_to_vector("lags").alias("features"), F.col(price).alias("label"))
    learner = estimator or LinearRegression(featuresCol="features", labelCol="label")
    model = Pipeline(stages=[learner]).fit(train)

    newest = row_tail(known, p, key=key, ts=ts)
    newest_first = F.sort_array(F.collect_list(F.struct(ts, price)), asc=False)
    state = newest.groupBy(key).agg(newest_first.alias("_s"))
    # Short series are padded here and left out at the end: the model must get vectors
    # of one length whatever order the optimiser gives the filters.
    padded = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.coalesce(F.get("_s", i)[price], F.lit(0.0)))
    state = state.select(
        key,
        F.get("_s", F.lit(0))[ts].cast("date").alias("_last"),
        padded.alias("_x"),
        (F.size("_s") == p).alias("_full"),
    )
    state = state.withColumn("_path", F.array().cast("array<double>"))
    for _ in range(steps):
        scored = model.transform(state.withColumn("features", array_to_vector("_x")))
        state = scored.select(
            key,
            "_last",
            "_full",
            F.concat(F.array("prediction"), F.slice("_x", 1, p - 1)).alias("_x"),
            F.concat("_path", F.array("prediction")).alias("_path"),
        )
    rows = state.where("_full").select(key, "_last", F.posexplode("_path").alias("_i", "mean"))
    return model, rows.select(
        key, (F.col("_i") + 1).alias("step"), F.date_add("_last", F.col("_i") + 1).alias("ts"), "mean"
    )
