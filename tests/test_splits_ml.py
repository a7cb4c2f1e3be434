import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tickframe.operators import ml
from tickframe.operators.search import LogUniform
from tickframe.operators import splits as S
from tickframe.sources.readers import synthetic_regression


@pytest.fixture(scope="module")
def thirteen(spark):
    return spark.createDataFrame([(i, "xyz"[i % 3] if i < 8 else "x") for i in range(1, 14)], "id int, label string")


def test_contiguous_folds(thirteen):
    rows = S.kfold(thirteen.repartition(5), 5, "id").orderBy("id").collect()
    assert [r.fold for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_fewer_rows_than_folds(thirteen):
    rows = S.kfold(thirteen.where("id < 4"), 5, "id").orderBy("id").collect()
    assert [r.fold for r in rows] == [0, 1, 2]


def test_shuffled_folds_partition_the_rows(thirteen):
    one = {r.id: r.fold for r in S.kfold(thirteen, 4, "id", shuffle=True, seed=3).collect()}
    two = {r.id: r.fold for r in S.kfold(thirteen.repartition(6), 4, "id", shuffle=True, seed=3).collect()}
    assert one == two and len(one) == 13
    sizes = sorted(list(one.values()).count(f) for f in range(4))
    assert sizes == [3, 3, 3, 4]
    assert [one[i] for i in range(1, 14)] != sorted(one.values())
    hashed = S.hash_fold(thirteen, 4, "id").where("fold between 0 and 3")
    assert hashed.count() == 13


def test_dense_numbers_with_one_hot_leading_value(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) as lead", "id", "cast(id % 2 as string) as g")
    got = S.dense_row_number(rows, ["lead", "id"], by=["g"]).toPandas()
    want = rows.toPandas().sort_values(["g", "lead", "id"])
    want["rn"] = want.groupby("g").cumcount() + 1
    merged = want.merge(got, on=["lead", "id", "g"], suffixes=("", "_got"))
    assert len(merged) == 5000 and (merged.rn == merged.rn_got).all()
    assert set(got.n) == {2500}


def test_stratified(thirteen):
    out = S.stratified_kfold(thirteen, 3, "label", "id").toPandas()
    assert len(out) == 13
    per = out.groupby(["label", "fold"]).size().unstack(fill_value=0)
    assert (per.max(axis=1) - per.min(axis=1) <= 1).all()


def test_time_series_split(series):
    out = S.time_series_split(series({"a": range(13), "b": range(4)}), 5, block_rows=3).toPandas()
    assert set(out.symbol) == {"a"}
    out["i"] = out.price.astype(int)
    for f in range(1, 6):
        part = out[out.fold == f]
        start = 13 - (5 - f + 1) * 2
        assert sorted(part[part.role == "test"].i) == [start, start + 1]
        assert sorted(part[part.role == "train"].i) == list(range(start))


def test_time_split(series):
    out = S.time_split(series({"a": range(11), "one": [5]})).toPandas().sort_values(["symbol", "ts"])
    assert out[out.symbol == "a"].split.tolist() == ["train"] * 8 + ["test"] * 3
    assert out[out.symbol == "one"].split.tolist() == ["train"]


def test_train_test_split_is_stable(spark):
    df = spark.range(20_000)
    held = S.train_test_split(df, "id").where("split = 'test'")
    again = S.train_test_split(df.repartition(9), "id").where("split = 'test'")
    assert held.exceptAll(again).count() == 0
    assert 3700 < held.count() < 4300
    assert S.train_test_split(df, "id", seed=1).where("split = 'test'").exceptAll(held).count() > 0


@pytest.fixture(scope="module")
def problem(spark):
    df = synthetic_regression(spark, 1000, 10, noise=1.0)
    folded = S.kfold(df, 5, "id", shuffle=True)
    return ml.features(folded, [f"x{i}" for i in range(10)], "y", keep=["fold"]).persist()


def test_synthetic_is_seeded(spark):
    assert synthetic_regression(spark, 50).exceptAll(synthetic_regression(spark, 50)).count() == 0


def test_cross_validate_linear(problem):
    rows = ml.cross_validate(LinearRegression(), problem).orderBy("fold").collect()
    assert [r.fold for r in rows] == [0, 1, 2, 3, 4]
    assert all(r.score > 0.99 for r in rows)
    assert rows[0].mean_score == pytest.approx(np.mean([r.score for r in rows]))


def test_cross_validate_expanding(series):
    df = S.time_series_split(series({"a": [float(i) for i in range(40)]}), 3)
    data = ml.features(df.withColumn("x", F.col("price") * 2), ["x"], "price", keep=["fold", "role"])
    rows = ml.cross_validate(LinearRegression(), data, metric="rmse").collect()
    assert [r.fold for r in rows] == [1, 2, 3] and all(abs(r.score) < 1e-6 for r in rows)


def test_searches(problem, tmp_path):
    grid = {"n_estimators": [2, 8], "max_depth": [2, 5], "min_samples_split": [2]}
    path = str(tmp_path / "best")
    best, scores = ml.grid_search(ml.forest(), grid, problem, 5, save_path=path)
    rows = scores.collect()
    assert len(rows) == 4 and sum(r.best for r in rows) == 1
    top = max(rows, key=lambda r: r.mean_score)
    assert top.best and {k: str(v) for k, v in best.items()} == top.params == {"numTrees": "8", "maxDepth": "5"}
    from pyspark.ml.regression import RandomForestRegressionModel

    assert RandomForestRegressionModel.load(path).getNumTrees == 8
    assert len(ml.random_search(ml.forest(), grid, problem, 5, n_iter=2)[1].collect()) == 2


def test_nested(problem):
    rows = ml.cross_validate(LinearRegression(), problem, grid={"regParam": [0.0, 50.0]}, inner_folds=2).collect()
    assert len(rows) == 5 and all(r.score > 0.99 for r in rows)


def test_settings():
    assert ml.settings({"max_depth": [None, 10], "min_samples_split": [2]}) == [{"maxDepth": 30}, {"maxDepth": 10}]
    with pytest.raises(ValueError):
        ml.settings({"min_samples_split": [2, 5]})
    grid = {"n_estimators": [50, 100, 150], "max_depth": [None, 10, 20], "min_samples_leaf": [1, 2, 4]}
    assert len(ml.settings(grid)) == 27
    drawn = ml.sample_settings(grid, 10, 42)
    assert drawn == ml.sample_settings(grid, 10, 42) and len({str(s) for s in drawn}) == 10


def test_searches_with_small_splits_and_distributions(problem, tmp_path):
    grid = {"n_estimators": [2, 6], "max_depth": [None, 3], "min_samples_split": [2, 30], "min_samples_leaf": [1]}
    path = str(tmp_path / "best")
    best, scores = ml.grid_search(ml.forest(), grid, problem, 5, save_path=path)
    rows = scores.orderBy("setting").collect()
    assert len(rows) == 8 and [r.setting for r in rows if r.best] == [max(range(8), key=lambda i: rows[i].mean_score)]
    assert best["n_estimators"] == 6 and len({r.mean_score for r in rows}) > 4
    from pyspark.ml.regression import RandomForestRegressionModel

    assert RandomForestRegressionModel.load(path).getNumTrees == 6
    space = {"regParam": LogUniform(1e-3, 10)}
    drawn = ml.random_search(LinearRegression(), space, problem, 5, n_iter=4)[1].collect()
    assert len({r.params["regParam"] for r in drawn}) == 4
    with pytest.raises(ValueError, match="no folds"):
        ml.cross_validate(LinearRegression(), problem.withColumn("fold", F.monotonically_increasing_id()))


def test_forest(problem):
    _, predicted, metrics = ml.random_forest_regression(
        problem.where("fold > 0"), problem.where("fold = 0"), numTrees=20, maxDepth=8
    )
    assert metrics.first().r2 > 0.5 and predicted.count() == metrics.first().n


def test_no_partition_of_a_forest_grows_with_its_input(problem, monkeypatch):
    monkeypatch.setattr("tickframe.operators.forests.PART_BYTES", 120 * 100)  # 100 rows of five trees
    sizes = []

    class Learner(ml.RandomForestRegressor):
        def fit(self, df):
            sizes.extend(len(p) for p in df.rdd.glom().collect())
            return super().fit(df)

    monkeypatch.setattr(ml, "RandomForestRegressor", Learner)
    one = problem.coalesce(1)
    _, predicted, _ = ml.random_forest_regression(one.where("fold > 0"), one.where("fold = 0"), numTrees=5, maxDepth=3)
    assert sum(sizes) + predicted.count() == 1000 and max(sizes) <= 110


def test_per_symbol_linear(spark):
    rng = np.random.default_rng(3)
    frames, want = [], {}
    for s in "abc":
        x = rng.normal(1e4, 3, size=(60, 3))
        y = x @ rng.normal(size=3) + 5 + rng.normal(size=60)
        frames.append(pd.DataFrame({"symbol": s, "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": y}))
        want[s] = np.linalg.lstsq(np.c_[x - 1e4, np.ones(60)], y, rcond=None)[0][:3]
    df = spark.createDataFrame(pd.concat(frames))
    models = ml.per_symbol_linear(df, ["x0", "x1", "x2"], "y")
    for r in models.collect():
        assert r.coef == pytest.approx(want[r.symbol], rel=1e-6)
        assert r.n == 60
    fitted = ml.predict_linear(df, models, ["x0", "x1", "x2"])
    assert fitted.where("abs(prediction - y) > 6").count() == 0
    flat = df.withColumn("x0", F.lit(1.0))
    assert all(abs(r.coef[0]) < 1e-9 for r in ml.per_symbol_linear(flat, ["x0"], "y").collect())


def test_window_forecast_follows_a_line(series):
    df = series({"a": [2.0 * i for i in range(60)], "b": [100 - i for i in range(60)], "short": [1, 2]})
    _, out = ml.window_forecast(df, 3, 7)
    got = {(r.symbol, r.step): (str(r.ts), r["mean"]) for r in out.collect()}
    assert got[("a", 1)][0] == "2024-03-01" and got[("a", 7)][1] == pytest.approx(132, abs=1e-3)
    assert got[("b", 7)][1] == pytest.approx(34, abs=1e-3)
    assert ("short", 1) not in got


def test_apply_per_symbol(series):
    out = ml.apply_per_symbol(
        series({"a": [1, 2], "b": [5]}),
        lambda p: pd.DataFrame({"symbol": [p.symbol.iloc[0]], "total": [p.price.sum()]}),
        "symbol string, total double",
    )
    assert sorted(tuple(r) for r in out.collect()) == [("a", 3.0), ("b", 5.0)]


def test_large_forests_are_fitted_from_cells(problem, monkeypatch):
    monkeypatch.setattr("tickframe.operators.forests.FEW_DRAWS", 100)
    sizes = []

    class Learner(ml.RandomForestRegressor):
        def fit(self, df):
            sizes.append(df.count())
            return super().fit(df)

    monkeypatch.setattr(ml, "RandomForestRegressor", Learner)
    model, predicted, metrics = ml.random_forest_regression(
        problem.where("fold > 0"), problem.where("fold = 0"), numTrees=20, maxDepth=8
    )
    assert max(sizes) <= 100 and model.getNumTrees == 20 and model.numFeatures == len(problem.first()["features"])
    assert metrics.first().r2 > 0.5 and predicted.count() == metrics.first().n
