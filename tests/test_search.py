"""Searches: drawn settings, ridge regressions from fold sums, forests read off grown ones, Gram matrices."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tickframe.operators import cells, forests, ml, search, stats
from tickframe.operators.moments import centres, pair_moments


def test_draws():
    space = {"a": search.Uniform(2, 3), "b": search.LogUniform(1e-6, 1e6), "c": search.IntRange(1, 3), "d": ["x", None]}
    drawn = search.draw_settings(space, 4000, 7)
    assert drawn == search.draw_settings(space, 4000, 7) != search.draw_settings(space, 4000, 8)
    assert all(2 <= s["a"] <= 3 and 1e-6 <= s["b"] <= 1e6 for s in drawn)
    assert np.mean([s["a"] for s in drawn]) == pytest.approx(2.5, abs=0.02)
    logs = [math.log10(s["b"]) for s in drawn]
    assert np.mean(logs) == pytest.approx(0, abs=0.2) and np.std(logs) == pytest.approx(12 / math.sqrt(12), abs=0.1)
    assert all(1200 < n < 1470 for n in Counter(s["c"] for s in drawn).values()) and {s["d"] for s in drawn} == {"x", None}
    lists = {"a": [1, 2, 3], "b": [4, 5]}
    assert len({str(s) for s in search.draw_settings(lists, 5, 1)}) == 5
    assert search.draw_settings(lists, 10, 1) == search.every_setting(lists) and len(search.every_setting(lists)) == 6


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4)) * [1, 10, 0.1, 1] + [0, 1e4, 5, -3]
    y = x @ [1, 0.2, 30, 0] + rng.normal(size=900) * 5 + 1e5
    fold, inner = rng.integers(0, 5, 900), rng.integers(0, 3, 900)
    rows = [(*map(float, r), float(v), int(f), int(g)) for r, v, f, g in zip(x, y, fold, inner, strict=True)]
    rows += [(None, 1.0, 1.0, 1.0, 1.0, 0, 0), (1.0, 1.0, 1.0, 1.0, None, 0, 0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int, inner int").repartition(5)
    return x, y, fold, inner, df.persist()


def plain_ridge(x, y, reg):
    spread = x.std(0)
    z = (x - x.mean(0)) / spread
    w = np.linalg.solve(z.T @ z / len(z) + reg * np.eye(z.shape[1]), z.T @ (y - y.mean()) / len(z)) / spread
    return y.mean() - x.mean(0) @ w, w


def plain_score(x, y, line, metric):
    wrong = y - line[0] - x @ line[1]
    return {"r2": 1 - wrong @ wrong / ((y - y.mean()) @ (y - y.mean())), "rmse": np.sqrt(np.mean(wrong**2)), "mse": np.mean(wrong**2)}[metric]


@pytest.mark.parametrize("metric", ["r2", "rmse", "mse"])
def test_ridge_from_sums_equals_refitting(table, metric):
    x, y, fold, _, df = table
    settings = search.every_setting({"regParam": [0.0, 0.01, 0.3, 2.0, 50.0]})
    got = search.ridge_scores(df, list("abcd"), "y", settings, metric=metric)
    for one, scores in zip(settings, got, strict=True):
        for f in range(5):
            own = fold == f
            line = plain_ridge(x[~own], y[~own], one["regParam"])
            assert scores[f] == pytest.approx(plain_score(x[own], y[own], line, metric), rel=1e-8)
    best, rows = search.ridge_search(df, list("abcd"), "y", settings, metric=metric)
    means = [np.mean(s) for s in got]
    top = int(np.argmax(means) if metric == "r2" else np.argmin(means))
    assert best == settings[top] and [r.best for r in rows.orderBy("setting").collect()] == [i == top for i in range(5)]


def test_nested_search_from_sums(table):
    x, y, fold, inner, df = table
    settings = search.every_setting({"regParam": [0.0, 0.05, 1.0]})
    rows = search.cross_validate_ridge(df, list("abcd"), "y", settings=settings).orderBy("fold").collect()
    for r in rows:
        out = fold != r.fold
        means = []
        for one in settings:
            scores = []
            for g in range(3):
                train, test = out & (inner != g), out & (inner == g)
                scores.append(plain_score(x[test], y[test], plain_ridge(x[train], y[train], one["regParam"]), "r2"))
            means.append(np.mean(scores))
        line = plain_ridge(x[out], y[out], settings[int(np.argmax(means))]["regParam"])
        assert r.score == pytest.approx(plain_score(x[~out], y[~out], line, "r2"), rel=1e-8)
    assert rows[0].mean_score == pytest.approx(np.mean([r.score for r in rows]))


def test_what_is_no_fold_is_refused(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_FOLDS", 20)
    df = spark.range(100).selectExpr("id as fold", "cast(id as double) as x", "cast(id as double) as y")
    with pytest.raises(ValueError, match="no folds"):
        search.ridge_scores(df, ["x"], "y", [{}])
    with pytest.raises(ValueError, match="no parameter"):
        search.ridge_scores(df.where("fold < 5"), ["x"], "y", [{"depth": 1}])


def test_moments_of_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 60)) * rng.lognormal(size=60) + rng.normal(size=60) * 1e6
    x[rng.random((400, 60)) < 0.1] = np.nan
    x[:, 7], x[:, 8] = 5.25, np.nan
    names = [f"c{i}" for i in range(60)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r.a, r.b): r["corr"] for r in stats.corr_matrix(df, names).collect()}
    assert len(got) == 3600
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if {7, 8} & {i, j}:
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert {r["corr"] for r in stats.corr_matrix(df.where("false"), ["c0", "c1"]).collect()} <= {None}


def test_moments_by_group(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, 4.0, 1.0), (2, None, 3.0)], "g int, a double, b double")
    middle = centres(df, ["a", "b"])
    rows = {(r.g, r.i, r.j): r for r in pair_moments(df, ["a", "b"], [0.0, 0.0], by="g").collect()}
    assert middle == [2.0, 1.0] and len(rows) == 6
    r = rows[1, 0, 1]
    assert (r.n, r.s_i, r.s_j, r.q_i, r.q_j, r.p) == (1, 4, 1, 16, 1, 4)
    assert (rows[1, 0, 0].n, rows[1, 0, 0].s_i, rows[2, 1, 1].p, rows[2, 0, 1].n) == (2, 6, 9, 0)


# --- forests ------------------------------------------------------------------


@pytest.fixture(scope="module")
def grown(spark, table):
    df = table[-1].dropna()
    data = ml.features(df, list("abcd"), "y", keep=["fold"]).persist()
    train = data.where("fold <> 0")
    model = forests._grown(train, 6, 30, 2, 42)
    return data, model, forests.tree_nodes(spark, model).persist()


def plain_predict(nodes, x, depth, split):
    """Walk down the saved nodes, and stop where the limits say so."""
    total = 0.0
    for tree in nodes.values():
        at, level = tree[0], 0
        while at.leftChild >= 0 and level < depth and at.rawCount >= split:
            goes_left = x[at.split.featureIndex] <= at.split.leftCategoriesOrThreshold[0]
            at, level = tree[at.leftChild if goes_left else at.rightChild], level + 1
        total += at.prediction
    return total / len(nodes)


def test_forest_settings_equal_walking_down(grown):
    data, model, nodes = grown
    trees = {}
    for r in nodes.collect():
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    space = {"n_estimators": [2, 6], "max_depth": [None, 3, 5], "min_samples_split": [2, 9, 40], "min_samples_leaf": [2]}
    settings = search.every_setting(space)
    only = data.where("fold in (0, 1)").withColumn("fold", F.when(F.col("fold") == 0, 0).otherwise(1))
    whole = data.withColumn("fold", (F.col("fold") > 0).cast("int"))
    got = forests.forest_scores(whole, settings, metric="neg_mse")
    rows = [(r.x, r.label) for r in data.where("fold = 0").select(vector_to_array("features").alias("x"), "label").collect()]
    for one, scores in zip(settings, got, strict=True):
        some = {t: trees[t] for t in range(one["n_estimators"])}
        depth = 30 if one["max_depth"] is None else one["max_depth"]
        errors = [(plain_predict(some, x, depth, one["min_samples_split"]) - y) ** 2 for x, y in rows]
        assert scores[0] == pytest.approx(-np.mean(errors), rel=1e-9)
    predicted = model.transform(data.where("fold = 0"))
    own = RegressionEvaluator(labelCol="label", metricName="mse").evaluate(predicted)
    deepest = settings.index({"n_estimators": 6, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 2})
    assert got[deepest][0] == pytest.approx(-own, rel=1e-9) and len({s[0] for s in got}) > 12
    assert len(forests.forest_scores(only, settings[:2], metric="r2")[0]) == 2


def test_saved_forest_splits_no_small_node(grown, tmp_path):
    data, _, _ = grown
    setting = {"n_estimators": 3, "max_depth": 8, "min_samples_split": 60, "min_samples_leaf": 2}
    path = str(tmp_path / "model")
    best, rows = forests.forest_search(data, [setting], save_path=path)
    assert best == setting and rows.first().best
    full = forests._grown(data, 3, 8, 2, 42)
    trees = {}
    for r in forests.tree_nodes(data.sparkSession, full).collect():
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    from pyspark.ml.regression import RandomForestRegressionModel

    model = RandomForestRegressionModel.load(path)
    assert model.getNumTrees == 3 and model.totalNumNodes < full.totalNumNodes
    for r in model.transform(data).select(vector_to_array("features").alias("x"), "prediction").collect():
        assert r.prediction == pytest.approx(plain_predict(trees, r.x, 8, 60), rel=1e-12)


def test_forests_grow_from_few_partitions_however_many_tasks_made_the_rows(table, monkeypatch):
    data = ml.features(table[-1].dropna(), list("abcd"), "y", keep=["fold"])
    seen = []

    class Learner(forests.RandomForestRegressor):
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return super().fit(df)

    monkeypatch.setattr(forests, "RandomForestRegressor", Learner)
    setting = {"n_estimators": 2, "max_depth": 3}
    scores = forests.forest_scores(data.repartition(60), [setting])
    assert seen == [1] * 5 and scores == forests.forest_scores(data.repartition(3), [setting])
    monkeypatch.setattr(forests, "PART_BYTES", 108 * 100)  # 100 rows of two trees
    dealt = forests.spread(data.coalesce(1), 2)
    assert [len(p) <= 110 for p in dealt.rdd.glom().collect()] == [True] * 9


def test_unknown_forest_parameter(grown):
    with pytest.raises(ValueError, match="criterion"):
        forests.forest_scores(grown[0], [{"criterion": "mae"}])


# --- forests from cells -----------------------------------------------------------


def plain_tree(bins, sums, leaf, depth, split=0):
    """The tree that tries all features, by trying every cut; as a function of the bins."""
    n, s, _ = sums.sum(0)
    best = (1e-9, None, None)
    for f in range(bins.shape[1]):
        for cut in range(bins[:, f].max()):
            left = sums[bins[:, f] <= cut].sum(0)
            if left[0] >= leaf and n - left[0] >= leaf:
                gain = (left[1] ** 2 / left[0] + (s - left[1]) ** 2 / (n - left[0]) - s**2 / n) / n
                best = max(best, (gain, f, cut), key=lambda x: x[0])
    if best[1] is None or not depth or n < split:
        return lambda x: s / n
    goes_left = bins[:, best[1]] <= best[2]
    low, high = (plain_tree(bins[own], sums[own], leaf, depth - 1, split) for own in (goes_left, ~goes_left))
    return lambda x: (low if x[best[1]] <= best[2] else high)(x)


@pytest.mark.parametrize(("leaf", "depth", "split"), [(1, 30, 0), (3, 30, 0), (2, 4, 0), (1, 30, 12)])
def test_tree_over_cells_equals_trying_every_cut(leaf, depth, split):
    rng = np.random.default_rng(5)
    bins = np.unique(rng.integers(0, 9, (150, 3)), axis=0)
    w = rng.poisson(1, len(bins)).astype(float)
    y = rng.normal(size=len(bins)) + bins[:, 0] - 2 * (bins[:, 1] > 4)
    sums = np.stack([w, w * y, w * y * y], 1)
    tree = cells.grow(bins, sums, depth, leaf, 3, rng)
    (got,) = cells._forest_values(tree, [(depth, split)])
    drawn = w > 0
    want = plain_tree(bins[drawn], sums[drawn], leaf, depth, split)
    assert got[cells._leaves(tree, bins[drawn])] == pytest.approx([want(x) for x in bins[drawn]], abs=1e-9)


def test_draws_are_those_of_a_bootstrap():
    table = np.bincount(cells._poisson()) / 65536
    assert table[:6] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(6)], abs=2e-5)


@pytest.fixture(scope="module")
def binned(spark):
    """Features of few values, so that bins are the same whichever folds are looked at."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, [30, 12, 9], (3000, 3))
    y = x[:, 0] * 3.0 + 20 * (x[:, 1] > 5) + rng.normal(size=3000) + 1e4
    rows = [(*map(float, r), float(v), int(f)) for r, v, f in zip(x, y, rng.integers(0, 3, 3000), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold int").repartition(3).persist()
    return ml.features(df, list("abc"), "y", keep=["fold"])


def test_forest_from_cells_is_a_model_whose_errors_the_search_finds(spark, binned, monkeypatch):
    monkeypatch.setattr(forests, "FEW_DRAWS", 100)
    monkeypatch.setattr(cells, "SCORED", 200)
    train, held = binned.where("fold <> 0"), binned.where("fold = 0")
    model = forests._grown(train, 6, 30, 2, 42)
    assert model.getNumTrees == 6 and model.getMaxDepth() == 30
    nodes = forests.tree_nodes(spark, model)
    roots = nodes.where("nodeData.id = 0").select("nodeData.rawCount", "nodeData.impurityStats").collect()
    drawn = [r.rawCount for r in roots]
    n = train.count()
    assert len(set(drawn)) > 3 and np.mean(drawn) == pytest.approx(n, abs=4 * math.sqrt(n / 6))
    assert all(r.impurityStats[0] == r.rawCount for r in roots)
    space = {"n_estimators": [2, 6], "max_depth": [None, 3], "min_samples_split": [2, 40], "min_samples_leaf": [2]}
    settings = search.every_setting(space)
    got = forests.forest_scores(binned, settings)
    trees = {}
    for r in nodes.collect():
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    rows = [(r.x, r.label) for r in held.select(vector_to_array("features").alias("x"), "label").collect()]
    for one, scores in zip(settings, got, strict=True):
        some = {t: trees[t] for t in range(one["n_estimators"])}
        errors = [(plain_predict(some, x, one["max_depth"] or 30, one["min_samples_split"]) - y) ** 2 for x, y in rows]
        assert scores[0] == pytest.approx(-np.mean(errors), rel=1e-7)
    own = RegressionEvaluator(labelCol="label", metricName="mse").evaluate(model.transform(held))
    assert got[settings.index({**settings[-1], "max_depth": None, "min_samples_split": 2})][0] == pytest.approx(-own, rel=1e-7)
    monkeypatch.setattr(cells, "GATHERED", 1)  # sums are sent bit by bit
    assert np.allclose(forests.forest_scores(binned, settings), got, rtol=1e-9, atol=0)


def test_equal_rows_are_drawn_apart(spark, binned):
    row = binned.first()
    one = spark.createDataFrame([(row.features, row.label)] * 5000, binned.select("features", "label").schema).coalesce(1)
    blocks = cells.cell_blocks(one, F.lit(0), [np.zeros(0)] * 3, 0.0, 8, 1).collect()
    draws = np.concatenate([cells._read(b.body)[1].reshape(-1, 3)[:, 0] for b in sorted(blocks)])
    assert draws[0] == 5000 and np.all(abs(draws[1:] - 5000) < 5 * math.sqrt(5000)) and len(set(draws[1:])) > 5


def test_cells_score_as_mllib_does(binned, monkeypatch):
    settings = [{"n_estimators": 40, "min_samples_leaf": leaf, "max_depth": depth} for leaf in (1, 4) for depth in (8, None)]
    monkeypatch.setattr(forests, "FEW_DRAWS", 1 << 30)
    plain = forests.forest_scores(binned, settings, metric="rmse")
    monkeypatch.setattr(forests, "FEW_DRAWS", 100)
    for own, other in zip(forests.forest_scores(binned, settings, metric="rmse"), plain, strict=True):
        assert np.mean(own) == pytest.approx(np.mean(other), rel=0.1)


def test_forests_over_too_many_cells_are_left_to_mllib(binned, monkeypatch):
    monkeypatch.setattr(forests, "FEW_DRAWS", 100)
    monkeypatch.setattr(cells, "MOST_CELLS", 50)
    assert not cells.fits(cells.bin_edges(binned)[0], 3, 3000)
    assert forests.fit_large(binned, ml.forest(numTrees=5)) is None
    monkeypatch.setattr(cells, "MOST_CELLS", 1 << 20)
    assert forests.fit_large(binned, ml.forest(numTrees=5, subsamplingRate=0.5)) is None
    assert forests.fit_large(binned, ml.forest(numTrees=5, maxDepth=3)).totalNumNodes <= 5 * 15
