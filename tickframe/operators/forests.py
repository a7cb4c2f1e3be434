"""Searching forests: few are grown, and many settings are read off each of them.

Trees grow from the root down by greedy splits, so a tree of a smaller ``max_depth`` or a larger
``min_samples_split`` is the grown tree with some inner nodes made leaves, and a smaller forest
is a part of a larger one. Only ``min_samples_leaf`` changes which splits are allowed. So each
fold grows one forest per ``min_samples_leaf``, with the most trees and the largest depth asked
for, and one pass over the held-out rows scores all other settings.

What a task holds of a forest is bounded by the forest, which MLlib holds on the driver as well.

From every partition MLlib sends the sums of all nodes that grow on a level, and it keeps every
row with its number of draws for every tree. :func:`spread` therefore deals rows into partitions by
their number alone: few for small tables, however many tasks made them, and never large ones.

Beyond :data:`FEW_DRAWS` forests grow from sums by cell (:mod:`tickframe.operators.cells`), unless there are too many cells.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.operators import cells
from tickframe.operators.search import _best, search_table
from tickframe.session import work_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: MLlib's deepest tree, used where no limit is asked for.
MAX_DEPTH = 30
#: Folds a search accepts.
MOST_FOLDS = 200
#: Bytes of a partition of training rows with their draws.
PART_BYTES = 64_000_000
#: Forests of a search that grow at once, and the draws (rows times trees) all of them may hold.
PARALLEL, MOST_DRAWS = 8, 20_000_000
#: Draws (rows times trees) of a forest that is left to MLlib.
FEW_DRAWS = 50_000
_DEFAULTS = {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1}


@dataclass
class Tree:
    """A grown tree as arrays; children come after their parents, -1 where there are none."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    depth: np.ndarray
    parent: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node, inner = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(inner := inner[self.left[node[inner]] >= 0]):
            at = node[inner]
            goes_left = x[inner, self.feature[at]] <= self.threshold[at]
            node[inner] = np.where(goes_left, self.left[at], self.right[at])
        return node

    def values(self, max_depth: int, min_split: int) -> np.ndarray:
        """What the tree with these limits predicts for rows that end in each node."""
        out = self.value.copy()
        stops = (self.depth >= max_depth) | (self.rows < min_split)
        under = np.zeros(len(out), bool)  # a node above is a leaf of the limited tree
        for level in range(1, int(self.depth.max(initial=0)) + 1):
            at = np.flatnonzero(self.depth == level)
            under[at] = under[self.parent[at]] | stops[self.parent[at]]
            out[at] = np.where(under[at], out[self.parent[at]], out[at])
        return out


def spread(df: DataFrame, trees: int) -> DataFrame:
    """Training rows in partitions that hold some 64 MB each once they are drawn for every tree.

    The order within a partition follows from the rows, so a task that is run again draws the same.
    """
    rows = max(1, PART_BYTES // (100 + 4 * trees))
    dealt = df.repartition(max(1, math.ceil(df.count() / rows)))
    return dealt.sortWithinPartitions(F.xxhash64("features", "label"))


def tree_nodes(spark: SparkSession, model: RandomForestRegressionModel) -> DataFrame:
    """The nodes of a forest as rows: the table MLlib saves."""
    path = work_path(spark, "forest")
    model.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data")


def trees_of(nodes: DataFrame) -> list[Tree]:
    """All trees of a forest, in order."""
    d = F.col("nodeData")
    flat = nodes.select(
        "treeID",
        d["id"].alias("id"),
        d["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.get(d["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
        d["leftChild"].alias("left"),
        d["rightChild"].alias("right"),
        d["prediction"].alias("value"),
        d["rawCount"].alias("rows"),
    )
    out = []
    for _, t in flat.toPandas().sort_values(["treeID", "id"]).groupby("treeID"):
        left, right = t["left"].to_numpy(np.int64), t["right"].to_numpy(np.int64)
        depth, parent = np.zeros(len(t), np.int64), np.full(len(t), -1)
        for node in np.flatnonzero(left >= 0).tolist():  # parents come first
            for child in (left[node], right[node]):
                depth[child], parent[child] = depth[node] + 1, node
        columns = (t[c].to_numpy() for c in ("feature", "threshold"))
        out.append(Tree(*columns, left, right, t["value"].to_numpy(), t["rows"].to_numpy(), depth, parent))
    return out


def _squares(trees: list[Tree], sizes: Sequence[int], limits: Sequence[tuple[int, int]]):
    """A function over batches ``(features, label)``: rows, sums of the label, and squared errors of every forest asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [[t.values(*limit) for limit in limits] for t in trees]
        sums, wrong = np.zeros(3), np.zeros((len(sizes), len(limits)))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            sums += [len(y), y.sum(), y @ y]
            total = np.zeros((len(limits), len(y)))
            for grown, (tree, of) in enumerate(zip(trees, values, strict=True), 1):
                leaf = tree.leaves(x)
                for k, value in enumerate(of):
                    total[k] += value[leaf]
                for s, size in enumerate(sizes):
                    if size == grown:
                        wrong[s] += ((total / grown - y) ** 2).sum(1)
        if sums[0]:
            yield pa.RecordBatch.from_arrays([pa.array([[*sums, *wrong.reshape(-1)]], pa.list_(pa.float64()))], ["v"])

    return run


def _checked(settings: Sequence[Mapping]) -> list[dict]:
    for one in settings:
        if unknown := set(one) - set(_DEFAULTS):
            raise ValueError(f"a forest has no parameter {', '.join(sorted(unknown))}")
    return [{**_DEFAULTS, **one} for one in settings]


def _depth(one: Mapping) -> int:
    return MAX_DEPTH if one["max_depth"] is None else int(one["max_depth"])


def fit_large(df: DataFrame, learner: RandomForestRegressor) -> RandomForestRegressionModel | None:
    """The forest of many draws, grown from cells; None where it is MLlib's to grow.

    ``learner`` may set trees, depth, bins, rows of a leaf and the seed.
    """
    known = {"numTrees", "maxDepth", "maxBins", "minInstancesPerNode", "seed", "featuresCol", "labelCol"}
    asked = {p.name for p, v in learner._paramMap.items() if v != learner._defaultParamMap.get(p)}
    trees = learner.getNumTrees()
    if asked - known or (learner.getFeaturesCol(), learner.getLabelCol()) != ("features", "label"):
        return None
    few = FEW_DRAWS // trees
    if df.limit(few + 1).count() <= few:
        return None
    edges, mean, rows = cells.bin_edges(df, learner.getMaxBins())
    if not cells.fits(edges, 1, rows):
        return None
    limits = learner.getMaxDepth(), learner.getMinInstancesPerNode()
    nodes = cells.grown_nodes(df, edges, mean, trees, *limits, learner.getSeed())
    # a model of MLlib of as many trees and the same settings, which is then given the grown nodes
    path = work_path(df.sparkSession, "forest")
    learner.fit(df.limit(100).coalesce(1)).write().overwrite().save(path)
    nodes.write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)


def _grown(df: DataFrame, trees: int, depth: int, leaf: int, seed: int) -> RandomForestRegressionModel:
    learner = RandomForestRegressor(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed
    )
    return fit_large(df, learner) or learner.fit(spread(df, trees))


def forest_scores(
    df: DataFrame, settings: Sequence[Mapping], *, fold: str = "fold", metric: str = "neg_mse", seed: int = 42
) -> list[list[float]]:
    """``neg_mse``, ``mse``, ``rmse`` or ``r2`` of every setting on every fold, in order of the folds.

    ``df`` has ``features``, ``label`` and ``fold``. Settings name ``n_estimators``,
    ``max_depth`` (None: as deep as can be), ``min_samples_split`` and ``min_samples_leaf``. Rows
    of a node count as often as its tree has drawn them.
    """
    wanted = _checked(settings)
    numbers = sorted(r[0] for r in df.select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if len(numbers) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} values of {fold}: these are no folds")
    leaves = sorted({one["min_samples_leaf"] for one in wanted})
    out = [[0.0] * len(numbers) for _ in wanted]
    rows = df.count()

    def shape(leaf: int) -> tuple[list[int], list[tuple[int, int]], list[int]]:
        """Numbers of trees, limits, and the places of the settings with these rows of a leaf."""
        places = [i for i, one in enumerate(wanted) if one["min_samples_leaf"] == leaf]
        sizes = sorted({wanted[i]["n_estimators"] for i in places})
        return sizes, sorted({(_depth(wanted[i]), wanted[i]["min_samples_split"]) for i in places}), places

    def note(at: int, leaf: int, n: float, s: float, q: float, wrong: Sequence[float]) -> None:
        """Scores of a fold from its rows, the sums of their labels and squares, and the squared errors by size and limit."""
        sizes, limits, places = shape(leaf)
        for i in places:
            limit = limits.index((_depth(wanted[i]), wanted[i]["min_samples_split"]))
            sse = wrong[sizes.index(wanted[i]["n_estimators"]) * len(limits) + limit]
            spread_of = q - s * s / n
            r2 = 1 - sse / spread_of if spread_of > 0 else math.nan
            out[i][at] = {"neg_mse": -sse / n, "mse": sse / n, "rmse": math.sqrt(max(sse, 0.0) / n), "r2": r2}[metric]

    if rows * max(one["n_estimators"] for one in wanted) > FEW_DRAWS and len(numbers) > 1:
        edges, mean, _ = cells.bin_edges(df)
        if cells.fits(edges, len(numbers), rows):
            place = F.array_position(F.array(*map(F.lit, numbers)), F.col(fold)) - 1
            asked = {leaf: shape(leaf)[:2] for leaf in leaves}
            for (leaf, at), v in cells.held_out_errors(df, place, len(numbers), edges, mean, rows, asked, seed).items():
                note(at, leaf, *v[:3].tolist(), v[3:].tolist())
            return out

    def grow(task: tuple[int, int]) -> None:
        at, leaf = task
        train, test = df.where(F.col(fold) != numbers[at]), df.where(F.col(fold) == numbers[at])
        sizes, limits, _ = shape(leaf)
        model = _grown(train, sizes[-1], max(d for d, _ in limits), leaf, seed)
        trees = trees_of(tree_nodes(df.sparkSession, model))
        held = spread(test, sizes[-1])
        rows = held.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
        parts = rows.mapInArrow(_squares(trees, sizes, limits), "v array<double>")
        width = 3 + len(sizes) * len(limits)
        n, s, q, *wrong = parts.agg(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).first()
        note(at, leaf, n, s, q, wrong)

    # Growing a small forest is many short stages of few tasks, so several grow side by side.
    draws = rows * max(one["n_estimators"] for one in wanted)
    tasks = [(at, leaf) for leaf in leaves for at in range(len(numbers))]  # small leaves, which take longest, first
    with ThreadPool(max(1, min(PARALLEL, len(tasks), MOST_DRAWS // max(1, draws)))) as pool:
        pool.map(inheritable_thread_target(df.sparkSession)(grow), tasks, chunksize=1)
    return out


def collapsed(nodes: DataFrame, min_split: int) -> DataFrame:
    """The nodes of trees in which no node of fewer than ``min_split`` rows is split, numbered anew.

    Rows only get fewer further down, so what goes are the children of nodes with too few.
    """
    d = F.col("nodeData")
    small = d["rawCount"] < min_split
    parents = nodes.where((d["leftChild"] >= 0) & ~small)
    kept = parents.select("treeID", F.explode(F.array(d["leftChild"], d["rightChild"])).alias("id")).union(
        nodes.where(d["id"] == 0).select("treeID", d["id"])
    )
    order = Window.partitionBy("treeID").orderBy("id")
    kept = kept.withColumn("new", F.row_number().over(order) - 1)
    of = lambda name: kept.select("treeID", F.col("id").alias(name), F.col("new").alias(f"new_{name}"))
    rows = nodes.withColumns({"id": d["id"], "left": d["leftChild"], "right": d["rightChild"]})
    for name, how in (("id", "inner"), ("left", "left"), ("right", "left")):
        rows = rows.join(of(name), ["treeID", name], how)
    leaf = F.col("new_left").isNull()
    split = F.struct(
        F.lit(-1).alias("featureIndex"),
        F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    made = F.struct(
        F.col("new_id").alias("id"),
        d["prediction"].alias("prediction"),
        d["impurity"].alias("impurity"),
        d["impurityStats"].alias("impurityStats"),
        d["rawCount"].alias("rawCount"),
        F.when(leaf, -1.0).otherwise(d["gain"]).alias("gain"),
        F.coalesce("new_left", F.lit(-1)).alias("leftChild"),
        F.coalesce("new_right", F.lit(-1)).alias("rightChild"),
        F.when(leaf, split).otherwise(d["split"]).alias("split"),
    )
    return rows.select("treeID", made.alias("nodeData"))


def save_forest(df: DataFrame, setting: Mapping, path: str, seed: int = 42) -> RandomForestRegressionModel:
    """Grow a forest of one setting on all rows and save it as a model that MLlib loads."""
    (one,) = _checked([setting])
    model = _grown(df, one["n_estimators"], _depth(one), one["min_samples_leaf"], seed)
    model.write().overwrite().save(path)
    if one["min_samples_split"] > 2:
        nodes = tree_nodes(df.sparkSession, model)
        collapsed(nodes, one["min_samples_split"]).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)


def forest_search(
    df: DataFrame,
    settings: Sequence[Mapping],
    *,
    fold: str = "fold",
    metric: str = "neg_mse",
    seed: int = 42,
    save_path: str | None = None,
) -> tuple[dict, DataFrame]:
    """The best setting and the mean score of every setting; ``save_path`` keeps the best one grown on all rows."""
    data = df.select("features", "label", fold).persist()
    try:
        scores = forest_scores(data, settings, fold=fold, metric=metric, seed=seed)
        best = dict(settings[_best([float(np.mean(s)) for s in scores], metric)])
        if save_path:
            save_forest(data, best, save_path, seed)
    finally:
        data.unpersist()
    return best, search_table(df, settings, scores, metric)
