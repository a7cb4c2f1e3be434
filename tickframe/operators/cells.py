"""Forests from cells: rows of equal binned features are added up, with their draws, before any tree grows.

A forest splits on at most 32 bins of a feature, so all that a tree asks of the rows of a cell
(one combination of bins) are the sums of their draws and labels. One pass over the rows adds
these up for all trees; the cells of a few trees then meet in one task, which grows them level
by level. Bootstrap, bins, features tried per node, gains and limits are MLlib's, and a grown
forest is handed over as a model of MLlib. Bins come from the features of all rows given.

A task holds the cells of :data:`TREES` trees. :func:`fits` tells whether there are few enough
of them; forests over more cells are MLlib's to grow.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells (of all folds together) that a task can hold, and the trees it grows from them.
MOST_CELLS, TREES = 1 << 20, 4
#: Rows that are drawn at once, and bytes of sums a task gathers before it sends them.
ROWS, GATHERED = 32_768, 64_000_000
#: Held-out cells that are scored in one task.
SCORED = 50_000
_U = np.uint64


def bin_edges(df: DataFrame, bins: int = 32) -> tuple[list[np.ndarray], float, int]:
    """The largest value of every bin but the last, per feature, the mean label and the number of rows.

    As in MLlib: the middle between neighbouring values where there are few, else between quantiles.
    """
    width = df.first()["features"].size
    x = vector_to_array("features")
    at = [k / 1000 for k in range(1001)]
    split = df.select(F.col("label").cast("double").alias("y"), *[F.get(x, F.lit(i)).alias(f"x{i}") for i in range(width)])
    row = split.agg(F.avg("y"), F.count(F.lit(1)), *[F.percentile_approx(f"x{i}", at, 10_000) for i in range(width)]).first()
    edges = []
    for found in row[2:]:
        found = np.array(found)
        known = np.unique(found)
        middles = (known[:-1] + known[1:]) / 2
        if len(known) > bins:
            picked = np.unique(found[np.linspace(0, 1000, bins + 1)[1:-1].round().astype(int)])
            places = np.searchsorted(known, picked)
            middles = middles[places[places < len(middles)]]
        edges.append(middles)
    return edges, float(row[0]), row[1]


def cell_count(edges: Sequence[np.ndarray]) -> int:
    return math.prod(len(e) + 1 for e in edges)


def fits(edges: Sequence[np.ndarray], folds: int, rows: int) -> bool:
    """Whether the cells of all folds are few enough for one task; there are no more of them than rows."""
    possible = folds * cell_count(edges)
    return min(rows, possible) <= MOST_CELLS and possible < 1 << 62


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _poisson() -> np.ndarray:
    """How often a row is drawn, for each of 65,536 equally likely numbers."""
    share = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(share * 65536, np.arange(65536) + 0.5).astype(np.uint8)


def _sums(code: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their rows. Here and below columns lie together, which adds up fastest."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[start], np.add.reduceat(sums.T[:, order], start, axis=1).T


def _body(code: np.ndarray, values: np.ndarray) -> bytes:
    return np.int64(len(code)).tobytes() + code.tobytes() + values.T.tobytes()


def _read(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    return np.frombuffer(body, np.int64, n, 8), np.frombuffer(body, np.float64, offset=8 + 8 * n).reshape(-1, n).T


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    number, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(body, pa.binary())], ["part", "body"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of at most :data:`ROWS` rows at a time, however rows came in batches."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            own = batch.slice(at, ROWS - n)
            at, n = at + own.num_rows, n + own.num_rows
            *plain, x = own.columns
            held.append([*(c.to_numpy() for c in plain), x.flatten().to_numpy().reshape(own.num_rows, -1)])
            if n == ROWS:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _added_up(edges: list[np.ndarray], mean: float, trees: int, seed: int):
    """A function over batches ``(hash, fold, label, features)``: sums of rows, labels and squares by cell, a block per few trees.

    Labels are taken less their mean. The first block also has the sums of all rows, drawn or not.
    """
    strides = np.cumprod([1, *(len(e) + 1 for e in edges)])
    table = _poisson()

    def drawn(key: np.ndarray) -> np.ndarray:
        """Draws of rows for all trees; four from one hash."""
        steps = np.arange(1, -(-trees // 4) + 1).astype(_U) * _U(0x9E3779B97F4A7C15)
        return np.ascontiguousarray(table[_mixed(key[:, None] + steps).view(np.uint16)[:, :trees]].T)

    def cells(place: int, known: np.ndarray, fold: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = fold.astype(np.int64) * strides[-1]
        for i, e in enumerate(edges):
            code += np.searchsorted(e, x[:, i]) * strides[i]
        # draws follow from the row; equal rows are drawn apart
        order = np.lexsort((code, known))
        code, known, y = code[order], known[order], y[order] - mean
        same = np.append(False, known[1:] == known[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        again = (np.arange(len(same)) - first).astype(_U)
        start_key = _mixed(np.array([seed, place], np.int64).astype(_U) + _U(1))
        key = _mixed(_mixed(known.view(_U) ^ start_key[0]) + start_key[1] + again * _U(0xD1342543DE82EF95))
        order = np.argsort(code, kind="stable")
        code, key, y = code[order], key[order], y[order]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        out = np.empty((trees + 1, 3, len(start)))
        w = np.concatenate((np.ones((1, len(code)), np.uint8), drawn(key)))
        for lo in range(0, trees + 1, 16):
            own = w[lo : lo + 16].astype(np.float64)
            for k in range(3):
                out[lo : lo + 16, k] = np.add.reduceat(own, start, axis=1)
                own *= y
        return code[start], out.reshape(-1, len(start)).T

    def blocks(code: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        rows = []
        for part, lo in enumerate(range(0, trees, TREES)):
            own = sums[:, 3 * (lo + 1 if lo else 0) : 3 * (lo + TREES + 1)]
            rows.append((part, _body(code, own)))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size = TaskContext.get().partitionId(), [], 0
        for chunk, columns in enumerate(_chunks(batches)):
            held.append(cells((task << 32) + chunk, *columns))
            size += held[-1][1].nbytes
            if size > GATHERED:
                held = [_sums(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                size = held[0][1].nbytes
                if size > GATHERED // 2:
                    yield blocks(*held[0])
                    held, size = [], 0
        if held:
            yield blocks(*_sums(*(np.concatenate(c) for c in zip(*held, strict=True))))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The blocks of each part of a task, added up; few are held at once."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = held.setdefault(part, [])
            own.append(_read(body))
            if len(own) > 16:
                held[part] = [_sums(*(np.concatenate(c) for c in zip(*own, strict=True)))]
    for part, own in held.items():
        yield part, *_sums(*(np.concatenate(c) for c in zip(*own, strict=True)))


def grow(bins: np.ndarray, sums: np.ndarray, depth: int, leaf: int, tried: int, rng: np.random.Generator) -> dict:
    """A tree over cells, as arrays; children come after their parents, -1 where there are none.

    ``sums`` has draws, labels and squares of every cell. A node tries ``tried`` features drawn for
    it, takes the cut of largest gain in variance that leaves ``leaf`` draws on either side, and is split
    unless that gain is (next to) nothing. ``cut`` is the last bin that goes left.
    """
    keep = sums[:, 0] > 0
    bins, sums = bins[keep], sums[keep]
    width, most = bins.shape[1], int(bins.max(initial=0)) + 1
    place, node, parents = np.arange(len(bins)), np.zeros(len(bins), np.int64), np.array([-1])
    total = sums.sum(0)[None]
    n = max(total[0, 0], 1.0)
    floor = 1e-12 * max(total[0, 2] / n - (total[0, 1] / n) ** 2, 0.0)
    levels, made = [], 0
    while len(parents):
        k, level = len(parents), len(levels)
        gain, feature, cut = np.zeros(k), np.full(k, -1), np.full(k, -1)
        if level < depth and len(place):
            value = total[:, 1] / total[:, 0]
            weight = sums[place, 0]
            rest = sums[place, 1] - weight * value[node]  # adds up to nothing in every node
            chosen = rng.random((k, width)).argsort(1)[:, :tried]
            for own in chosen.T:
                key = node * most + bins[place, own[node]]
                order = np.argsort(key)
                key = key[order]
                end = np.flatnonzero(np.append(key[1:] != key[:-1], True))
                at, key = key[end] // most, key[end] % most
                last = np.flatnonzero(np.append(at[1:] != at[:-1], True))  # of every node
                left = np.cumsum(weight[order])[end]
                left -= np.append(0, left[last[:-1]])[at]
                right = total[at, 0] - left
                ok = (left >= leaf) & (right >= leaf) & (right > 0)
                ok[last] = False
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = np.where(ok, np.cumsum(rest[order])[end] ** 2 / (left * right), -1.0)
                top = np.maximum.reduceat(found, np.append(0, last[:-1] + 1))
                hit = np.flatnonzero(found == top[at])
                hit = hit[np.unique(at[hit], return_index=True)[1]]
                better = top > gain
                gain[better], feature[better], cut[better] = top[better], own[better], key[hit][better]
        split = gain > floor
        feature[~split] = cut[~split] = -1
        rank = np.cumsum(split) - 1
        child = np.where(split, made + k + 2 * rank, -1)
        levels.append((feature, cut, child, np.where(split, child + 1, -1), total, np.where(split, gain, -1.0), parents))
        inner = split[node]
        place, node = place[inner], node[inner]
        goes_right = bins[place, feature[node]] > cut[node]
        node = 2 * rank[node] + goes_right
        parents = np.repeat(made + np.flatnonzero(split), 2)
        total = np.stack([np.bincount(node, sums[place, c], len(parents)) for c in range(3)], 1)
        made += k
    names = ("feature", "cut", "left", "right", "total", "gain", "parent")
    out = {name: np.concatenate(c) for name, c in zip(names, zip(*levels, strict=True), strict=True)}
    return {**out, "depth": np.repeat(np.arange(len(levels)), [len(x[0]) for x in levels])}


def _spread_out(code: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of cells, a column per feature."""
    sizes = [len(e) + 1 for e in edges]
    strides = np.cumprod([1, *sizes])
    return np.stack([code // strides[i] % size for i, size in enumerate(sizes)], 1)


def _tried(trees: int, width: int) -> int:
    """Features a node tries: MLlib's choice for regression."""
    return width if trees == 1 else math.ceil(width / 3)


def _trees(part: int, code: np.ndarray, sums: np.ndarray, trees: int) -> Iterator[tuple[int, np.ndarray]]:
    for t in range(part * TREES, min(trees, (part + 1) * TREES)):
        column = t - part * TREES + (part == 0)
        yield t, sums[:, 3 * column : 3 * column + 3]


def cell_blocks(df: DataFrame, fold, edges: list[np.ndarray], mean: float, trees: int, seed: int) -> DataFrame:
    """Cells of ``df`` in blocks; the blocks of the same few trees meet in one partition."""
    rows = df.select(
        F.xxhash64("features", "label").alias("h"),
        fold.cast("int").alias("fold"),
        F.col("label").cast("double").alias("y"),
        vector_to_array("features").alias("x"),
    )
    blocks = rows.mapInArrow(_added_up(edges, mean, trees, seed), "part int, body binary")
    return blocks.repartitionById(-(-trees // TREES), "part")


_NODES = """treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double,
    leftChild int, rightChild int, split struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"""


def grown_nodes(df: DataFrame, edges, mean: float, trees: int, depth: int, leaf: int, seed: int) -> DataFrame:
    """The nodes of a forest on all rows, in the columns MLlib saves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, code, sums in _merged(batches):
            bins = _spread_out(code, edges)
            for t, own in _trees(part, code, sums, trees):
                tree = grow(bins, own, depth, leaf, _tried(trees, len(edges)), np.random.default_rng([seed, t]))
                n, s, q = tree["total"].T
                drawn = np.maximum(n, 1.0)
                middle = s / drawn
                variance = np.maximum(q / drawn - middle**2, 0.0)
                stats = np.stack([n, s + n * mean, q + 2 * mean * s + n * mean * mean], 1)
                cuts = [[float(edges[f][c])] if f >= 0 else [] for f, c in zip(tree["feature"], tree["cut"], strict=True)]
                split = pa.StructArray.from_arrays(
                    [pa.array(tree["feature"], pa.int32()), pa.array(cuts, pa.list_(pa.float64())), pa.array([-1] * len(n), pa.int32())],
                    ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
                )
                columns = {
                    "treeID": pa.array([t] * len(n), pa.int32()),
                    "id": pa.array(np.arange(len(n)), pa.int32()),
                    "prediction": pa.array(middle + mean),
                    "impurity": pa.array(variance),
                    "impurityStats": pa.array(list(stats), pa.list_(pa.float64())),
                    "rawCount": pa.array(n.astype(np.int64)),
                    "gain": pa.array(tree["gain"]),
                    "leftChild": pa.array(tree["left"], pa.int32()),
                    "rightChild": pa.array(tree["right"], pa.int32()),
                    "split": split,
                }
                yield pa.RecordBatch.from_pydict(columns)

    blocks = cell_blocks(df, F.lit(0), edges, mean, trees, seed)
    flat = blocks.mapInArrow(run, _NODES)
    return flat.select("treeID", F.struct(*[c for c in flat.columns if c != "treeID"]).alias("nodeData"))


def _forest_values(tree: dict, limits: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """What the tree predicts in each of its nodes under each ``(max_depth, min_split)``: of the first limited node above."""
    n, s, _ = tree["total"].T
    value, parent, depth = s / np.maximum(n, 1.0), tree["parent"], tree["depth"]
    levels = np.split(np.arange(len(n)), np.flatnonzero(np.diff(depth)) + 1)
    out = []
    for most, least in limits:
        stops, under, own = (depth >= most) | (n < least), np.zeros(len(n), bool), value.copy()
        for at in levels[1:]:
            up = parent[at]
            under[at] = under[up] | stops[up]
            own[at] = np.where(under[at], own[up], own[at])
        out.append(own)
    return out


def _leaves(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The leaf of every cell."""
    node, inner = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(inner := inner[tree["left"][node[inner]] >= 0]):
        at = node[inner]
        goes_left = bins[inner, tree["feature"][at]] <= tree["cut"][at]
        node[inner] = np.where(goes_left, tree["left"][at], tree["right"][at])
    return node


def held_out_errors(
    df: DataFrame,
    fold,
    folds: int,
    edges: list[np.ndarray],
    mean: float,
    rows: int,
    asked: dict[int, tuple[list[int], list[tuple[int, int]]]],
    seed: int,
) -> dict[tuple[int, int], np.ndarray]:
    """Of every ``(min_samples_leaf, fold)``: held-out rows, sums of their labels (less the mean) and squares, then squared errors.

    ``asked`` has for each ``min_samples_leaf`` the ascending numbers of trees and the limits ``(max_depth, min_split)``; errors come
    by number of trees, then limit. A fold's forests grow on the cells of the other folds. What they predict for a held-out
    cell is added up over trees by a shuffle.
    """
    trees, cells = max(sizes[-1] for sizes, _ in asked.values()), cell_count(edges)
    parts = -(-min(rows, folds * cells) // SCORED)
    leaves = sorted(asked)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, code, sums in _merged(batches):
            own_fold, cell = code // cells, code % cells
            for k in range(folds):
                held = np.flatnonzero(own_fold == k)
                if not len(held):
                    continue
                rest = own_fold != k
                test = _spread_out(cell[held], edges)
                to = (_mixed(code[held].astype(_U)) % _U(parts)).astype(np.int64)
                known, place = np.unique(cell[rest], return_inverse=True)
                train = _spread_out(known, edges)
                drawn = [
                    (t, np.stack([np.bincount(place, own[rest, c], len(known)) for c in range(3)], 1))
                    for t, own in _trees(part, code, sums, trees)
                ]
                for number, leaf in enumerate(leaves):
                    sizes, limits = asked[leaf]
                    deepest = max(d for d, _ in limits)
                    values = np.zeros((len(held), 3 + len(sizes) * len(limits)))
                    if part == 0:
                        values[:, :3] = sums[held, :3]
                    for t, own in drawn:
                        if t >= sizes[-1]:
                            continue
                        tree = grow(train, own, deepest, leaf, _tried(sizes[-1], len(edges)), np.random.default_rng([seed, t]))
                        at = _leaves(tree, test)
                        first = 3 + int(np.searchsorted(sizes, t, "right")) * len(limits)
                        for i, value in enumerate(_forest_values(tree, limits)):
                            values[:, first + i] += value[at]
                    rows = [(number * parts + p, own) for p in range(parts) if len(own := np.flatnonzero(to == p))]
                    yield _batch([(p, _body(code[held[own]], values[own])) for p, own in rows])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, code, values in _merged(batches):
            sizes, limits = asked[leaves[part // parts]]
            n, s, q = values[:, :3].T
            by_size = np.cumsum(values[:, 3:].reshape(len(code), len(sizes), len(limits)), axis=1)
            found = by_size / np.array(sizes)[:, None]
            wrong = n[:, None, None] * found**2 - 2 * s[:, None, None] * found + q[:, None, None]
            each = np.concatenate((values[:, :3], wrong.reshape(len(code), -1)), 1)
            known, sums = _sums(code // cells, each)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([leaves[part // parts]] * len(known), pa.int32()),
                    pa.array(known, pa.int32()),
                    pa.array(list(sums), pa.list_(pa.float64())),
                ],
                ["leaf", "fold", "v"],
            )

    predicted = cell_blocks(df, fold, edges, mean, trees, seed).mapInArrow(predict, "part int, body binary")
    scored = predicted.repartitionById(parts * len(leaves), "part").mapInArrow(score, "leaf int, fold int, v array<double>")
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in scored.collect():  # a few numbers per part and fold
        out[r["leaf"], r["fold"]] = out.get((r["leaf"], r["fold"]), 0) + np.array(r["v"])
    return out
