"""Parameter search: settings from lists or distributions, and ridge regressions scored from fold statistics.

A ridge regression depends on its training rows through their sums of products alone. One pass
gives these per fold; a training set is the total less a fold, so all settings on all folds
are solved without reading the rows again. Errors on the held-out rows come from the fold's
sums in the same way.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.moments import centres, pair_moments

#: Folds times inner folds that a search accepts: their sums come to the driver.
MOST_FOLDS = 2000


# --- where settings come from -------------------------------------------------


@dataclass(frozen=True)
class Uniform:
    """Numbers between two bounds, all alike."""

    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)


@dataclass(frozen=True)
class LogUniform:
    """Positive numbers between two bounds, all orders of magnitude alike."""

    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))


@dataclass(frozen=True)
class IntRange:
    """Whole numbers from ``low`` to ``high``, both included."""

    low: int
    high: int

    def draw(self, rng: random.Random) -> int:
        return rng.randint(self.low, self.high)


Space = Mapping[str, "Sequence | Uniform | LogUniform | IntRange"]


def every_setting(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def draw_settings(space: Space, n: int = 10, seed: int = 42) -> list[dict]:
    """``n`` settings of a space whose parameters are lists or distributions.

    Lists alone are drawn from without repetition (all of them if there are fewer); with a
    distribution every draw stands for itself. A seed gives the same draws everywhere.
    """
    rng = random.Random(seed)
    if all(not hasattr(values, "draw") for values in space.values()):
        every = every_setting(space)
        return every if n >= len(every) else rng.sample(every, n)
    one = lambda v: v.draw(rng) if hasattr(v, "draw") else rng.choice(list(v))
    return [{name: one(values) for name, values in space.items()} for _ in range(n)]


# --- ridge regression from sums -------------------------------------------------


@dataclass
class Sums:
    """Rows, sums and sums of products of the features and, last, the label (less their centres)."""

    n: float
    s: np.ndarray
    p: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.s + other.s, self.p + other.p)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.s - other.s, self.p - other.p)


def fold_sums(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str]) -> tuple[dict[tuple, Sums], list[float]]:
    """The sums of every group of rows without a missing value, and the columns' centres; one pass over the rows."""
    names = [*xs, y]
    complete = df.dropna(subset=[*names, *by])
    middle = centres(complete, names)
    found = pair_moments(complete, names, middle, by=by)
    most = MOST_FOLDS * len(names) * (len(names) + 1) // 2
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {MOST_FOLDS} groups by {', '.join(by)}: these are no folds")
    out: dict[tuple, Sums] = {}
    for r in rows:
        group = out.setdefault(tuple(r[b] for b in by), Sums(0.0, np.zeros(len(names)), np.zeros((len(names),) * 2)))
        group.n = r["n"]
        group.s[r["i"]], group.s[r["j"]] = r["s_i"], r["s_j"]
        group.p[r["i"], r["j"]] = group.p[r["j"], r["i"]] = r["p"]
    return out, middle


def ridge(train: Sums, reg: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients: least squares with a penalty of ``reg`` on coefficients of standardised features."""
    mean = train.s / train.n
    cov = train.p / train.n - np.outer(mean, mean)
    inner = cov[:-1, :-1] + reg * np.diag(np.diag(cov)[:-1])
    beta = np.linalg.lstsq(inner, cov[:-1, -1], rcond=None)[0]
    return float(mean[-1] - beta @ mean[:-1]), beta


def score(test: Sums, line: tuple[float, np.ndarray], metric: str = "r2") -> float:
    """``r2``, ``mse``, ``rmse`` or ``neg_mse`` of a line on the rows that gave these sums."""
    a, beta = line
    if not test.n:
        return math.nan
    w = np.append(-beta, 1.0)  # y - x beta
    sse = float(w @ test.p @ w - 2 * a * (w @ test.s) + test.n * a * a)
    if metric == "r2":
        spread = test.p[-1, -1] - test.s[-1] ** 2 / test.n
        return 1 - sse / spread if spread > 0 else math.nan
    mse = max(sse / test.n, 0.0)
    return {"mse": mse, "rmse": math.sqrt(mse), "neg_mse": -mse}[metric]


def _held_out(df: DataFrame, xs: Sequence[str], y: str, fold: str) -> dict[int, tuple[Sums, Sums]]:
    """Per fold the sums of its rows and of all others."""
    parts, _ = fold_sums(df, xs, y, [fold])
    total = _total(parts.values()) if parts else None
    return {f: (part, total - part) for (f,), part in sorted(parts.items())}


def _total(parts) -> Sums:
    parts = list(parts)
    return sum(parts[1:], parts[0])


def _larger_is_better(metric: str) -> bool:
    return metric in ("r2", "neg_mse")


def _best(scores: Sequence[float], metric: str) -> int:
    known = [(-s if _larger_is_better(metric) else s, i) for i, s in enumerate(scores) if not math.isnan(s)]
    return min(known)[1] if known else 0


def _reg(setting: Mapping) -> float:
    unknown = set(setting) - {"regParam"}
    if unknown:
        raise ValueError(f"a ridge regression has no parameter {', '.join(sorted(unknown))}")
    return float(setting.get("regParam", 0.0))


def ridge_scores(
    df: DataFrame, xs: Sequence[str], y: str, settings: Sequence[Mapping], *, fold: str = "fold", metric: str = "r2"
) -> list[list[float]]:
    """Score of every setting on every fold, in order of the folds."""
    held = _held_out(df, xs, y, fold)
    return [[score(test, ridge(train, _reg(one)), metric) for test, train in held.values()] for one in settings]


def cross_validate_ridge(
    df: DataFrame,
    xs: Sequence[str],
    y: str,
    reg: float = 0.0,
    *,
    settings: Sequence[Mapping] | None = None,
    fold: str = "fold",
    inner: str = "inner",
    role: str | None = None,
    metric: str = "r2",
) -> DataFrame:
    """Score per fold, as rows ``(fold, score, mean_score)``.

    With ``settings`` the best of them is searched on the ``inner`` folds of each training
    part first. With ``role`` a fold names its own training rows (``train``) and held-out rows
    (``test``), as expanding folds do; else a fold is held out against the others.
    """
    lines = []
    if settings:
        cells, _ = fold_sums(df, xs, y, [fold, inner])
        folds, parts = sorted({f for f, _ in cells}), sorted({g for _, g in cells})
        for f in folds:
            outside = {g: [s for c, s in cells.items() if c[0] != f and c[1] == g] for g in parts}
            outside = {g: _total(found) for g, found in outside.items() if found}
            train = _total(outside.values())
            means = [
                float(np.mean([score(part, ridge(train - part, _reg(one)), metric) for part in outside.values()]))
                for one in settings
            ]
            line = ridge(train, _reg(settings[_best(means, metric)]))
            lines.append((f, score(_total(cells[c] for c in cells if c[0] == f), line, metric)))
    elif role:
        marked = df.withColumn("_test", (F.col(role) == "test").cast("int"))
        cells, _ = fold_sums(marked, xs, y, [fold, "_test"])
        lines = [(f, score(cells[f, 1], ridge(cells[f, 0], reg), metric)) for f in sorted({c[0] for c in cells})]
    else:
        held = _held_out(df, xs, y, fold)
        lines = [(f, score(test, ridge(train, reg), metric)) for f, (test, train) in held.items()]
    mean = float(np.mean([s for _, s in lines])) if lines else None
    rows = [(int(f), float(s), mean) for f, s in lines]
    return df.sparkSession.createDataFrame(rows, "fold int, score double, mean_score double")


def search_table(df: DataFrame, settings: Sequence[Mapping], scores: Sequence[Sequence[float]], metric: str) -> DataFrame:
    """Rows ``(setting, params, mean_score, best)``; the first of equally good settings is best."""
    means = [float(np.mean(s)) for s in scores]
    best = _best(means, metric)
    rows = [(i, {k: str(v) for k, v in one.items()}, m, i == best) for i, (one, m) in enumerate(zip(settings, means, strict=True))]
    return df.sparkSession.createDataFrame(rows, "setting int, params map<string,string>, mean_score double, best boolean")


def ridge_search(
    df: DataFrame, xs: Sequence[str], y: str, settings: Sequence[Mapping], *, fold: str = "fold", metric: str = "r2"
) -> tuple[dict, DataFrame]:
    """The best setting and the mean score of every setting, from one pass over the rows."""
    scores = ridge_scores(df, xs, y, settings, fold=fold, metric=metric)
    return dict(settings[_best([float(np.mean(s)) for s in scores], metric)]), search_table(df, settings, scores, metric)
