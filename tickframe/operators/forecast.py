"""Autoregressive forecasts for whole panels.

Fits are conditional least squares on sums of products: every block of a series is reduced
to one short row, rows are added up per series, and a tiny system is solved per series.
Models without moving average and without product of lags need one such pass. Others start
from the two-stage method of Hannan and Rissanen (1982), with roots reflected into the unit
circle, and are refined by damped Gauss-Newton passes over their own residuals, in the
factors of the multiplicative seasonal polynomials. These are not maximum-likelihood
estimates.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickframe.operators.indicators import row_tail
from tickframe.operators.layout import block_series, series_blocks
from tickframe.operators.stats import naive_forecast
from tickframe.session import broadcast_if_small, materialize

# The helpers of the small solves travel with them, so that executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Largest root (per row) that moving-average weights keep, and the share of a shock at the
#: start of the history that may still be felt: together they say how many rows a forecast
#: starts from. FAINT is that share at the start of a block of a long series while fitting.
ROOT, FELT, FAINT = 0.995, 1e-12, 1e-6
#: Largest root of the autoregressive factors of models that are refined.
STEADY = 0.9995
#: A fit is done where a pass lowers the squares by less than this part, or after so many passes.
ENOUGH, PASSES = 1e-9, 40
#: Highest order of the long autoregression; a series of n rows uses 10 log10(n) of it.
LONG_AR = 60
_MODEL = (
    "const double, ar_lags array<int>, ar array<double>, ma_lags array<int>, ma array<double>, "
    "exog array<double>, sigma2 double, n bigint, reason string, phi array<double>, season_phi array<double>, "
    "theta array<double>, season_theta array<double>"
)
_MODEL_NAMES = [part.split()[0] for part in _MODEL.split(", ")]


@dataclass(frozen=True)
class Arima:
    """Orders ``(p, d, q)`` and ``(P, D, Q, s)``; ``exog`` names further regressors."""

    order: tuple[int, int, int] = (5, 1, 0)
    seasonal: tuple[int, int, int, int] = (0, 0, 0, 1)
    exog: tuple[str, ...] = ()

    def _lags(self, plain: int, seasonal: int) -> list[int]:
        season = self.seasonal[3]
        reach = {i + j * season for i in range(plain + 1) for j in range(seasonal + 1)}
        return sorted(reach - {0})

    @property
    def ar_lags(self) -> list[int]:
        return self._lags(self.order[0], self.seasonal[0])

    @property
    def ma_lags(self) -> list[int]:
        return self._lags(self.order[2], self.seasonal[2])

    @property
    def differencing(self) -> list[float]:
        """Coefficients of ``(1 - L)^d (1 - L^s)^D``, lag 0 first."""
        poly = np.array([1.0])
        for _ in range(self.order[1]):
            poly = np.convolve(poly, [1.0, -1.0])
        for _ in range(self.seasonal[1]):
            poly = np.convolve(poly, [1.0, *[0.0] * (self.seasonal[3] - 1), -1.0])
        return poly.tolist()

    @property
    def with_const(self) -> bool:
        return self.order[1] == 0 and self.seasonal[1] == 0

    @property
    def long_ar(self) -> int:
        return max(LONG_AR, 2 * max(self.ma_lags, default=0)) if self.ma_lags else 0

    def _memory(self, felt: float) -> int:
        return math.ceil(math.log(felt) / math.log(ROOT)) if self.ma_lags else 0

    @property
    def tail(self) -> int:
        """Rows before the end that a forecast depends on."""
        return self._memory(FELT) + max([*self.ar_lags, *self.ma_lags, 0]) + len(self.differencing) + 1

    @property
    def lookback(self) -> int:
        """Rows before a block that its residuals depend on."""
        widest = max([*self.ar_lags, *self.ma_lags, 0])
        return len(self.differencing) - 1 + max(self.long_ar, self._memory(FAINT)) + widest


# The model orders asked for by name.
MODELS = {
    "arima": Arima((5, 1, 0)),
    "sarima": Arima((1, 1, 1), (1, 1, 1, 12)),
    "sarimax": Arima((1, 1, 1), (1, 1, 1, 12)),
}


def model_named(name: str) -> Arima:
    try:
        return MODELS[name.lower()]
    except KeyError:
        raise ValueError(f"unsupported model type: {name}") from None


# --- numbers of one block ----------------------------------------------------


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    """``x`` some rows later, zeros before it begins."""
    out = np.zeros_like(x)
    if k < len(x):
        out[k:] = x[: len(x) - k]
    return out


def _filtered(poly: Sequence[float], x: np.ndarray) -> np.ndarray:
    """The lag polynomial applied to ``x``, which is zero before it begins."""
    out = np.zeros_like(x)
    for k, c in enumerate(poly):
        if c and k < len(x):
            out += c * _shifted(x, k)
    return out


def _divided(weights: Sequence[float], step: int, x: np.ndarray) -> np.ndarray:
    """``x`` divided by ``1 + w1 L^step + w2 L^(2 step) + ...``, without a walk along the rows.

    A factor ``1 / (1 - a B)`` is the product of ``1 + a^(2^j) B^(2^j)``, so it takes as many
    vector steps as the row count has binary digits.
    """
    roots = np.roots([1.0, *weights]) if len(weights) else []
    out = x if np.isrealobj(roots) or not len(roots) else x.astype(complex)
    for a in roots:
        shift = step
        while shift < len(x) and abs(a) > 1e-200:
            out = out + a * _shifted(out, shift)
            a, shift = a * a, 2 * shift
    return np.real(out)


def _polynomial(signed: Sequence[float], seasonal: Sequence[float], season: int) -> np.ndarray:
    far = np.zeros(len(seasonal) * season + 1)
    far[0] = 1.0
    far[season::season] = seasonal
    return np.convolve([1.0, *signed], far)


def _held(weights: Sequence[float], limit: float, *, reflect: bool = False) -> np.ndarray:
    """Weights of ``1 + w1 B + w2 B^2 + ...`` with no root beyond ``limit``.

    ``reflect`` first turns roots outside of the unit circle into it.
    """
    weights = np.asarray(weights, float)
    if not len(weights):
        return weights
    roots = np.roots([1.0, *weights]).astype(complex)
    size = np.abs(roots)
    if not (size > limit).any():
        return weights
    if reflect:
        out = size > 1
        roots[out] = 1 / np.conj(roots[out])
        size = np.abs(roots)
    over = size > limit
    roots[over] *= limit / size[over]
    made = np.real(np.poly(roots))[1:]
    return np.append(made, np.zeros(len(weights) - len(made)))


def reflected(ma: Sequence[float], sigma2: float = 1.0) -> tuple[list[float], float]:
    """Moving-average weights with all roots inside the unit circle, and the variance that goes with them.

    Spectral factorisation: both describe the same autocovariances.
    """
    weights = np.asarray(ma, float)
    roots = np.roots([1.0, *weights]).astype(complex)
    out = np.abs(roots) > 1
    sigma2 = float(sigma2 * np.prod(np.abs(roots[out]) ** 2))
    roots[out] = 1 / np.conj(roots[out])
    made = np.real(np.poly(roots))[1:]
    return np.append(made, np.zeros(len(weights) - len(made))).tolist(), sigma2


class _Fit:
    """Least squares of one model as a sequence of sums over blocks and steps between them.

    A state goes through ``moments`` (autocovariances, for the long autoregression that gives
    first residuals), ``start`` (linear regression on lags and these residuals) and ``refine``
    (damped Gauss-Newton on the residuals of the model itself). ``sums`` looks at one block,
    ``advance`` at the sums of all blocks of a series; a model without moving average and
    without product of lags is done after ``start``.
    """

    def __init__(self, spec: Arima):
        self.spec, self.diff = spec, spec.differencing
        (self.p, _, self.q), (self.P, _, self.Q, self.s) = spec.order, spec.seasonal
        self.linear = not spec.ma_lags and not (self.p and self.P)
        self.extra = len(spec.exog) + (1 if spec.exog and spec.with_const else 0)
        self.size = self.p + self.P + self.q + self.Q + self.extra
        self.burn = max([*spec.ar_lags, 0])

    def first(self) -> dict:
        return {"stage": "moments" if self.spec.ma_lags else "start", "reason": None}

    def parts(self, beta: Sequence[float]) -> list[np.ndarray]:
        ends = np.cumsum([self.p, self.P, self.q, self.Q])
        return np.split(np.asarray(beta, float), ends)

    def data(self, y: np.ndarray, exog: np.ndarray, mean: float, halo: int):
        """Differenced rows, their regressors, and which rows of the block count."""
        cut = max(halo - self.spec.lookback, 0)  # copied rows beyond need are left out: cuts do not matter
        y, exog, halo, gap = y[cut:], exog[cut:], halo - cut, len(self.diff) - 1
        w = _filtered(self.diff, y - mean if self.spec.with_const else y)[gap:]
        e = np.column_stack([_filtered(self.diff, c)[gap:] for c in exog.T]) if exog.size else np.zeros((len(w), 0))
        if self.extra > len(self.spec.exog):
            e = np.column_stack([e, np.ones(len(w))])
        known = ~np.isnan(e).any(1)
        e[~known] = 0.0
        rows = known & (np.arange(len(w)) >= max(halo - gap if halo else 0, self.burn))
        return w, e, rows

    def sums(self, state: dict, w: np.ndarray, e: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if state["stage"] == "moments":
            m = self.spec.long_ar
            at = np.flatnonzero(rows)
            products = [float(w[at[at >= k]] @ w[at[at >= k] - k]) for k in range(m + 1)]
            return np.array([len(at), *products])
        if state["stage"] == "start":
            columns = [_shifted(w, k) for k in self.spec.ar_lags]
            if self.spec.ma_lags:
                u = _filtered([1.0, *(-v for v in state["long"])], w)
                columns += [_shifted(u, k) for k in self.spec.ma_lags]
            x = np.column_stack([*columns, e, w])[rows]
        else:
            x = np.column_stack([*self.slopes(state["beta"], w, e)])[rows]
        gram = x.T @ x
        return np.append(float(rows.sum()), gram[np.triu_indices(len(gram))])

    def slopes(self, beta: Sequence[float], w: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
        """The residual's derivative by each parameter, and the residual."""
        phi, far_phi, theta, far_theta, rest = self.parts(beta)

        def settled(x: np.ndarray) -> np.ndarray:
            x = np.where(np.arange(len(x)) < self.burn, 0.0, x)
            return _divided(far_theta, self.s, _divided(theta, 1, x))

        near, far = _polynomial(-phi, [], self.s), _polynomial([], -far_phi, self.s)
        u = settled(_filtered(np.convolve(near, far), w) - e @ rest)
        by_far, by_near = _filtered(far, w), _filtered(near, w)
        out = [settled(-_shifted(by_far, i)) for i in range(1, self.p + 1)]
        out += [settled(-_shifted(by_near, j * self.s)) for j in range(1, self.P + 1)]
        out += [_divided(theta, 1, -_shifted(u, i)) for i in range(1, self.q + 1)]
        out += [_divided(far_theta, self.s, -_shifted(u, j * self.s)) for j in range(1, self.Q + 1)]
        return [*out, *(settled(-c) for c in e.T), u]

    def hold(self, beta: np.ndarray, *, reflect: bool = False) -> np.ndarray:
        phi, far_phi, theta, far_theta, rest = self.parts(beta)
        return np.concatenate(
            [
                -_held(-phi, STEADY, reflect=reflect),
                -_held(-far_phi, STEADY, reflect=reflect),
                _held(theta, ROOT, reflect=reflect),
                _held(far_theta, ROOT**self.s, reflect=reflect),
                rest,
            ]
        )

    def advance(self, state: dict, sums: np.ndarray) -> dict:
        n = int(round(sums[0]))
        if state["stage"] == "moments":
            return {"stage": "start", "reason": None, "long": self.long(n, sums[1:])}
        gram = np.zeros((size := int((np.sqrt(8 * len(sums) - 7) - 1) / 2), size))
        gram[np.triu_indices(size)] = sums[1:]
        gram += np.triu(gram, 1).T
        a, b, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
        if not n:
            return state | {"stage": "done", "beta": None, "n": 0}
        few = "few rows" if n < 2 * size else None
        if state["stage"] == "start":
            beta = np.linalg.lstsq(a, b, rcond=None)[0]  # of least norm where rows are too few
            if self.linear:
                sse = float(yy - 2 * beta @ b + beta @ a @ beta)
                return {"stage": "done", "beta": beta.tolist(), "sse": sse, "n": n, "reason": few}
            at = {k: v for k, v in zip(self.spec.ar_lags, beta, strict=False)}
            mas = {k: v for k, v in zip(self.spec.ma_lags, beta[len(self.spec.ar_lags) :], strict=False)}
            first = [at[i] for i in range(1, self.p + 1)] + [at[j * self.s] for j in range(1, self.P + 1)]
            first += [mas[i] for i in range(1, self.q + 1)] + [mas[j * self.s] for j in range(1, self.Q + 1)]
            first = self.hold(np.append(first, beta[len(beta) - self.extra :] if self.extra else []), reflect=True)
            return {"stage": "refine", "beta": first.tolist(), "sse": None, "damp": 1e-3, "passes": 0, "reason": few}
        done = False
        new = state | {"passes": state["passes"] + 1, "n": n}
        if np.isfinite(yy) and (state["sse"] is None or yy <= state["sse"]):
            done = state["sse"] is not None and state["sse"] - yy <= ENOUGH * yy
            new |= {"best": state["beta"], "sse": float(yy), "a": a.tolist(), "b": b.tolist(), "damp": max(state["damp"] / 5, 1e-9)}
        elif state["sse"] is None:
            return new | {"stage": "done", "beta": None}
        else:
            new["damp"] = state["damp"] * 6
        best, a, b = np.array(new["best"]), np.array(new["a"]), np.array(new["b"])
        ridge = np.diag(np.diag(a) * new["damp"] + 1e-12 * max(float(np.trace(a)), 1e-300))
        beta = self.hold(best - np.linalg.lstsq(a + ridge, b, rcond=None)[0])
        if done or new["damp"] > 1e8 or np.abs(beta - best).max(initial=0.0) < 1e-8:
            return new | {"stage": "done", "beta": best.tolist()}
        if new["passes"] >= PASSES:
            return new | {"stage": "done", "beta": best.tolist(), "reason": new["reason"] or f"stopped after {PASSES} passes"}
        return new | {"beta": beta.tolist()}

    def long(self, n: int, gamma: np.ndarray) -> list[float]:
        """Coefficients of the long autoregression; its order grows with the rows up to that of the model."""
        m = self.spec.long_ar
        order = min(m, max(2 * max(self.spec.ma_lags), math.ceil(10 * math.log10(max(n, 1)))), n // 3)
        if order < 1 or not np.isfinite(gamma).all() or gamma[0] <= 0:
            return []
        steps = np.arange(order)
        return np.linalg.lstsq(gamma[np.abs(steps[:, None] - steps[None, :])], gamma[1 : order + 1], rcond=None)[0].tolist()

    def model(self, state: dict, mean: float) -> tuple | None:
        """What :data:`_MODEL` names, the polynomials multiplied out."""
        if state.get("beta") is None:
            return None
        phi, far_phi, theta, far_theta, rest = self.parts(state["beta"]) if not self.linear else (None,) * 5
        if self.linear:
            beta = np.array(state["beta"])
            ar, ma, rest = beta[: len(self.spec.ar_lags)], np.zeros(0), beta[len(self.spec.ar_lags) :]
            phi, far_phi, theta, far_theta = (ar, [], [], []) if self.p else ([], ar, [], [])
        else:
            ar = -_polynomial(-phi, -far_phi, self.s)[self.spec.ar_lags] if self.spec.ar_lags else np.zeros(0)
            ma = _polynomial(theta, far_theta, self.s)[self.spec.ma_lags] if self.spec.ma_lags else np.zeros(0)
        exog, one = rest[: len(self.spec.exog)], rest[len(self.spec.exog) :]
        const = (mean * (1 - float(np.sum(ar))) if self.spec.with_const else 0.0) + float(np.sum(one))
        sigma2 = max(state["sse"] / state["n"], 0.0)
        lists = [list(map(float, x)) for x in (ar, ma, exog, phi, far_phi, theta, far_theta)]
        ar, ma, exog, *own = lists
        return (const, self.spec.ar_lags, ar, self.spec.ma_lags, ma, exog, sigma2, state["n"], state["reason"], *own)


# --- fits of a panel -----------------------------------------------------------


def packed_series(
    df: DataFrame,
    specs: Sequence[Arima],
    *,
    price: str = "price",
    key: str = "symbol",
    ts: str = "ts",
    tie: Sequence[str] = (),
    bucket: str | None = None,
    **layout,
) -> DataFrame:
    """The rows with a price, placed once for all ``specs``: one row per series and block, its values as arrays.

    Columns ``key, _blk, _blocks, _mean, _halo`` (rows that belong to the block before), ``_y``
    and one array per regressor. A block holds a bounded number of rows, a series any number.
    """
    exog = list(dict.fromkeys(c for spec in specs for c in spec.exog))
    known = df.where(F.col(price).isNotNull()).select(
        key, ts, *tie, F.col(price).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x_{c}") for c in exog]
    )

    def derive(per: DataFrame, whole: WindowSpec, _walk: WindowSpec) -> DataFrame:
        mean = F.sum("_s").over(whole) / F.col("_total")
        return per.withColumns({"_mean": mean, "_blocks": F.max("_blk").over(whole) + 1}).drop("_s")

    blocks = series_blocks(
        known,
        key=key,
        ts=ts,
        bucket=bucket,
        lookback=max(spec.lookback for spec in specs),
        aggs={"_s": F.sum("_y")},
        derive=derive,
        **layout,
    )
    rows = block_series(known, key=key, ts=ts, bucket=bucket, blocks=blocks)
    own = ["_y", *(f"_x_{c}" for c in exog)]
    ordered = F.sort_array(F.collect_list(F.struct(ts, *tie, "_halo", *own)))
    packed = rows.groupBy(key, "_blk").agg(
        ordered.alias("_rows"), F.max("_mean").alias("_mean"), F.max("_blocks").alias("_blocks")
    )
    values = [F.col("_rows").getField(c).alias(c) for c in own]  # a field of an array of rows is an array
    halo = F.size(F.filter("_rows", lambda r: r["_halo"])).alias("_halo")
    return materialize(packed.select(key, "_blk", "_blocks", "_mean", halo, *values))


def _block_data(fit: _Fit, row: dict):
    y = np.asarray(row["_y"], float)
    exog = [np.array([np.nan if v is None else v for v in row[f"_x_{c}"]], float) for c in fit.spec.exog]
    return fit.data(y, np.column_stack(exog) if exog else np.zeros((len(y), 0)), row["_mean"], row["_halo"])


def fit_packed(packed: DataFrame, spec: Arima, *, key: str = "symbol") -> DataFrame:
    """Models of all series of :func:`packed_series`.

    A series of one block is fitted where it lies. Others take one pass over all their blocks
    per step: each block yields sums, added up per series, and a small solve per series.
    """
    fit = _Fit(spec)
    columns = [key, "_blk", "_mean", "_halo", "_y", *(f"_x_{c}" for c in spec.exog)]
    kind = packed.schema[key].dataType.simpleString()

    def whole(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                state, data = fit.first(), _block_data(fit, row)
                while state["stage"] != "done":
                    state = fit.advance(state, fit.sums(state, *data))
                found = fit.model(state, row["_mean"])
                out += [(row[key], *found)] if found else []
            yield pd.DataFrame(out, columns=[key, *_MODEL_NAMES])

    single = packed.where(F.col("_blocks") == 1).select(*columns)
    models = single.mapInPandas(whole, f"`{key}` {kind}, {_MODEL}")
    cut = packed.where(F.col("_blocks") > 1).select(*columns)
    if cut.isEmpty():
        return models

    def block_sums(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            sums = [fit.sums(json.loads(row["_state"]), *_block_data(fit, row)).tolist() for row in pdf.to_dict("records")]
            yield pd.DataFrame({key: pdf[key], "_mean": pdf["_mean"], "_state": pdf["_state"], "_v": sums})

    def next_state(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            states = [json.dumps(fit.advance(json.loads(s), np.array(v))) for s, v in zip(pdf["_state"], pdf["_v"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "_mean": pdf["_mean"], "_state": states})

    def finished(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            found = [(k, fit.model(json.loads(s), m)) for k, s, m in zip(pdf[key], pdf["_state"], pdf["_mean"], strict=True)]
            yield pd.DataFrame([(k, *f) for k, f in found if f], columns=[key, *_MODEL_NAMES])

    state = cut.groupBy(key).agg(F.max("_mean").alias("_mean")).withColumn("_state", F.lit(json.dumps(fit.first())))
    while True:
        probe = state.select("_state").first()
        if probe is None:
            return models
        size = len(fit.sums(json.loads(probe[0]), np.zeros(0), np.zeros((0, fit.extra)), np.zeros(0, bool)))
        joined = cut.join(broadcast_if_small(state.select(key, "_state"), keep=True), key)
        parts = joined.mapInPandas(block_sums, f"`{key}` {kind}, _mean double, _state string, _v array<double>")
        total = F.array(*[F.sum(F.get("_v", F.lit(i))) for i in range(size)])
        sums = parts.groupBy(key).agg(F.max("_mean").alias("_mean"), F.max("_state").alias("_state"), total.alias("_v"))
        advanced = materialize(sums.mapInPandas(next_state, f"`{key}` {kind}, _mean double, _state string"))
        done = F.get_json_object("_state", "$.stage") == "done"
        models = models.union(advanced.where(done).mapInPandas(finished, f"`{key}` {kind}, {_MODEL}"))
        state = advanced.where(~done)


def fit_arima(df: DataFrame, spec: Arima = MODELS["arima"], *, key: str = "symbol", **options) -> DataFrame:
    """One model row per series; ``reason`` says why a series has none, or what to be wary of.

    A series has no model only if it is too short to hold one row with all its lags. ``ar``
    and ``ma`` are the multiplied-out polynomials; ``phi``, ``season_phi``, ``theta`` and
    ``season_theta`` their factors, which are the parameters fitted.
    """
    return _with_every_series(df, fit_packed(packed_series(df, [spec], key=key, **options), spec, key=key), key)


def _with_every_series(df: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    joined = df.select(key).distinct().join(fitted, key, "left")
    return joined.withColumns(
        {"n": F.coalesce("n", F.lit(0)), "reason": F.when(F.col("n").isNull(), "too few rows").otherwise(F.col("reason"))}
    )


def fit_ar(df: DataFrame, p: int = 5, d: int = 1, **options) -> DataFrame:
    return fit_arima(df, Arima((p, d, 0)), **options)


def fit_arma(df: DataFrame, p: int = 1, d: int = 1, q: int = 1, **options) -> DataFrame:
    return fit_arima(df, Arima((p, d, q)), **options)


def fit_sarima(
    df: DataFrame, order=(1, 1, 1), seasonal=(1, 1, 1, 12), exog: Sequence[str] = (), **options
) -> DataFrame:
    return fit_arima(df, Arima(tuple(order), tuple(seasonal), tuple(exog)), **options)


def _short(x, lags: Sequence[int], differences: int):
    """A model for a series shorter than its lags: fewer of them, on first differences if any are asked for."""
    differenced = differences > 0 and len(x) > 1
    z = np.diff(x) if differenced else np.asarray(x) - np.mean(x)
    p = min(max([*lags, 0]), max(len(z) - 1, 0) // 2)
    rows = np.column_stack([z[p - k : len(z) - k] for k in range(1, p + 1)]) if p else np.zeros((len(z), 0))
    beta = np.linalg.lstsq(rows, z[p:], rcond=None)[0] if p else np.zeros(0)
    rest = z[p:] - rows @ beta
    const = 0.0 if differenced else float(np.mean(x) * (1 - beta.sum()))
    model = {"const": const, "ar_lags": list(range(1, p + 1)), "ar": beta.tolist(), "ma_lags": [], "ma": []}
    model["sigma2"] = float(np.mean(rest**2)) if len(rest) else 0.0
    return model, [1.0, -1.0] if differenced else [1.0], f"short series: {p} lags"


def _project(x, model, diff, steps: int, z: float, exog=None):
    """Mean path and half-widths from the last values of one series.

    ``exog`` has the regressors' values for these rows and, below them, the steps to come;
    they are differenced as the series is. A step without them, and all after it, is NaN.
    """
    ar = dict(zip(model["ar_lags"], model["ar"], strict=True))
    ma = dict(zip(model["ma_lags"], model["ma"], strict=True))
    const = model["const"] or 0.0
    gap = len(diff) - 1
    x = list(x)
    w = [sum(c * x[t - k] for k, c in enumerate(diff) if c) for t in range(gap, len(x))]
    pull = np.zeros(len(w) + steps)
    if exog is not None and len(model["exog"]):
        lagged = [c * exog[gap - k : len(exog) - k] for k, c in enumerate(diff) if c]
        pull = np.sum(lagged, axis=0) @ np.asarray(model["exog"], float)
        pull[: len(w)] = np.nan_to_num(pull[: len(w)])  # an unknown past regressor pulls nowhere
    shocks = []
    burn = max([*ar, 0])
    for t in range(len(w)):
        if t < burn:
            shocks.append(0.0)
            continue
        level = const + pull[t] + sum(a * w[t - k] for k, a in ar.items())
        level += sum(b * shocks[t - k] for k, b in ma.items() if t >= k)
        shocks.append(w[t] - level)
    means = []
    for h in range(steps):
        level = const + pull[len(w)] + sum(a * w[-k] for k, a in ar.items() if k <= len(w))
        level += sum(b * shocks[-k] for k, b in ma.items() if k <= len(shocks))
        w.append(level)
        shocks.append(0.0)
        x.append(level - sum(c * x[len(x) - k] for k, c in enumerate(diff) if k and c))
        means.append(x[-1])
    # Response of the level to one shock, from the full recursion.
    full = np.zeros(max([*ar, 0]) + 1)
    full[0] = 1.0
    for k, a in ar.items():
        full[k] -= a
    full = np.convolve(full, diff)
    psi = [1.0]
    for h in range(1, steps):
        value = ma.get(h, 0.0)
        value -= sum(full[k] * psi[h - k] for k in range(1, min(h, len(full) - 1) + 1))
        psi.append(value)
    half = z * np.sqrt(model["sigma2"] * np.cumsum(np.square(psi)))
    return means, half.tolist()


def _coming(future: DataFrame, last: DataFrame, exog: Sequence[str], steps: int, key: str, ts: str) -> DataFrame:
    """Per series the regressors of the ``steps`` days after its last one, as a map from step to values.

    Of several rows of a day the last one counts; days without a row are not in the map.
    """
    step = F.datediff(F.col(ts).cast("date"), F.col("_last"))
    rows = future.join(last.select(key, "_last"), key).withColumn("_step", step)
    rows = rows.where(F.col("_step").between(1, steps))
    values = F.array(*[F.col(c).cast("double") for c in exog])
    per = rows.groupBy(key, "_step").agg(F.max_by(values, ts).alias("_e"))
    return per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_step", "_e"))).alias("_future"))


def forecast(
    models: DataFrame,
    history: DataFrame,
    spec: Arima,
    steps: int = 7,
    level: float = 0.95,
    *,
    future: DataFrame | None = None,
    price: str = "price",
    key: str = "symbol",
    ts: str = "ts",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Mean and interval for the next days of every series: ``(symbol, step, ts, mean, lo, hi, reason)``.

    Only the last rows of each series are gathered: as many as the model's memory spans,
    a fixed number. A series too short for a model is projected with as many lags as it
    holds, and ``reason`` says so; one without prices gives NULLs.

    A model with further regressors needs their values for the days to come: ``future`` has
    ``key, ts`` and those columns. They are differenced together with the end of the history
    and carried through the steps. From the first day that lacks one on, the mean is NULL
    and ``reason`` says so.
    """
    if spec.exog and future is None:
        raise ValueError(f"the forecast needs future values of {', '.join(spec.exog)}")
    diff = spec.differencing
    rows, wanted, differences = spec.tail, spec.ar_lags, len(spec.differencing) - 1
    known = history.where(F.col(price).isNotNull())
    tail = row_tail(known.select(key, ts, *tie, price, *spec.exog), rows, key=key, ts=ts, tie=tie)
    values = [F.col(price).cast("double").alias("_x"), *[F.col(c).cast("double").alias(f"_x_{c}") for c in spec.exog]]
    series = F.sort_array(F.collect_list(F.struct(ts, *tie, *values)))
    last = tail.groupBy(key).agg(F.max(F.col(ts).cast("date")).alias("_last"), series.alias("_s"))
    arrays = [F.col("_s").getField(c).alias(c) for c in ("_x", *(f"_x_{c}" for c in spec.exog))]
    last = last.select(key, "_last", *arrays)
    joined = models.drop("n").join(last, key, "left")
    if spec.exog:
        joined = joined.join(_coming(future, last, spec.exog, steps, key, ts), key, "left")
    z = NormalDist().inv_cdf(0.5 + level / 2)

    def regressors(row: dict) -> np.ndarray | None:
        if not spec.exog:
            return None
        past = np.column_stack([np.array([np.nan if v is None else v for v in row[f"_x_{c}"]], float) for c in spec.exog])
        coming, found = np.full((steps, len(spec.exog)), np.nan), row["_future"]
        for step, values in (found.items() if isinstance(found, dict) else found if isinstance(found, list) else ()):
            coming[int(step) - 1] = [np.nan if v is None else v for v in values]
        return np.concatenate([past, coming])

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out = []
            for model in pdf.to_dict("records"):
                x, reason, poly, means = model["_x"], model["reason"], diff, None
                if x is not None and len(x):
                    exog = regressors(model)
                    if model["ar"] is None or len(x) < len(diff) + max([*model["ar_lags"], 1]):
                        short, poly, reason = _short(x, wanted, differences)
                        model |= short
                        exog = None
                    means, half = _project(x, model, poly, steps, z, exog)
                    gone = "a regressor of the day is missing" if exog is not None else "no finite forecast"
                for h in range(steps):
                    if means is not None and np.isfinite(means[h]):
                        out.append((model[key], h + 1, model["_last"], means[h], means[h] - half[h], means[h] + half[h], reason))
                    else:
                        out.append((model[key], h + 1, model["_last"], None, None, None, gone if means is not None else reason))
            yield pd.DataFrame(out, columns=[key, "step", "_last", "mean", "lo", "hi", "reason"])

    kind = history.schema[key].dataType.simpleString()
    rows_out = joined.mapInPandas(
        run, f"`{key}` {kind}, step int, _last date, mean double, lo double, hi double, reason string"
    )
    return rows_out.select(key, "step", F.expr("date_add(_last, step)").alias("ts"), "mean", "lo", "hi", "reason")


def _flat_forecast(df: DataFrame, steps: int, price: str, key: str, ts: str) -> DataFrame:
    last = df.groupBy(key).agg(F.max(F.col(ts).cast("date")).alias("_last"))
    flat = naive_forecast(df, key=key, price=price).join(last, key)
    flat = flat.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    reason = F.when(F.col("mean").isNull(), "too few rows").alias("reason")
    return flat.select(key, "step", F.expr("date_add(_last, step)").alias("ts"), "mean", "lo", "hi", reason)


def forecast_all(
    df: DataFrame,
    models: Sequence[str] = ("naive", "arima", "sarima", "sarimax"),
    steps: int = 7,
    level: float = 0.95,
    *,
    price: str = "price",
    key: str = "symbol",
    ts: str = "ts",
    tie: Sequence[str] = (),
    **layout,
) -> DataFrame:
    """All models for all series in one long table.

    The series are placed and packed once for all models. Models with equal orders are
    fitted once and listed under each of their names. Unknown names are an error.
    """
    named: dict[Arima | None, list[str]] = {}
    for name in dict.fromkeys(models):
        named.setdefault(None if name == "naive" else model_named(name), []).append(name)
    specs = [spec for spec in named if spec is not None]
    packed = packed_series(df, specs, price=price, key=key, ts=ts, tie=tie, **layout) if specs else None
    out = None
    for spec, names in named.items():
        if spec is None:
            part = _flat_forecast(df, steps, price, key, ts)
        else:
            fitted = _with_every_series(df, fit_packed(packed, spec, key=key), key)
            part = forecast(fitted, df, spec, steps, level, price=price, key=key, ts=ts, tie=tie)
        part = part.select("*", F.explode(F.lit(names)).alias("model"))
        out = part if out is None else out.unionByName(part)
    return out


def forecast_named(df: DataFrame, name: str, steps: int = 7, level: float = 0.95, **options) -> DataFrame:
    """Fit and forecast with a model chosen by name; unknown names are an error."""
    return forecast_all(df, [name], steps, level, **options)
