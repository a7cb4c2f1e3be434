import subprocess
import sys
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from tickframe.operators import forecast as FC


def simulate(n, ar, ma, seed):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 300)
    x = np.zeros(n + 300)
    for t in range(30, n + 300):
        x[t] = sum(a * x[t - k] for k, a in ar.items()) + e[t] + sum(b * e[t - k] for k, b in ma.items())
    return x[300:]


@pytest.fixture(scope="module")
def panel(spark):
    n = 3000
    made = {
        "ar1": 100 + np.cumsum(simulate(n, {1: 0.6}, {}, 1)),
        "arma": 100 + np.cumsum(simulate(n, {1: 0.6}, {1: 0.4}, 2)),
        "few": np.array([1.0, 2.0, 4.0, 7.0]),
    }
    w = np.cumsum(simulate(n, {1: 0.5, 12: 0.4, 13: -0.2}, {1: 0.3, 12: 0.2, 13: 0.06}, 4))
    x = np.zeros(n)
    for t in range(n):
        x[t] = w[t] + (x[t - 12] if t >= 12 else 0)
    made["seasonal"] = x
    frames = [
        pd.DataFrame({"symbol": s, "d": pd.date_range("2000-01-01", periods=len(v)), "price": v}) for s, v in made.items()
    ]
    df = spark.createDataFrame(pd.concat(frames)).selectExpr("symbol", "cast(d as date) as ts", "price").persist()
    return df, made


def fitted(models, symbol):
    return next(r for r in models.collect() if r.symbol == symbol)


def test_ar_equals_direct_solution(panel):
    df, made = panel
    got = fitted(FC.fit_ar(df, 5, 1, block_rows=400), "ar1")
    z = np.diff(made["ar1"])
    lags = np.column_stack([z[5 - k : len(z) - k] for k in range(1, 6)])
    beta, *_ = np.linalg.lstsq(lags, z[5:], rcond=None)
    assert got.ar == pytest.approx(beta, rel=1e-8)
    assert got.sigma2 == pytest.approx(np.mean((z[5:] - lags @ beta) ** 2), rel=1e-8)
    assert got.n == len(z) - 5
    assert got.ar[0] == pytest.approx(0.6, abs=0.06)


def test_stationary_model_has_a_constant(spark):
    x = 50 + simulate(3000, {1: 0.7}, {}, 9)
    df = spark.createDataFrame(
        pd.DataFrame({"symbol": "a", "d": pd.date_range("2000-01-01", periods=3000), "price": x})
    ).selectExpr("symbol", "cast(d as date) as ts", "price")
    row = FC.fit_ar(df, 1, 0).first()
    assert row.ar[0] == pytest.approx(0.7, abs=0.05)
    assert row.const / (1 - row.ar[0]) == pytest.approx(50, abs=0.3)
    far = FC.forecast(FC.fit_ar(df, 1, 0), df, FC.Arima((1, 0, 0)), steps=40).orderBy("step").collect()[-1]
    assert far["mean"] == pytest.approx(50, abs=0.3)


def test_arma_recovery(panel):
    df, _ = panel
    got = fitted(FC.fit_arma(df, 1, 1, 1, block_rows=300), "arma")
    assert got.ar[0] == pytest.approx(0.6, abs=0.07) and got.ma[0] == pytest.approx(0.4, abs=0.08)
    assert fitted(FC.fit_arma(df, 1, 1, 1), "few").reason in ("few rows", "too few rows")


def test_near_unit_moving_average_is_reached_and_tails_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(5)
    e = rng.normal(size=3001)
    x = 1000 + np.cumsum(e[1:] - 0.98 * e[:-1])
    pdf = pd.DataFrame({"symbol": "a", "d": pd.date_range("2000-01-01", periods=3000), "price": x})
    df = spark.createDataFrame(pdf).selectExpr("symbol", "cast(d as date) as ts", "price")
    spec = FC.Arima((0, 1, 1))
    models = FC.fit_arima(df, spec).persist()
    assert models.first().ma[0] == pytest.approx(-0.98, abs=0.015)
    one = FC.forecast(models, df, spec, steps=1).first()["mean"]
    monkeypatch.setattr(FC, "FELT", 1e-30)
    assert FC.forecast(models, df, spec, steps=1).first()["mean"] == pytest.approx(one, abs=1e-9)
    whole = models.first().asDict()
    means, _ = FC._project(x, whole, spec.differencing, 1, 1.96)
    assert means[0] == pytest.approx(one, abs=1e-6)


def test_exogenous_column_of_levels(spark):
    rng = np.random.default_rng(6)
    drive = 100 + rng.normal(size=1500)
    y = np.zeros(1500)
    for t in range(1500):
        y[t] = 10 + 0.5 * (y[t - 1] if t else 420) + 2 * drive[t] + rng.normal()
    pdf = pd.DataFrame({"symbol": "a", "d": pd.date_range("2000-01-01", periods=1500), "price": y, "x": drive})
    df = spark.createDataFrame(pdf).selectExpr("symbol", "cast(d as date) as ts", "price", "x")
    got = FC.fit_arima(df, FC.Arima((1, 0, 0), exog=("x",)), block_rows=200).first()
    lags = np.column_stack([y[:-1], drive[1:], np.ones(1499)])
    beta, *_ = np.linalg.lstsq(lags, y[1:], rcond=None)
    assert [got.ar[0], got.exog[0], got.const] == pytest.approx(beta.tolist(), rel=1e-6)
    assert got.sigma2 == pytest.approx(np.mean((y[1:] - lags @ beta) ** 2), rel=1e-6)


def seasonal_path(n, phi, far_phi, theta, far_theta, seed, season=12):
    ar = {1: phi, season: far_phi, season + 1: -phi * far_phi}
    w = np.cumsum(simulate(n, ar, {1: theta, season: far_theta, season + 1: theta * far_theta}, seed))
    x = np.zeros(n)
    for t in range(n):
        x[t] = w[t] + (x[t - season] if t >= season else 0)
    return x


def daily(spark, made):
    frames = [pd.DataFrame({"symbol": s, "d": pd.date_range("1970-01-01", periods=len(v)), "price": v}) for s, v in made.items()]
    return spark.createDataFrame(pd.concat(frames)).selectExpr("symbol", "cast(d as date) as ts", "price")


def test_seasonal_recovery(spark):
    """The four factors of the multiplicative model, not the lags they multiply out to."""
    # factors that do not nearly cancel, so that their standard errors are below 0.01
    truth = {"a": (0.5, 0.4, 0.3, 0.2), "b": (-0.3, 0.3, -0.4, 0.5), "c": (0.7, -0.2, 0.4, -0.5)}
    df = daily(spark, {s: seasonal_path(40_000, *v, 40 + i) for i, (s, v) in enumerate(truth.items())})
    for row in FC.fit_sarima(df).collect():
        phi, far_phi, theta, far_theta = truth[row.symbol]
        got = [*row.phi, *row.season_phi, *row.theta, *row.season_theta]
        assert got == pytest.approx([phi, far_phi, theta, far_theta], abs=0.03)
        assert row.ar_lags == [1, 12, 13] and row.ma_lags == [1, 12, 13] and row.reason is None
        assert row.ar == pytest.approx([got[0], got[1], -got[0] * got[1]]) and row.ma[2] == pytest.approx(got[2] * got[3])
        assert row.sigma2 == pytest.approx(1, abs=0.05)


@pytest.mark.parametrize("spec", [FC.Arima((1, 1, 1), (1, 1, 1, 12)), FC.Arima((2, 0, 2)), FC.Arima((1, 0, 0), (1, 0, 0, 7))])
def test_cuts_do_not_matter(spark, spec):
    df = daily(spark, {"a": 50 + simulate(6000, {1: 0.5, 2: 0.2}, {1: 0.4, 2: 0.3}, 11), "b": seasonal_path(5000, 0.4, 0.3, 0.2, 0.1, 12)})
    whole = {r.symbol: r for r in FC.fit_arima(df, spec).collect()}
    cut = {r.symbol: r for r in FC.fit_arima(df, spec, block_rows=900).collect()}
    for s, row in whole.items():
        assert cut[s].n == row.n and cut[s].reason == row.reason
        for name in ("ar", "ma", "phi", "theta", "season_theta"):
            assert getattr(cut[s], name) == pytest.approx(getattr(row, name), abs=1e-4)
        assert cut[s].sigma2 == pytest.approx(row.sigma2, rel=1e-5)


def test_slopes_are_derivatives():
    rng = np.random.default_rng(13)
    fit = FC._Fit(FC.Arima((2, 0, 2), (1, 0, 1, 5), exog=("x",)))
    w, e = rng.normal(size=300), np.column_stack([rng.normal(size=300), np.ones(300)])
    beta = np.array([0.5, -0.2, 0.3, 0.4, 0.25, -0.5, 0.7, 0.1])
    *slopes, u = fit.slopes(beta, w, e)
    phi, far, theta, far_theta, rest = fit.parts(beta)
    ar, ma = FC._polynomial(-phi, -far, 5), FC._polynomial(theta, far_theta, 5)
    plain = np.zeros(300)
    for t in range(fit.burn, 300):
        plain[t] = sum(c * w[t - k] for k, c in enumerate(ar)) - e[t] @ rest
        plain[t] -= sum(c * plain[t - k] for k, c in enumerate(ma) if 0 < k <= t)
    assert u == pytest.approx(plain, abs=1e-9)
    for i, slope in enumerate(slopes):
        step = np.zeros(len(beta))
        step[i] = 1e-6
        rise = (fit.slopes(beta + step, w, e)[-1] - fit.slopes(beta - step, w, e)[-1]) / 2e-6
        assert slope[fit.burn :] == pytest.approx(rise[fit.burn :], abs=1e-5)


def test_reflection_keeps_autocovariances():
    def covariances(ma, sigma2):
        poly = np.array([1.0, *ma])
        return [sigma2 * poly[: len(poly) - k] @ poly[k:] for k in range(len(poly))]

    for ma in ([2.5], [0.4], [1.3, 2.2], [-3.0, 2.5, 0.4], [2.0, 0.0]):
        inside, sigma2 = FC.reflected(ma, 1.7)
        assert covariances(inside, sigma2) == pytest.approx(covariances(ma, 1.7))
        assert np.abs(np.roots([1.0, *inside])).max(initial=0) <= 1 + 1e-9


def test_moving_average_outside_the_unit_circle(spark):
    """Shocks weigh more a day later: the fit finds the invertible twin."""
    x = np.cumsum(simulate(12_000, {}, {1: 2.0}, 14))
    row = FC.fit_arima(daily(spark, {"a": x}), FC.Arima((0, 1, 1))).first()
    assert row.theta == pytest.approx([0.5], abs=0.03) and row.sigma2 == pytest.approx(4, abs=0.2)


def test_exogenous_column(spark):
    rng = np.random.default_rng(8)
    drive = np.cumsum(rng.normal(size=1500))
    price = 3 * drive + np.cumsum(simulate(1500, {1: 0.3}, {}, 3) * 0.1)
    pdf = pd.DataFrame({"symbol": "a", "d": pd.date_range("2000-01-01", periods=1500), "price": price, "x": drive})
    df = spark.createDataFrame(pdf).selectExpr("symbol", "cast(d as date) as ts", "price", "x")
    spec = FC.Arima((1, 1, 0), exog=("x",))
    models = FC.fit_arima(df, spec)
    assert models.first().exog[0] == pytest.approx(3, abs=0.1)
    with pytest.raises(ValueError):
        FC.forecast(models, df, spec)
    model = models.first()
    coming = [(k, 100.0 + k * k) for k in range(1, 6)]  # two days short of a week
    first = date(2000, 1, 1)
    days = [("a", first + timedelta(days=1499 + k), v) for k, v in coming]
    days += [("a", first - timedelta(days=9), 5.0), ("other", first + timedelta(days=1501), 5.0)]
    future = spark.createDataFrame(days, "symbol string, ts date, x double")
    rows = FC.forecast(models, df, spec, future=future).orderBy("step").collect()
    y, z, before, want = price[-1], price[-1] - price[-2], drive[-1], []
    for _, v in coming:
        z = model.ar[0] * z + model.exog[0] * (v - before)
        y, before = y + z, v
        want.append(y)
    assert [r["mean"] for r in rows[:5]] == pytest.approx(want)
    assert all(r["mean"] is None and r.lo is None and "missing" in r.reason for r in rows[5:]) and len(rows) == 7


def test_regressors_in_a_seasonal_model(spark):
    """Levels driven by a known day of the week, with moving average: the effect is found and carried on."""
    n = 4000
    weekend = (np.arange(n + 7) % 7 >= 5).astype(float)
    noise, y = simulate(n + 7, {}, {1: 0.4}, 15), np.zeros(n + 7)
    for t in range(1, n + 7):
        y[t] = 20 + 0.6 * y[t - 1] + 8 * weekend[t] + noise[t]
    pdf = pd.DataFrame({"symbol": "a", "d": pd.date_range("2000-01-01", periods=n + 7), "price": y, "x": weekend})
    both = spark.createDataFrame(pdf).selectExpr("symbol", "cast(d as date) as ts", "price", "x", "row_number() over (order by d) as i")
    df, future = both.where(f"i <= {n}").drop("i"), both.where(f"i > {n}").select("symbol", "ts", "x")
    spec = FC.Arima((1, 0, 1), exog=("x",))
    models = FC.fit_arima(df, spec, block_rows=1000).persist()
    row = models.first()
    assert row.exog == pytest.approx([8], abs=0.3) and row.ar == pytest.approx([0.6], abs=0.04) and row.ma == pytest.approx([0.4], abs=0.05)
    rows = FC.forecast(models, df, spec, future=future).orderBy("step").collect()
    assert max(abs(r["mean"] - v) for r, v in zip(rows, y[n:], strict=True)) < 6
    assert all(r.lo <= v <= r.hi or abs(r["mean"] - v) < 4 for r, v in zip(rows, y[n:], strict=True))


def test_six_points_are_projected(series):
    df = series({"a": [100, 110, 105, 120, 125, 130], "b": [5.0], "c": [None, None]}, start="2024-07-01")
    for name in ("sarimax", "arima"):
        rows = FC.forecast_named(df, name).orderBy("symbol", "step").collect()
        assert [(r.symbol, r.step) for r in rows] == [(s, h) for s in "abc" for h in range(1, 8)]
        assert all(90 < r["mean"] < 200 and r.lo <= r["mean"] <= r.hi and r.reason for r in rows if r.symbol == "a")
        assert {r["mean"] for r in rows if r.symbol == "b"} == {5.0}
        assert {(r["mean"], r.reason) for r in rows if r.symbol == "c"} == {(None, "too few rows")}
    flat = FC.forecast_named(df.where("symbol = 'a'"), "naive").orderBy("step").collect()
    assert [str(r.ts) for r in flat] == [f"2024-07-{d:02d}" for d in range(7, 14)]
    assert (flat[0]["mean"], flat[0].lo, flat[0].hi) == (115.0, 100.0, 130.0)


def test_straight_line_goes_on(series):
    df = series({"a": [3.0 * i for i in range(40)]})
    spec = FC.Arima((1, 1, 0))
    rows = FC.forecast(FC.fit_arima(df, spec), df, spec).orderBy("step").collect()
    assert [r["mean"] for r in rows] == pytest.approx([117 + 3.0 * h for h in range(1, 8)])
    assert rows[-1].hi - rows[-1].lo == pytest.approx(0, abs=1e-4)


def test_interval_covers(spark):
    paths, frames = {}, []
    for i in range(150):
        x = np.cumsum(simulate(310, {1: 0.5}, {}, 100 + i))
        paths[f"s{i}"] = x[303]
        frames.append(pd.DataFrame({"symbol": f"s{i}", "d": pd.date_range("2020-01-01", periods=301), "price": x[:301]}))
    df = spark.createDataFrame(pd.concat(frames)).selectExpr("symbol", "cast(d as date) as ts", "price")
    spec = FC.Arima((1, 1, 0))
    out = FC.forecast(FC.fit_arima(df, spec), df, spec, steps=3).where("step = 3").collect()
    inside = sum(r.lo <= paths[r.symbol] <= r.hi for r in out)
    assert 0.88 <= inside / len(out) <= 1.0


def test_all_models_long_table(panel):
    df, _ = panel
    out = FC.forecast_all(df.where("symbol in ('ar1', 'few')")).toPandas()
    assert set(out.model) == {"naive", "arima", "sarima", "sarimax"}
    assert len(out) == 2 * 4 * 7
    bad = out[(out.symbol == "few") & (out.model != "naive")]
    assert bad.reason.notna().all() and bad["mean"].notna().all()
    same = out[(out.symbol == "ar1") & out.model.isin(["sarima", "sarimax"])].groupby("step")["mean"].nunique()
    assert (same == 1).all()


def test_all_models_equal_separate_fits(panel):
    df, _ = panel
    df = df.where("symbol in ('ar1', 'seasonal')")
    together = FC.forecast_all(df, ("arima", "sarima"), block_rows=1000).toPandas()
    for name in ("arima", "sarima"):
        alone = FC.forecast_named(df, name).toPandas()
        joined = alone.merge(together[together.model == name], on=["symbol", "step"], suffixes=("", "_"))
        assert len(joined) == len(alone) == 14
        assert joined["mean"].to_numpy() == pytest.approx(joined["mean_"].to_numpy(), rel=1e-5)


def test_unknown_model():
    with pytest.raises(ValueError):
        FC.model_named("prophet")
    with pytest.raises(ValueError):
        FC.forecast_all(None, ("arima", "magic"))


def test_seasonal_differencing_polynomial():
    poly = FC.Arima((1, 1, 1), (1, 1, 1, 12)).differencing
    assert len(poly) == 14
    assert {i: c for i, c in enumerate(poly) if c} == {0: 1.0, 1: -1.0, 12: -1.0, 13: 1.0}


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from tickframe import get_session
from tickframe.operators import forecast as FC

spark = get_session("elsewhere", "local[1]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"})
df = spark.range(60).selectExpr("'a' as symbol", "date_add(date'2024-01-01', cast(id as int)) as ts",
                                "cast(id * id % 17 as double) as price")
print("rows", FC.forecast_all(df, ("arima", "sarima")).where("mean is not null or reason is not null").count())
"""


def test_workers_do_not_need_the_package(tmp_path):
    """As on a cluster: Python workers start without this repository on their path."""
    repo = str(Path(__file__).resolve().parents[1])
    run = subprocess.run(
        [sys.executable, "-c", ELSEWHERE, repo], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "rows 14" in run.stdout, run.stderr[-2000:]
