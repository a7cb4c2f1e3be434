import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import column

from tickframe.operators import indicators as I
from tickframe.operators.bars import coarser_bars, date_range, future_calendar, ohlc_bars, ohlcv_period, ohlcv_range
from tickframe.operators.impute import ffill_bfill, fill_zero, minmax_apply, minmax_fit

SIX = [100, 110, 105, 120, 125, 130]


def test_returns_golden(series):
    out = I.returns(series({"a": SIX}))
    simple = column(out, "ret")
    assert simple[0] is None
    assert simple[1:] == pytest.approx([0.1, -1 / 22, 1 / 7, 1 / 24, 0.04])
    assert column(out, "log_ret")[1:] == pytest.approx([math.log(b / a) for a, b in zip(SIX, SIX[1:])])


def test_returns_zero_and_crash(series):
    out = I.returns(series({"a": [10, 0, 5]}))
    assert column(out, "ret", "log_ret") == [(None, None), (-1.0, None), (None, None)]


def test_returns_padding(series):
    df = series({"a": [10, None, 12]})
    assert column(I.returns(df, log=False), "ret") == [None, None, None]
    assert column(I.returns(df, log=False, pad=True), "ret") == pytest.approx([None, 0.0, 0.2])


@pytest.mark.parametrize("n", [19, 20, 21])
def test_full_window_guard(series, n):
    values = [float(i * i % 17) for i in range(n)]
    out = I.rolling_std(I.sma(series({"a": values})))
    s = pd.Series(values)
    for col, want in (("sma", s.rolling(20).mean()), ("std_dev", s.rolling(20).std())):
        got = column(out, col)
        assert [v is None for v in got] == want.isna().tolist()
        assert [v for v in got if v is not None] == pytest.approx(want.dropna().tolist())


def test_constant_series(series):
    df = series({"a": [7.0] * 25})
    bands = I.bollinger(df, price="price")
    assert column(bands, "sma", "upper_band", "lower_band")[-1] == (7.0, 7.0, 7.0)
    assert column(I.ema(df), "ema") == pytest.approx([7.0] * 25)
    assert column(I.rsi(df), "rsi")[1:] == [100.0] * 24
    assert column(I.macd(df), "macd", "macd_signal")[-1] == pytest.approx((0.0, 0.0), abs=1e-12)


def test_all_null(series):
    df = series({"a": [None] * 5})
    for out, cols in (
        (I.returns(df), ["ret", "log_ret"]),
        (I.ema(df), ["ema"]),
        (I.rsi(df), ["rsi"]),
        (I.macd(df), ["macd", "macd_signal"]),
        (I.sma(df, 2), ["sma"]),
        (ffill_bfill(df, ["price"]), ["price"]),
    ):
        rows = out.collect()
        assert len(rows) == 5
        assert all(r[c] is None for r in rows for c in cols)


def _noisy(n):
    r = random.Random(n)
    return [50 + 10 * math.sin(i / 9) + r.random() for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 10, 60])
def test_ema_against_plain_recurrence(series, n):
    values = _noisy(800)
    want = pd.Series(values).ewm(span=n, adjust=False).mean()
    got = column(I.ema(series({"a": values}), n, block_rows=100), "ema")
    assert got == pytest.approx(want.tolist(), rel=1e-12)


def test_ema_skips_null(series):
    values = [1.0, None, 2.0, None, None, 4.0]
    got = column(I.ema(series({"a": values}), 3), "ema")
    assert got == [1.0, None, 1.5, None, None, 2.75]
    with pytest.raises(ValueError):
        I.ema_step(alpha=0.0)


def test_rsi_both_ways(series):
    values = _noisy(300)
    s = pd.Series(values)
    up, down = s.diff().clip(lower=0), (-s.diff()).clip(lower=0)

    def index(f):
        return (100 - 100 / (1 + f(up) / f(down))).tolist()

    plain = column(I.rsi(series({"a": values}), method="sma"), "rsi")
    assert plain[14:] == pytest.approx(index(lambda x: x.rolling(14).mean())[14:])
    assert plain[:14] == [None] * 14
    wilder = column(I.rsi(series({"a": values}), block_rows=64), "rsi")
    assert wilder[1:] == pytest.approx(index(lambda x: x.iloc[1:].ewm(alpha=1 / 14, adjust=False).mean().reindex(x.index))[1:])
    with pytest.raises(ValueError):
        I.rsi_step(method="other")


def test_macd(series):
    values = _noisy(400)
    s = pd.Series(values)
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    out = I.macd(series({"a": values}), block_rows=90)
    assert column(out, "macd") == pytest.approx(line.tolist(), abs=1e-10)
    assert column(out, "macd_signal") == pytest.approx(line.ewm(span=9, adjust=False).mean().tolist(), abs=1e-10)


def test_lags_and_differences(series):
    df = series({"a": SIX})
    lags = column(I.lag_features(df, 2), "lags")
    assert lags == [None, None, [110, 100], [105, 110], [120, 105], [125, 120]]
    assert column(I.difference(df, (1, 3)), "diff_1", "diff_3")[3:] == [(15, 20), (5, 15), (5, 25)]


def test_row_tail(series):
    out = I.row_tail(series({"a": range(10), "b": range(3)}), 4)
    assert sorted((r.symbol, r.price) for r in out.collect()) == [
        *[("a", float(v)) for v in (6, 7, 8, 9)],
        *[("b", float(v)) for v in (0, 1, 2)],
    ]


def test_row_tail_merges_tails_of_many_tasks(series):
    df = series({"a": range(500), "b": range(3)}).repartition(70)
    out = I.row_tail(df, 5)
    assert sorted(r.price for r in out.where("symbol = 'a'").collect()) == [495, 496, 497, 498, 499]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SinglePartition" not in plan


def test_fill_both_ends(series):
    df = series({"a": [None, 1, None, None, 4, None]})
    assert column(ffill_bfill(df, ["price"]), "price") == [1, 1, 1, 1, 4, 4]
    assert column(ffill_bfill(df, ["price"], backward=False), "price") == [None, 1, 1, 1, 4, 4]


def test_fill_zero_takes_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 3.0, 4)], "id int, x double, y int")
    assert [tuple(r) for r in fill_zero(df, ["x", "y"]).orderBy("id").collect()] == [(1, 0.0, 0), (2, 3.0, 4)]


def test_minmax(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, 7.0), (float("nan"), 7.0), (5.0, None)], "x double, y double")
    stats = minmax_fit(df, ["x", "y"])
    assert tuple(stats.first()) == (1.0, 5.0, 7.0, 7.0)
    later = spark.createDataFrame([(9.0, 7.0), (None, 8.0)], "x double, y double")
    assert [tuple(r) for r in minmax_apply(later, stats, ["x", "y"]).collect()] == [(2.0, 0.0), (None, 0.0)]


def _ticks(spark):
    rows = [
        ("a", "2024-01-01 00:10:00", 1, 5.0),
        ("a", "2024-01-01 00:10:00", 2, 6.0),
        ("a", "2024-01-01 00:50:00", 3, 9.0),
        ("a", "2024-01-01 00:50:00", 4, 2.0),
        ("a", "2024-01-01 03:00:00", 5, None),
        ("a", "2024-01-01 03:30:00", 6, 4.0),
        ("b", "2024-01-02 00:00:00", 7, 1.0),
    ]
    df = spark.createDataFrame(rows, "symbol string, t string, id int, price double")
    return df.selectExpr("symbol", "cast(t as timestamp_ntz) as ts", "id", "price")


def test_bars(spark):
    hourly = ohlc_bars(_ticks(spark), "1 hour", tie=["id"], volume="id")
    got = sorted((r.symbol, str(r.ts), r.open, r.high, r.low, r.close, r.volume, r.ticks) for r in hourly.collect())
    assert got == [
        ("a", "2024-01-01 00:00:00", 5.0, 9.0, 2.0, 2.0, 10, 4),
        ("a", "2024-01-01 03:00:00", 4.0, 4.0, 4.0, 4.0, 11, 1),
        ("b", "2024-01-02 00:00:00", 1.0, 1.0, 1.0, 1.0, 7, 1),
    ]
    daily = coarser_bars(hourly, "1 day").where("symbol = 'a'").first()
    assert (daily.open, daily.high, daily.low, daily.close, daily.ticks) == (5.0, 9.0, 2.0, 4.0, 5)
    assert hourly.schema["ts"].dataType.simpleString() == "timestamp_ntz"


def test_bars_aggregate_by_hash_before_the_shuffle(spark):
    plan = ohlc_bars(_ticks(spark), "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_ranges_and_periods(spark, series):
    df = series({"a": range(60), "b": range(60)})
    assert ohlcv_range(df, "a", "2024-01-05", "2024-01-12").count() == 7
    with pytest.raises(ValueError):
        ohlcv_range(df, "a", "", "2024-01-12")
    assert date_range(df, "2024-02-01").count() == 2 * 29
    assert date_range(df, None, "2024-01-03").count() == 4
    listed = spark.createDataFrame([("b",), ("b",), ("zz",)], "symbol string")
    assert ohlcv_period(df, listed, "1mo", "2024-02-29").count() == 32  # from 29 January
    assert ohlcv_period(df, None, "max", "2024-02-29").count() == 120
    assert ohlcv_period(df, None, "10d", "2024-02-29").count() == 22
    with pytest.raises(ValueError):
        ohlcv_period(df, None, "soon", "2024-02-29")


def test_future_calendar(series):
    out = future_calendar(series({"a": SIX}, start="2024-07-01"))
    assert [str(d) for d in column(out, "ts")] == [f"2024-07-{d:02d}" for d in range(7, 14)]


def test_input_order_does_not_matter(series):
    df = series({"a": list(np.arange(100.0) ** 1.5)})
    assert column(I.ema(df.orderBy("price", ascending=False).repartition(5)), "ema") == column(I.ema(df), "ema")
