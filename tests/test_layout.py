import random

import pytest
from conftest import column
from pyspark.sql import functions as F

from tickframe.operators.impute import ffill_bfill
from tickframe.operators.indicators import (
    bollinger,
    bollinger_step,
    difference,
    ema,
    ema_step,
    indicators,
    lag_features,
    macd,
    macd_step,
    returns,
    rsi,
    rsi_step,
    sma,
)
from tickframe.operators.layout import BLOCK_ROWS, block_series, calendar_bucket, pick_bucket, series_position
from tickframe.operators.stats import acf, market_analysis

RANDOM = random.Random(5)


@pytest.fixture(scope="module")
def panel(spark):
    """A long series with uneven gaps and NULLs, a short one, and one of a single row."""
    rows, day = [], 0
    for i in range(700):
        day += RANDOM.choice([1, 1, 1, 2, 5, 60])
        rows.append(("long", day, None if i % 11 == 0 else 100 + 10 * RANDOM.random()))
    rows += [("short", d, 50.0 + d) for d in range(0, 90, 3)]
    rows += [("single", 5, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, d int, price double")
    return df.selectExpr("symbol", "date_add(date'2000-01-01', d) as ts", "price").persist()


OPERATORS = {
    "returns": lambda df, **o: returns(df, **o),
    "sma": lambda df, **o: sma(df, 7, **o),
    "bollinger": lambda df, **o: bollinger(df, 20, price="price", **o),
    "ema": lambda df, **o: ema(df, 10, **o),
    "rsi": lambda df, **o: rsi(df, 14, **o),
    "rsi_sma": lambda df, **o: rsi(df, 14, method="sma", **o),
    "macd": lambda df, **o: macd(df, **o),
    "difference": lambda df, **o: difference(df, (1, 12), **o),
    "lags": lambda df, **o: lag_features(df, 5, **o),
    "fill": lambda df, **o: ffill_bfill(df, ["price"], **o),
    "acf": lambda df, **o: acf(df, 6, **o),
    "analysis": lambda df, **o: market_analysis(df, **o),
    "position": lambda df, **o: series_position(df, **o),
}


def as_rows(df):
    def norm(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return tuple(norm(x) for x in v) if isinstance(v, list) else v

    return sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_cuts_do_not_change_results(panel, name):
    run = OPERATORS[name]
    whole = as_rows(run(panel, block_rows=1_000_000))
    assert as_rows(run(panel.repartition(7, "price"), block_rows=25, bucket="month")) == whole


@pytest.mark.parametrize("name", ["sma", "ema", "fill"])
def test_broadcast_summary_gives_the_same(panel, name):
    run = OPERATORS[name]
    assert as_rows(run(panel, block_rows=40, broadcast_rows=10_000)) == as_rows(run(panel))
    assert as_rows(run(panel, block_rows=40, broadcast_rows=1)) == as_rows(run(panel))


def test_one_symbol_alone_gives_the_same(panel):
    alone = as_rows(macd(panel.where("symbol = 'short'")))
    assert alone == as_rows(macd(panel).where("symbol = 'short'"))


def test_bundle_equals_single_steps(panel):
    both = indicators(
        panel, ema_step(), macd_step(), rsi_step(), bollinger_step(price="price"), block_rows=50, bucket="year"
    )
    for single, cols in ((ema(panel), ["ema"]), (macd(panel), ["macd", "macd_signal"]), (rsi(panel), ["rsi"])):
        assert as_rows(both.select("symbol", "ts", *cols)) == as_rows(single.select("symbol", "ts", *cols))


def test_long_series_is_cut_and_every_row_kept_once(panel):
    rows = block_series(panel, lookback=10, block_rows=50, bucket="month")
    blocks = rows.where("symbol = 'long'").groupBy("_blk").agg(F.count(F.lit(1)).alias("n"))
    assert blocks.count() > 8
    assert blocks.agg(F.max("n")).first()[0] < 200
    assert rows.where("not _halo").count() == panel.count()


def test_long_runs_of_null_are_not_copied_along(spark):
    """400 known prices, 1,200 missing ones, 400 known ones, in blocks of 50 rows."""
    known = "if(id between 400 and 1599, null, 100 + pmod(id * 7919, 13))"
    df = spark.range(2000).selectExpr(
        "'a' as symbol", "date_add(date'2000-01-01', cast(id as int)) as ts", f"cast({known} as double) as price"
    )
    valid = F.col("price").isNotNull()
    rows = block_series(df, block_rows=50, lookback=19, valid=valid, valid_lookback=60)
    assert rows.groupBy("_blk").count().agg(F.max("count")).first()[0] < 50 + 31 + 19 + 31 + 60 + 31
    assert rows.where("_halo and price is null").count() < 40 * (19 + 31)
    both = indicators(df, ema_step(3), bollinger_step(5, price="price"), block_rows=50)
    assert as_rows(both) == as_rows(indicators(df, ema_step(3), bollinger_step(5, price="price"), block_rows=9999))


def test_null_symbols_and_equal_times_survive(spark):
    rows = [(None, "2024-01-01 00:00:00", 1, 1.0), (None, "2024-01-01 00:00:00", 2, 2.0), ("a", "2024-01-01 00:00:00", 1, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, t string, seq int, price double")
    df = df.selectExpr("symbol", "cast(t as timestamp_ntz) as ts", "seq", "price")
    out = returns(df, tie=["seq"], log=False)
    assert sorted((r.symbol or "", r.seq, r.ret) for r in out.collect() if r.ret is not None) == [("", 2, 1.0)]
    assert out.count() == 3


def test_indicator_bundle_plan(panel):
    """Rows are shuffled by symbol and block together, and nothing runs in a single task."""
    plan = indicators(panel, ema_step(), rsi_step(), bollinger_step(price="price"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "SinglePartition" not in physical
    rows_by_block = [line for line in physical.splitlines() if "Exchange hashpartitioning" in line and "_blk" in line]
    assert len(rows_by_block) == 1


def test_pick_bucket(spark):
    ticks = spark.range(4000).selectExpr("'a' as symbol", "timestamp_seconds(id * 30) as ts")
    assert pick_bucket(ticks, max_rows=10_000) == "year"
    assert pick_bucket(ticks, max_rows=3_000) == "day"
    assert pick_bucket(ticks, max_rows=120) == "hour"
    assert pick_bucket(ticks, max_rows=2) == "minute"
    assert pick_bucket(ticks, max_rows=0) == "second"
    dates = spark.range(60).selectExpr("'a' as symbol", "date_add(date'2024-01-01', cast(id as int)) as ts")
    assert pick_bucket(dates, max_rows=31) == "month"


def test_buckets_never_decrease(spark):
    times = spark.range(0, 5000).selectExpr("cast(timestamp_seconds(id * 7919) as timestamp_ntz) as ts")
    for unit in ("year", "month", "day", "hour", "minute", "second"):
        values = column(times.select("ts", calendar_bucket("ts", unit).alias("b")), "b")
        assert values == sorted(values)
    with pytest.raises(ValueError):
        calendar_bucket("ts", "week")


def test_a_heavy_day_is_cut_by_default(spark):
    """300,000 ticks of one symbol within a day are several blocks, none much above the bound."""
    ticks = spark.range(300_000).selectExpr(
        "'a' as symbol", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 0.288) as ts", "cast(id as double) as price"
    )
    sizes = [r["count"] for r in block_series(ticks).groupBy("_blk").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 1.25 * BLOCK_ROWS
