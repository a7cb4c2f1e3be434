"""Registered queries on price series: bars, indicators, filling, statistics, position splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import indicators as I
from tickframe.operators import stats
from tickframe.operators.bars import coarser_bars, future_calendar, ohlc_bars, ohlcv_period, ohlcv_range
from tickframe.operators.impute import ffill_bfill
from tickframe.operators.splits import time_series_split, time_split
from tickframe.plans.adapters import (
    BRAND_PRICES,
    DAILY,
    PRICES,
    SQL_DAY,
    TICKS,
    brand_prices,
    day,
    prices,
    rounded,
    sql_rounded,
    table,
    ticks,
)
from tickframe.plans.registry import query
from tickframe.session import work_path
from tickframe.sources.readers import scan_points_since, scan_points_windows
from tickframe.sources.writers import read_points, write_points

_OHLC = ("open", "high", "low", "close")
_ROWS = "symbol, " + SQL_DAY


def _daily(spark, sf):
    return ohlc_bars(ticks(spark, sf), "1 day")


# --- scans and bars ---------------------------------------------------------


@query(
    "ohlcv_range",
    f"""with {DAILY} select symbol, ts, open, high, low, close, ticks from bars
    where symbol = 'click' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'""",
)
def ohlcv_range_query(spark, sf):
    return ohlcv_range(_daily(spark, sf), "click", "2024-01-05", "2024-01-20").drop("volume")


@query(
    "ohlcv_period",
    """select o_orderpriority as symbol, date_trunc('day', o_orderdate) as ts,
    min(o_totalprice) as low, max(o_totalprice) as high, count(*) as ticks
    from orders where o_orderdate >= timestamp '2001-02-01' and o_orderpriority in ('1-URGENT', '5-LOW')
    group by 1, 2""",
)
def ohlcv_period_query(spark, sf):
    """Daily bars of two listed symbols over the six months before 2001-08-01."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price")
    )
    listed = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("6-NONE",)], "symbol string")
    bars = ohlc_bars(ohlcv_period(orders, listed, "6mo", "2001-08-01"))
    return bars.select("symbol", "ts", "low", "high", "ticks")


@query(
    "ohlc_bars",
    f"""with {TICKS}, hourly as (select symbol, date_trunc('hour', ts) as ts, arg_min(price, ts) as open,
        max(price) as high, min(price) as low, arg_max(price, ts) as close, sum(price) as volume, count(*) as ticks
        from ticks group by 1, 2),
    daily as (select symbol, date_trunc('day', ts) as ts, arg_min(open, ts) as open, max(high) as high,
        min(low) as low, arg_max(close, ts) as close, sum(volume) as volume, cast(sum(ticks) as bigint) as ticks
        from hourly group by 1, 2)
    select '1 hour' as bar, symbol, ts, open, high, low, close, round(volume, 4) as volume, ticks from hourly
    union all
    select '1 day', symbol, ts, open, high, low, close, round(volume, 4), ticks from daily""",
)
def ohlc_bars_query(spark, sf):
    """Hourly bars from ticks and daily bars from the hourly ones."""
    hourly = ohlc_bars(ticks(spark, sf), "1 hour", volume="price")
    cols = ["symbol", "ts", *_OHLC, *rounded(4, "volume"), "ticks"]
    daily = coarser_bars(hourly, "1 day")
    return hourly.select(F.lit("1 hour").alias("bar"), *cols).union(daily.select(F.lit("1 day").alias("bar"), *cols))


@query(
    "future_calendar",
    f"""with {PRICES}, last as (select symbol, max(ts) as ts from prices group by 1),
    steps as (select cast(unnest(range(1, 8)) as integer) as step)
    select symbol, step, strftime(ts + step, '%Y-%m-%d') as ts from last, steps""",
)
def future_calendar_query(spark, sf):
    return future_calendar(prices(spark, sf), 7).select("symbol", "step", day())


@query(
    "scan_points_since",
    f"""with {TICKS} select symbol as measurement, ts as time, price as value from ticks
    where symbol = 'purchase' and ts >= timestamp '2024-01-31' - interval 7 day""",
)
def scan_points_since_query(spark, sf):
    points = ticks(spark, sf).select(
        F.col("symbol").alias("measurement"), F.col("ts").alias("time"), F.col("price").alias("value")
    )
    return scan_points_since(points, "purchase", 7, as_of="2024-01-31")


def _stored_points(spark, sf):
    """All ticks as points in a store laid out by measurement and day."""
    path = work_path(spark, "points")
    renamed = {"symbol": "measurement", "ts": "time", "price": "value"}
    write_points(ticks(spark, sf).withColumnsRenamed(renamed).select(*renamed.values()), path)
    return read_points(spark, path)


@query(
    "scan_points_stored",
    f"""with {TICKS} select symbol as measurement, ts as time, price as value from ticks
    where symbol = 'purchase' and ts >= timestamp '2024-01-31' - interval 7 day""",
)
def scan_points_stored_query(spark, sf):
    """The same days from a store, of which only their folders are read."""
    return scan_points_since(_stored_points(spark, sf), "purchase", 7, as_of="2024-01-31").drop("date")


@query(
    "scan_points_windows",
    f"""with {TICKS}, peaks as (select symbol, arg_max(ts, (price, -epoch_us(ts))) as peak from ticks group by 1)
    select symbol as measurement, peak, count(*) as n, round(avg(price), 6) as mean from ticks join peaks using (symbol)
    where ts >= peak - interval 12 hour and ts < peak + interval 12 hour group by 1, 2""",
)
def scan_points_windows_query(spark, sf):
    """What happened half a day around each symbol's highest price; the windows are a table."""
    points = _stored_points(spark, sf)
    first = F.max_by("time", F.struct("value", -F.unix_micros(F.col("time").cast("timestamp"))))
    peaks = points.groupBy("measurement").agg(first.alias("peak"))
    half = F.expr("INTERVAL 12 HOURS")
    windows = peaks.select("measurement", "peak", (F.col("peak") - half).alias("start"), (F.col("peak") + half).alias("stop"))
    near = scan_points_windows(points, windows)
    return near.groupBy("measurement", "peak").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# --- indicators -------------------------------------------------------------

_RET = "price / lag(price) over (partition by symbol order by ts) - 1"


@query("pct_change", f"with {PRICES} select {_ROWS}, round({_RET}, 6) as ret from prices")
def pct_change(spark, sf):
    return I.returns(prices(spark, sf), log=False).select("symbol", day(), *rounded(6, "ret"))


@query("log_returns", f"with {PRICES} select {_ROWS}, round(ln(1 + ({_RET})), 6) as log_ret from prices")
def log_returns(spark, sf):
    return I.returns(prices(spark, sf)).select("symbol", day(), *rounded(6, "log_ret"))


def _guarded(value: str, column: str = "price") -> str:
    return f"case when count({column}) over w = 20 then {value} end"


_W20 = "window w as (partition by symbol order by ts rows between 19 preceding and current row)"


@query("sma", f"with {PRICES} select {_ROWS}, round({_guarded('avg(price) over w')}, 6) as sma from prices {_W20}")
def sma(spark, sf):
    return I.sma(prices(spark, sf)).select("symbol", day(), *rounded(6, "sma"))


@query(
    "rolling_std",
    f"with {PRICES} select {_ROWS}, round({_guarded('stddev_samp(price) over w')}, 4) as std_dev from prices {_W20}",
)
def rolling_std(spark, sf):
    return I.rolling_std(prices(spark, sf)).select("symbol", day(), *rounded(4, "std_dev"))


@query(
    "bollinger",
    f"""with {DAILY}, b as (select symbol, ts, close, {_guarded('avg(close) over w', 'close')} as sma,
        {_guarded('stddev_samp(close) over w', 'close')} as dev from bars {_W20})
    select symbol, ts, close, round(sma, 4) as sma, round(sma + 2 * dev, 4) as upper_band,
        round(sma - 2 * dev, 4) as lower_band from b""",
)
def bollinger(spark, sf):
    """Daily bars from ticks and their 20-day bands."""
    bands = I.bollinger(_daily(spark, sf))
    return bands.select("symbol", "ts", "close", *rounded(4, "sma", "upper_band", "lower_band"))


@query(
    "row_tail",
    f"""with {PRICES} select {_ROWS}, price from prices
    qualify row_number() over (partition by symbol order by ts desc) <= 100""",
)
def row_tail(spark, sf):
    return I.row_tail(prices(spark, sf), 100).select("symbol", day(), "price")


@query(
    "ffill_bfill",
    f"""with {PRICES}, ends as (select symbol, min(ts) as a, max(ts) as b from prices group by 1),
    calendar as (select symbol, cast(unnest(generate_series(a - interval 3 day, b + interval 3 day,
        interval 1 day)) as date) as ts from ends),
    gaps as (select c.symbol, c.ts, p.price from calendar c left join prices p on c.symbol = p.symbol and c.ts = p.ts)
    select {_ROWS}, coalesce(last_value(price ignore nulls) over (partition by symbol order by ts
        rows between unbounded preceding and current row), first_value(price ignore nulls) over (
        partition by symbol order by ts rows between current row and unbounded following)) as price from gaps""",
)
def ffill_bfill_query(spark, sf):
    """Every calendar day from three days before the first price to three after the last."""
    known = prices(spark, sf)
    ends = known.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = F.explode(F.sequence(F.date_sub("a", 3), F.date_add("b", 3))).alias("ts")
    gaps = ends.select("symbol", days).join(known, ["symbol", "ts"], "left")
    return ffill_bfill(gaps, ["price"]).select("symbol", day(), "price")


def _fold(alpha: str, values: str) -> str:
    """Exponential average by folding the ordered list of values up to each row."""
    return f"list_reduce({values}, lambda a, x: (1 - {alpha}) * a + {alpha} * x)"


_UPTO = "over (partition by symbol order by ts rows between unbounded preceding and current row)"


@query(
    "ema",
    f"with {PRICES} select {_ROWS}, round({_fold('(2.0e0 / 11)', f'list(price) {_UPTO}')}, 4) as ema from prices",
)
def ema(spark, sf):
    return I.ema(prices(spark, sf), 10).select("symbol", day(), *rounded(4, "ema"))


_GAINS = f"""d as (select symbol, ts, price - lag(price) over (partition by symbol order by ts) as d from prices),
    g as (select symbol, ts, d, case when d is not null then greatest(d, 0) end as gain,
        case when d is not null then greatest(-d, 0) end as loss from d)"""


@query(
    "rsi",
    f"""with {PRICES}, {_GAINS},
    s as (select symbol, ts, case when count(d) over w = 14 then avg(gain) over w end as up,
        case when count(d) over w = 14 then avg(loss) over w end as down from g
        window w as (partition by symbol order by ts rows between 13 preceding and current row)),
    v as (select symbol, ts, {_fold('(1.0e0 / 14)', f'list(gain) {_UPTO}')} as up,
        {_fold('(1.0e0 / 14)', f'list(loss) {_UPTO}')} as down from g where d is not null)
    select s.symbol, strftime(s.ts, '%Y-%m-%d') as ts,
        round(case when s.down = 0 then 100 else 100 - 100 / (1 + s.up / nullif(s.down, 0)) end, 4) as rsi_sma,
        round(case when v.down = 0 then 100 else 100 - 100 / (1 + v.up / nullif(v.down, 0)) end, 4) as rsi_wilder
    from s left join v on s.symbol = v.symbol and s.ts = v.ts""",
)
def rsi(spark, sf):
    """Both ways of averaging gains and losses."""
    both = I.indicators(
        prices(spark, sf), I.rsi_step(method="sma", out="rsi_sma"), I.rsi_step(method="wilder", out="rsi_wilder")
    )
    return both.select("symbol", day(), *rounded(4, "rsi_sma", "rsi_wilder"))


@query(
    "macd",
    f"""with {PRICES}, m as (select symbol, ts, {_fold('(2.0e0 / 13)', f'list(price) {_UPTO}')}
        - {_fold('(2.0e0 / 27)', f'list(price) {_UPTO}')} as macd from prices)
    select {_ROWS}, round(macd, 4) as macd, round({_fold('(2.0e0 / 10)', f'list(macd) {_UPTO}')}, 4) as macd_signal
    from m""",
)
def macd(spark, sf):
    return I.macd(prices(spark, sf)).select("symbol", day(), *rounded(4, "macd", "macd_signal"))


@query(
    "difference",
    f"""with {PRICES} select {_ROWS}, round(price - lag(price, 1) over w, 4) as diff_1,
    round(price - lag(price, 12) over w, 4) as diff_12 from prices window w as (partition by symbol order by ts)""",
)
def difference(spark, sf):
    return I.difference(prices(spark, sf), (1, 12)).select("symbol", day(), *rounded(4, "diff_1", "diff_12"))


@query(
    "lag_features",
    f"""with {PRICES} select {_ROWS}, {', '.join(
        f'case when lag(price, 5) over w is not null then lag(price, {k}) over w end as lag_{k}' for k in range(1, 6))}
    from prices window w as (partition by symbol order by ts)""",
)
def lag_features(spark, sf):
    lagged = I.lag_features(prices(spark, sf), 5)
    return lagged.select("symbol", day(), *[F.get("lags", F.lit(k - 1)).alias(f"lag_{k}") for k in range(1, 6)])


# --- statistics -------------------------------------------------------------


@query(
    "naive_forecast",
    f"""with {PRICES} select symbol, round(avg(price), 4) as mean, min(price) as lo, max(price) as hi
    from prices group by 1""",
)
def naive_forecast(spark, sf):
    return stats.naive_forecast(prices(spark, sf)).select("symbol", *rounded(4, "mean"), "lo", "hi")


@query(
    "acf",
    f"""with {PRICES}, c as (select symbol, ts, price - avg(price) over (partition by symbol) as x from prices),
    l as (select symbol, x, {', '.join(f'lag(x, {k}) over w as l{k}' for k in range(1, 11))} from c
        window w as (partition by symbol order by ts)),
    {', '.join(f's{k} as (select symbol, {k} as lag, sum(x * l{k}) / sum(x * x) as acf from l group by 1)'
               for k in range(1, 11))}
    select symbol, lag, round(acf, 6) as acf from ({' union all '.join(
        f'select * from s{k}' for k in range(1, 11))}) t""",
)
def acf(spark, sf):
    return stats.acf(prices(spark, sf), 10).select("symbol", "lag", *rounded(6, "acf"))


@query(
    "pacf",
    f"""with {PRICES}, c as (select symbol, ts, price - avg(price) over (partition by symbol) as x from prices),
    l as (select symbol, x, lag(x, 1) over w as l1, lag(x, 2) over w as l2, lag(x, 3) over w as l3 from c
        window w as (partition by symbol order by ts)),
    r as (select symbol, sum(x * l1) / sum(x * x) as r1, sum(x * l2) / sum(x * x) as r2, sum(x * l3) / sum(x * x) as r3
        from l group by 1),
    two as (select *, (r2 - r1 * r1) / (1 - r1 * r1) as p2 from r),
    three as (select *, (r3 - r1 * (1 - p2) * r2 - p2 * r1) / (1 - r1 * (1 - p2) * r1 - p2 * r2) as p3 from two)
    select symbol, cast(lag as integer) as lag, round(pacf, 6) as pacf from (select symbol, 1 as lag, r1 as pacf from three
        union all select symbol, 2, p2 from three union all select symbol, 3, p3 from three) t""",
)
def pacf(spark, sf):
    return stats.pacf(prices(spark, sf), 3).select("symbol", "lag", *rounded(6, "pacf"))


_ANALYSIS = f"""walked as (select symbol, ts, price, {_RET} as ret,
        max(price) over (partition by symbol order by ts rows between unbounded preceding and current row) as high
        from prices),
    analysis as (select symbol, avg(ret) as mean_return, stddev_samp(ln(1 + ret)) as volatility,
        arg_max(price, ts) / arg_min(price, ts) - 1 as momentum, max(1 - price / high) as max_drawdown, count(*) as n
        from walked group by 1)"""


@query(
    "market_analysis",
    f"""with {BRAND_PRICES}, {_ANALYSIS}
    select symbol, {sql_rounded(6, 'mean_return', 'volatility', 'momentum', 'max_drawdown')}, n from analysis""",
)
def market_analysis(spark, sf):
    out = stats.market_analysis(brand_prices(spark, sf))
    return out.select("symbol", *rounded(6, "mean_return", "volatility", "momentum", "max_drawdown"), "n")


# --- splits along time ------------------------------------------------------


@query(
    "time_split",
    f"""with {PRICES} select {_ROWS}, case when percent_rank() over (partition by symbol order by ts) >= 0.8
    then 'test' else 'train' end as split from prices""",
)
def time_split_query(spark, sf):
    return time_split(prices(spark, sf), 0.2).select("symbol", day(), "split")


@query(
    "time_series_split",
    f"""with {PRICES}, p as (select symbol, ts, row_number() over (partition by symbol order by ts) - 1 as i,
        count(*) over (partition by symbol) as n, count(*) over (partition by symbol) // 6 as t from prices),
    f as (select cast(unnest(range(1, 6)) as integer) as fold),
    r as (select symbol, ts, fold, case when i < n - (6 - fold) * t then 'train'
        when i < n - (5 - fold) * t then 'test' end as role from p, f where t > 0)
    select {_ROWS}, fold, role from r where role is not null""",
)
def time_series_split_query(spark, sf):
    return time_series_split(prices(spark, sf), 5).select("symbol", day(), "fold", "role")
