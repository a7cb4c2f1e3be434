"""Indicators over price series: returns, moving averages, bands, EMA, RSI, MACD, lags.

All of them run in the block layout of :mod:`tickframe.operators.layout`; options
given as ``**layout`` (``key``, ``ts``, ``tie``, ``bucket``, ``block_rows``,
``broadcast_rows``) go there. Each indicator is a :class:`Step`; :func:`indicators`
runs several in one layout, with one shuffle and without reading the input anew
for each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickframe.operators.impute import ffill_bfill
from tickframe.operators.layout import as_list, over_blocks

#: Weight below which an older observation no longer changes a double.
_NEGLIGIBLE = 1e-18
#: Largest scale used inside a run of the exponential average.
_MAX_SCALE = 1e12


@dataclass(frozen=True)
class Step:
    """One indicator: how far it looks back, the column whose NULLs it skips, how it is built.

    ``build`` gets the rows, the block window, and the window's partition and order columns.
    """

    lookback: int
    build: Callable[[DataFrame, WindowSpec, Sequence[str], Sequence[str]], DataFrame]
    skips_null: str | None = None


def indicators(df: DataFrame, *steps: Step, **layout) -> DataFrame:
    """Add the columns of all steps in one block layout."""
    key, ts, tie = layout.get("key", "symbol"), layout.get("ts", "ts"), layout.get("tie", ())
    part, order = [*as_list(key), "_blk"], [ts, *tie]
    valid = None
    for column in {s.skips_null for s in steps if s.skips_null}:
        known = F.col(column).isNotNull()
        valid = known if valid is None else valid & known

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        for step in steps:
            rows = step.build(rows, w, part, order)
        return rows

    by_row = sum(s.lookback for s in steps if not s.skips_null)
    if valid is None:
        return over_blocks(df, build, lookback=by_row, **layout)
    total = sum(s.lookback for s in steps)
    return over_blocks(df, build, lookback=by_row, valid=valid, valid_lookback=total, **layout)


def _full(value: Column, counted: str, n: int, frame: WindowSpec) -> Column:
    return F.when(F.count(counted).over(frame) == n, value)


# --- returns and plain windows ----------------------------------------------


def returns_step(price: str = "price", log: bool = True) -> Step:
    def build(rows, w, part, order):
        rows = rows.withColumn("ret", F.try_divide(F.col(price), F.lag(price).over(w)) - 1)
        return rows.withColumn("log_ret", F.log1p("ret")) if log else rows

    return Step(1, build)


def returns(df: DataFrame, *, price: str = "price", log: bool = True, pad: bool = False, **layout) -> DataFrame:
    """Simple (``ret``) and logarithmic (``log_ret``) change on the previous row.

    A zero or missing previous price gives NULL; so does the logarithm of a -100 %
    return. ``pad`` first carries the last known price over gaps.
    """
    if pad:
        df = ffill_bfill(df, [price], backward=False, **layout)
    return indicators(df, returns_step(price, log), **layout)


def sma_step(n: int = 20, price: str = "price", out: str = "sma") -> Step:
    def build(rows, w, part, order):
        frame = w.rowsBetween(1 - n, 0)
        return rows.withColumn(out, _full(F.avg(price).over(frame), price, n, frame))

    return Step(n - 1, build)


def sma(df: DataFrame, n: int = 20, *, price: str = "price", out: str = "sma", **layout) -> DataFrame:
    """Mean of the last ``n`` rows, NULL until ``n`` values are there."""
    return indicators(df, sma_step(n, price, out), **layout)


def rolling_std_step(n: int = 20, price: str = "price", out: str = "std_dev") -> Step:
    def build(rows, w, part, order):
        frame = w.rowsBetween(1 - n, 0)
        return rows.withColumn(out, _full(F.stddev_samp(price).over(frame), price, n, frame))

    return Step(n - 1, build)


def rolling_std(df: DataFrame, n: int = 20, *, price: str = "price", out: str = "std_dev", **layout) -> DataFrame:
    """Sample standard deviation of the last ``n`` rows, NULL until ``n`` values are there."""
    return indicators(df, rolling_std_step(n, price, out), **layout)


def bollinger_step(n: int = 20, k: float = 2.0, price: str = "close") -> Step:
    def build(rows, w, part, order):
        frame = w.rowsBetween(1 - n, 0)
        mean = _full(F.avg(price).over(frame), price, n, frame)
        dev = _full(F.stddev_samp(price).over(frame), price, n, frame)
        rows = rows.withColumns({"sma": mean, "_dev": dev})
        bands = {
            "upper_band": F.col("sma") + k * F.col("_dev"),
            "lower_band": F.col("sma") - k * F.col("_dev"),
        }
        return rows.withColumns(bands).drop("_dev")

    return Step(n - 1, build)


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, *, price: str = "close", **layout) -> DataFrame:
    """Moving mean and the bands ``k`` sample deviations above and below it."""
    return indicators(df, bollinger_step(n, k, price), **layout)


# --- exponential averages ---------------------------------------------------


def _memory(alpha: float) -> int:
    """Rows after which an observation's weight is negligible."""
    beta = 1.0 - alpha
    return 1 if beta <= 0 else math.ceil(math.log(_NEGLIGIBLE) / math.log(beta)) + 1


def _with_ema(
    rows: DataFrame, specs: dict[str, tuple[str, float]], part: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Add exponential averages ``{out: (column, alpha)}`` inside each block.

    ``e_t = alpha * x_t + beta * e_{t-1}`` with ``e_1 = x_1``, skipping NULLs (the
    frame must be partitioned so that a partition holds only NULLs or none, see
    ``_ok``). Rows are cut into short runs; within a run the average is a running
    sum of ``x * beta**-j`` scaled back by ``beta**j``, and the two runs before it
    enter through their end values. Older runs weigh less than a double resolves.
    """
    place = Window.partitionBy(*part).orderBy(*order)
    rows = rows.withColumn("_i", F.row_number().over(place) - 1)
    temp = ["_i"]
    for out, (x, alpha) in specs.items():
        beta = 1.0 - alpha
        if beta <= 0:
            rows = rows.withColumn(out, F.col(x))
            continue
        size = max(1, math.floor(math.log(_MAX_SCALE) / -math.log(beta)))
        run, j, local, end = (f"_{name}_{out}" for name in ("run", "j", "local", "end"))
        rows = rows.withColumns({run: F.expr(f"_i div {size}"), j: F.col("_i") % size})
        within = Window.partitionBy(*part, run).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        earlier = Window.partitionBy(*part).orderBy(run, "_i").rowsBetween(Window.unboundedPreceding, -1)
        weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        scaled = weight * F.col(x) * F.pow(F.lit(beta), -F.col(j))
        rows = rows.withColumn(local, F.sum(scaled).over(within) * F.pow(F.lit(beta), F.col(j)))
        closes = F.col(j) == size - 1
        one = F.last(F.when(closes, F.col(local)), ignorenulls=True).over(earlier)
        rows = rows.withColumn(end, F.coalesce(one, F.lit(0.0)))
        both = F.col(local) + F.lit(beta**size) * F.col(end)
        carry = F.coalesce(F.last(F.when(closes, both), ignorenulls=True).over(earlier), F.lit(0.0))
        rows = rows.withColumn(
            out, F.when(F.col(x).isNotNull(), F.col(local) + F.pow(F.lit(beta), F.col(j) + 1) * carry)
        )
        temp += [run, j, local, end]
    return rows.drop(*temp)


def _span_alpha(n: int) -> float:
    return 2.0 / (n + 1)


def _skipping_null(price: str, build) -> Callable:
    """Run a build with NULL prices set apart in partitions of their own."""

    def run(rows, w, part, order):
        rows = rows.withColumn("_ok", F.col(price).isNotNull())
        return build(rows, [*part, "_ok"], order).drop("_ok")

    return run


def ema_step(n: int = 10, price: str = "price", alpha: float | None = None, out: str = "ema") -> Step:
    a = _span_alpha(n) if alpha is None else alpha
    if not 0 < a <= 1:
        raise ValueError("alpha must lie in (0, 1]")

    def build(rows, part, order):
        return _with_ema(rows, {out: (price, a)}, part, order)

    return Step(_memory(a), _skipping_null(price, build), price)


def ema(
    df: DataFrame, n: int = 10, *, price: str = "price", alpha: float | None = None, out: str = "ema", **layout
) -> DataFrame:
    """Exponential average with ``alpha = 2 / (n + 1)``; NULL prices are skipped."""
    return indicators(df, ema_step(n, price, alpha, out), **layout)


def rsi_step(n: int = 14, method: str = "wilder", price: str = "price", out: str = "rsi") -> Step:
    if method not in ("wilder", "sma"):
        raise ValueError(f"unknown method {method!r}")

    def build(rows, part, order):
        w = Window.partitionBy(*part).orderBy(*order)
        rows = rows.withColumn("_d", F.col(price) - F.lag(price).over(w))
        moved = F.col("_d").isNotNull()
        rows = rows.withColumns(
            {
                "_gain": F.when(moved, F.greatest("_d", F.lit(0.0))),
                "_loss": F.when(moved, F.greatest(-F.col("_d"), F.lit(0.0))),
            }
        )
        if method == "sma":
            frame = w.rowsBetween(1 - n, 0)
            rows = rows.withColumns(
                {
                    "_up": _full(F.avg("_gain").over(frame), "_d", n, frame),
                    "_down": _full(F.avg("_loss").over(frame), "_d", n, frame),
                }
            )
        else:
            specs = {"_up": ("_gain", 1.0 / n), "_down": ("_loss", 1.0 / n)}
            rows = _with_ema(rows.withColumn("_moved", moved), specs, [*part, "_moved"], order).drop("_moved")
        strength = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("_up"), F.col("_down")))
        value = F.when(F.col("_down") == 0, F.lit(100.0)).otherwise(strength)
        return rows.withColumn(out, value).drop("_d", "_gain", "_loss", "_up", "_down")

    lookback = n if method == "sma" else _memory(1.0 / n) + 1
    return Step(lookback, _skipping_null(price, build), price)


def rsi(
    df: DataFrame, n: int = 14, *, method: str = "wilder", price: str = "price", out: str = "rsi", **layout
) -> DataFrame:
    """Relative strength index from plain (``sma``) or Wilder averages of gains and losses."""
    return indicators(df, rsi_step(n, method, price, out), **layout)


def macd_step(fast: int = 12, slow: int = 26, signal: int = 9, price: str = "price") -> Step:
    def build(rows, part, order):
        rows = _with_ema(rows, {"_f": (price, _span_alpha(fast)), "_s": (price, _span_alpha(slow))}, part, order)
        rows = rows.withColumn("macd", F.col("_f") - F.col("_s"))
        return _with_ema(rows, {"macd_signal": ("macd", _span_alpha(signal))}, part, order).drop("_f", "_s")

    lookback = max(_memory(_span_alpha(fast)), _memory(_span_alpha(slow))) + _memory(_span_alpha(signal))
    return Step(lookback, _skipping_null(price, build), price)


def macd(
    df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, *, price: str = "price", **layout
) -> DataFrame:
    """Difference of a fast and a slow exponential average, and its signal line."""
    return indicators(df, macd_step(fast, slow, signal, price), **layout)


# --- lags -------------------------------------------------------------------


def difference(df: DataFrame, lags: Sequence[int] = (1,), *, price: str = "price", **layout) -> DataFrame:
    """``x_t - x_{t-lag}`` as ``diff_<lag>``, one column per lag."""

    def build(rows, w, part, order):
        return rows.withColumns({f"diff_{k}": F.col(price) - F.lag(price, k).over(w) for k in lags})

    return indicators(df, Step(max(lags), build), **layout)


def lag_features(df: DataFrame, p: int = 5, *, price: str = "price", out: str = "lags", **layout) -> DataFrame:
    """The previous ``p`` values as an array, newest first; NULL until all are there."""

    def build(rows, w, part, order):
        rows = rows.withColumn(out, F.array(*[F.lag(price, k).over(w) for k in range(1, p + 1)]))
        gap = F.exists(out, lambda v: v.isNull())
        return rows.withColumn(out, F.when(~gap, F.col(out)))

    return indicators(df, Step(p, build), **layout)


#: Groups of map tasks whose tails are merged before the last merge of a series.
_TAIL_GROUPS = 64


def row_tail(
    df: DataFrame, n: int = 100, *, key: str | Sequence[str] = "symbol", ts: str = "ts", tie: Sequence[str] = ()
) -> DataFrame:
    """Last ``n`` rows of each series.

    Every map task keeps at most ``n`` rows per key. Tails are merged first within
    groups of tasks and then per key, so a symbol found in a great many files does
    not bring all its tails to one task at once.
    """
    newest = [F.col(c).desc() for c in (ts, *tie)]
    rows = df.withColumn("_group", F.spark_partition_id() % _TAIL_GROUPS)
    for part in ([*as_list(key), "_group"], as_list(key)):
        w = Window.partitionBy(*part).orderBy(*newest)
        rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return rows.drop("_group")
