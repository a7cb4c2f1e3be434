"""OHLC bars from ticks, and the ranges and periods they are asked for in."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.operators.layout import on_days
from tickframe.session import broadcast_if_small


def _bar_start(ts: str, interval: str) -> Column:
    return F.window(ts, interval)["start"].alias("_start")


def ohlc_bars(
    ticks: DataFrame,
    interval: str = "1 day",
    *,
    key: str = "symbol",
    ts: str = "ts",
    price: str = "price",
    volume: str | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Open, high, low, close, volume and tick count per symbol and interval.

    Partial aggregation runs before the shuffle, so a busy symbol costs one row per
    bar and map task. Ticks with equal ``ts`` are ordered by ``tie``; that makes
    the order a struct and the aggregation a sorting one, so leave it out where
    ``(symbol, ts)`` is unique. Grouping by the start of the window keeps the
    grouping key a plain value.
    """
    order = F.struct(ts, *tie) if tie else F.col(ts)
    priced = F.when(F.col(price).isNotNull(), order)
    bars = ticks.groupBy(key, _bar_start(ts, interval)).agg(
        F.min_by(price, priced).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, priced).alias("close"),
        (F.sum(volume) if volume else F.lit(None).cast("double")).alias("volume"),
        F.count(price).alias("ticks"),
    )
    return bars.select(key, F.col("_start").alias("ts"), "open", "high", "low", "close", "volume", "ticks")


def coarser_bars(bars: DataFrame, interval: str, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Roll bars up to a longer interval."""
    out = bars.groupBy(key, _bar_start(ts, interval)).agg(
        F.min_by("open", ts).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("ticks").alias("ticks"),
    )
    return out.select(key, F.col("_start").alias("ts"), "open", "high", "low", "close", "volume", "ticks")


def date_range(df: DataFrame, start=None, end=None, *, ts: str = "ts") -> DataFrame:
    """Rows with ``start <= ts < end``; an open side is not restricted.

    Of a store laid out by day (:func:`tickframe.sources.writers.write_dated`) only the folders
    of these days are read.
    """
    kind = df.schema[ts].dataType
    low, high = (None if v is None else F.lit(v).cast(kind) for v in (start, end))
    df = on_days(df, low, high) if ts != "date" else df
    if low is not None:
        df = df.where(F.col(ts) >= low)
    if high is not None:
        df = df.where(F.col(ts) < high)
    return df


def ohlcv_range(df: DataFrame, symbol: str, start: str, end: str, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """History of one symbol in ``[start, end)``; all three are required."""
    if not (symbol and start and end):
        raise ValueError("symbol, start and end are required")
    return date_range(df.where(F.col(key) == symbol), start, end, ts=ts)


def period_start(period: str, as_of) -> Column | None:
    """First instant of a period such as ``10d``, ``6mo`` or ``1y`` before ``as_of``; None for ``max``."""
    if period == "max":
        return None
    parts = re.fullmatch(r"(\d+)(d|wk|mo|y)", period)
    if parts is None:
        raise ValueError(f"unknown period {period!r}")
    n, unit = int(parts[1]), parts[2]
    now = F.to_date(F.lit(as_of))
    if unit in ("d", "wk"):
        return F.date_sub(now, n * (7 if unit == "wk" else 1))
    return F.add_months(now, -n * (12 if unit == "y" else 1))


def ohlcv_period(
    df: DataFrame, symbols: DataFrame | None, period: str, as_of, *, key: str = "symbol", ts: str = "ts"
) -> DataFrame:
    """History of the listed symbols over a relative period."""
    start = period_start(period, as_of)
    if start is not None:
        df = df.where(F.col(ts) >= start.cast(df.schema[ts].dataType))
    if symbols is not None:
        df = df.join(broadcast_if_small(symbols.select(key).distinct()), key, "left_semi")
    return df


def future_calendar(df: DataFrame, steps: int = 7, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """The ``steps`` days after the last date of each series."""
    last = df.groupBy(key).agg(F.max(F.col(ts).cast("date")).alias("_last"))
    days = F.posexplode(F.sequence(F.date_add("_last", 1), F.date_add("_last", steps))).alias("_i", "ts")
    return last.select(key, days).select(key, (F.col("_i") + 1).alias("step"), "ts")
