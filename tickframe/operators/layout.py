"""Block layout of a panel: the base of every operator that looks back along a series.

A window over ``partitionBy(symbol)`` puts a whole series into one task, and one
symbol may hold a third of all rows. Here each series is cut into blocks of whole
calendar buckets (about ``block_rows`` rows each). The cuts come from a summary
with one row per symbol and bucket, so the rows themselves are shuffled by
``(symbol, block)`` and a long series is spread over the cluster.

An operator that looks back ``n`` rows asks for ``lookback=n``: the buckets that
end less than ``n`` rows before a later block are copied into it as halo rows,
used by the window and dropped afterwards. Results do not depend on the cuts.

What a single task holds is bounded by ``block_rows`` plus one bucket; a bucket is
a month for dates and an hour for times unless ``bucket`` says otherwise, and
:func:`pick_bucket` measures which one keeps every task small. The summary walk of
one symbol covers at most the calendar length of the series in buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.session import broadcast_if_small

BLOCK_ROWS = 65_536
INTERNAL = ("_bucket", "_blk", "_halo", "_base", "_total")


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


#: From coarse to fine.
BUCKETS = ("year", "month", "day", "hour", "minute", "second")


def calendar_bucket(ts: str, bucket: str) -> Column:
    """Number of the year, month, ... or second a row falls in; never decreases with ``ts``."""
    c = F.col(ts)
    if bucket == "year":
        return F.year(c).cast("long")
    if bucket == "month":
        return F.year(c).cast("long") * 12 + F.month(c)
    number = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    for unit, per, part in (("day", 0, None), ("hour", 24, F.hour), ("minute", 60, F.minute), ("second", 60, F.second)):
        if part is not None:
            number = number * per + part(c)
        if unit == bucket:
            return number
    raise ValueError(f"bucket must be one of {', '.join(BUCKETS)}, not {bucket!r}")


def _default_bucket(df: DataFrame, ts: str) -> str:
    """Months for dates (at most 31 rows), hours for times."""
    return "month" if isinstance(df.schema[ts].dataType, T.DateType) else "hour"


def pick_bucket(
    df: DataFrame, *, key: str | Sequence[str] = "symbol", ts: str = "ts", max_rows: int = 16 * BLOCK_ROWS
) -> str:
    """The coarsest bucket of which none holds more than ``max_rows`` rows of one key.

    Tries them from coarse to fine; each try counts keys and times only and brings
    back one number. Use it before a run over series that tick often, and hand the
    answer to the operators as ``bucket``.
    """
    dates = isinstance(df.schema[ts].dataType, T.DateType)
    units = BUCKETS[: BUCKETS.index("day") + 1] if dates else BUCKETS
    for unit in units[:-1]:
        counts = df.groupBy(*as_list(key), calendar_bucket(ts, unit).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        if (counts.agg(F.max("_n")).first()[0] or 0) <= max_rows:
            return unit
    return units[-1]


def series_blocks(
    df: DataFrame,
    *,
    key: str | Sequence[str] = "symbol",
    ts: str = "ts",
    lookback: int = 0,
    bucket: str | None = None,
    block_rows: int = BLOCK_ROWS,
    valid: Column | None = None,
    valid_lookback: int = 0,
    aggs: dict[str, Column] | None = None,
    derive: Callable[[DataFrame, WindowSpec, WindowSpec], DataFrame] | None = None,
) -> DataFrame:
    """One row per key and bucket: its block, the last block it must be copied to, and counts.

    ``lookback`` counts rows. Operators that skip NULLs say which rows count for them
    (``valid``) and how many of those they look back on (``valid_lookback``); then
    only valid rows are copied that far, so a long run of NULLs is never copied
    along. ``aggs`` are extra per-bucket aggregates; ``derive`` may turn them into
    carried values with the windows ``(whole key, key in time order)``.
    """
    keys = as_list(key)
    bucket = bucket or _default_bucket(df, ts)
    counts = [F.count(F.lit(1)).alias("_n")]
    if valid is not None:
        counts.append(F.count(F.when(valid, 1)).alias("_v"))
    extra = [agg.alias(name) for name, agg in (aggs or {}).items()]
    per = df.groupBy(*keys, calendar_bucket(ts, bucket).alias("_bucket")).agg(*counts, *extra)

    whole = Window.partitionBy(*keys)
    walk = whole.orderBy("_bucket")
    so_far = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("_end", F.sum("_n").over(so_far))
    per = per.withColumn("_cum", F.col("_end") - F.col("_n"))
    per = per.withColumn("_step", F.expr(f"_cum div {int(block_rows)}"))
    opens = (F.col("_step") > F.lag("_step", 1, 0).over(walk)).cast("int")
    per = per.withColumn("_blk", F.sum(opens).over(so_far).cast("int"))
    if valid is not None:
        per = per.withColumn("_vend", F.sum("_v").over(so_far))
    per = per.withColumn("_next", F.lead("_blk").over(walk))

    def reach(end: str, rows: int) -> Column:
        # A later block opens where its predecessor bucket ends, so the blocks within
        # reach are those that follow a bucket ending less than `rows` rows on.
        return F.max("_next").over(whole.orderBy(end).rangeBetween(0, rows - 1))

    if lookback > 0:
        per = per.withColumn("_last", F.greatest("_blk", reach("_end", lookback)))
    if valid is not None and valid_lookback > 0:
        nearest = F.col("_last" if lookback > 0 else "_blk")
        per = per.withColumn("_vlast", F.greatest(nearest, reach("_vend", valid_lookback)))
    per = per.withColumn("_base", F.min("_cum").over(Window.partitionBy(*keys, "_blk")))
    per = per.withColumn("_total", F.sum("_n").over(whole))
    if derive is not None:
        per = derive(per, whole, walk)
    return per.drop("_n", "_v", "_end", "_vend", "_cum", "_step", "_next")


def block_series(
    df: DataFrame,
    *,
    key: str | Sequence[str] = "symbol",
    ts: str = "ts",
    bucket: str | None = None,
    blocks: DataFrame | None = None,
    broadcast_rows: int | None = None,
    valid: Column | None = None,
    **options,
) -> DataFrame:
    """Give each row its block (``_blk``), copying the halo rows (``_halo``) where needed.

    ``broadcast_rows`` materialises the summary and broadcasts it if it is at most
    that long, which saves one shuffle of the rows; otherwise both sides shuffle
    by key and bucket.
    """
    keys = as_list(key)
    bucket = bucket or _default_bucket(df, ts)
    if blocks is None:
        blocks = series_blocks(df, key=keys, ts=ts, bucket=bucket, valid=valid, **options)
    if broadcast_rows is not None:
        blocks = broadcast_if_small(blocks, broadcast_rows, keep=True)
    renamed = {c: f"_b_{c}" for c in [*keys, "_bucket"]}
    side = blocks.withColumnsRenamed(renamed)
    rows = df.withColumn("_bucket", calendar_bucket(ts, bucket))
    match = None
    for c, r in renamed.items():
        same = F.col(c).eqNullSafe(F.col(r))
        match = same if match is None else match & same
    joined = rows.join(side, match).drop(*renamed.values())
    to = F.col("_last") if "_last" in blocks.columns else F.col("_blk")
    if "_vlast" in blocks.columns:
        to = F.when(valid, F.col("_vlast")).otherwise(to)
    if {"_last", "_vlast"}.isdisjoint(blocks.columns):
        placed = joined.withColumn("_halo", F.lit(False))
    else:
        kept = [c for c in joined.columns if c not in ("_blk", "_last", "_vlast")]
        copies = F.explode(F.sequence(F.col("_blk"), to)).alias("_to")
        placed = joined.select(*kept, "_blk", copies).select(
            *kept, F.col("_to").alias("_blk"), (F.col("_to") > F.col("_blk")).alias("_halo")
        )
    # One placement that serves every window on key and block, also those that
    # partition further; left to itself Spark may shuffle anew between them.
    return placed.repartition(*keys, "_blk")


def on_days(df: DataFrame, start: Column | None = None, stop: Column | None = None) -> DataFrame:
    """Only the days or months that ``[start, stop]`` touches, where the store is laid out by ``date`` or ``month``.

    The filter on the folder's column is what lets Spark leave out folders; the caller filters
    the time itself.
    """
    for name, first in (("date", lambda c: c.cast("date")), ("month", lambda c: F.trunc(c.cast("date"), "month"))):
        if name in df.columns and isinstance(df.schema[name].dataType, T.DateType):
            if start is not None:
                df = df.where(F.col(name) >= first(start))
            if stop is not None:
                df = df.where(F.col(name) <= first(stop))
    return df


def block_window(key: str | Sequence[str] = "symbol", ts: str = "ts", tie: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*as_list(key), "_blk").orderBy(ts, *tie)


def over_blocks(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    key: str | Sequence[str] = "symbol",
    ts: str = "ts",
    tie: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Run ``build(rows, window)`` block by block and give back the original rows only."""
    rows = block_series(df, key=key, ts=ts, **options)
    out = build(rows, block_window(key, ts, tie))
    return out.where(~F.col("_halo")).drop(*INTERNAL)


def series_position(df: DataFrame, **options) -> DataFrame:
    """Add ``rn`` (1-based place in the series) and ``n`` (length) without a whole-series window."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns(
            {
                "rn": F.col("_base") + F.row_number().over(w),
                "n": F.col("_total"),
            }
        )

    return over_blocks(df, build, **options)
