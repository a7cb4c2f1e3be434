"""Filling gaps and scaling columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickframe.operators.layout import over_blocks
from tickframe.schemas import nan_to_null, numeric_columns


def ffill_bfill(
    df: DataFrame,
    cols: Sequence[str],
    *,
    backward: bool = True,
    ts: str = "ts",
    tie: Sequence[str] = (),
    **layout,
) -> DataFrame:
    """Carry the last known value forward, then fill what leads the series backward.

    The summary of buckets holds the last known value before each bucket and the
    first of the series, so a gap of any length is bridged without a halo.
    """
    order = F.struct(ts, *tie) if tie else F.col(ts)
    aggs = {}
    for c in cols:
        known = F.when(F.col(c).isNotNull(), order)
        aggs[f"_l_{c}"] = F.max_by(F.col(c), known)
        aggs[f"_f_{c}"] = F.min_by(F.col(c), known)

    def derive(per: DataFrame, whole: WindowSpec, walk: WindowSpec) -> DataFrame:
        before = walk.rowsBetween(Window.unboundedPreceding, -1)
        everything = walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return per.withColumns(
            {f"_carry_{c}": F.last(f"_l_{c}", ignorenulls=True).over(before) for c in cols}
            | {f"_lead_{c}": F.first(f"_f_{c}", ignorenulls=True).over(everything) for c in cols}
        ).drop(*aggs)

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = {}
        for c in cols:
            choices = [F.last(c, ignorenulls=True).over(seen), F.col(f"_carry_{c}")]
            filled[c] = F.coalesce(*choices, *([F.col(f"_lead_{c}")] if backward else []))
        return rows.withColumns(filled).drop(*[f"_{p}_{c}" for p in ("carry", "lead") for c in cols])

    return over_blocks(df, build, ts=ts, tie=tie, aggs=aggs, derive=derive, **layout)


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers, NaN included, become 0."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return nan_to_null(df, cols).fillna(0, subset=cols)


def minmax_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``<col>_min`` and ``<col>_max`` of every column, in one aggregation."""
    clean = nan_to_null(df.select(*cols), list(cols))
    return clean.agg(
        *[f(c).alias(f"{c}_{name}") for c in cols for name, f in (("min", F.min), ("max", F.max))]
    )


def minmax_apply(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale columns to [0, 1] with fitted bounds; a constant column becomes 0.

    ``stats`` is the one-row result of :func:`minmax_fit`; it enters as a scalar subquery.
    """
    bounds = stats.select(F.struct(*stats.columns).alias("b")).scalar()
    scaled = df.withColumn("_b", bounds)
    exprs = {}
    for c in cols:
        low, high = F.col(f"_b.{c}_min"), F.col(f"_b.{c}_max")
        share = F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))
        exprs[c] = F.when(F.col(c).isNotNull(), share)
    return scaled.withColumns(exprs).drop("_b")
