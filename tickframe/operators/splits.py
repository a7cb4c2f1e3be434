"""Splits and folds for validation, all deterministic under repartitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.layout import as_list, series_position
from tickframe.session import broadcast_if_small, materialize

#: Values of the hash that chooses rows.
_HASHES = 1 << 32


def dense_row_number(df: DataFrame, order: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rn`` (1-based, dense, in ``order`` within ``by``) and ``n`` (rows in ``by``).

    The rows are range-partitioned and sorted by the full order, so neither one
    group nor one leading value ends up in a single task. The result is
    checkpointed, because partition bounds come from a sample and must be the same
    for the counts and for the rows. ``by`` plus ``order`` must be unique. Hand in
    only the columns you need.
    """
    total_order = [*by, *order]
    placed = (
        df.repartitionByRange(*total_order)
        .sortWithinPartitions(*total_order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = materialize(placed).withColumn("_pid", F.shiftright("_id", 33))
    keys = [*by, "_pid"]
    per = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *[F.col(c).alias(f"_k_{c}") for c in keys],
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("n"),
    )
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = placed.join(broadcast_if_small(per, keep=True), match)
    rn = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return joined.withColumn("rn", rn).select(*df.columns, "rn", "n")


def row_hash(ids: str | Sequence[str], seed: int) -> Column:
    """32 bits from the ids as text: the first eight digits of an MD5 sum, so that any engine can choose alike."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in as_list(ids)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def train_test_split(df: DataFrame, ids: str | Sequence[str], frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: ``test`` for about ``frac`` of the ids, chosen by hash, else ``train``."""
    held = row_hash(ids, seed) < round(frac * _HASHES)
    return df.withColumn("split", F.when(held, "test").otherwise("train"))


def time_split(df: DataFrame, frac: float = 0.2, **layout) -> DataFrame:
    """Add ``split``: the last ``frac`` of each series is ``test``."""
    placed = series_position(df, **layout)
    rank = F.coalesce(F.try_divide(F.col("rn") - 1, F.col("n") - 1), F.lit(0.0))
    return placed.withColumn("split", F.when(rank >= 1 - frac, "test").otherwise("train")).drop("rn", "n")


def kfold(
    df: DataFrame, k: int, ids: str | Sequence[str], *, shuffle: bool = False, seed: int = 0
) -> DataFrame:
    """Add ``fold`` 0..k-1: contiguous in id order, the first ``n mod k`` folds one row longer.

    ``shuffle`` orders the rows by a seeded hash first.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    order = as_list(ids)
    if shuffle:
        df = df.withColumn("_h", F.xxhash64(*order, F.lit(seed)))
        order = ["_h", *order]
    placed = dense_row_number(df, order)
    placed = placed.withColumns({"_q": F.expr(f"n div {k}"), "_r": F.col("n") % k, "_i": F.col("rn") - 1})
    long_rows = F.col("_r") * (F.col("_q") + 1)
    fold = F.when(F.col("_i") < long_rows, F.expr("_i div (_q + 1)")).otherwise(
        F.col("_r") + F.expr("(_i - _r * (_q + 1)) div greatest(_q, 1)")
    )
    return placed.withColumn("fold", fold.cast("int")).drop("_q", "_r", "_i", "_h", "rn", "n")


def hash_fold(df: DataFrame, k: int, ids: str | Sequence[str], seed: int = 0) -> DataFrame:
    """Add a random ``fold`` without any shuffle; sizes are only about equal."""
    return df.withColumn("fold", (row_hash(ids, seed) % k).cast("int"))


def stratified_kfold(df: DataFrame, k: int, label: str, ids: str | Sequence[str]) -> DataFrame:
    """Add ``fold`` 0..k-1 with every class spread to within one row."""
    placed = dense_row_number(df, as_list(ids), by=[label])
    return placed.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn", "n")


def time_series_split(df: DataFrame, k: int = 5, **layout) -> DataFrame:
    """Expanding folds 1..k per series: each row once for every fold it plays a part in.

    Fold ``i`` tests a run of ``n div (k + 1)`` rows near the end and trains on all
    rows before it.
    """
    placed = series_position(df, **layout).withColumn("_t", F.expr(f"n div {k + 1}"))
    i = F.col("rn") - 1
    folds = []
    for f in range(1, k + 1):
        start = F.col("n") - (k - f + 1) * F.col("_t")
        role = F.when(i < start, "train").when(i < start + F.col("_t"), "test")
        folds.append(F.struct(F.lit(f).alias("fold"), role.alias("role")))
    out = placed.select("*", F.inline(F.array(*folds)))
    return out.where(F.col("role").isNotNull() & (F.col("_t") > 0)).drop("rn", "n", "_t")
