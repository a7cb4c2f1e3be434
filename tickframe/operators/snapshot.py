"""The coin table: filters, look-ups, sorting, paging, and joins against it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.layout import as_list
from tickframe.session import broadcast_if_small

DEFAULT_SORT = "expected_return"


def top_k(df: DataFrame, by: str = "market_cap", k: int = 250, *, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), tie).limit(k)


def filter_expected_return(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    return df.where(F.col("expected_return") >= threshold)


def lookup_symbol(df: DataFrame, text: str, *, rank: str = "market_cap", tie: str = "id") -> DataFrame:
    """The highest-ranked coin whose name or symbol equals ``text`` (empty if there is none)."""
    return top_k(df.where((F.col("name") == text) | (F.col("symbol") == text)), rank, 1, tie=tie)


def filter_entity(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def filter_min_rows(df: DataFrame, key: str = "symbol", more_than: int = 1) -> DataFrame:
    """Rows of the series that have more than ``more_than`` rows."""
    long_enough = df.groupBy(key).count().where(F.col("count") > more_than).select(key)
    return df.join(broadcast_if_small(long_enough, keep=True), key, "left_semi")


def flag_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Add ``valid``: every required field is there and, if text, not blank."""
    types = dict(df.dtypes)
    ok = F.lit(True)
    for c in required:
        present = F.col(c).isNotNull()
        if types[c] == "string":
            present = present & (F.trim(F.col(c)) != "")
        ok = ok & present
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``."""
    flagged = flag_required(df, required)
    return flagged.where("valid").drop("valid"), flagged.where("not valid").drop("valid")


# --- sorting and paging -----------------------------------------------------


def _sort_key(df: DataFrame, field: str | None, order: str | None) -> tuple[str, bool]:
    return (field if field in df.columns else DEFAULT_SORT), order == "asc"


def sort_dynamic(
    df: DataFrame, field: str | None = None, order: str | None = None, *, tie: str | Sequence[str] = "id"
) -> DataFrame:
    """Sort by any column; unknown fields and orders fall back. NULLs come last both ways."""
    name, up = _sort_key(df, field, order)
    c = F.col(name)
    return df.orderBy(c.asc_nulls_last() if up else c.desc_nulls_last(), *as_list(tie))


def sort_expected_return(df: DataFrame) -> DataFrame:
    return sort_dynamic(df, DEFAULT_SORT, "desc")


def page_rows(
    df: DataFrame, page: int = 1, per_page: int = 100, field=None, order=None, *, tie: str | Sequence[str] = "id"
) -> DataFrame:
    """Rows of one page; each task keeps only ``page * per_page`` rows."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    return sort_dynamic(df, field, order, tie=tie).offset((page - 1) * per_page).limit(per_page)


def page_after(
    df: DataFrame, last_value, last_tie, per_page: int = 100, field=None, order=None, *, tie: str = "id"
) -> DataFrame:
    """The page that follows a known last row: a filter instead of an offset, for deep paging.

    ``last_value`` may be None, which stands for the NULLs at the end.
    """
    name, up = _sort_key(df, field, order)
    c, t = F.col(name), F.col(tie)
    if last_value is None:
        rest = c.isNull() & (t > F.lit(last_tie))
    else:
        beyond = c > F.lit(last_value) if up else c < F.lit(last_value)
        rest = beyond | ((c == F.lit(last_value)) & (t > F.lit(last_tie))) | c.isNull()
    return sort_dynamic(df.where(rest), field, order, tie=tie).limit(per_page)


def page_totals(df: DataFrame, per_page: int = 100) -> DataFrame:
    """One row: the number of rows and of pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / F.lit(per_page)).cast("long")
    )


def page(
    df: DataFrame, page: int = 1, per_page: int = 100, field=None, order=None, *, tie: str | Sequence[str] = "id"
) -> tuple[DataFrame, DataFrame]:
    """``(rows, totals)`` of one page."""
    return page_rows(df, page, per_page, field, order, tie=tie), page_totals(df, per_page)


# --- joins ------------------------------------------------------------------


def resolve_symbols(requests: DataFrame, coins: DataFrame, *, text: str = "request") -> DataFrame:
    """Match requested texts with coin names or symbols: two equi-joins instead of an OR."""
    named = coins.select(F.col("name").alias(text), "symbol")
    own = coins.select(F.col("symbol").alias(text), "symbol")
    return requests.select(text).distinct().join(named.union(own).distinct(), text).distinct()


def join_coin_history(requests: DataFrame, coins: DataFrame, history: DataFrame, *, text: str = "request") -> DataFrame:
    """History rows of every requested coin, found by name or symbol."""
    return history.join(broadcast_if_small(resolve_symbols(requests, coins, text=text), keep=True), "symbol")


def semi_symbol_list(df: DataFrame, symbols: DataFrame, *, key: str = "symbol") -> DataFrame:
    return df.join(broadcast_if_small(symbols.select(key).distinct()), key, "left_semi")


def non_empty(symbols: DataFrame, df: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Each requested symbol and whether it has any row (``has_data``)."""
    present = df.select(key).distinct().withColumn("_p", F.lit(True))
    asked = symbols.select(key).distinct().join(present, key, "left")
    return asked.select(key, F.col("_p").isNotNull().alias("has_data"))


def anti_missing_symbols(symbols: DataFrame, df: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Requested symbols that have no rows; counts before the join, so a hot symbol is one row."""
    return symbols.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def lookup_prices(requests: DataFrame, prices: DataFrame, *, key: str = "id") -> DataFrame:
    """Every requested id with its price, and whether it was found."""
    found = F.col("price").isNotNull().alias("found")
    return requests.select(key).distinct().join(prices, key, "left").select(key, "price", found)


def latest_per_symbol(df: DataFrame, cols: Sequence[str], *, key: str = "symbol", ts: str = "ts", tie: Sequence[str] = ()):
    """The newest row of each key."""
    order = F.struct(ts, *tie) if tie else F.col(ts)
    newest = F.max_by(F.struct(ts, *cols), order).alias("_row")
    return df.groupBy(key).agg(newest).select(key, f"_row.{ts}", *[f"_row.{c}" for c in cols])


def upsert_latest(log: DataFrame, *, key: str = "id", order: Sequence[str] = ("last_updated", "seq")) -> DataFrame:
    """Latest row of each key in a change log; the whole row wins, its NULLs included.

    One shuffle with partial aggregation, so a key with many updates costs one row
    per map task.
    """
    cols = [c for c in log.columns if c != key]
    newest = F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")
    return log.groupBy(key).agg(newest).select(key, *[F.col(f"_row.{c}").alias(c) for c in cols])


def distinct_names(df: DataFrame, column: str = "name") -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def count_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))
