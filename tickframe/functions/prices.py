"""Scalar columns of the coin table and small formatting helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.schemas import PRICE_DAYS

#: ISO-8601 with ``Z`` or an offset, with or without a fraction of a second.
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX"


def expected_return(df: DataFrame, change: str = "price_change_percentage_24h") -> DataFrame:
    """``1 + change / 100``; a constant 1 if the column is missing altogether."""
    value = F.col(change) / 100 + 1 if change in df.columns else F.lit(1.0)
    return df.withColumn("expected_return", value)


def price_path(df: DataFrame, days: int = PRICE_DAYS) -> DataFrame:
    """Compounded price for each of the next days, one column per day."""
    base, growth = F.col("current_price"), F.col("expected_return")
    return df.withColumns({f"price_day_{d}": base * F.pow(growth, F.lit(d)) for d in range(1, days + 1)})


def analyse(df: DataFrame) -> DataFrame:
    """Expected return and price path of a snapshot."""
    return price_path(expected_return(df))


def price_path_long(df: DataFrame, ids=("id",), days: int = PRICE_DAYS) -> DataFrame:
    """The price path as rows ``(day, price)``."""
    points = F.explode(
        F.array(*[F.struct(F.lit(d).alias("day"), F.col(f"price_day_{d}").alias("price")) for d in range(1, days + 1)])
    )
    return df.select(*ids, points.alias("_p")).select(*ids, "_p.day", "_p.price")


def parse_ts(col: Column | str) -> Column:
    """ISO text to whole-second UTC time without zone; NULL if it does not parse."""
    c = F.col(col) if isinstance(col, str) else col
    parsed = F.try_to_timestamp(c, F.lit(ISO_PATTERN))
    return F.date_trunc("second", parsed).cast("timestamp_ntz")


def parse_date(col: Column | str) -> Column:
    return parse_ts(col).cast("date")


def coalesce_name(*cols: str) -> Column:
    """First of the names that is there and not blank."""
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in cols])


def slug(col: Column | str) -> Column:
    return F.translate(F.col(col) if isinstance(col, str) else col, " ", "_")


def first_of_list(col: Column | str) -> Column:
    """First element as double; NULL for an empty list."""
    return F.try_element_at(F.col(col) if isinstance(col, str) else col, F.lit(1)).cast("double")


def fmt2(col: Column | str, prefix: str = "") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    text = F.format_string("%.2f", c)
    return F.when(c.isNotNull(), F.concat(F.lit(prefix), text) if prefix else text)


def relative_dates(as_of: Column | str, days: int = 30) -> tuple[Column, Column]:
    """``(as_of - days, as_of)`` as ``yyyy-MM-dd`` text."""
    now = F.col(as_of) if isinstance(as_of, str) else as_of
    return (
        F.date_format(F.date_sub(now.cast("date"), days), "yyyy-MM-dd"),
        F.date_format(now.cast("date"), "yyyy-MM-dd"),
    )


def price_from_payload(payload: Column | str, coin: Column, currency: str) -> Column:
    """Price of a coin in a currency from ``{id: {currency: price}}``; NULL if either is absent."""
    prices = F.from_json(payload, "map<string,map<string,double>>")
    return F.try_element_at(F.try_element_at(prices, coin), F.lit(currency))
