"""Canonical schemas and the small checks that keep frames on contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


PRICE_DAYS = 7

# The column names and order of the persisted coin table.
MARKET = _schema(
    ("name", _S),
    ("id", _S),
    ("current_price", _D),
    ("expected_return", _D),
    ("high_24h", _D),
    ("low_24h", _D),
    ("last_updated", _TS),
    ("price_change_24h", _D),
    ("price_change_percentage_24h", _D),
    ("ath", _D),
    ("ath_date", _DATE),
    ("ath_change_percentage", _D),
    ("atl_change_percentage", _D),
    ("market_cap", _D),
    ("market_cap_change_24h", _D),
    ("market_cap_change_percentage_24h", _D),
    ("market_cap_rank", _I),
    ("circulating_supply", _D),
    ("symbol", _S),
    *[(f"price_day_{d}", _D) for d in range(1, PRICE_DAYS + 1)],
)

#: Columns of the coin table that follow from others.
DERIVED = {"expected_return"} | {f"price_day_{d}" for d in range(1, PRICE_DAYS + 1)}
_ISO = {"last_updated", "ath_date"}

#: Landed snapshot records: no derived columns yet, times still ISO strings.
MARKET_RAW = T.StructType(
    [
        T.StructField(f.name, _S if f.name in _ISO else f.dataType, True)
        for f in MARKET.fields
        if f.name not in DERIVED
    ]
)

OHLCV = _schema(
    ("symbol", _S), ("ts", _TS), ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _D)
)
PRICES = _schema(("symbol", _S), ("ts", _TS), ("price", _D))
MENTIONS = _schema(("mention_id", _L), ("symbol", _S), ("ts", _TS), ("text", _S))
SENTIMENT = _schema(
    ("symbol", _S),
    ("positive_sentiment", _D),
    ("negative_sentiment", _D),
    ("neutral_sentiment", _D),
    ("compound_sentiment", _D),
)
PREDICTIONS = _schema(("id", _L), ("cryptocurrency", _S), ("predicted_price", _D))
POINTS = _schema(("measurement", _S), ("time", _TS), ("field", _S), ("value", _D))
FORECAST = _schema(
    ("symbol", _S), ("model", _S), ("step", _I), ("ts", _DATE), ("mean", _D), ("lo", _D), ("hi", _D), ("reason", _S)
)
METRICS = _schema(("symbol", _S), ("mae", _D), ("mse", _D), ("r2", _D), ("n", _L))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add the columns that are missing altogether; cells that are NULL stay NULL."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a schema: extra columns go, absent ones become typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def contract_errors(df: DataFrame, schema: T.StructType) -> list[str]:
    """Names and types on which a frame departs from a schema (empty when it fits)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    errors = []
    for f in schema.fields:
        if f.name not in have:
            errors.append(f"missing column {f.name}")
        elif have[f.name] != f.dataType:
            errors.append(f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}")
    return errors


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL, so that max, count and the window guards skip it."""
    floating = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (cols is None or f.name in cols)
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df
