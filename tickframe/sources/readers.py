"""Typed scans of landed files and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions.prices import analyse, parse_date, parse_ts
from tickframe.operators.layout import on_days
from tickframe.operators.snapshot import flag_required, top_k
from tickframe.schemas import MARKET, MARKET_RAW, conform, nan_to_null
from tickframe.session import broadcast_if_small


def scan_market(spark: SparkSession, path: str) -> DataFrame:
    """Landed market snapshots, one JSON record per line."""
    return spark.read.schema(MARKET_RAW).json(path)


def market_rows(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw records as rows of the coin table: parsed times, expected return, price path; ``keep`` stays as it is."""
    typed = raw.withColumns({"last_updated": parse_ts("last_updated"), "ath_date": parse_date("ath_date")})
    kept = [f for f in raw.schema.fields if f.name in keep]
    return conform(analyse(nan_to_null(typed)), T.StructType([*MARKET.fields, *kept]))


def scan_market_top(spark: SparkSession, path: str, k: int = 250) -> DataFrame:
    return top_k(scan_market(spark, path), "market_cap", k)


def scan_prices_csv(spark: SparkSession, path: str, columns: Sequence[str] = ("timestamp", "price")) -> DataFrame:
    """Price files with a header row, one folder ``symbol=…`` or one file per symbol.

    Columns are taken by place, so the spelling of the header does not matter.
    """
    fields = [T.StructField(c, T.StringType()) for c in columns]
    reader = spark.read.option("header", True)
    if path.endswith(".csv"):
        raw = reader.schema(T.StructType(fields)).csv(path)
        file = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
        raw = raw.withColumn("symbol", file)
    else:
        raw = reader.schema(T.StructType([*fields, T.StructField("symbol", T.StringType())])).csv(path)
    return raw.select(
        "symbol",
        F.col(columns[0]).try_cast("timestamp_ntz").alias("ts"),
        *[F.col(c).try_cast("double").alias(c) for c in columns[1:]],
    )


def scan_json_table(spark: SparkSession, path: str, schema: T.StructType | str, *, multi_line: bool = False) -> DataFrame:
    """JSON files as a table. ``multi_line`` reads each file as one document, in one task."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def scan_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, trimmed, blanks left out."""
    line = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return spark.read.text(path).select(line.alias("symbol")).where(F.length("symbol") > 0)


def symbol_list(spark: SparkSession, symbols: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def scan_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A table of a relational store; connection and partitioning options come from the caller."""
    return spark.read.format("jdbc").options(**options).load()


def scan_points_since(
    points: DataFrame, measurement: str | None, days: int = 7, *, as_of: Column | str | None = None
) -> DataFrame:
    """Points of a measurement in the last days before ``as_of`` (now, if not given).

    Of a store laid out by measurement and day only the folders of these days are read.
    """
    now = F.current_timestamp() if as_of is None else (F.lit(as_of) if isinstance(as_of, str) else as_of)
    kind = points.schema["time"].dataType
    since = (now.cast(kind) - F.expr(f"INTERVAL {int(days)} DAYS")).cast(kind)
    if measurement is not None:
        points = points.where(F.col("measurement") == measurement)
    return on_days(points, since).where(F.col("time") >= since)


def scan_points_windows(points: DataFrame, windows: DataFrame, *, by: str = "measurement") -> DataFrame:
    """The points inside windows that a table names: its columns ``by, start, stop`` and any others, with each point.

    A window holds ``start <= time < stop``; a point in several windows comes once for each.
    Windows are unfolded to their days and joined by measurement and day, so of a store laid
    out by both Spark reads only the folders that some window touches, once it knows them.
    """
    if "date" not in points.columns:
        points = points.withColumn("date", F.col("time").cast("date"))
    kind = points.schema["time"].dataType
    bounds = windows.withColumns({"start": F.col("start").cast(kind), "stop": F.col("stop").cast(kind)})
    bounds = bounds.where(F.col("start") < F.col("stop"))
    last = (F.col("stop") - F.expr("INTERVAL 1 MICROSECOND")).cast("date")
    days = bounds.withColumn("date", F.explode(F.sequence(F.col("start").cast("date"), last)))
    joined = points.join(broadcast_if_small(days), [by, "date"])
    return joined.where((F.col("time") >= F.col("start")) & (F.col("time") < F.col("stop"))).drop("date")


def parse_json_records(
    df: DataFrame, column: str, record: T.StructType | str, required: Sequence[str] = (), *, keep: Sequence[str] = ()
) -> DataFrame:
    """Texts holding a JSON array of records as rows, with ``valid``.

    A text that does not parse gives one row of NULLs that is not valid.
    """
    ddl = record if isinstance(record, str) else record.simpleString()
    kind = f"array<{ddl}>" if ddl.startswith("struct") else f"array<struct<{ddl}>>"
    parsed = F.from_json(F.col(column), kind, {"mode": "PERMISSIVE"})
    rows = df.select(*keep, F.inline_outer(parsed))
    return flag_required(rows, required)


def synthetic_regression(
    spark: SparkSession, n: int = 1000, features: int = 10, *, seed: int = 42, noise: float = 0.0
) -> DataFrame:
    """A seeded linear problem: ``x0..``, ``y`` and an ``id``."""
    rows = spark.range(n)
    for i in range(features):
        rows = rows.withColumn(f"x{i}", F.randn(seed + i))
    y = F.lit(0.0)
    for i in range(features):
        y = y + F.col(f"x{i}") * float(10 * (i + 1))
    if noise:
        y = y + F.randn(seed + features) * noise
    return rows.withColumn("y", y)
