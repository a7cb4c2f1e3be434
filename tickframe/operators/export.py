"""Shapes for readers outside Spark: points, JSON rows, column-wise JSON, prediction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss",
    "dateFormat": "yyyy-MM-dd",
    "ignoreNullFields": "false",
}

_POINTS = "array<struct<field:string,value:double,text:string>>"


def flatten_fields(df: DataFrame) -> DataFrame:
    """Struct cells become columns ``<col>_<key>``; everything else stays."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"{f.name}.{k}").alias(f"{f.name}_{k}") for k in f.dataType.fieldNames()]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def flatten_points(df: DataFrame, measurement: str | Column, *, time_col: str = "time") -> DataFrame:
    """One row per field that has a value: ``(measurement, time, field, value, text)``.

    Numbers and flags go to ``value``, everything else to ``text``; struct and map
    cells give fields ``<col>_<key>``.
    """
    name = F.lit(measurement) if isinstance(measurement, str) else measurement
    flat = flatten_fields(df)

    def point(field: Column, cell: Column, kind: T.DataType) -> Column:
        number = isinstance(kind, (T.NumericType, T.BooleanType))
        return F.struct(
            field.alias("field"),
            (cell.cast("double") if number else F.lit(None).cast("double")).alias("value"),
            (F.lit(None).cast("string") if number else cell.cast("string")).alias("text"),
        )

    def map_points(f: T.StructField) -> Column:
        def one(e: Column) -> Column:
            return point(F.concat(F.lit(f"{f.name}_"), e["key"].cast("string")), e["value"], f.dataType.valueType)

        return F.transform(F.map_entries(f.name), one)

    single, many = [], []
    for f in flat.schema.fields:
        if f.name == time_col:
            continue
        if isinstance(f.dataType, T.MapType):
            many.append(F.coalesce(map_points(f), F.array().cast(_POINTS)))
        else:
            single.append(point(F.lit(f.name), F.col(f.name), f.dataType))
    points = F.concat(F.array(*single), *many) if many else F.array(*single)
    rows = flat.select(
        name.alias("measurement"), F.col(time_col).alias("time"), F.inline(points)
    )
    return rows.where(F.col("value").isNotNull() | F.col("text").isNotNull())


def json_rows(df: DataFrame, *, out: str = "json", keep: Sequence[str] = ()) -> DataFrame:
    """One JSON object per row, ISO-8601 times, NULLs written out."""
    return df.select(*keep, F.to_json(F.struct(*df.columns), _JSON).alias(out))


def columnar_json(
    df: DataFrame,
    cols: Sequence[str],
    start: str | None = None,
    end: str | None = None,
    *,
    step_seconds: int,
    points: int = 65_536,
    key: str = "symbol",
    ts: str = "ts",
) -> DataFrame:
    """JSON objects of parallel arrays for bars in ``[start, end)``: ``(symbol, part, json)``.

    A part spans ``points`` steps of time, so what is gathered is bounded however long the
    series are; parts ascend with time, and joined in order they are the whole series.
    ``start`` or ``end`` may be None: no bound on that side.
    """
    kind = df.schema[ts].dataType
    inside = df
    if start is not None:
        inside = inside.where(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        inside = inside.where(F.col(ts) < F.lit(end).cast(kind))
    part = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / (step_seconds * points)).alias("part")
    series = inside.groupBy(key, part).agg(F.sort_array(F.collect_list(F.struct(ts, *cols))).alias("_s"))
    # A field of an array of structs is the array of that field.
    arrays = [F.col(f"_s.{c}").alias(c) for c in [ts, *cols]]
    return series.select(key, "part", F.to_json(F.struct(*arrays), _JSON).alias("json"))


def prediction_rows(df: DataFrame, run_id: str, *, coin: str = "symbol", price: str = "prices") -> DataFrame:
    """Rows for the prediction table: first price of a list, as double, with a stable id."""
    listed = isinstance(df.schema[price].dataType, T.ArrayType)
    value = F.try_element_at(F.col(price), F.lit(1)) if listed else F.col(price)
    return df.select(
        F.xxhash64(F.lit(run_id), F.col(coin)).alias("id"),
        F.col(coin).alias("cryptocurrency"),
        value.cast("double").alias("predicted_price"),
    )
