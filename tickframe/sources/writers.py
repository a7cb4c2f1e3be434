"""Sinks: tables on contract, files per symbol, and the keyed latest view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions.prices import analyse, slug
from tickframe.operators.snapshot import upsert_latest
from tickframe.schemas import DERIVED, MARKET, conform, contract_errors


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, *, path: str | None = None) -> DataFrame:
    """Create a parquet table unless it is there, and check it against the schema."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{place}")
    table = spark.table(name)
    errors = contract_errors(table, schema)
    if errors:
        raise ValueError(f"table {name} is off contract: {'; '.join(errors)}")
    return table


def append_table(df: DataFrame, name: str, schema: T.StructType) -> None:
    conform(df, schema).write.mode("append").insertInto(name)


def append_files(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_csv_per_symbol(df: DataFrame, path: str, *, key: str = "symbol") -> None:
    """CSV files below one folder per symbol, blanks in its name turned into ``_``.

    Rows are gathered by symbol, and a symbol too large for one task is split at run time:
    so a symbol has as many files as its size asks for, not one per task that met it.
    """
    named = df.withColumn(key, slug(key)).hint("rebalance", key)
    named.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_dated(
    df: DataFrame, path: str, by: Sequence[str] = (), *, ts: str = "ts", span: str = "day", mode: str = "append"
) -> None:
    """Rows laid out by ``by`` and the day (``date``) or month (``month``) of ``ts``, so that range reads skip folders.

    Choose months where a day brings few rows: a folder should hold megabytes.
    """
    name = {"day": "date", "month": "month"}[span]
    dated = df.withColumn(name, F.trunc(F.col(ts).cast("date"), "month") if span == "month" else F.col(ts).cast("date"))
    dated.hint("rebalance", *by, name).write.mode(mode).partitionBy(*by, name).parquet(path)


def write_points(points: DataFrame, path: str, *, mode: str = "append") -> None:
    """Points, laid out by measurement and day."""
    write_dated(points, path, ["measurement"], ts="time", mode=mode)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- keyed latest view ------------------------------------------------------
#
# <root>/log/batch_id=<n>   the changes of batch n; writing it again replaces it
# <root>/base/version=<n>   the latest view after batch n; valid once _SUCCESS is there
#
# What follows from a row (expected return, price path) is not kept but worked out when it is read.


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the committed folders ``<prefix>=<n>`` below a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{prefix}=") and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


_ANALYSED = {"current_price", "price_change_percentage_24h"}


def _landed(df: DataFrame) -> DataFrame:
    """Rows of the coin table without the columns that follow from others; other tables as they are."""
    return df.drop(*DERIVED) if _ANALYSED <= set(df.columns) else df


def analysed(df: DataFrame) -> DataFrame:
    """Rows of the coin table with all its columns, in its order; other tables as they are."""
    if not _ANALYSED <= set(df.columns):
        return df
    full = analyse(df)
    first = [c for c in MARKET.names if c in full.columns]
    return full.select(*first, *[c for c in full.columns if c not in first])


def append_changes(df: DataFrame, root: str, batch_id: int) -> None:
    """Add one batch of changes; a retry of the batch replaces what it wrote before."""
    kept = _landed(df).write.mode("overwrite").option("compression", "zstd")
    kept.parquet(f"{root}/log/batch_id={int(batch_id)}")


def committed_version(spark: SparkSession, root: str) -> int | None:
    versions = _numbers(spark, f"{root}/base", "version")
    return versions[-1] if versions else None


def read_latest(
    spark: SparkSession, root: str, *, key: str = "id", order: Sequence[str] = ("last_updated", "batch_id", "seq")
) -> DataFrame:
    """Latest row of each key: the newest committed base and the changes after it."""
    version = committed_version(spark, root)
    newer = [n for n in _numbers(spark, f"{root}/log", "batch_id") if version is None or n > version]
    parts = []
    if version is not None:
        parts.append(_landed(spark.read.parquet(f"{root}/base/version={version}")))
    if newer:
        folders = [f"{root}/log/batch_id={n}" for n in newer]
        changes = spark.read.option("basePath", f"{root}/log").parquet(*folders)
        parts.append(_landed(changes).withColumn("batch_id", F.col("batch_id").cast("long")))
    if not parts:
        raise FileNotFoundError(f"no committed batch below {root}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return analysed(rows if not newer else upsert_latest(rows, key=key, order=order))


def compact(spark: SparkSession, root: str, **options) -> int:
    """Write the latest view as a new version; the one being read stays untouched."""
    batches = _numbers(spark, f"{root}/log", "batch_id")
    version = batches[-1]
    if committed_version(spark, root) != version:
        kept = _landed(read_latest(spark, root, **options)).write.mode("overwrite").option("compression", "zstd")
        kept.parquet(f"{root}/base/version={version}")
    return version


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed version as it was written, without the changes after it."""
    version = committed_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no committed version below {root}")
    return analysed(spark.read.parquet(f"{root}/base/version={version}"))
