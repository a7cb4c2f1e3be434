"""What the queries of this package share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tickframe

#: Rows of a batch that Spark hands to Python: bounds a worker's memory.
BATCH_ROWS = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the executors, once per application, as they may not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(tickframe.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tickframe-")) / "tickframe.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, Path(top.name) / path.relative_to(top))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each made longer until the frame has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
