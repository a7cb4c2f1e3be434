"""Session settings, the shared work folder, and size-checked broadcasting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings every operator relies on to a session the caller made."""
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def get_session(app: str = "tickframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A folder of this machine is used only where none is named and Spark runs in
    local mode; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="tickframe-")
    sc.setCheckpointDir(local)
    return local


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later readers all see the same rows, executors may be lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a side table (lexicon, lemmas, symbol list, summary) is broadcast.
SMALL_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS, *, keep: bool = False) -> DataFrame:
    """Broadcast a side of a join only if counting shows at most ``max_rows`` rows.

    Beyond the bound the frame comes back without a hint, so the join shuffles.
    ``keep`` materialises it first, for summaries that are costly to compute.
    """
    side = materialize(df) if keep else df
    few = side.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(side) if few else side
