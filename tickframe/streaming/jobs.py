"""Streaming jobs: snapshot upsert, served view, dedupe, bars that grow with late ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickframe.operators.export import flatten_points
from tickframe.schemas import MARKET_RAW
from tickframe.sources.readers import market_rows
from tickframe.sources.writers import analysed, append_changes, compact

POLL = "5 minutes"


def _trigger(once: bool, interval: str) -> dict:
    return {"availableNow": True} if once else {"processingTime": interval}


def read_market_stream(spark: SparkSession, landing: str, *, max_files: int | None = None) -> DataFrame:
    """Landed records, each with the time and name of its file and the place of its block there (``file``)."""
    reader = spark.readStream.schema(MARKET_RAW)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    place = ("file_modification_time", "file_name", "file_block_start")
    return reader.json(landing).select("*", F.struct(*[f"_metadata.{c}" for c in place]).alias("file"))


def arrival(file: str = "file") -> Column:
    """What orders records as they arrived: file by file, then by place in the file.

    A block of a file is read by one task from its beginning to its end, so ids that grow
    within a task follow the lines of the block however files are packed into tasks.
    """
    return F.struct(f"{file}.*", F.monotonically_increasing_id().alias("line"))


#: Bytes of changes that a task turns into points, which are many times as many.
POINT_BYTES = "4m"


def _write_points(changes: DataFrame, path: str) -> None:
    """The numbers of changes as points, a folder per month.

    The changes are shuffled by month, not their points; every task makes the points of its rows.
    """
    month = lambda ts: F.trunc(F.col(ts).cast("date"), "month")
    by_month = changes.withColumn("month", month("last_updated")).hint("rebalance", "month").drop("month")
    stamped = analysed(by_month).withColumnRenamed("last_updated", "time")
    long = flatten_points(stamped, F.col("id")).where(F.col("value").isNotNull()).drop("text")
    rows = long.withColumn("month", month("time"))
    conf, name = changes.sparkSession.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = conf.get(name, None)
    conf.set(name, POINT_BYTES)
    try:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("month").parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def stream_upsert(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    *,
    points: str | None = None,
    serve: bool = False,
    once: bool = False,
    interval: str = POLL,
    max_files: int | None = None,
) -> StreamingQuery:
    """Landed snapshots to the change log of the latest view, once per batch.

    Every write goes to a place named after the batch, so a retried batch replaces
    its own rows. Of changes with the same ``last_updated`` the one that arrived last wins. ``points`` also keeps the numbers as time-series points, ``serve``
    writes a new version of the view for readers after each batch. Pushed updates
    land in the same kind of folder and take the same way.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = market_rows(batch.withColumn("seq", arrival()), keep=["seq"])
        append_changes(rows, root, batch_id)
        if points:
            log = batch.sparkSession.read.parquet(f"{root}/log/batch_id={int(batch_id)}")
            _write_points(log.drop("seq"), f"{points}/batch_id={int(batch_id)}")
        if serve:
            compact(batch.sparkSession, root)

    return (
        read_market_stream(spark, landing, max_files=max_files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once, interval))
        .start()
    )


def dedupe(stream: DataFrame, *, key: str = "id", ts: str = "last_updated") -> DataFrame:
    """Each ``(key, ts)`` once, however late it comes.

    The pairs seen so far are keyed state without expiry; :func:`stream_dedupe` needs none.
    """
    return stream.dropDuplicates([key, ts])


def _written_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What other batches have written below a folder, if there is any."""
    try:
        return spark.read.parquet(path).where(F.col("batch_id") != batch_id)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing there, or only empty batches
            raise
        return None


def _new_rows(batch: DataFrame, path: str, batch_id: int, ids: Sequence[str], part: str) -> DataFrame:
    """Rows of a batch, each once, whose ``ids`` no other batch has written.

    The store is laid out by ``part``, which follows from the ids: of what was written before,
    only the folders that the batch touches are read.
    """
    once = batch.dropDuplicates([*ids])
    before = _written_before(batch.sparkSession, path, batch_id)
    if before is None:
        return once
    touched = [r[0] for r in once.select(part).distinct().collect()]  # months or hash parts: few by nature
    near = before.where(F.col(part).isin(touched)).select(part, *ids)

    def match(left: str, right: str) -> Column:
        same = F.col(f"{left}.{part}") == F.col(f"{right}.{part}")
        for c in ids:
            same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        return same

    # What was written streams past the ids of the batch, so only the batch is held in memory, and nothing is sorted.
    brought = once.select(part, *ids).hint("shuffle_hash")
    repeated = near.alias("b").join(brought.alias("n"), match("b", "n"), "left_semi")
    return once.alias("n").join(repeated.alias("b"), match("n", "b"), "left_anti")


#: Folders that quarantined records are dealt into by hash.
ASIDE_PARTS = 64


def stream_dedupe(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    *,
    quarantine: str | None = None,
    schema: T.StructType | None = None,
    once: bool = False,
    interval: str = POLL,
    max_files: int | None = None,
) -> StreamingQuery:
    """Landed snapshots, each ``(id, last_updated)`` once, below ``out``, a folder per batch and month.

    The stream keeps no state: what a batch repeats is found in the output itself, of which
    it reads the ids of the months it brings. So a coin heard of for the first time is never
    too late, and nothing grows with the history but the output. A batch run again replaces
    its own folder and does not count as written before.

    Records whose time cannot be read are no repeats of one another: they go whole, as
    JSON text, below ``quarantine`` (``<out>-quarantine`` by default), each text once.
    """
    aside = quarantine or f"{out.rstrip('/')}-quarantine"
    reader = spark.readStream.schema(schema or MARKET_RAW)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.json(landing)
    read = F.try_to_timestamp("last_updated")
    timed = raw.withColumn("_bad", F.when(read.isNull(), F.to_json(F.struct("*")))).withColumn("last_updated", read)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            split(batch, batch_id)
        finally:
            batch.unpersist()

    def split(batch: DataFrame, batch_id: int) -> None:
        month = F.trunc(F.col("last_updated").cast("date"), "month")
        good = batch.where("_bad is null").drop("_bad").withColumn("month", month)
        fresh = _new_rows(good, out, batch_id, ["id", "last_updated"], "month")
        # gathered by month: batches to come open every file of the months they touch
        by_month = fresh.hint("rebalance", "month")
        by_month.write.mode("overwrite").partitionBy("month").parquet(f"{out}/batch_id={int(batch_id)}")
        bad = batch.where("_bad is not null").select("id", F.col("_bad").alias("record"))
        bad = bad.withColumn("part", F.pmod(F.xxhash64("record"), F.lit(ASIDE_PARTS)).cast("int"))
        fresh = _new_rows(bad, aside, batch_id, ["record"], "part")
        by_part = fresh.hint("rebalance", "part")
        by_part.write.mode("overwrite").partitionBy("part").parquet(f"{aside}/batch_id={int(batch_id)}")

    return (
        timed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once, interval))
        .start()
    )


def partial_bars(ticks: DataFrame, interval: str = "1 day", *, key: str = "symbol") -> DataFrame:
    """What a batch of ticks adds to each bar: first and last tick with their order, extremes, count."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    tick = F.struct("ts", "tick_id", "price")
    return timed.groupBy(key, F.window("ts", interval)["start"].alias("start")).agg(
        F.min(F.when(F.col("price").isNotNull(), tick)).alias("first"),
        F.max(F.when(F.col("price").isNotNull(), tick)).alias("last"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.count("price").alias("ticks"),
    )


def merge_bars(parts: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Partial bars of the same interval put together; merging in steps gives the same."""
    return parts.groupBy(key, "start").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("ticks").alias("ticks"),
    )


def read_bars(spark: SparkSession, root: str, *, key: str = "symbol") -> DataFrame:
    """All bars so far, open ones and late ticks included."""
    merged = merge_bars(spark.read.parquet(root), key=key)
    start = F.col("start").cast("timestamp_ntz").alias("ts")
    prices = [F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close")]
    return merged.select(key, start, *prices, "ticks")


def stream_bars(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    interval: str = "1 day",
    *,
    once: bool = False,
    every: str = POLL,
    max_files: int | None = None,
) -> StreamingQuery:
    """Landed parquet ticks ``(tick_id, symbol, ts, price)`` to partial bars, a folder per batch.

    ``read_bars`` merges them. No tick is too late and no bar has to close first; a batch
    that is run again replaces its own folder.
    """
    reader = spark.readStream.schema("tick_id bigint, symbol string, ts timestamp_ntz, price double")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, batch_id: int) -> None:
        partial_bars(batch, interval).write.mode("overwrite").parquet(f"{root}/batch_id={int(batch_id)}")

    return (
        reader.parquet(landing)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once, every))
        .start()
    )
