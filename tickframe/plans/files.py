"""Registered queries that write and read: scans of landed files, sinks, JSON shapes, streams.

Each run writes to a fresh place below the shared folder and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickframe.functions.prices import parse_ts
from tickframe.operators import export as X
from tickframe.operators.bars import ohlc_bars
from tickframe.operators.ml import features, fit_forest
from tickframe.plans.adapters import (
    DAILY,
    MARKET,
    PRICES,
    UPDATES,
    day,
    market,
    market_json,
    prices,
    rounded,
    table,
    ticks,
    updates,
)
from tickframe.plans.registry import query
from tickframe.schemas import PREDICTIONS, PRICE_DAYS, conform
from tickframe.session import work_path
from tickframe.sources import readers as R
from tickframe.sources import writers as W
from tickframe.streaming import jobs

_SHOWN = ("id", "name", "symbol", "current_price", "price_change_percentage_24h", "market_cap", "last_updated")


def _landed_market(spark, sf) -> str:
    path = work_path(spark, "market")
    market_json(market(spark, sf)).write.json(path)
    return path


# --- scans ------------------------------------------------------------------


@query(
    "scan_market_top",
    f"""with {MARKET} select {', '.join(_SHOWN)} from market
    order by market_cap desc nulls last, id limit 250""",
)
def scan_market_top(spark, sf):
    best = R.scan_market_top(spark, _landed_market(spark, sf))
    return best.withColumn("last_updated", parse_ts("last_updated")).select(*_SHOWN)


_CSV = f"with {PRICES} select replace(symbol, ' ', '_') as symbol, strftime(ts, '%Y-%m-%d') as ts, price from prices"


def _csv(spark, sf) -> str:
    path = work_path(spark, "csv")
    W.write_csv_per_symbol(prices(spark, sf).select(F.col("ts").alias("Timestamp"), "price", "symbol"), path)
    return path


@query("scan_csv_prices", _CSV)
def scan_csv_prices(spark, sf):
    return R.scan_prices_csv(spark, _csv(spark, sf)).select("symbol", day(), "price")


@query("write_csv_per_symbol", "with p as (" + _CSV + ") select symbol, count(*) as n, round(sum(price), 2) as total from p group by 1")
def write_csv_per_symbol(spark, sf):
    """What the folder of each symbol holds."""
    back = spark.read.option("header", True).csv(_csv(spark, sf))
    return back.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("price").cast("double")), 2).alias("total")
    )


_RECORD = "id string, name string, current_price double, market_cap double"


@query("scan_json_table", f"with {MARKET} select id, name, current_price, market_cap from market")
def scan_json_table(spark, sf):
    return R.scan_json_table(spark, _landed_market(spark, sf), _RECORD)


@query("write_json", f"with {MARKET} select id, market_cap, market_cap is not null as kept from market")
def write_json(spark, sf):
    """Missing values are written out as null."""
    path = work_path(spark, "json")
    W.write_json(market(spark, sf).select("id", "market_cap"), path)
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", "id string, market_cap double").alias("r"))
    written = ~F.col("value").contains('"market_cap":null')
    return parsed.select("r.id", "r.market_cap", written.alias("kept"))


@query("scan_symbol_list", "select distinct trim(c_mktsegment) as symbol, count(*) as n from customer group by 1")
def scan_symbol_list(spark, sf):
    """Padded names, each followed by a blank line."""
    path = work_path(spark, "symbols")
    line = F.concat(F.lit("  "), "c_mktsegment", F.lit(" \t"))
    lines = table(spark, sf, "customer").select(F.explode(F.array(line, F.lit("   "))).alias("value"))
    lines.write.text(path)
    return R.scan_symbol_list(spark, path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_json_records",
    """with r as (select event_id, cast(json_extract_string(props, '$.k') as double) as k from events)
    select event_id, k, k is not null as valid from r where event_id % 5 <> 0
    union all select event_id, null, false from r""",
)
def parse_json_records(spark, sf):
    """Each text is an array of two records, one without its required field; every fifth is broken."""
    text = F.when(F.col("event_id") % 5 == 0, F.lit("[{oops")).otherwise(
        F.concat(F.lit("["), "props", F.lit(', {"other": 1}]'))
    )
    events = table(spark, sf, "events").select("event_id", text.alias("body"))
    return R.parse_json_records(events, "body", "k double", ["k"], keep=["event_id"])


# --- sinks and shapes -------------------------------------------------------


@query(
    "ensure_table",
    "select o_orderpriority as cryptocurrency, count(*) as n, round(avg(o_totalprice), 4) as predicted_price "
    "from orders group by 1",
)
def ensure_table(spark, sf):
    """Create the prediction table twice, append to it, read it."""
    name, path = f"predictions_{uuid.uuid4().hex}", work_path(spark, "predictions")
    for _ in range(2):
        W.ensure_table(spark, name, PREDICTIONS, path=path)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("cryptocurrency"),
        F.col("o_totalprice").alias("predicted_price"),
    )
    W.append_table(rows, name, PREDICTIONS)
    return spark.table(name).groupBy("cryptocurrency").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("predicted_price"), 4).alias("predicted_price")
    )


@query(
    "append_predictions",
    "select cast(vec_id as varchar) as cryptocurrency, round(cast(embedding[1] as double), 6) as predicted_price "
    "from embeddings",
)
def append_predictions(spark, sf):
    """The first element of each list; the table also holds a stable id."""
    path = work_path(spark, "predictions")
    lists = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("symbol"), "embedding")
    W.append_files(conform(X.prediction_rows(lists, "run-1", price="embedding"), PREDICTIONS), path)
    return spark.read.parquet(path).select("cryptocurrency", *rounded(6, "predicted_price"))


_POINT_FIELDS = ("current_price", "market_cap", "circulating_supply")


@query(
    "flatten_points",
    f"""with {MARKET} select id as measurement, last_updated as time, field, round(value, 4) as value, text from (
        {' union all '.join(
            f"select id, last_updated, '{c}' as field, {c} as value, null as text from market"
            for c in _POINT_FIELDS)}
        union all select id, last_updated, 'range_high', high_24h, null from market
        union all select id, last_updated, 'range_low', low_24h, null from market
        union all select id, last_updated, 'quote_inr', current_price, null from market
        union all select id, last_updated, 'name', null, name from market) p
    where value is not null or text is not null""",
)
def flatten_points(spark, sf):
    """Plain cells, a struct cell and a map cell."""
    coins = market(spark, sf).select(
        "id",
        F.col("last_updated").alias("time"),
        *_POINT_FIELDS,
        "name",
        F.struct(F.col("high_24h").alias("high"), F.col("low_24h").alias("low")).alias("range"),
        F.create_map(F.lit("inr"), F.col("current_price")).alias("quote"),
    )
    points = X.flatten_points(coins, F.col("id")).where("field <> 'id'")
    return points.select("measurement", "time", "field", *rounded(4, "value"), "text")


@query(
    "json_iso",
    """select o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderdate":"' ||
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","o_comment":null}' as json from orders""",
)
def json_iso(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.lit(None).cast("string").alias("o_comment"))
    return X.json_rows(orders, keep=["o_orderkey"])


@query(
    "records_json",
    f"""with {MARKET} select id, cast(to_json({{'id': id, 'name': name, 'symbol': symbol,
    'current_price': current_price}}) as varchar) as json from market""",
)
def records_json(spark, sf):
    rows = market(spark, sf).select("id", "name", "symbol", "current_price")
    return X.json_rows(rows, keep=["id"])


@query(
    "columnar_json",
    f"""with {DAILY} select symbol, cast(floor(epoch(ts) / 864000) as bigint) as part, cast(to_json({{'ts': list(strftime(ts, '%Y-%m-%dT%H:%M:%S') order by ts),
    'open': list(open order by ts), 'high': list(high order by ts), 'low': list(low order by ts),
    'close': list(close order by ts)}}) as varchar) as json from bars group by 1, 2""",
)
def columnar_json(spark, sf):
    bars = ohlc_bars(ticks(spark, sf), "1 day")
    return X.columnar_json(bars, ["open", "high", "low", "close"], step_seconds=86_400, points=10)


@query("save_model")
def save_model(spark, sf):
    """Predictions of a forest that was written and read back."""
    from pyspark.ml.regression import RandomForestRegressionModel

    path = work_path(spark, "model")
    data = features(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    fit_forest(data, numTrees=50, maxDepth=6).write().overwrite().save(path)
    scored = RandomForestRegressionModel.load(path).transform(data)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 2).alias("mean_prediction"))


# --- streams ----------------------------------------------------------------


POLLS = 5
#: Files of the poll that repeats all changes: as many as the others have together.
AGAIN_FILES = 2 * POLLS


def _land_updates(spark, sf) -> str:
    """All raw changes in polls that do not follow their times, landed one after another.

    A poll holds the orders of one remainder; within it a coin's changes are in one file, by
    order and line. So arrival is by remainder, order, line, and equal times are common.
    """
    path = work_path(spark, "updates")
    rows = updates(spark, sf)
    order = ("l_orderkey", "l_linenumber", "l_suppkey", "current_price")
    for poll in range(POLLS):
        landed = rows.where(F.col("l_orderkey") % POLLS == poll).repartition(2, "id").sortWithinPartitions(*order)
        landed.select(
            "id",
            "current_price",
            F.col("volume").alias("circulating_supply"),
            F.col("discount").alias("price_change_percentage_24h"),
            F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_updated"),
        ).write.mode("append").json(path)
    return path


_LATEST = f"""{UPDATES}, latest as (select * from updates qualify row_number() over (partition by id order by
    last_updated desc, l_orderkey % {POLLS} desc, l_orderkey desc, l_linenumber desc, l_suppkey desc,
    current_price desc) = 1)"""
_LATEST_SQL = f"""with {_LATEST} select id, current_price, volume as circulating_supply, last_updated,
    round(discount / 100 + 1, 6) as expected_return,
    round(current_price * pow(discount / 100 + 1, 7), 3) as price_day_7 from latest"""


def _latest_columns(df):
    return df.select(
        "id",
        "current_price",
        "circulating_supply",
        "last_updated",
        *rounded(6, "expected_return"),
        *rounded(3, "price_day_7"),
    )


def _run_upserts(spark, sf, **options) -> tuple[str, str]:
    root = work_path(spark, "coins")
    points = f"{root}/points"
    jobs.stream_upsert(
        spark, _land_updates(spark, sf), root, f"{root}/checkpoint", points=points, once=True, max_files=1, **options
    ).awaitTermination()
    return root, points


@query("stream_snapshot_upsert", _LATEST_SQL)
def stream_snapshot_upsert(spark, sf):
    """The latest view after every landed file has gone through the stream."""
    root, _ = _run_upserts(spark, sf)
    return _latest_columns(W.read_latest(spark, root))


_DAYS = range(1, PRICE_DAYS + 1)


@query(
    "ingest_updates",
    f"""with {UPDATES}
    select field, count(*) as n, round(sum(value), 2) as total from (
        select 'current_price' as field, current_price as value from updates
        union all select 'circulating_supply', volume from updates
        union all select 'price_change_percentage_24h', discount from updates where discount is not null
        union all select 'expected_return', discount / 100 + 1 from updates where discount is not null
        {" ".join(f"union all select 'price_day_{d}', current_price * pow(discount / 100 + 1, {d}) from updates "
                  "where discount is not null" for d in _DAYS)}) p group by 1""",
)
def ingest_updates(spark, sf):
    """The points that pushed updates leave behind, all fields of all changes."""
    _, points = _run_upserts(spark, sf)
    rows = W.read_points(spark, points)
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("stream_cached_view", _LATEST_SQL)
def stream_cached_view(spark, sf):
    """The newest version written for readers."""
    root, _ = _run_upserts(spark, sf, serve=True)
    return _latest_columns(W.read_version(spark, root))


@query("stream_dedupe", "select distinct cast(l_partkey as varchar) as id, l_shipdate as last_updated from lineitem")
def stream_dedupe(spark, sf):
    """Every line item is a poll, landed out of time order; ``(id, last_updated)`` arrive many times."""
    landing, out = _land_updates(spark, sf), work_path(spark, "deduped")

    def take() -> None:
        jobs.stream_dedupe(spark, landing, out, f"{out}-checkpoint", once=True, max_files=1).awaitTermination()

    take()
    again = F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_updated")
    updates(spark, sf).select("id", "current_price", again).coalesce(AGAIN_FILES).write.mode("append").json(landing)
    take()
    return spark.read.parquet(out).select("id", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


@query("stream_ohlc_bars", f"with {DAILY} select symbol, ts, open, high, low, close, ticks from bars")
def stream_ohlc_bars(spark, sf):
    """All bars, the last day's included, from ticks that come in five batches out of time order."""
    landing, out = work_path(spark, "ticks"), work_path(spark, "bars")
    for part in range(POLLS):
        ticks(spark, sf).where(F.col("tick_id") % POLLS == part).write.mode("append").parquet(landing)
    jobs.stream_bars(spark, landing, out, f"{out}-checkpoint", "1 day", once=True, max_files=1).awaitTermination()
    return jobs.read_bars(spark, out)
