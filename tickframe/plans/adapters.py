"""The test tables seen as market data: as Spark frames, and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(digits: int, *cols: str) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in cols]


def day(col: str = "ts") -> Column:
    return F.date_format(col, "yyyy-MM-dd").alias(col)


def sql_rounded(digits: int, *cols: str) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in cols)


SQL_DAY = "strftime(ts, '%Y-%m-%d') as ts"

TICKS = "ticks as (select event_id as tick_id, event_type as symbol, ts, value as price from events)"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tick_id"),
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
    )


DAILY = (
    TICKS + ", bars as (select symbol, date_trunc('day', ts) as ts, arg_min(price, ts) as open, max(price) as high, "
    "min(price) as low, arg_max(price, ts) as close, count(*) as ticks from ticks group by 1, 2)"
)

PRICES = (
    "prices as (select o_orderpriority as symbol, cast(o_orderdate as date) as ts, "
    "round(avg(o_totalprice), 4) as price from orders group by 1, 2)"
)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order value per priority: five long series with natural gaps."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("ts")
    ).agg(F.round(F.avg("o_totalprice"), 4).alias("price"))


BRAND_PRICES = (
    "prices as (select p_brand as symbol, cast(l_shipdate as date) as ts, "
    "round(avg(l_extendedprice), 4) as price from lineitem join part on l_partkey = p_partkey group by 1, 2)"
)


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean item value per brand; brands are the symbols of the coin table."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    joined = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("ts")).agg(
        F.round(F.avg("l_extendedprice"), 4).alias("price")
    )


MARKET = (
    "market as (select cast(p_partkey as varchar) as id, p_name as name, p_brand as symbol, "
    "p_retailprice as current_price, (p_size - 25) / 10.0e0 as price_change_percentage_24h, "
    "m.high_24h, m.low_24h, m.market_cap, m.circulating_supply, m.last_updated "
    "from part left join (select l_partkey, max(l_extendedprice) as high_24h, min(l_extendedprice) as low_24h, "
    "round(sum(l_extendedprice), 2) as market_cap, sum(l_quantity) as circulating_supply, "
    "max(l_shipdate) as last_updated from lineitem group by 1) m on p_partkey = m.l_partkey)"
)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One coin per part, with totals of its line items."""
    totals = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.max("l_extendedprice").alias("high_24h"),
            F.min("l_extendedprice").alias("low_24h"),
            F.round(F.sum("l_extendedprice"), 2).alias("market_cap"),
            F.sum("l_quantity").alias("circulating_supply"),
            F.max("l_shipdate").alias("last_updated"),
        )
    )
    part = table(spark, sf_dir, "part")
    return part.join(totals, part.p_partkey == totals.l_partkey, "left").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("symbol"),
        F.col("p_retailprice").alias("current_price"),
        ((F.col("p_size") - 25) / 10.0).alias("price_change_percentage_24h"),
        "high_24h",
        "low_24h",
        "market_cap",
        "circulating_supply",
        "last_updated",
    )


ANALYSED = MARKET + (
    ", analysed as (select *, price_change_percentage_24h / 100 + 1 as expected_return from market)"
)



def market_json(df: DataFrame) -> DataFrame:
    """Coins as landed records: times are ISO text."""
    return df.withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


UPDATES = (
    "updates as (select cast(l_partkey as varchar) as id, l_extendedprice as current_price, l_quantity as volume, "
    "nullif(l_discount, 0.0) as discount, l_shipdate as last_updated, l_orderkey, l_linenumber, l_suppkey "
    "from lineitem)"
)


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 30 changes per coin; some overwrite a value with NULL."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("id"),
        F.col("l_extendedprice").alias("current_price"),
        F.col("l_quantity").alias("volume"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.col("l_shipdate").alias("last_updated"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
    )


MENTIONS = (
    "mentions as (select doc_id as mention_id, 'Brand#' || cast(doc_id % 25 + 1 as varchar) as symbol, text "
    "from documents)"
)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a mention of a brand."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("mention_id"),
        F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("symbol"),
        "text",
    )
