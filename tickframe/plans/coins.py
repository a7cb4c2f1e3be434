"""Registered queries on the coin table: columns, filters, sorting, joins, latest view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.functions import prices as P
from tickframe.operators import snapshot as S
from tickframe.operators.bars import date_range
from tickframe.operators.impute import fill_zero, minmax_apply, minmax_fit
from tickframe.operators.stats import corr_matrix, regression_metrics
from tickframe.plans.adapters import (
    ANALYSED,
    MARKET,
    PRICES,
    UPDATES,
    day,
    market,
    prices,
    rounded,

    table,
    updates,
)
from tickframe.plans.registry import query
from tickframe.schemas import numeric_columns

_DAYS = [f"price_day_{d}" for d in range(1, 8)]
#: Compounded prices often end in an exact half at the sixth decimal; both engines
#: add this much before rounding, so that the last bit does not decide.
_OFF_HALF = 1e-9


def _analysed(spark, sf):
    return P.expected_return(market(spark, sf))


@query(
    "simple_price_lookup",
    f"""with {MARKET}, asked as (select distinct cast(l_partkey * 2 as varchar) as id from lineitem)
    select a.id, m.current_price as price, m.current_price is not null as found
    from asked a left join market m on a.id = m.id""",
)
def simple_price_lookup(spark, sf):
    """Each coin's payload is a nested JSON map; ids asked for beyond the list stay without a price."""
    coins = market(spark, sf)
    payload = F.to_json(F.create_map("id", F.create_map(F.lit("inr"), F.col("current_price"))))
    landed = coins.select("id", payload.alias("payload"))
    priced = landed.select("id", P.price_from_payload("payload", F.col("id"), "inr").alias("price"))
    asked = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).cast("string").alias("id"))
    return S.lookup_prices(asked, priced)


@query("scan_table", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def scan_table(spark, sf):
    from tickframe.sources.readers import scan_table as scan

    table(spark, sf, "customer").createOrReplaceTempView("tickframe_coins")
    return scan(spark, "tickframe_coins")


@query(
    "expected_return",
    f"with {ANALYSED} select id, round(expected_return, 6) as expected_return from analysed",
)
def expected_return(spark, sf):
    return _analysed(spark, sf).select("id", *rounded(6, "expected_return"))


@query(
    "price_path",
    f"""with {ANALYSED} select id, {', '.join(
        f'round(current_price * pow(expected_return, {d}) + {_OFF_HALF}, 6) as price_day_{d}' for d in range(1, 8))}
    from analysed""",
)
def price_path(spark, sf):
    return P.price_path(_analysed(spark, sf)).select(
        "id", *[F.round(F.col(c) + _OFF_HALF, 6).alias(c) for c in _DAYS]
    )


@query(
    "price_path_long",
    f"""with {ANALYSED}, days as (select cast(unnest(range(1, 8)) as integer) as day)
    select id, day, round(current_price * pow(expected_return, day) + {_OFF_HALF}, 6) as price from analysed, days""",
)
def price_path_long(spark, sf):
    return P.price_path_long(P.price_path(_analysed(spark, sf))).select(
        "id", "day", F.round(F.col("price") + _OFF_HALF, 6).alias("price")
    )


@query("select_columns", f"with {MARKET} select name, symbol from market")
def select_columns(spark, sf):
    return market(spark, sf).select("name", "symbol")


@query(
    "rename_drop",
    'select o_orderkey as "timestamp", o_totalprice as price, o_orderpriority from orders',
)
def rename_drop(spark, sf):
    orders = table(spark, sf, "orders")
    renamed = orders.withColumnsRenamed({"o_totalprice": "price", "o_orderkey": "timestamp"})
    return renamed.drop("o_custkey", "o_orderstatus", "o_orderdate")


@query(
    "numeric_only",
    "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem",
)
def numeric_only(spark, sf):
    items = table(spark, sf, "lineitem")
    return items.select(*numeric_columns(items))


@query(
    "parse_ts",
    "select o_orderkey, o_orderdate as ts, strftime(o_orderdate, '%Y-%m-%d') as day, "
    "o_orderkey % 3 <> 2 as parsed from orders where o_orderkey % 3 <> 2 "
    "union all select o_orderkey, null, null, false from orders where o_orderkey % 3 = 2",
)
def parse_ts(spark, sf):
    """ISO text with a fraction, without one, and garbage."""
    kind = F.col("o_orderkey") % 3
    text = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.concat(F.lit("on "), F.date_format("o_orderdate", "dd/MM/yyyy")))
    )
    raw = table(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    return raw.select(
        "o_orderkey",
        P.parse_ts("text").alias("ts"),
        F.date_format(P.parse_date("text"), "yyyy-MM-dd").alias("day"),
        P.parse_ts("text").isNotNull().alias("parsed"),
    )


@query(
    "coalesce_name",
    "select p_partkey, case when p_size > 25 then p_name else p_brand end as label from part",
)
def coalesce_name(spark, sf):
    part = table(spark, sf, "part").withColumn("long_name", F.when(F.col("p_size") > 25, F.col("p_name")))
    return part.select("p_partkey", P.coalesce_name("long_name", "p_brand").alias("label"))


@query("slug", "select p_partkey, replace(p_name, ' ', '_') as slug from part")
def slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", P.slug("p_name").alias("slug"))


@query(
    "first_of_list",
    "select vec_id, round(cast(embedding[1] as double), 6) as first from embeddings",
)
def first_of_list(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(P.first_of_list("embedding"), 6).alias("first"))


@query(
    "fill_zero",
    f"""with {MARKET} select id, coalesce(market_cap, 0) as market_cap,
    coalesce(circulating_supply, 0) as circulating_supply, symbol from market""",
)
def fill_zero_query(spark, sf):
    cols = ["market_cap", "circulating_supply"]
    return fill_zero(market(spark, sf), cols).select("id", *cols, "symbol")


@query(
    "fmt2",
    f"with {MARKET} select id, printf('%.2f', current_price) as price, '₹' || printf('%.2f', market_cap) as cap from market",
)
def fmt2(spark, sf):
    return market(spark, sf).select("id", P.fmt2("current_price").alias("price"), P.fmt2("market_cap", "₹").alias("cap"))


@query(
    "relative_dates",
    "select o_orderkey, strftime(o_orderdate - interval 30 day, '%Y-%m-%d') as since, "
    "strftime(o_orderdate, '%Y-%m-%d') as until from orders",
)
def relative_dates(spark, sf):
    since, until = P.relative_dates("o_orderdate", 30)
    return table(spark, sf, "orders").select("o_orderkey", since.alias("since"), until.alias("until"))


# --- filters, sorting, paging -----------------------------------------------


@query(
    "filter_expected_return",
    f"with {ANALYSED} select id, round(expected_return, 6) as expected_return from analysed where expected_return >= 1",
)
def filter_expected_return(spark, sf):
    kept = S.sort_expected_return(S.filter_expected_return(_analysed(spark, sf)))
    return kept.select("id", *rounded(6, "expected_return"))


@query(
    "lookup_symbol",
    f"""with {MARKET} select id, name, symbol, market_cap from market
    where name = 'Brand#7' or symbol = 'Brand#7' order by market_cap desc nulls last, id limit 1""",
)
def lookup_symbol(spark, sf):
    return S.lookup_symbol(market(spark, sf), "Brand#7").select("id", "name", "symbol", "market_cap")


@query("filter_entity", f"with {MARKET} select id, name, current_price from market where symbol = 'Brand#3'")
def filter_entity(spark, sf):
    return S.filter_entity(market(spark, sf), "symbol", "Brand#3").select("id", "name", "current_price")


@query(
    "filter_date_range",
    "select o_orderkey, o_orderdate, o_totalprice from orders "
    "where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1998-07-15'",
)
def filter_date_range(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return date_range(orders, "1996-03-01", "1998-07-15", ts="o_orderdate")


@query(
    "filter_min_rows",
    "select o_orderkey, o_custkey from orders where o_custkey in "
    "(select o_custkey from orders group by 1 having count(*) > 9)",
)
def filter_min_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.filter_min_rows(orders, "o_custkey", 9)


@query(
    "validate_required",
    f"with {MARKET} select id, market_cap, market_cap is not null and last_updated is not null as valid from market",
)
def validate_required(spark, sf):
    flagged = S.flag_required(market(spark, sf), ["id", "name", "market_cap", "last_updated"])
    return flagged.select("id", "market_cap", "valid")


@query(
    "non_empty",
    "select c_custkey * 2 as symbol, exists (select 1 from orders where o_custkey = c_custkey * 2) as has_data "
    "from customer",
)
def non_empty(spark, sf):
    """Doubled keys: about half of them are nobody's."""
    asked = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("symbol"))
    return S.non_empty(asked, table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol")))


@query(
    "sort_dynamic",
    f"with {MARKET} select id, circulating_supply, current_price from market",
)
def sort_dynamic(spark, sf):
    coins = market(spark, sf).select("id", "circulating_supply", "current_price")
    return S.sort_dynamic(coins, "circulating_supply", "asc")


@query(
    "sort_expected_return",
    f"with {ANALYSED} select id, round(expected_return, 6) as expected_return, current_price from analysed",
)
def sort_expected_return(spark, sf):
    rows = S.sort_expected_return(_analysed(spark, sf))
    return rows.select("id", *rounded(6, "expected_return"), "current_price")


_PAGE = 7


@query(
    "page",
    f"""select l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    (select count(*) from lineitem) as total, (select cast(ceil(count(*) / 100.0) as bigint) from lineitem) as pages
    from lineitem order by l_extendedprice desc nulls last, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate
    limit 100 offset {(_PAGE - 1) * 100}""",
)
def page(spark, sf):
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    rows, totals = S.page(table(spark, sf, "lineitem"), _PAGE, 100, "l_extendedprice", "desc", tie=tie)
    count = totals.select(F.struct("total", "pages").alias("t")).scalar()
    shown = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").withColumn("_t", count)
    return shown.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "_t.total", "_t.pages")


@query(
    "top_k",
    f"with {MARKET} select id, market_cap from market order by market_cap desc nulls last, id limit 250",
)
def top_k(spark, sf):
    return S.top_k(market(spark, sf), "market_cap", 250).select("id", "market_cap")


@query("first_row", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5")
def first_row(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return S.top_k(orders, "o_totalprice", 5, tie="o_orderkey")


# --- joins ------------------------------------------------------------------

_REQUESTS = (
    "requests as (select distinct p_brand as request from part where p_size < 10 "
    "union select distinct p_name from part where p_size > 45 union select 'nobody')"
)


@query(
    "join_coin_history",
    f"""with {MARKET}, {_REQUESTS}, resolved as (
        select distinct request, symbol from requests join market on request = name or request = symbol),
    history as (select p_brand as symbol, cast(l_shipdate as date) as d, max(l_extendedprice) as high,
        min(l_extendedprice) as low from lineitem join part on l_partkey = p_partkey group by 1, 2)
    select request, symbol, count(*) as bars, round(max(high), 2) as high, round(min(low), 2) as low
    from resolved join history using (symbol) group by 1, 2""",
)
def join_coin_history(spark, sf):
    part, items = table(spark, sf, "part"), table(spark, sf, "lineitem")
    asked = (
        part.where("p_size < 10")
        .select(F.col("p_brand").alias("request"))
        .union(part.where("p_size > 45").select("p_name"))
        .union(spark.range(1).select(F.lit("nobody")))
    )
    daily = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("d")
    )
    history = daily.agg(F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"))
    rows = S.join_coin_history(asked, market(spark, sf), history)
    return rows.groupBy("request", "symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.round(F.max("high"), 2).alias("high"), F.round(F.min("low"), 2).alias("low")
    )


@query(
    "semi_symbol_list",
    "select o_orderkey, o_custkey as symbol from orders where o_custkey in "
    "(select c_custkey from customer where c_mktsegment = 'MACHINERY')",
)
def semi_symbol_list(spark, sf):
    wanted = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("symbol"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("symbol"))
    return S.semi_symbol_list(orders, wanted).select("o_orderkey", "symbol")


@query(
    "anti_missing_symbols",
    "select c_custkey * 2 as symbol from customer where c_custkey * 2 not in (select o_custkey from orders)",
)
def anti_missing_symbols(spark, sf):
    """Doubled keys: about half of them are nobody's."""
    asked = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("symbol"))
    return S.anti_missing_symbols(asked, table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol")))


# --- aggregates and the latest view -----------------------------------------


@query("distinct_names", f"with {MARKET} select distinct name from market")
def distinct_names(spark, sf):
    return S.distinct_names(market(spark, sf)).orderBy("name")


@query("count_total", "select count(*) as total from lineitem")
def count_total(spark, sf):
    return S.count_total(table(spark, sf, "lineitem"))


_ORDER = ["last_updated", "l_orderkey", "l_linenumber", "l_suppkey", "current_price"]


@query(
    "upsert_latest",
    f"""with {UPDATES} select id, current_price, volume, discount, last_updated from updates
    qualify row_number() over (partition by id order by {', '.join(f'{c} desc' for c in _ORDER)}) = 1""",
)
def upsert_latest(spark, sf):
    latest = S.upsert_latest(updates(spark, sf), key="id", order=_ORDER)
    return latest.select("id", "current_price", "volume", "discount", "last_updated")


@query(
    "latest_per_symbol",
    f"with {PRICES} select symbol, strftime(max(ts), '%Y-%m-%d') as ts, arg_max(price, ts) as price from prices group by 1",
)
def latest_per_symbol(spark, sf):
    return S.latest_per_symbol(prices(spark, sf), ["price"]).select("symbol", day(), "price")


_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql() -> str:
    cells = [f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from x" for a in _METRICS for b in _METRICS]
    empty = [f"select '{a}', '{b}', cast(null as double)" for c in _METRICS for a, b in ((c, "fixed"), ("fixed", c))]
    empty.append("select 'fixed', 'fixed', cast(null as double)")
    return f"with x as (select {', '.join(_METRICS)} from lineitem) {' union all '.join(cells + empty)}"


@query("corr_matrix", _corr_sql())
def corr_matrix_query(spark, sf):
    """All pairs, with a column that does not vary."""
    rows = table(spark, sf, "lineitem").withColumn("fixed", F.lit(7.0))
    return corr_matrix(rows, [*_METRICS, "fixed"]).select("a", "b", *rounded(6, "corr"))


_ERRORS = """round(avg(abs(y - yhat)), 4) as mae, round(avg((y - yhat) * (y - yhat)), 2) as mse,
    round(1 - avg((y - yhat) * (y - yhat)) / nullif(var_pop(y), 0), 6) as r2, count(*) as n"""
_FIT = "x as (select l_returnflag as symbol, l_extendedprice as y, l_quantity * 1500.0 as yhat from lineitem)"


def _fitted(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500.0).alias("yhat"),
    )


def _error_columns():
    return [*rounded(4, "mae"), *rounded(2, "mse"), *rounded(6, "r2"), "n"]


@query("regression_metrics", f"with {_FIT} select {_ERRORS} from x")
def regression_metrics_query(spark, sf):
    return regression_metrics(_fitted(spark, sf), "y", "yhat").select(*_error_columns())


@query("regression_metrics_by_symbol", f"with {_FIT} select symbol, {_ERRORS} from x group by symbol")
def regression_metrics_by_symbol(spark, sf):
    return regression_metrics(_fitted(spark, sf), "y", "yhat", by="symbol").select("symbol", *_error_columns())


@query(
    "minmax_stats",
    f"select {', '.join(f'min({c}) as {c}_min, max({c}) as {c}_max' for c in _METRICS)} from lineitem",
)
def minmax_stats(spark, sf):
    return minmax_fit(table(spark, sf, "lineitem"), _METRICS)


@query(
    "minmax_scale",
    f"""with b as (select {', '.join(f'min({c}) as {c}_min, max({c}) as {c}_max' for c in _METRICS)} from lineitem)
    select l_orderkey, l_linenumber, {', '.join(
        f'round(({c} - {c}_min) / ({c}_max - {c}_min), 6) as {c}' for c in _METRICS)}, 0.0::double as fixed
    from lineitem, b""",
)
def minmax_scale(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("fixed", F.lit(7.0))
    cols = [*_METRICS, "fixed"]
    scaled = minmax_apply(rows, minmax_fit(rows, cols), cols)
    return scaled.select("l_orderkey", "l_linenumber", *rounded(6, *cols))


