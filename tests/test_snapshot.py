import pytest
from pyspark.sql import functions as F

from tickframe.functions import prices as P
from tickframe.operators import snapshot as S
from tickframe.operators import stats
from tickframe.schemas import MARKET, conform, contract_errors, nan_to_null, numeric_columns, with_defaults


@pytest.fixture(scope="module")
def coins(spark):
    rows = [
        ("1", "alpha", "AA", 10.0, 2.0, 50.0),
        ("2", "beta", "BB", 20.0, None, 70.0),
        ("3", "gamma", "AA", 30.0, -5.0, None),
        ("4", "AA", "DD", 40.0, 0.0, 70.0),
    ]
    return spark.createDataFrame(
        rows, "id string, name string, symbol string, current_price double, "
        "price_change_percentage_24h double, market_cap double"
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_expected_return(coins):
    out = P.expected_return(coins)
    assert [r.expected_return for r in out.orderBy("id").collect()] == [1.02, None, 0.95, 1.0]
    missing = P.expected_return(coins.drop("price_change_percentage_24h"))
    assert {r.expected_return for r in missing.collect()} == {1.0}


def test_price_path(coins):
    row = P.analyse(coins).where("id = '1'").first()
    assert [row[f"price_day_{d}"] for d in range(1, 8)] == pytest.approx([10 * 1.02**d for d in range(1, 8)])
    long = P.price_path_long(P.analyse(coins)).where("id = '3'").orderBy("day").collect()
    assert [r.price for r in long] == pytest.approx([30 * 0.95**d for d in range(1, 8)])


def test_filters_and_lookup(coins):
    analysed = P.expected_return(coins)
    assert sorted(ids(S.filter_expected_return(analysed))) == ["1", "4"]
    assert ids(S.filter_expected_return(analysed, 1.01)) == ["1"]
    assert ids(S.lookup_symbol(coins, "AA")) == ["4"]
    assert ids(S.lookup_symbol(coins, "nobody")) == []
    assert ids(S.filter_entity(coins, "name", "beta")) == ["2"]
    assert sorted(ids(S.filter_min_rows(coins))) == ["1", "3"]


def test_sort_puts_nulls_last_both_ways(coins):
    assert ids(S.sort_dynamic(coins, "market_cap", "asc")) == ["1", "2", "4", "3"]
    assert ids(S.sort_dynamic(coins, "market_cap", "desc")) == ["2", "4", "1", "3"]
    analysed = P.expected_return(coins)
    assert ids(S.sort_dynamic(analysed, "no such", "sideways")) == ["1", "4", "3", "2"]


def test_pages_concatenate(spark):
    df = spark.range(25).selectExpr("cast(id as string) as id", "if(id % 4 = 0, null, id % 5) as expected_return")
    full = ids(S.sort_dynamic(df))
    assert [x for p in (1, 2, 3, 4) for x in ids(S.page_rows(df, p, 8))] == full
    walked, last = [], None
    rows = S.page_rows(df, 1, 8).collect()
    while rows:
        walked += [r.id for r in rows]
        last = rows[-1]
        rows = S.page_after(df, last.expected_return, last.id, 8).collect()
    assert walked == full
    assert tuple(S.page(df, 1, 5)[1].first()) == (25, 5)
    assert tuple(S.page_totals(df, 8).first()) == (25, 4)
    with pytest.raises(ValueError):
        S.page_rows(df, 0)


def test_page_plan_takes_ordered(coins):
    plan = S.page_rows(coins, 2, 1, "market_cap")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_joins(spark, coins):
    asked = spark.createDataFrame([("AA",), ("gamma",), ("nobody",)], "request string")
    assert sorted(tuple(r) for r in S.resolve_symbols(asked, coins).collect()) == [
        ("AA", "AA"), ("AA", "DD"), ("gamma", "AA"),
    ]
    history = spark.createDataFrame([("AA", 1), ("AA", 2), ("DD", 3)], "symbol string, v int")
    found = S.join_coin_history(asked, coins, history)
    assert sorted((r.request, r.v) for r in found.collect()) == [("AA", 1), ("AA", 2), ("AA", 3), ("gamma", 1), ("gamma", 2)]
    listed = spark.createDataFrame([("AA",), ("ZZ",)], "symbol string")
    assert sorted(ids(S.semi_symbol_list(coins, listed))) == ["1", "3"]
    assert [r.symbol for r in S.anti_missing_symbols(listed, coins).collect()] == ["ZZ"]
    assert sorted(tuple(r) for r in S.non_empty(listed, coins).collect()) == [("AA", True), ("ZZ", False)]


def test_join_plan_has_no_nested_loop(spark, coins):
    asked = spark.createDataFrame([("AA",)], "request string")
    plan = S.resolve_symbols(asked, coins)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_upsert_whole_row_wins(spark):
    log = spark.createDataFrame(
        [("a", 1, 0, 5.0), ("a", 2, 0, None), ("b", 1, 0, 1.0), ("b", 1, 1, 2.0), ("b", 0, 9, 3.0)],
        "id string, last_updated int, seq int, price double",
    )
    latest = S.upsert_latest(log)
    want = [("a", 2, None), ("b", 1, 2.0)]
    assert sorted((r.id, r.last_updated, r.price) for r in latest.collect()) == want
    again = S.upsert_latest(log.union(log).union(latest.select(*log.columns)))
    assert sorted((r.id, r.last_updated, r.price) for r in again.collect()) == want


def test_required(spark):
    df = spark.createDataFrame([("a", 1), (" ", 2), (None, 3), ("b", None)], "symbol string, v int")
    good, bad = S.split_valid(df, ["symbol", "v"])
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert bad.count() == 3


def test_parse_ts(spark):
    texts = ["2024-03-05T10:11:12.345Z", "2024-03-05T10:11:12Z", "2024-03-05T10:11:12+02:00", "garbage", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(P.parse_ts("t").cast("string"), P.parse_date("t").cast("string")).collect()
    assert [r[0] for r in got] == ["2024-03-05 10:11:12", "2024-03-05 10:11:12", "2024-03-05 08:11:12", None, None, None]
    assert [r[1] for r in got[:2]] == ["2024-03-05"] * 2


def test_small_columns(spark):
    df = spark.createDataFrame([([1.5, 2.0], "a b", None, 3.14159), ([], "c", "d", None)], "l array<double>, s string, n string, x double")
    got = df.select(P.first_of_list("l"), P.slug("s"), P.coalesce_name("n", "s"), P.fmt2("x", "$")).collect()
    assert [tuple(r) for r in got] == [(1.5, "a_b", "a b", "$3.14"), (None, "c", "d", None)]
    one = spark.range(1).select(*P.relative_dates(F.lit("2024-03-01"), 30)).first()
    assert tuple(one) == ("2024-01-31", "2024-03-01")
    payload = spark.createDataFrame([('{"a":{"inr":5.0}}', "a"), ('{"a":{"usd":5.0}}', "a"), ("{}", "b")], "p string, id string")
    assert [r[0] for r in payload.select(P.price_from_payload("p", F.col("id"), "inr")).collect()] == [5.0, None, None]


def test_schema_helpers(spark, coins):
    market = conform(P.analyse(coins), MARKET)
    assert market.columns == MARKET.fieldNames() and len(market.columns) == 26
    assert contract_errors(market, MARKET) == []
    assert len(contract_errors(coins, MARKET)) == 20
    assert with_defaults(coins.limit(1), {"extra": 1, "name": "x"}).select("extra", "name").first()[0] == 1
    assert numeric_columns(coins) == ["current_price", "price_change_percentage_24h", "market_cap"]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert nan_to_null(nan).agg(F.max("x"), F.count("x")).first() == (1.0, 1)


def test_corr_matrix(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, None, 7.0), (4.0, 9.0, 7.0)], "a double, b double, c double"
    )
    got = {(r.a, r.b): r["corr"] for r in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "a")] == 1.0 and got[("c", "c")] is None and got[("a", "c")] is None
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(0.9986254, abs=1e-6)


def test_regression_metrics(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 4.0), ("b", 5.0, None)], "symbol string, y double, p double"
    )
    overall = stats.regression_metrics(df, "y", "p").first()
    assert tuple(overall) == pytest.approx((2 / 3, 2 / 3, 1 - 2 / 8, 3))
    per = {r.symbol: r for r in stats.regression_metrics(df, "y", "p", by="symbol").collect()}
    assert per["b"].r2 is None and per["b"].n == 1 and per["a"].r2 == 0.5


def test_acf_and_analysis(series):
    df = series({"a": [1, 2, 3, 4, 5], "flat": [2, 2, 2]})
    got = {(r.symbol, r.lag): r.acf for r in stats.acf(df, 2).collect()}
    assert got[("a", 1)] == pytest.approx(0.4) and got[("a", 2)] == pytest.approx(-0.1)
    assert got[("flat", 1)] is None
    falls = stats.market_analysis(series({"a": [100, 120, 60, 90]})).first()
    assert falls.max_drawdown == 0.5 and falls.momentum == pytest.approx(-0.1) and falls.n == 4


def test_long_term_benefit(spark):
    market = spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.1, 0.1), ("c", 0.0, 0.1)], "symbol string, momentum double, volatility double")
    feeling = spark.createDataFrame([("a", 0.2), ("b", 0.2), ("z", 1.0)], "symbol string, compound_sentiment double")
    got = {r.symbol: r.score for r in stats.long_term_benefit(market, feeling).collect()}
    assert set(got) == {"a", "b"} and got["a"] == pytest.approx(0.5**0.5) and got["b"] == pytest.approx(-(0.5**0.5))
