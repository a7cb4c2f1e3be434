"""Registered queries on splits, model fitting, parameter search and forecasts."""

from __future__ import annotations

from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from tickframe.operators import forecast as FC
from tickframe.operators import forests as FO
from tickframe.operators import ml
from tickframe.operators import search as SE
from tickframe.operators import splits as SP
from tickframe.operators.stats import regression_metrics
from tickframe.plans.adapters import BRAND_PRICES, PRICES, brand_prices, day, prices, rounded, table
from tickframe.plans.registry import query

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_X = ["l_quantity", "l_discount", "l_tax"]
_Y = "l_extendedprice"


def _items(spark, sf):
    return table(spark, sf, "lineitem").select(*_KEYS, *_X)


_IDS = _KEYS[:4]


def _sql_hash(ids, seed: int) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(ids)}, '{seed}')), 1, 8) as bigint)"


def _folded(spark, sf, k: int, inner: int | None = None):
    keyed = SP.hash_fold(_items(spark, sf), k, _IDS, 7)
    return keyed.withColumn("inner", (SP.row_hash(_IDS, 8) % inner).cast("int")) if inner else keyed


def _vectors(folded, xs=tuple(_X)):
    return ml.features(folded, list(xs), _Y, keep=["fold"])


def _line():
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="features", labelCol="label", solver="normal")


def solve_sql(source: str, p: int, out: str) -> str:
    """Common table expressions that solve ``p`` normal equations per row of ``source``.

    ``source`` has the columns ``m_i_j`` (i <= j) and ``r_i``; ``out`` adds ``b_i``. Elimination
    and back substitution, written out.
    """
    steps, now = [], source
    for k in range(p):
        changed = [f"m_{i}_{j} - m_{k}_{i} * m_{k}_{j} / m_{k}_{k} as m_{i}_{j}" for i in range(k + 1, p) for j in range(i, p)]
        changed += [f"r_{i} - m_{k}_{i} * r_{k} / m_{k}_{k} as r_{i}" for i in range(k + 1, p)]
        if changed:
            steps.append(f"{out}_{k} as (select * replace ({', '.join(changed)}) from {now})")
            now = f"{out}_{k}"
    for k in reversed(range(p)):
        known = "".join(f" - m_{k}_{j} * b_{j}" for j in range(k + 1, p))
        name = out if k == 0 else f"{out}_back_{k}"
        steps.append(f"{name} as (select *, (r_{k}{known}) / m_{k}_{k} as b_{k} from {now})")
        now = name
    return ",\n    ".join(steps)


def _ridge_sql(k: int, regs, inner: int = 1) -> str:
    """SQL for R2 of ridge regressions on all three features, from sums of products.

    ``outer_scores`` has a row per fold and setting; ``inner_scores`` the mean over the inner
    folds of the rows outside of that fold.
    """
    p = len(_X)
    sums = ["n", *(f"s_{i}" for i in range(p)), "s_y", *(f"p_{i}_{j}" for i in range(p) for j in range(i, p))]
    sums += [*(f"p_{i}_y" for i in range(p)), "p_yy"]
    added = ", ".join(f"sum({c}) as {c}" for c in sums)
    made = ["count(*) as n", *(f"sum(x{i}) as s_{i}" for i in range(p)), "sum(y) as s_y", "sum(y * y) as p_yy"]
    made += [f"sum(x{i} * x{j}) as p_{i}_{j}" for i in range(p) for j in range(i, p)] + [f"sum(x{i} * y) as p_{i}_y" for i in range(p)]

    def scored(name: str, keys: str) -> str:
        system = [
            f"(p_{i}_{j} / n - s_{i} * s_{j} / (n * n)){' * (1 + reg)' if i == j else ''} as m_{i}_{j}" for i in range(p) for j in range(i, p)
        ] + [f"p_{i}_y / n - s_{i} * s_y / (n * n) as r_{i}" for i in range(p)]
        slope = " + ".join(f"b_{i} * s_{i}" for i in range(p))
        cross = " + ".join(f"b_{i} * p_{i}_y" for i in range(p))
        square = " + ".join(f"{'' if i == j else '2 * '}b_{i} * b_{j} * p_{i}_{j}" for i in range(p) for j in range(i, p))
        sse = f"p_yy - 2 * (a * s_y + {cross}) + n * a * a + 2 * a * ({slope}) + {square}"
        return f"""{name}_sys as (select *, {', '.join(system)} from {name}_train, settings),
    {solve_sql(f"{name}_sys", p, f"{name}_fit")},
    {name}_line as (select {keys}, setting, (s_y - ({slope})) / n as a, {', '.join(f'b_{i}' for i in range(p))} from {name}_fit),
    {name}_each as (select {keys}, setting, 1 - ({sse}) / (p_yy - s_y * s_y / n) as score
        from {name}_line join {name}_test using ({keys}))"""

    listed = ", ".join(f"({i}, {reg!r}e0)" if "e" not in repr(reg) else f"({i}, {reg!r})" for i, reg in enumerate(regs))
    return f"""rows as (select {_Y} as y, {', '.join(f'{x} as x{i}' for i, x in enumerate(_X))}, {_sql_hash(_IDS, 7)} % {k} as fold,
        {_sql_hash(_IDS, 8)} % {inner} as inner_fold from lineitem),
    cells as (select fold, inner_fold, {', '.join(made)} from rows group by 1, 2),
    settings as (select * from (values {listed}) t(setting, reg)),
    folds as (select distinct fold as f from cells), parts as (select distinct inner_fold as g from cells),
    outer_train as (select f, {added} from cells, folds where fold <> f group by f),
    outer_test as (select fold as f, {added} from cells group by fold),
    {scored("outer", "f")},
    outer_scores as (select * from outer_each),
    inner_train as (select f, g, {added} from cells, folds, parts where fold <> f and inner_fold <> g group by f, g),
    inner_test as (select f, inner_fold as g, {added} from cells, folds where fold <> f group by f, inner_fold),
    {scored("inner", "f, g")},
    inner_scores as (select f, setting, avg(score) as score from inner_each group by f, setting)"""


# --- splits -----------------------------------------------------------------


@query(
    "train_test_split",
    f"""select o_orderkey, o_totalprice, case when {_sql_hash(["o_orderkey"], 42)} < round(0.2 * 4294967296)
    then 'test' else 'train' end as split from orders""",
)
def train_test_split(spark, sf):
    """Which orders are held out."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return SP.train_test_split(orders, "o_orderkey", 0.2, 42)


@query(
    "kfold_assign",
    f"""select {', '.join(_KEYS[:4])}, cast(ntile(5) over (order by {', '.join(_KEYS)}) - 1 as integer) as fold
    from lineitem""",
)
def kfold_assign(spark, sf):
    folds = SP.kfold(table(spark, sf, "lineitem").select(*_KEYS), 5, _KEYS)
    return folds.select(*_KEYS[:4], "fold")


@query(
    "stratified_kfold",
    """select o_orderkey, o_orderstatus, cast((row_number() over (partition by o_orderstatus order by o_orderkey) - 1)
    % 5 as integer) as fold from orders""",
)
def stratified_kfold(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return SP.stratified_kfold(orders, 5, "o_orderstatus", "o_orderkey").select("o_orderkey", "o_orderstatus", "fold")


# --- models -----------------------------------------------------------------


def _scores(df):
    return df.select("fold", *rounded(6, "score", "mean_score"))


_MEAN = "round(avg(score) over (), 6) as mean_score"


@query(
    "cross_validate",
    f"""with {_ridge_sql(5, [0.0])} select cast(f as integer) as fold, round(score, 6) as score, {_MEAN} from outer_scores""",
)
def cross_validate(spark, sf):
    """R2 of a line on all three features on each of five folds."""
    return _scores(SE.cross_validate_ridge(_folded(spark, sf, 5), _X, _Y))


#: Penalties of the searches: none, and eleven from a thousandth to a hundred.
_REGS = [0.0, *(round(10 ** (k / 2), 6) for k in range(-6, 5))]


@query(
    "nested_cv",
    f"""with {_ridge_sql(5, _REGS, 4)}, chosen as (select f, setting from inner_scores
        qualify row_number() over (partition by f order by score desc, setting) = 1)
    select cast(f as integer) as fold, round(score, 6) as score, {_MEAN} from outer_scores join chosen using (f, setting)""",
)
def nested_cv(spark, sf):
    """Twelve penalties searched on four inner folds inside each of five outer folds."""
    settings = SE.every_setting({"regParam": _REGS})
    return _scores(SE.cross_validate_ridge(_folded(spark, sf, 5, inner=4), _X, _Y, settings=settings))


_SEARCH = """select cast(setting as integer) as setting, round(any_value(reg), 9) as reg_param, round(avg(score), 6) as mean_score,
    row_number() over (order by avg(score) desc, setting) = 1 as best
    from outer_scores join settings using (setting) group by setting"""


def _searched(df):
    reg = F.round(F.col("params")["regParam"].cast("double"), 9).alias("reg_param")
    return df.select("setting", reg, *rounded(6, "mean_score"), "best")


@query("grid_search", f"with {_ridge_sql(5, _REGS)} {_SEARCH}")
def grid_search(spark, sf):
    """Twelve penalties on five folds."""
    return _searched(SE.ridge_search(_folded(spark, sf, 5), _X, _Y, SE.every_setting({"regParam": _REGS}))[1])


_DRAWN = SE.draw_settings({"regParam": SE.LogUniform(1e-4, 1e2)}, 10, 42)


@query("random_search", f"with {_ridge_sql(5, [s['regParam'] for s in _DRAWN])} {_SEARCH}")
def random_search(spark, sf):
    """Ten penalties drawn between a ten-thousandth and a hundred, all magnitudes alike, on five folds."""
    return _searched(SE.ridge_search(_folded(spark, sf, 5), _X, _Y, _DRAWN)[1])


# The grid the original searches, 81 settings.
_FOREST_GRID = {
    "n_estimators": [50, 100, 150],
    "max_depth": [None, 10, 20],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
}


def _suppliers(spark, sf):
    """Five folds of suppliers: what they hold and have sold, and the mean value of an item."""
    sold = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").cast("double").alias("volume"),
        F.sum("l_extendedprice").cast("double").alias("market_cap"),
        F.avg("l_discount").cast("double").alias("discount"),
        F.avg(F.col("l_extendedprice").cast("double")).alias("price"),
    )
    held = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("supply"))
    rows = SP.hash_fold(held.join(sold, F.col("s_suppkey") == F.col("l_suppkey")), 5, "s_suppkey", 3)
    return ml.features(rows, ["market_cap", "volume", "supply", "discount"], "price", keep=["fold"])


def _forest_settings(df):
    names = [F.col("params")[n].alias(n) for n in _FOREST_GRID]
    return df.select("setting", *names, *rounded(4, "mean_score"), "best")


@query("forest_grid_search")
def forest_grid_search(spark, sf):
    """All 81 settings on five folds, from three grown forests a fold."""
    return _forest_settings(FO.forest_search(_suppliers(spark, sf), SE.every_setting(_FOREST_GRID))[1])


@query("forest_random_search")
def forest_random_search(spark, sf):
    """Ten drawn settings on five folds: numbers of trees and depths from ranges, the rest from lists."""
    space = {**_FOREST_GRID, "n_estimators": SE.IntRange(50, 150), "min_samples_split": SE.IntRange(2, 10)}
    return _forest_settings(FO.forest_search(_suppliers(spark, sf), SE.draw_settings(space, 10, 42))[1])


#: The sums a cut of a feature splits, per fold: a stump's R2 on the fold it has not seen.
_STUMP = f"""items as (select l_extendedprice as y, l_quantity as x, {_sql_hash(_IDS, 7)} % 3 as fold from lineitem),
    per as (select fold, x, count(*) as n, sum(y) as s, sum(y * y) as q from items group by 1, 2),
    held as (select distinct fold as f from per),
    train as (select f, x, sum(n) as n, sum(s) as s from per, held where fold <> f group by 1, 2),
    cuts as (select f, x, sum(n) over w as n, sum(s) over w as s, sum(n) over a as na, sum(s) over a as sa,
        lead(x) over (partition by f order by x) as above from train
        window w as (partition by f order by x), a as (partition by f)),
    chosen as (select f, (x + above) / 2 as cut, s / n as lo, (sa - s) / (na - n) as hi from cuts where above is not null
        qualify row_number() over (partition by f order by s * s / n + (sa - s) * (sa - s) / (na - n) desc) = 1),
    stumps as (select f, 1 - sum(q - 2 * p * s + n * p * p) / (sum(q) - sum(s) * sum(s) / sum(n)) as score from (
        select f, n, s, q, case when x <= cut then lo else hi end as p from per join chosen on f = fold) group by f)"""


@query(
    "estimator_arg",
    f"""with {_ridge_sql(3, [0.0])}, {_STUMP}, joined as (select 'line' as estimator, f, score from outer_scores
        union all select 'stump', f, score from stumps)
    select estimator, cast(f as integer) as fold, round(score, 6) as score,
        round(avg(score) over (partition by estimator), 6) as mean_score from joined""",
)
def estimator_arg(spark, sf):
    """Any MLlib estimator goes where the forest went: a line on three features, a tree of one cut on the quantity."""
    folded = _folded(spark, sf, 3)
    stump = DecisionTreeRegressor(featuresCol="features", labelCol="label", maxDepth=1, maxBins=64)
    line = ml.cross_validate(_line(), _vectors(folded)).withColumn("estimator", F.lit("line"))
    tree = ml.cross_validate(stump, _vectors(folded, ["l_quantity"])).withColumn("estimator", F.lit("stump"))
    return line.union(tree).select("estimator", "fold", *rounded(6, "score", "mean_score"))


@query("random_forest_regression")
def random_forest_regression(spark, sf):
    """Errors on the held-out fifth."""
    marked = SP.train_test_split(_items(spark, sf), _KEYS, 0.2, 42)
    data = ml.features(marked, _X, _Y, keep=["split"])
    _, _, metrics = ml.random_forest_regression(
        data.where("split = 'train'"), data.where("split = 'test'"), numTrees=100, maxDepth=8
    )
    return metrics


@query(
    "per_symbol_regression",
    """select l_returnflag || l_linestatus as symbol, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
    round(regr_slope(l_extendedprice, l_quantity), 3) as slope,
    round(regr_r2(l_extendedprice, l_quantity), 6) as r2, count(*) as n from lineitem group by 1""",
)
def per_symbol_regression(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("symbol", F.concat("l_returnflag", "l_linestatus"))
    fitted = ml.per_symbol_linear(items, ["l_quantity"], "l_extendedprice")
    return fitted.select(
        "symbol", *rounded(3, "intercept"), F.round(F.get("coef", F.lit(0)), 3).alias("slope"), *rounded(6, "r2"), "n"
    )


@query(
    "per_symbol_scores",
    f"""with rows as (select l_returnflag || l_linestatus as symbol, l_extendedprice as y, l_quantity as x,
        {_sql_hash(_IDS, 42)} < round(0.2 * 4294967296) as held from lineitem),
    lines as (select symbol, regr_intercept(y, x) as a, regr_slope(y, x) as b from rows where not held group by 1),
    tested as (select symbol, y, a + b * x as p from rows join lines using (symbol) where held),
    means as (select symbol, avg(y) as m from tested group by 1)
    select symbol, round(avg(abs(y - p)), 4) as mae, round(avg((y - p) * (y - p)) / 1e6, 6) as mse_millions,
        round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) as r2, count(*) as n
    from tested join means using (symbol) group by 1""",
)
def per_symbol_scores(spark, sf):
    """A line fitted to each symbol's training rows, applied to its held-out rows, and scored there."""
    rows = SP.train_test_split(
        table(spark, sf, "lineitem").withColumn("symbol", F.concat("l_returnflag", "l_linestatus")), _IDS, 0.2, 42
    )
    models = ml.per_symbol_linear(rows.where("split = 'train'"), ["l_quantity"], _Y)
    scored = ml.predict_linear(rows.where("split = 'test'"), models, ["l_quantity"])
    found = regression_metrics(scored, _Y, "prediction", by=["symbol"])
    return found.select(
        "symbol", *rounded(4, "mae"), F.round(F.col("mse") / 1e6, 6).alias("mse_millions"), *rounded(6, "r2"), "n"
    )


@query(
    "cross_validate_expanding",
    f"""with {PRICES}, placed as (select symbol, price as y, datediff('day', date '1990-01-01', ts) as x,
        row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n from prices),
    folds as (select unnest(range(1, 6)) as f),
    roles as (select f, x, y, i < n - (6 - f) * (n // 6) as train from placed, folds
        where i < n - (6 - f) * (n // 6) + n // 6 and n >= 6),
    lines as (select f, regr_intercept(y, x) as a, regr_slope(y, x) as b from roles where train group by 1),
    tested as (select f, y, a + b * x as p, avg(y) over (partition by f) as m from roles join lines using (f) where not train),
    scores as (select f, 1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) as score from tested group by 1)
    select cast(f as integer) as fold, round(score, 6) as score, round(avg(score) over (), 6) as mean_score from scores""",
)
def cross_validate_expanding(spark, sf):
    """A trend line over all symbols, trained on what lies before each test run."""
    days = prices(spark, sf).withColumn("day", F.datediff("ts", F.lit("1990-01-01").cast("date")).cast("double"))
    folds = SP.time_series_split(days, 5)
    return _scores(SE.cross_validate_ridge(folds, ["day"], "price", role="role"))


@query("supervised_window_forecast")
def supervised_window_forecast(spark, sf):
    """Boosted trees on the five prices before, projected over a week."""
    learner = GBTRegressor(featuresCol="features", labelCol="label", maxIter=20, maxDepth=4, seed=42)
    return ml.window_forecast(brand_prices(spark, sf), 5, 7, estimator=learner)[1]


@query(
    "apply_per_symbol",
    f"with {BRAND_PRICES} select symbol, count(*) as bars, round(max(price) - min(price), 4) as spread from prices group by 1",
)
def apply_per_symbol(spark, sf):
    """A pandas function on each symbol's daily prices."""
    import pandas as pd

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"symbol": pdf["symbol"].iloc[0], "bars": len(pdf), "spread": pdf["price"].max() - pdf["price"].min()}
        return pd.DataFrame([out])

    out = ml.apply_per_symbol(brand_prices(spark, sf), spread, "symbol string, bars bigint, spread double")
    return out.select("symbol", "bars", *rounded(4, "spread"))


# --- forecasts --------------------------------------------------------------


_AR1 = f"""{PRICES},
    z as (select symbol, ts, price, price - lag(price) over (partition by symbol order by ts) as z from prices),
    l as (select symbol, z, lag(z) over (partition by symbol order by ts) as l from z),
    g as (select symbol, count(*) as n, sum(l * l) as ll, sum(l * z) as lz, sum(z * z) as zz from l
        where z is not null and l is not null group by 1)"""


@query(
    "ar_fit",
    f"""with {_AR1}
    select symbol, round(lz / ll, 8) as phi, round((zz - lz * lz / ll) / n / 1e6, 4) as sigma2_millions, n from g""",
)
def ar_fit(spark, sf):
    """Order one; higher orders are checked against a direct solution in the tests."""
    fitted = FC.fit_ar(prices(spark, sf), 1, 1)
    return fitted.select(
        "symbol",
        F.round(F.get("ar", F.lit(0)), 8).alias("phi"),
        F.round(F.col("sigma2") / 1e6, 4).alias("sigma2_millions"),
        "n",
    )


def _flat(models):
    return models.select(
        "symbol",
        F.array_join("ar_lags", ",").alias("ar_lags"),
        F.array_join(F.transform("ar", lambda v: F.format_string("%.6f", v)), ",").alias("ar"),
        F.array_join("ma_lags", ",").alias("ma_lags"),
        F.array_join(F.transform("ma", lambda v: F.format_string("%.6f", v)), ",").alias("ma"),
        F.round("sigma2", 2).alias("sigma2"),
        "n",
        "reason",
    )


@query("arma_fit")
def arma_fit(spark, sf):
    return _flat(FC.fit_arma(prices(spark, sf), 1, 1, 1))


@query("sarima_fit")
def sarima_fit(spark, sf):
    return _flat(FC.fit_sarima(prices(spark, sf)))


def _ar5() -> str:
    """The fifth-order model on first differences, fitted and carried on for a week."""
    lags = [f"lag(z, {k}) over s as l{k}" for k in range(1, 6)]
    sums = [f"sum(l{i + 1} * l{j + 1}) as m_{i}_{j}" for i in range(5) for j in range(i, 5)]
    sums += [f"sum(l{i + 1} * z) as r_{i}" for i in range(5)]
    ahead = " + ".join(f"b_{k} * s.z{k + 1}" for k in range(5))
    return f"""with recursive {PRICES},
    z as (select symbol, ts, price, price - lag(price) over (partition by symbol order by ts) as z from prices),
    l as (select symbol, ts, price, z, {', '.join(lags)} from z window s as (partition by symbol order by ts)),
    g as (select symbol, {', '.join(sums)} from l where l5 is not null group by 1),
    {solve_sql("g", 5, "fit")},
    steps as (select symbol, 0 as step, ts as last, price, z as z1, l1 as z2, l2 as z3, l3 as z4, l4 as z5
          from l qualify row_number() over (partition by symbol order by ts desc) = 1
        union all select s.symbol, step + 1, last, price + {ahead}, {ahead}, z1, z2, z3, z4
          from steps s join fit on fit.symbol = s.symbol where step < 7)
    select symbol, cast(step as integer) as step, strftime(last + step, '%Y-%m-%d') as ts, round(price, 2) as mean,
      cast(null as varchar) as reason from steps where step > 0"""


@query("forecast_steps", _ar5())
def forecast_steps(spark, sf):
    """A week ahead with the fifth-order model, one row per step."""
    out = FC.forecast_named(prices(spark, sf), "arima")
    return out.select("symbol", "step", day(), *rounded(2, "mean"), "reason")


@query(
    "forecast_interval",
    f"""with {_AR1}, fit as (select symbol, lz / ll as phi, (zz - lz * lz / ll) / n as sigma2 from g),
    tail as (select symbol, max(ts) as last, arg_max(price, ts) as x, arg_max(z, ts) as z from z group by 1),
    h as (select cast(unnest(range(1, 31)) as integer) as step),
    p as (select symbol, step, (1 - pow(phi, step)) / (1 - phi) as psi from fit, h)
    select tail.symbol, h.step, strftime(last + h.step, '%Y-%m-%d') as ts,
        round(x + z * phi * (1 - pow(phi, h.step)) / (1 - phi), 2) as mean,
        round(1.959963984540054 * sqrt(sigma2 * (select sum(psi * psi) from p
            where p.symbol = tail.symbol and p.step <= h.step)), 2) as half
    from tail join fit on tail.symbol = fit.symbol, h""",
)
def forecast_interval(spark, sf):
    """Thirty steps of the first-order model with its 95 % interval."""
    history, spec = prices(spark, sf), FC.Arima((1, 1, 0))
    out = FC.forecast(FC.fit_arima(history, spec), history, spec, steps=30)
    half = ((F.col("hi") - F.col("lo")) / 2).alias("half")
    return out.select("symbol", "step", day(), "mean", half).select(
        "symbol", "step", "ts", *rounded(2, "mean", "half")
    )


_DRIVEN = """daily as (select cast(o_orderdate as date) as ts, count(*) as n_orders from orders group by 1),
    cutoff as (select max(ts) - 7 as c from daily),
    prices as (select symbol, ts, price, n_orders as x from (select o_orderpriority as symbol,
        cast(o_orderdate as date) as ts, round(avg(o_totalprice), 4) as price from orders group by 1, 2)
        join daily using (ts) where ts <= (select c from cutoff)),
    days as (select cast(unnest(generate_series((select c - 60 from cutoff), (select c + 7 from cutoff), interval 1 day)) as date) as ts),
    ahead as (select days.ts, coalesce(n_orders, 0) as x from days left join daily on days.ts = daily.ts)"""


def _driven(spark, sf):
    """Prices up to a week before the end with the market's order count of the day, and the count of the days to come."""
    daily = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ts")).agg(
        F.count("*").cast("double").alias("n_orders")
    )
    cutoff = daily.agg(F.date_sub(F.max("ts"), 7)).scalar()
    history = prices(spark, sf).join(daily, "ts").where(F.col("ts") <= cutoff)
    symbols = history.select("symbol").distinct().withColumn("c", cutoff)
    days = symbols.select("symbol", F.explode(F.sequence(F.date_sub("c", 60), F.date_add("c", 7))).alias("ts"))
    future = days.join(daily, "ts", "left").select("symbol", "ts", F.coalesce("n_orders", F.lit(0.0)).alias("n_orders"))
    return history, future


@query(
    "forecast_with_regressors",
    f"""with recursive {_DRIVEN},
    z as (select symbol, ts, price, x, price - lag(price) over s as z, x - lag(x) over s as e from prices
        window s as (partition by symbol order by ts)),
    l as (select symbol, z, e, lag(z) over (partition by symbol order by ts) as l from z),
    g as (select symbol, sum(l * l) as ll, sum(l * e) as le, sum(e * e) as ee, sum(l * z) as lz, sum(e * z) as ez
        from l where l is not null group by 1),
    fit as (select symbol, (lz * ee - ez * le) / (ll * ee - le * le) as phi, (ez * ll - lz * le) / (ll * ee - le * le) as b from g),
    tail as (select symbol, max(ts) as last, arg_max(price, ts) as price, arg_max(z, ts) as z, arg_max(x, ts) as x from z group by 1),
    steps as (select symbol, 0 as step, last, price, z, x from tail
        union all select s.symbol, step + 1, last, price + phi * z + b * (a.x - s.x), phi * z + b * (a.x - s.x), a.x
        from steps s join fit on fit.symbol = s.symbol join ahead a on a.ts = s.last + s.step + 1 where step < 7)
    select symbol, cast(step as integer) as step, strftime(last + step, '%Y-%m-%d') as ts, round(price, 2) as mean
    from steps where step > 0""",
)
def forecast_with_regressors(spark, sf):
    """A week of the first-order model driven by the day's number of orders, which is known ahead."""
    history, future = _driven(spark, sf)
    spec = FC.Arima((1, 1, 0), exog=("n_orders",))
    out = FC.forecast(FC.fit_arima(history, spec), history, spec, future=future)
    return out.select("symbol", "step", day(), *rounded(2, "mean"))


@query("forecast_all_models")
def forecast_all_models(spark, sf):
    out = FC.forecast_all(prices(spark, sf))
    return out.select("symbol", "model", "step", "ts", "mean", "lo", "hi", "reason")
