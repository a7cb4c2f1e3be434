"""Statistics: correlation, model errors, autocorrelation, baseline forecast, market analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickframe.operators.layout import as_list, over_blocks
from tickframe.operators.moments import centres, pair_moments
from tickframe.session import materialize


def naive_forecast(df: DataFrame, *, key: str = "symbol", price: str = "price") -> DataFrame:
    """Mean of the series with its range as interval."""
    return df.groupBy(key).agg(F.avg(price).alias("mean"), F.min(price).alias("lo"), F.max(price).alias("hi"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, as rows ``(a, b, corr)``.

    Each pair uses the rows where both are known. A column that does not vary gives NULL.
    Rows are summed up where they are read, as Gram matrices; pairs of columns are shuffled.
    """
    names = F.array(*[F.lit(c) for c in cols])
    sums = pair_moments(df, cols, centres(df, cols))
    spread = lambda q, s: F.col(q) - F.col(s) * F.try_divide(s, "n")
    together = F.col("p") - F.col("s_i") * F.try_divide("s_j", "n")
    apart = spread("q_i", "s_i") * spread("q_j", "s_j")
    value = F.when(apart > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), together / F.sqrt(apart))))
    itself = F.col("i") == F.col("j")
    a, b = F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b")
    corr = F.when(itself, F.when(spread("q_i", "s_i") > 0, 1.0)).otherwise(value).alias("corr")
    there = F.struct(a, b, corr)
    back = F.struct(b.alias("a"), a.alias("b"), corr)
    return sums.select(F.inline(F.when(itself, F.array(there)).otherwise(F.array(there, back))))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Mean absolute and squared error and R2, overall or per group, in one pass.

    Rows where either side is missing do not count; R2 is NULL where ``y`` does not vary.
    """
    both = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    error = F.col(y) - F.col(yhat)
    grouped = both.groupBy(*as_list(by)) if by is not None else both.groupBy()
    return grouped.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(y))).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def _with_series_mean(value: str):
    """Aggregates and a derivation that give every bucket the mean of its whole series."""
    aggs = {"_s": F.sum(value), "_c": F.count(value)}

    def derive(per: DataFrame, whole: WindowSpec, _walk: WindowSpec) -> DataFrame:
        mean = F.try_divide(F.sum("_s").over(whole), F.sum("_c").over(whole))
        return per.withColumn("_mean", mean).drop("_s", "_c")

    return aggs, derive


def acf(df: DataFrame, max_lag: int = 10, *, price: str = "price", key: str = "symbol", **layout) -> DataFrame:
    """Autocorrelation per symbol for lags 1..``max_lag``.

    The lagged products are summed per symbol with partial aggregation: one row per
    symbol and map task is shuffled, never a series.
    """
    aggs, derive = _with_series_mean(price)

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        dev = F.col(price) - F.col("_mean")
        rows = rows.withColumn("_x", dev)
        return rows.withColumns({f"_p{k}": F.col("_x") * F.lag("_x", k).over(w) for k in range(1, max_lag + 1)})

    lagged = over_blocks(
        df, build, key=key, lookback=max_lag, aggs=aggs, derive=derive, **layout
    )
    sums = lagged.groupBy(key).agg(
        F.sum(F.col("_x") * F.col("_x")).alias("_v"),
        *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(1, max_lag + 1)],
    )
    cells = [
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_p{k}"), F.col("_v")).alias("acf"))
        for k in range(1, max_lag + 1)
    ]
    return sums.select(key, F.inline(F.array(*cells)))


def pacf(df: DataFrame, max_lag: int = 10, *, key: str = "symbol", **options) -> DataFrame:
    """Partial autocorrelation per symbol for lags 1..``max_lag``, by Durbin and Levinson from the ACF.

    The recursion runs on one short array per symbol, in column expressions.
    """
    lags = acf(df, max_lag, key=key, **options).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_r"))
    lags = lags.select(key, F.transform("_r", lambda r: r["acf"]).alias("_r"))
    # phi holds the coefficients of the autoregression of the order before, out the last one of each
    zero = F.struct(F.lit([]).cast("array<double>").alias("phi"), F.lit([]).cast("array<double>").alias("out"))

    def step(state: Column, k: Column) -> Column:
        phi, r = state["phi"], F.col("_r")
        ahead = F.zip_with(phi, F.reverse(F.slice(r, 1, k - 1)), lambda a, b: a * b)
        along = F.zip_with(phi, F.slice(r, 1, k - 1), lambda a, b: a * b)
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
        last = F.try_divide(F.get(r, k - 1) - total(ahead), 1 - total(along))
        # the last coefficient takes part in those before it, so it is named once
        return F.get(
            F.transform(
                F.array(last),
                lambda x: F.struct(
                    F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - x * b), F.array(x)).alias("phi"),
                    F.concat(state["out"], F.array(x)).alias("out"),
                ),
            ),
            F.lit(0),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.size("_r")), zero, step)["out"]
    return lags.select(key, F.posexplode(found).alias("_k", "pacf")).select(key, (F.col("_k") + 1).alias("lag"), "pacf")


def market_analysis(
    df: DataFrame, *, price: str = "price", key: str = "symbol", ts: str = "ts", tie: Sequence[str] = (), **layout
) -> DataFrame:
    """Mean return, volatility of log returns, momentum and deepest drawdown per symbol."""
    aggs = {"_top": F.max(price)}

    def derive(per: DataFrame, _whole: WindowSpec, walk: WindowSpec) -> DataFrame:
        before = walk.rowsBetween(Window.unboundedPreceding, -1)
        return per.withColumn("_peak", F.max("_top").over(before)).drop("_top")

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns(
            {
                "_ret": F.try_divide(F.col(price), F.lag(price).over(w)) - 1,
                "_high": F.greatest("_peak", F.max(price).over(seen)),
            }
        )

    rows = over_blocks(df, build, key=key, ts=ts, tie=tie, lookback=1, aggs=aggs, derive=derive, **layout)
    order = F.struct(ts, *tie) if tie else F.col(ts)
    known = F.when(F.col(price).isNotNull(), order)
    first, last = F.min_by(price, known), F.max_by(price, known)
    return rows.groupBy(key).agg(
        F.avg("_ret").alias("mean_return"),
        F.stddev_samp(F.log1p("_ret")).alias("volatility"),
        (F.try_divide(last, first) - 1).alias("momentum"),
        F.max(1 - F.try_divide(F.col(price), F.col("_high"))).alias("max_drawdown"),
        F.count(price).alias("n"),
    )


def zscores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardise columns over all rows as ``z_<col>``; 0 where a column does not vary."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in cols],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in cols],
        ).alias("s")
    )
    with_stats = df.withColumn("_s", stats.scalar())
    scores = {}
    for c in cols:
        z = F.try_divide(F.col(c) - F.col(f"_s.m_{c}"), F.col(f"_s.s_{c}"))
        scores[f"z_{c}"] = F.when(F.col(c).isNotNull(), F.coalesce(z, F.lit(0.0)))
    return with_stats.withColumns(scores).drop("_s")


def long_term_benefit(market: DataFrame, sentiment: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Rank symbols by momentum and sentiment less volatility, each standardised (a heuristic)."""
    # one row per symbol, read twice below: for the statistics and for the scores
    joined = materialize(market.join(sentiment, key))
    scored = zscores(joined, ["momentum", "volatility", "compound_sentiment"])
    score = F.col("z_momentum") - F.col("z_volatility") + F.col("z_compound_sentiment")
    return scored.withColumn("score", score).drop("z_momentum", "z_volatility", "z_compound_sentiment")
