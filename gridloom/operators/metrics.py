"""Performance of return series: table series, day, ret (one row per day). One window pass and one aggregate for any number of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_series():
    return Window.partitionBy("series").orderBy("day")


def so_far():
    return by_series().rowsBetween(Window.unboundedPreceding, 0)


def equity(returns: DataFrame) -> DataFrame:
    """returns with ``equity`` (cumulative product of 1 + ret, missing as 0) and ``drawdown`` from the highest equity so far (starting with the first value)."""
    e = returns.withColumn("equity", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(so_far()))
    return e.withColumn("drawdown", F.col("equity") / F.max("equity").over(so_far()) - 1)


def performance(returns: DataFrame, per_year: int = 252, tail: float = 0.05, target: float = 0.0) -> DataFrame:
    """series, n, total_return, cagr, ann_vol, sharpe, sortino, max_drawdown, calmar, conditional_drawdown, hit_rate, profit_factor."""
    rows = equity(returns)
    cut = rows.groupBy("series").agg(F.percentile("drawdown", F.lit(tail)).alias("_q"))
    r = F.col("ret")
    a = rows.join(cut, "series").groupBy("series").agg(
        F.count("ret").alias("n"), F.max_by("equity", "day").alias("_end"), F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"),
        F.sqrt(F.avg(F.when(r.isNotNull(), F.pow(F.least(r - target, F.lit(0.0)), F.lit(2))))).alias("_down"), F.abs(F.min("drawdown")).alias("max_drawdown"),
        (-F.avg(F.when(F.col("drawdown") <= F.col("_q"), F.col("drawdown")))).alias("conditional_drawdown"), F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("_gain"), F.coalesce(-F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("_loss"),
    )
    root = per_year**0.5
    cagr = F.when(F.col("n") > 0, F.when(F.col("_end") <= 0, F.lit(-1.0)).otherwise(F.pow("_end", F.lit(float(per_year)) / F.col("n")) - 1))
    return a.withColumn("cagr", cagr).select(
        "series", "n", (F.col("_end") - 1).alias("total_return"), "cagr", (F.col("_sd") * root).alias("ann_vol"),
        F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * root).alias("sharpe"), F.when(F.col("_down") > 0, (F.col("_mean") - target) / F.col("_down") * root).alias("sortino"),
        "max_drawdown", F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.col("max_drawdown")).alias("calmar"), "conditional_drawdown", "hit_rate",
        F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")).when(F.col("_gain") > 0, F.lit(float("inf"))).alias("profit_factor"),
    )


def average_turnover(daily: DataFrame) -> DataFrame:
    """avg_turnover, n_rebalances: mean two-sided turnover over the days (turnover) on which the book changed; NULL without any."""
    moved = F.when(F.col("turnover") > 0, F.col("turnover"))
    return daily.agg(F.avg(moved).alias("avg_turnover"), F.count(moved).alias("n_rebalances"))


def monthly_returns(returns: DataFrame) -> DataFrame:
    """series, year, month, ret: compounded by calendar month, months without a day between first and last as 0."""
    day = F.date_from_unix_date("day")
    have = returns.groupBy("series", F.trunc(day, "month").alias("m")).agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"))
    life = have.groupBy("series").agg(F.min("m").alias("_a"), F.max("m").alias("_b"))
    span = life.select("series", F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("m"))
    return span.join(have, ["series", "m"], "left").select(
        "series", F.year("m").alias("year"), F.month("m").alias("month"), F.coalesce("ret", F.lit(0.0)).alias("ret")
    )


def month_table(monthly: DataFrame) -> DataFrame:
    """series, year and one column per month."""
    return monthly.groupBy("series", "year").pivot("month", list(range(1, 13))).agg(F.first("ret"))


def realised_beta(returns: DataFrame, market: DataFrame) -> DataFrame:
    """series, beta: sample covariance with the market over its sample variance on common days; NULL below two."""
    j = returns.where("ret is not null").join(market.where("market is not null"), "day")
    return j.groupBy("series").agg(F.when(F.count("ret") > 1, F.try_divide(F.covar_samp("ret", "market"), F.var_samp("market"))).alias("beta"))


def rolling_sharpe(returns: DataFrame, window: int = 252, per_year: int = 252) -> DataFrame:
    """series, day, sharpe over full windows."""
    w = by_series().rowsBetween(-(window - 1), 0)
    full = F.count("ret").over(w) == window
    return returns.select("series", "day", F.when(full, F.try_divide(F.avg("ret").over(w), F.stddev_samp("ret").over(w)) * per_year**0.5).alias("sharpe"))


def benchmark_table(strategy: DataFrame, market: DataFrame | None = None, extra: DataFrame | None = None, per_year: int = 252) -> DataFrame:
    """performance() of the strategy, of the market (log returns to simple) and of extra series, on the strategy's days."""
    rows = strategy
    days = strategy.select("day").distinct()
    if market is not None:
        rows = rows.unionByName(days.join(market, "day", "left").select(F.lit("market").alias("series"), "day", F.expm1("market").alias("ret")))
    if extra is not None:
        rows = rows.unionByName(extra.join(days, "day", "left_semi").select("series", "day", "ret"))
    return performance(rows, per_year)
