"""Scoring signals: rank correlation with forward returns, bucket portfolios, turnover and their summaries.

Signals are tables factor, ticker, pos, day, value. scored() builds any number of them, and the forward returns they are
held against, as columns of one panel: one scan of the prices and one exchange by ticker for all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.moments import safe_corr
from gridloom.operators.factors import Factor
from gridloom.operators.panel import lagged, log_positive
from gridloom.operators.universe import restrict
from gridloom.sources.catalog import Catalog

DAY = ["factor", "day"]


def forward_cells(horizons: tuple[int, ...]) -> Column:
    """array of (horizon, fwd): ln P horizon rows later - ln P."""
    p = log_positive("adj")
    return F.array(*(F.struct(F.lit(h).alias("horizon"), (lagged(p, -h) - p).alias("fwd")) for h in horizons))


def scored(catalog: Catalog, factors: list[Factor], horizons: tuple[int, ...] = (), lag: int = 0, days: DataFrame | None = None) -> DataFrame:
    """factor, ticker, pos, day, value, forward (array of (horizon, fwd)): the oriented signals, ``lag`` rows late, beside the forward returns from their rows.

    Everything is a column of the catalog's panel; only factors with panels of their own (stored ones, networks) are joined.
    """
    rows = reduce(lambda r, f: f.add(catalog, r), factors, catalog.panel)
    value = [lagged(f.signal_column(), lag) if lag else F.col(f.signal_column()) for f in factors]
    each = F.array(*(F.struct(F.lit(f.name).alias("factor"), (v * f.direction).alias("value")) for f, v in zip(factors, value, strict=True)))
    forward = forward_cells(horizons) if horizons else F.lit(None).cast("array<struct<horizon:int,fwd:double>>")
    wide = rows.select("ticker", "pos", "day", each.alias("_each"), forward.alias("forward"))
    if days is not None:
        wide = wide.join(F.broadcast(days.select("day").distinct()), "day", "left_semi")
    return wide.select("ticker", "pos", "day", "forward", F.inline("_each")).select(*DAY, "ticker", "pos", "value", "forward")


def signals(catalog: Catalog, factors: list[Factor], days: DataFrame | None = None) -> DataFrame:
    """factor, ticker, pos, day, value: the oriented panels of several factors in one table."""
    return scored(catalog, factors, days=days).drop("forward")


def forward_returns(panel: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """ticker, day, horizon, fwd: ln P horizon rows later - ln P. All horizons share one window pass."""
    return panel.select("ticker", "day", forward_cells(horizons).alias("_c")).select("ticker", "day", F.inline("_c"))


def average_rank(c: str, by: list[str]) -> Column:
    """Rank among the rows of ``by``; ties share the mean of their places. Rank and ties are read off one sorted window."""
    ordered = Window.partitionBy(*by).orderBy(c)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ordered.rangeBetween(0, 0)) - 1) / 2.0


def rank_correlation(pairs: DataFrame, least: int = 30) -> DataFrame:
    """factor, horizon, day, ic, n of pairs (factor, horizon, day, value, fwd) with both present; see information()."""
    by = ["factor", "horizon", "day"]
    both = pairs.where("value is not null and fwd is not null")
    ranked = both.select(*by, average_rank("value", by).alias("_a"), average_rank("fwd", by).alias("_b"))
    out = ranked.groupBy(*by).agg((F.round(safe_corr("_a", "_b"), 12) + 0.0).alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= least) & F.col("ic").isNotNull())


def information(signal: DataFrame, forward: DataFrame, least: int = 30) -> DataFrame:
    """factor, horizon, day, ic, n: rank correlation over the pairs with both present, days with fewer than ``least`` left out; NULL correlations dropped.
    Correlations are rounded to 12 digits, so that no correlation has no sign.

    A cross-section is one day of one factor: as many rows as tickers that day.
    """
    return rank_correlation(signal.where("value is not null").join(forward.where("fwd is not null"), ["ticker", "day"]), least)


def scored_information(scores: DataFrame, least: int = 30) -> DataFrame:
    """information() of scored() rows, without a join."""
    return rank_correlation(scores.where("value is not null").select(*DAY, "value", F.inline("forward")), least)


def factor_information(
    catalog: Catalog, factors: list[Factor], horizons: tuple[int, ...] = (1, 5, 21), least: int = 30, restrict_universe: bool = True,
    days: DataFrame | None = None
) -> DataFrame:
    rows = scored(catalog, factors, horizons, days=days)
    return scored_information(restrict(rows, catalog.periods) if restrict_universe else rows, least)


def information_by_day(
    catalog: Catalog, compute: Callable[[Catalog, int], DataFrame], days: list[int], name: str = "signal", horizons: tuple[int, ...] = (1, 5, 21),
    least: int = 30, restrict_universe: bool = True
) -> DataFrame:
    """information() of a signal that is given as a function of the catalog and one day (ticker, value), on some days.

    Each day is a plan of its own, so this is for signals that have no panel and for few days. Days on which ``compute``
    raises ValueError (not enough history) are left out.
    """
    parts = []
    for day in days:
        try:
            parts.append(compute(catalog, day).select(F.lit(name).alias("factor"), "ticker", F.lit(day).alias("day"), "value"))
        except ValueError:
            continue
    if not parts:
        return catalog.spark.createDataFrame([], "factor string, horizon int, day int, ic double, n long")
    rows = reduce(DataFrame.unionByName, parts)
    return information(restrict(rows, catalog.periods) if restrict_universe else rows, forward_returns(catalog.panel, horizons), least)


def summarise_information(ic: DataFrame, lags: int | None = None, per_year: int = 252) -> DataFrame:
    """factor, horizon, n, mean, sd, ir, t_naive, hit_rate, first_day, last_day and, with lags, t_hac. One pass over the correlations."""
    by = ["factor", "horizon"]
    rows = ic if lags is None else with_lags(ic.withColumn("x", F.col("ic")), by, lags, "day")
    stats = rows.groupBy(*by).agg(
        F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.sum((F.col("ic") > 0).cast("int")).alias("_up"), F.sum((F.col("ic") < 0).cast("int")).alias("_down"), F.sum((F.col("ic") == 0).cast("int")).alias("_flat"),
        *([] if lags is None else lag_sums(lags)),
    )
    same = F.when(F.col("mean") > 0, F.col("_up")).when(F.col("mean") < 0, F.col("_down")).otherwise(F.col("_flat"))
    return stats.select(
        *by, "n", "mean", "sd", (F.try_divide("mean", "sd") * per_year**0.5).alias("ir"), F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")).alias("t_naive"),
        (same / F.col("n")).alias("hit_rate"), "first_day", "last_day", *([] if lags is None else [t_of(lags, F.col("n"), F.col("mean")).alias("t_hac")]),
    )


def with_lags(series: DataFrame, by: list[str], lags: int, order: str) -> DataFrame:
    """series (by, order, x not NULL) with the deviation _e of x from its mean and its values _e1 ... rows earlier."""
    w = Window.partitionBy(*by).orderBy(order)
    e = series.withColumn("_e", F.col("x") - F.avg("x").over(Window.partitionBy(*by)))
    return e.select("*", *(F.lag("_e", k).over(w).alias(f"_e{k}") for k in range(1, lags + 1)))


def lag_sums(lags: int) -> list[Column]:
    return [F.sum(F.col("_e") * F.col("_e")).alias("_g0")] + [
        F.coalesce(F.sum(F.col("_e") * F.col(f"_e{k}")), F.lit(0.0)).alias(f"_g{k}") for k in range(1, lags + 1)
    ]


def t_of(lags: int, n: Column, mean: Column) -> Column:
    """Newey-West t from the sums of lag_sums()."""
    long_run = F.col("_g0")
    for k in range(1, lags + 1):
        long_run = long_run + 2 * (1 - k / (lags + 1)) * F.col(f"_g{k}")
    return F.when((n > 1) & (long_run > 0), mean / (F.sqrt(long_run) / n))


def hac_t(series: DataFrame, by: list[str], lags: int, order: str = "day") -> DataFrame:
    """by, t: Newey-West t of the mean of x. Autocovariances are sums over lagged windows: no series leaves the engine."""
    g = with_lags(series.where("x is not null"), by, lags, order).groupBy(*by).agg(F.count("x").alias("_n"), F.avg("x").alias("_m"), *lag_sums(lags))
    return g.select(*by, t_of(lags, F.col("_n"), F.col("_m")).alias("t"))


def buckets(signal: DataFrame, n: int = 10) -> DataFrame:
    """signal with ``side``: 1 in the top, -1 in the bottom bucket of the day, 0 between. Percentile ranks; ties in order of ticker."""
    rows = signal.where("value is not null")
    on = Window.partitionBy(*DAY).orderBy("value", "ticker")
    pct = F.row_number().over(on) / F.count(F.lit(1)).over(on.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("side", F.when(pct > 1 - 1 / n, 1).when(pct <= 1 / n, -1).otherwise(0))


def long_short(sided: DataFrame, forward: DataFrame | None = None) -> DataFrame:
    """factor, day, horizon, ret: mean forward return of the top less the bottom bucket. Without ``forward`` those of scored() rows are used."""
    held = sided.where("side <> 0")
    if forward is None:
        held = held.select(*DAY, "side", F.inline("forward")).where("fwd is not null")
    else:
        held = held.join(forward.where("fwd is not null"), ["ticker", "day"])
    out = held.groupBy(*DAY, "horizon").agg((F.avg(F.when(F.col("side") > 0, F.col("fwd"))) - F.avg(F.when(F.col("side") < 0, F.col("fwd")))).alias("ret"))
    return out.where("ret is not null")


def turnover(sided: DataFrame, sides: tuple[int, ...] = (1, -1)) -> DataFrame:
    """factor, day, turnover: per leg (entries + exits) / (2 x size) against the previous signal day, legs summed; the first day is left out."""
    legs = sided.where(F.col("side").isin(list(sides))).select("factor", "side", "day", "ticker")
    dates = sided.select(*DAY).distinct()
    seq = Window.partitionBy("factor").orderBy("day")
    follow = dates.select("factor", "day", F.lead("day").over(seq).alias("_next"), F.lag("day").over(seq).alias("_prev"))
    now = legs.join(follow, DAY)
    entered = now.where("_prev is not null").select("factor", "side", F.col("day").alias("on"), "ticker", F.lit(1).alias("_in"))
    left = now.where("_next is not null").select("factor", "side", F.col("_next").alias("on"), "ticker", F.lit(1).alias("_was"))
    both = entered.join(left, ["factor", "side", "on", "ticker"], "full")
    per = both.groupBy("factor", "side", "on").agg(
        F.sum(F.when(F.col("_in").isNull() | F.col("_was").isNull(), 1).otherwise(0)).alias("_moves"), F.count("_in").alias("_size")
    )
    each = per.select("factor", F.col("on").alias("day"), F.try_divide(F.col("_moves"), 2.0 * F.col("_size")).alias("_t"))
    return each.groupBy(*DAY).agg(F.sum(F.coalesce("_t", F.lit(0.0))).alias("turnover"))


def net_long_short(gross: DataFrame, moved: DataFrame, cost: float = 0.001) -> DataFrame:
    """gross with ``net``: less cost per unit of turnover; no turnover counts as 0."""
    return gross.join(moved, DAY, "left").withColumn("net", F.col("ret") - cost * F.coalesce("turnover", F.lit(0.0)))


def delayed(signal: DataFrame, lag: int = 1) -> DataFrame:
    """Signals shifted by calendar rows before any restriction to days."""
    w = Window.partitionBy("factor", "ticker").orderBy("pos")
    return signal.withColumn("value", F.lag("value", lag).over(w)) if lag else signal


def factor_long_short(
    catalog: Catalog, factors: list[Factor], n: int = 10, horizons: tuple[int, ...] = (21,), lag: int = 1, restrict_universe: bool = False,
    days: DataFrame | None = None
) -> DataFrame:
    rows = scored(catalog, factors, horizons, lag, days)
    return long_short(buckets(restrict(rows, catalog.periods) if restrict_universe else rows, n))


def information_decay(
    catalog: Catalog, factors: list[Factor], horizons: tuple[int, ...] = (1, 5, 10, 21, 42, 63), least: int = 30,
    restrict_universe: bool = True
) -> DataFrame:
    """factor, horizon, mean: mean rank correlation by horizon."""
    return factor_information(catalog, factors, horizons, least, restrict_universe).groupBy("factor", "horizon").agg(F.avg("ic").alias("mean"))
