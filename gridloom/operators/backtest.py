"""Portfolio simulation in closed form: schedules, weights, constraints, a drift executor, costs and capacity.

Within a holding period with start weights w the wealth is V = 1 + sum w (G - 1), G the product of 1 + r since its start,
so a simulation is a product window per (period, ticker) and one aggregate per day: no loop over days.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.engine.session import checkpoint
from gridloom.operators.panel import by_ticker, dollar_volume, guarded, last_pos

#: Columns of a table of weights: pos (the rebalance row), ticker, weight.
ON_DAY = ["pos"]


def split_days(days: DataFrame, day: int) -> tuple[DataFrame, DataFrame]:
    """Days before, and from, a day."""
    return days.where(F.col("day") < day), days.where(F.col("day") >= day)


def walk_forward(days: DataFrame, train: int, test: int, step: int | None = None) -> DataFrame:
    """fold, part ('train' or 'test'), day: rolling folds over calendar rows; only whole folds."""
    if min(train, test) < 1 or (step is not None and step < 1):
        raise ValueError("folds need at least one day")
    step = step or test
    span = days.agg(F.min("pos").alias("a"), F.count(F.lit(1)).alias("n")).first()
    folds = max(0, (span["n"] - train - test) // step + 1)
    rows = days.withColumn("_p", F.col("pos") - (span["a"] or 0))
    low = F.greatest(F.lit(0), F.ceil((F.col("_p") - (train + test) + 1) / step)).cast("int")
    high = F.least(F.lit(folds - 1), F.floor(F.col("_p") / step)).cast("int")
    placed = rows.where(low <= high).withColumn("fold", F.explode(F.sequence(low, high)))
    return placed.select("fold", F.when(F.col("_p") - F.col("fold") * step < train, "train").otherwise("test").alias("part"), "day")


def sides(signal: DataFrame, n_buckets: int = 10) -> DataFrame:
    """signal (pos, ticker, value) with ``side``: the top and, of what is left, the bottom max(1, round half even(n / n_buckets)) names; days with fewer than two names are left out."""
    day = Window.partitionBy(*ON_DAY)
    rows = signal.where("value is not null").withColumn("_n", F.count(F.lit(1)).over(day)).where("_n > 1")
    k = F.greatest(F.lit(1), F.bround(F.col("_n") / n_buckets, 0).cast("int"))
    top = F.row_number().over(day.orderBy(F.col("value").desc(), "ticker")) <= k
    low = F.row_number().over(day.orderBy(F.col("value"), "ticker")) <= k
    return rows.withColumn("side", F.when(top, 1).when(low, -1).otherwise(0)).drop("_n")


def weights(signal: DataFrame, scheme: str = "equal", n_buckets: int = 10) -> DataFrame:
    """pos, ticker, weight: dollar-neutral with gross 1. equal: both buckets; signal: demeaned values; rank: demeaned ranks. A constant signal gives zeros for signal and rank."""
    if scheme == "equal":
        s = sides(signal, n_buckets).where("side <> 0")
        return s.select("pos", "ticker", (0.5 * F.col("side") / F.count(F.lit(1)).over(Window.partitionBy("pos", "side"))).alias("weight"))
    day = Window.partitionBy(*ON_DAY)
    rows = signal.where("value is not null").withColumn("_n", F.count(F.lit(1)).over(day)).where("_n > 1")
    if scheme == "rank":
        x = F.rank().over(day.orderBy("value")) + (F.count(F.lit(1)).over(Window.partitionBy("pos", "value")) - 1) / 2.0
    elif scheme == "signal":
        x = F.col("value")
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    rows = rows.withColumn("_x", x).withColumn("_d", F.col("_x") - F.avg("_x").over(day))
    gross = F.sum(F.abs("_d")).over(day)
    flat = F.max("_x").over(day) == F.min("_x").over(day)
    return rows.select("pos", "ticker", F.when(flat, 0.0).otherwise(F.col("_d") / gross).alias("weight"))


def risk_weights(signal: DataFrame, vol: DataFrame, n_buckets: int = 10) -> DataFrame:
    """pos, ticker, weight: half the book on either side by inverse volatility; a missing or non-positive one counts as the day's median inverse."""
    s = sides(signal, n_buckets).where("side <> 0").join(vol.select("pos", "ticker", "vol"), ["pos", "ticker"], "left")
    s = s.withColumn("_inv", F.when(F.col("vol") > 0, 1 / F.col("vol")))
    median = F.percentile("_inv", F.lit(0.5)).over(Window.partitionBy("pos"))
    s = s.withColumn("_w", F.coalesce("_inv", median, F.lit(1.0)))
    return s.select("pos", "ticker", (0.5 * F.col("side") * F.col("_w") / F.sum("_w").over(Window.partitionBy("pos", "side"))).alias("weight"))


def capped(w: DataFrame, most: float) -> DataFrame:
    return w.withColumn("weight", F.greatest(F.least(F.col("weight"), F.lit(most)), F.lit(-most)))


def dollar_neutral(w: DataFrame) -> DataFrame:
    return w.withColumn("weight", F.col("weight") - F.avg("weight").over(Window.partitionBy(*ON_DAY)))


def sector_neutral(w: DataFrame, sectors: DataFrame, cap: float = 0.0) -> DataFrame:
    """Shift each sector's weights so that its net lies within +-cap; names without a sector stay."""
    rows = w.join(sectors.select("ticker", "sector"), "ticker", "left")
    by = Window.partitionBy("pos", "sector")
    net = F.sum("weight").over(by)
    shift = (net - F.greatest(F.least(net, F.lit(cap)), F.lit(-cap))) / F.count(F.lit(1)).over(by)
    return rows.withColumn("weight", F.when(F.col("sector").isNull(), F.col("weight")).otherwise(F.col("weight") - shift)).select(*w.columns)


def beta_neutral(w: DataFrame, betas: DataFrame) -> DataFrame:
    """Take the beta exposure out; missing betas count as 0; without any nothing changes."""
    rows = w.join(betas.select("pos", "ticker", "beta"), ["pos", "ticker"], "left").withColumn("_b", F.coalesce("beta", F.lit(0.0)))
    day = Window.partitionBy(*ON_DAY)
    k = F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("_b")).over(day), F.sum(F.col("_b") * F.col("_b")).over(day)), F.lit(0.0))
    return rows.withColumn("weight", F.col("weight") - k * F.col("_b")).select(*w.columns)


def renormalised(w: DataFrame, gross: float = 1.0) -> DataFrame:
    """Scale to the gross; a book of zeros stays."""
    total = F.sum(F.abs("weight")).over(Window.partitionBy(*ON_DAY))
    return w.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * gross, total), F.col("weight")))


def constrained(
    w: DataFrame, most: float | None = None, sectors: DataFrame | None = None, sector_cap: float = 0.0, betas: DataFrame | None = None,
    gross: float = 1.0
) -> DataFrame:
    """Cap, dollar-neutral, sector-neutral, beta-neutral, then scale to gross."""
    w = capped(w, most) if most is not None else w
    w = dollar_neutral(w)
    w = sector_neutral(w, sectors, sector_cap) if sectors is not None else w
    w = beta_neutral(w, betas) if betas is not None else w
    return renormalised(w, gross)


def rolling_beta(rets: DataFrame, market: DataFrame, window: int = 252) -> DataFrame:
    """ticker, pos, day, beta: population covariance over variance on full windows (ret and market both complete)."""
    r = rets.join(market, "day", "left").withColumn("_rm", F.col("ret") * F.col("market")).withColumn("_mm", F.col("market") * F.col("market"))
    cov = guarded(F.avg("_rm"), "_rm", window, window) - guarded(F.avg("ret"), "ret", window, window) * guarded(F.avg("market"), "market", window, window)
    var = guarded(F.avg("_mm"), "_mm", window, window) - F.pow(guarded(F.avg("market"), "market", window, window), F.lit(2))
    return r.select("ticker", "pos", "day", F.try_divide(cov, var).alias("beta"))


def weigher(scheme: str = "equal", n_buckets: int = 10, vol: DataFrame | None = None, **limits) -> Callable[[DataFrame], DataFrame]:
    """A function from signals (pos, ticker, value) to weights: a scheme ('risk' needs vol), then constrained() if any limit is given."""
    if scheme == "risk" and vol is None:
        raise ValueError("the risk scheme needs volatilities")

    def run(signal: DataFrame) -> DataFrame:
        w = risk_weights(signal, vol, n_buckets) if scheme == "risk" else weights(signal, scheme, n_buckets)
        return constrained(w, **limits) if limits else w

    return run


@dataclass
class Run:
    """A simulation, lazily: every table is read off ``rows``, one row per held name and day.

    rows: pos, ticker, period (first row of the holding period), stop (its last), weight (at its start), before and after
    (weight at the start and the end of the day), ret (of the whole book on the day). Use stored() where several tables of
    one run are wanted.
    """

    rows: DataFrame
    days: DataFrame

    def stored(self) -> Run:
        """The same run with its rows written to the checkpoint folder, so that nothing is simulated twice."""
        return Run(checkpoint(self.rows), self.days)

    @property
    def book(self) -> DataFrame:
        """pos, ticker, weight at the start of the day."""
        return self.rows.select("pos", "ticker", F.col("before").alias("weight"))

    def _moves(self) -> DataFrame:
        """pos, ticker, trade, ret: a period's start weight on its first row and what drifted until its last on the row after, summed by name; 0 otherwise."""
        none = F.lit(0.0)
        here = F.struct("pos", F.when(F.col("pos") == F.col("period"), F.col("weight")).otherwise(none).alias("trade"), "ret")
        then = F.struct((F.col("pos") + 1).alias("pos"), (-F.col("after")).alias("trade"), F.lit(None).cast("double").alias("ret"))
        each = F.when((F.col("pos") == F.col("stop")) & ~F.col("last"), F.array(here, then)).otherwise(F.array(here))
        moves = self.rows.select("ticker", F.inline(each))
        return moves.groupBy("pos", "ticker").agg(F.sum("trade").alias("trade"), F.max("ret").alias("ret"))

    @property
    def trades(self) -> DataFrame:
        """pos, ticker, trade: the target less the drifted book at a change."""
        return self._moves().where("trade <> 0").select("pos", "ticker", "trade")

    @property
    def daily(self) -> DataFrame:
        """pos, day, ret, turnover. Returns are rounded to 14 digits, so that a day on which nothing moves has return 0."""
        per = self._moves().groupBy("pos").agg((F.round(F.max("ret"), 14) + 0.0).alias("ret"), F.sum(F.abs("trade")).alias("turnover"))
        return per.where("ret is not null").join(F.broadcast(self.days.select("pos", "day")), "pos").select("pos", "day", "ret", "turnover")


def simulate(targets: DataFrame, returns: DataFrame, days: DataFrame, exec_lag: int = 1) -> Run:
    """Hold each target (pos, ticker, weight) from the row pos + 1 + exec_lag until the next one is held, drifting with simple returns.

    A day without a target (or with zeros only) keeps the book; missing returns are 0; trades are the target less the
    drifted book at a change. returns: ticker, pos, ret. The targets, rows of the rebalance days only, are computed once
    and written; the rest is one plan: an exchange by (period, ticker) for the products of returns and one by
    (period, day) for the wealth.
    """
    end = last_pos(days)
    targets = checkpoint(targets.select("pos", "ticker", "weight"))
    real = targets.where("weight is not null").withColumn("_g", F.sum(F.abs("weight")).over(Window.partitionBy("pos"))).where("_g > 0").drop("_g")
    starts = real.select("pos").distinct().withColumn("start", F.col("pos") + 1 + exec_lag).withColumn("_next", F.lead("start").over(Window.orderBy("pos")))
    stop = F.least(F.coalesce(F.col("_next") - 1, F.lit(end)), F.lit(end))
    spans = starts.where(F.col("start") <= end).select("pos", "start", stop.alias("stop"), (stop == end).alias("last"))  # at most one row a day
    held = real.where("weight <> 0").join(F.broadcast(spans), "pos").select(
        F.col("start").alias("period"), "ticker", "weight", "stop", "last", F.explode(F.sequence(F.col("start"), F.col("stop"))).alias("pos")
    )
    rows = held.join(returns.select("ticker", "pos", "ret"), ["ticker", "pos"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    w = Window.partitionBy("period", "ticker").orderBy("pos")
    rows = rows.withColumn("_g1", F.product(1 + F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_g0", F.coalesce(F.lag("_g1").over(w), F.lit(1.0)))
    day = Window.partitionBy("pos")  # periods do not overlap
    rows = rows.withColumn("_v1", 1 + F.sum(F.col("weight") * (F.col("_g1") - 1)).over(day)).withColumn("_v0", 1 + F.sum(F.col("weight") * (F.col("_g0") - 1)).over(day))
    rows = rows.select(
        "pos", "ticker", "period", "stop", "last", "weight", (F.col("weight") * F.col("_g0") / F.col("_v0")).alias("before"),
        (F.col("weight") * F.col("_g1") / F.col("_v1")).alias("after"), (F.col("_v1") / F.col("_v0") - 1).alias("ret")
    )
    return Run(rows, days)


@dataclass(frozen=True)
class CostModel:
    """One-way spread in basis points of traded weight, impact coefficient, yearly borrow in basis points of short weight, assets under management."""

    spread_bps: float = 8.0
    impact: float = 0.1
    borrow_bps: float = 75.0
    aum: float = 5e8
    per_year: int = 252


def linear_cost(turnover: Column, bps: float) -> Column:
    return turnover * (bps * 1e-4)


def impact_cost(notional: Column, adv: Column, coefficient: float) -> Column:
    """Coefficient times the root of notional / average dollar volume; 0 where that is missing or not positive."""
    return coefficient * F.sqrt(F.greatest(F.coalesce(F.try_divide(notional, F.when(adv > 0, adv)), F.lit(0.0)), F.lit(0.0)))


def average_dollar_volume(panel: DataFrame, window: int = 21) -> DataFrame:
    """ticker, pos, day, adv: mean raw dollar volume of the trailing rows, at least one."""
    rows = panel.withColumn("_d", dollar_volume())
    return rows.select("ticker", "pos", "day", F.avg("_d").over(by_ticker().rowsBetween(-(window - 1), 0)).alias("adv"))


def with_costs(run: Run, adv: DataFrame, model: CostModel) -> DataFrame:
    """pos, day, gross, linear, impact, borrow, net. Impact of a trade is its weight times the impact rate at its notional."""
    t = run.trades.join(adv.select("ticker", "pos", "adv"), ["ticker", "pos"], "left")
    size = F.abs("trade")
    impact = t.groupBy("pos").agg(F.sum(size * impact_cost(size * model.aum, F.col("adv"), model.impact)).alias("impact"))
    borrow = run.book.groupBy("pos").agg(
        (F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)) * (model.borrow_bps * 1e-4 / model.per_year)).alias("borrow")
    )
    d = run.daily.join(impact, "pos", "left").join(borrow, "pos", "left")
    d = d.select(
        "pos", "day", F.col("ret").alias("gross"), linear_cost(F.col("turnover"), model.spread_bps).alias("linear"),
        F.coalesce("impact", F.lit(0.0)).alias("impact"), F.coalesce("borrow", F.lit(0.0)).alias("borrow")
    )
    return d.withColumn("net", F.col("gross") - F.col("linear") - F.col("impact") - F.col("borrow"))


# The spreads of the cost curve, in basis points.
SPREADS = (0.0, 5.0, 10.0, 15.0, 20.0, 25.0)


def sharpe_by_cost(run: Run, adv: DataFrame, grid: tuple[float, ...] = SPREADS, model: CostModel = CostModel()) -> DataFrame:  # noqa: B008
    """bps, net_sharpe: the one gross run priced at several spreads; only the linear term differs."""
    base = with_costs(run, adv, CostModel(0.0, model.impact, model.borrow_bps, model.aum, model.per_year)).join(run.daily.select("pos", "turnover"), "pos")
    each = base.select(
        F.explode(F.array(*(F.lit(float(b)) for b in grid))).alias("bps"), "net", "turnover"
    ).withColumn("net", F.col("net") - F.col("turnover") * F.col("bps") * 1e-4)
    return each.groupBy("bps").agg((F.try_divide(F.avg("net"), F.stddev_samp("net")) * model.per_year**0.5).alias("net_sharpe"))


def hard_to_borrow(capped_panel: DataFrame, adv: DataFrame, quantile: float = 0.2) -> DataFrame:
    """ticker, pos, htb: both market cap and average dollar volume within the day's lowest quantile (linear, missing left out)."""
    rows = capped_panel.select("ticker", "pos", "cap").join(adv.select("ticker", "pos", "adv"), ["ticker", "pos"])
    q = rows.groupBy("pos").agg(F.percentile("cap", F.lit(quantile)).alias("_qc"), F.percentile("adv", F.lit(quantile)).alias("_qa"))
    return rows.join(q, "pos").select("ticker", "pos", F.coalesce((F.col("cap") <= F.col("_qc")) & (F.col("adv") <= F.col("_qa")), F.lit(False)).alias("htb"))


def without_hard_shorts(w: DataFrame, flags: DataFrame) -> DataFrame:
    """Short weights of flagged names set to 0; names without a flag count as not flagged."""
    rows = w.join(flags.select("ticker", "pos", "htb"), ["ticker", "pos"], "left")
    return rows.withColumn("weight", F.when((F.col("weight") < 0) & F.coalesce("htb", F.lit(False)), 0.0).otherwise(F.col("weight"))).select(*w.columns)


def capacity(book: DataFrame, adv: DataFrame, aum: float) -> DataFrame:
    """ticker, max_days, mean_days: position size in days of average dollar volume, over the days it is held; names without any left out."""
    rows = book.join(adv.select("ticker", "pos", "adv"), ["ticker", "pos"]).withColumn(
        "_x", F.try_divide(F.abs("weight") * aum, F.when(F.col("adv") > 0, F.col("adv")))
    ).where("_x > 0")
    return rows.groupBy("ticker").agg(F.max("_x").alias("max_days"), F.avg("_x").alias("mean_days"))
