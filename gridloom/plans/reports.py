"""Backtest and audit reports: a signal through schedule, weights, simulation, costs and metrics to summary tables and files."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.engine.session import checkpoint
from gridloom.functions import inference as I
from gridloom.operators import audit as A
from gridloom.operators import backtest as B
from gridloom.operators import evaluate as E
from gridloom.operators import graphs as G
from gridloom.operators import metrics as M
from gridloom.operators.factors import Factor
from gridloom.operators.universe import restrict, sizes_at_month_ends
from gridloom.plans.study import exposures, long_short_moments
from gridloom.sources.catalog import Catalog
from gridloom.sources.tables import report


def backtest(catalog: Catalog, factor: Factor, freq: str | int = "M", weigh=None, exec_lag: int = 1, in_universe: bool = False) -> B.Run:
    """Simulate a factor: signals on the schedule, weights, drift. ``weigh`` maps signals to weights (equal buckets by default)."""
    signal = factor.oriented(catalog).join(F.broadcast(G.rebalance_days(catalog.days, freq).select("pos")), "pos", "left_semi")
    signal = restrict(signal, catalog.periods) if in_universe else signal
    return B.simulate((weigh or B.weigher())(signal.select("pos", "ticker", "value")), catalog.returns("simple", pad_gaps=True), catalog.days, exec_lag)


def holding_period_sweep(catalog: Catalog, factor: Factor, held: tuple[int, ...] = (1, 5, 21), **settings) -> dict[int, B.Run]:
    return {n: backtest(catalog, factor, n, **settings) for n in held}


@dataclass
class Report:
    """Tables of one backtest."""

    costed: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def backtest_report(catalog: Catalog, factor: Factor, freq: str | int = "M", weigh=None, costs: B.CostModel = B.CostModel(), split_day: int | None = None, n_trials: int | None = None, var_sharpe: float | None = None) -> Report:  # noqa: B008
    """Gross and net metrics, benchmark, beta, factor exposures (where the catalog has a table ``factor_returns``: factor, day, ret), cost curve, capacity, equity with drawdown, rolling Sharpe, monthly returns, settings and headline.

    From ``split_day`` on only; equity, rolling Sharpe and monthly returns are of the whole run. A deflated Sharpe ratio
    needs both n_trials and var_sharpe.
    """
    run = backtest(catalog, factor, freq, weigh).stored()
    adv = B.average_dollar_volume(catalog.panel)
    costed = checkpoint(B.with_costs(run, adv, costs))
    kept = costed if split_day is None else costed.where(F.col("day") >= split_day)
    series = kept.select(
        "day", F.inline(F.array(*(F.struct(F.lit(s).alias("series"), F.col(s).alias("ret")) for s in ("net", "gross"))))
    ).select("series", "day", "ret")
    net = series.where("series = 'net'")
    grid = tuple(sorted({*B.SPREADS, costs.spread_bps}))
    tables = {
        "metrics": M.performance(series, costs.per_year), "benchmark": M.benchmark_table(net, catalog.market, per_year=costs.per_year), "beta": M.realised_beta(net, catalog.market), "monthly": M.monthly_returns(net),
        "cost_curve": B.sharpe_by_cost(run, adv, grid, costs), "capacity": B.capacity(run.book, adv, costs.aum),
        "costs": kept.agg(*(F.sum(c).alias(c) for c in ("linear", "impact", "borrow"))),
    }
    whole = costed.select("day", F.inline(F.array(*(F.struct(F.lit(s).alias("series"), F.col(s).alias("ret")) for s in ("net", "gross")))))
    tables["equity"] = M.equity(whole.select("series", "day", "ret"))
    tables["rolling_sharpe"] = M.rolling_sharpe(whole.where("series = 'net'").select("series", "day", "ret"), per_year=costs.per_year)
    tables["turnover"] = M.average_turnover(run.daily if split_day is None else run.daily.where(F.col("day") >= split_day))
    try:
        tables["exposures"] = exposures(catalog.spark, net, catalog.table("factor_returns"))
    except (KeyError, AnalysisException):
        pass  # no factor returns at hand: the section is left out
    span = costed.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    turned = tables["turnover"].first()
    score = tables["metrics"].where("series = 'net'").first()
    names = run.book.where("weight <> 0").agg(F.countDistinct("ticker")).first()[0]
    label = "full sample" if split_day is None else f"from day {split_day}"
    shown = {
        "factor": factor.name, "freq": freq, "spread_bps": costs.spread_bps, "impact": costs.impact, "borrow_bps": costs.borrow_bps, "aum": costs.aum,
        "first_day": span["a"], "last_day": span["b"], "universe_size": names, "n_rebalances": turned["n_rebalances"], "evaluated_on": label,
    }
    number = lambda x, f: "n/a" if x is None else format(x, f)
    shown["headline"] = (
        f"Turnover {number(turned['avg_turnover'], '.1%')} per rebalance; assumed cost {costs.spread_bps:.0f} bps; "
        f"net Sharpe {number(score and score['sharpe'], '.2f')} ({label})."
    )
    tables["settings"] = catalog.spark.createDataFrame([(k, str(v)) for k, v in shown.items()], "setting string, value string")
    if n_trials is not None and var_sharpe is not None:
        m = long_short_moments(net.select(F.lit(factor.name).alias("factor"), "ret")).collect()
        d = [
            (
                r["factor"], r["n"], r["sharpe"],
                I.deflated_sharpe(r["sharpe"], n_trials, r["n"], var_sharpe, r["skew"] or 0.0, (r["kurtosis"] or 0.0) + 3)
            ) for r in m
        ]
        tables["deflated_sharpe"] = catalog.spark.createDataFrame(d, "factor string, n long, sharpe double, deflated double")
    return Report(costed, tables)


def information_report(catalog: Catalog, factor: Factor, horizons: tuple[int, ...] = (1, 5, 21), least: int = 30, smooth: int = 63) -> dict[str, DataFrame]:
    """A factor's rank correlations: by day with their trailing mean, and summarised with HAC t per horizon."""
    ic = checkpoint(E.factor_information(catalog, [factor], horizons, least))
    w = Window.partitionBy("factor", "horizon").orderBy("day").rowsBetween(-(smooth - 1), 0)
    summary = [E.summarise_information(ic.where(F.col("horizon") == h), max(h - 1, 0)) for h in horizons]
    return {"information": ic.withColumn("smoothed", F.avg("ic").over(w)), "summary": reduce(DataFrame.unionByName, summary)}


def audit_report(catalog: Catalog, first: str, last: str, check_day: str) -> dict[str, DataFrame]:
    """All audits of a catalog."""
    end = catalog.days.agg(F.max("day")).first()[0] or 0
    return {
        "universe_size": sizes_at_month_ends(catalog.periods, first, last), "missing_share": A.missing_share(catalog.panel, catalog.periods), "return_quantiles": A.return_quantiles(catalog.panel),
        "leakage": A.leakage_check(catalog.table("membership"), catalog.periods, check_day), "churn": A.churn_check(catalog.periods, end), "adjustment": A.adjustment_check(catalog.panel),
    }


def save(tables: dict[str, DataFrame], folder: str, title: str) -> str:
    return report(tables, folder, title)
