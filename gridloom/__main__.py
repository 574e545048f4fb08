"""python -m gridloom STUDY DATA OUT: studies of a data folder as CSV and HTML, or offline source files into tables.

Studies: zoo, scorecard, information, backtest, audit, grid. Sources: facts and shares (company facts, DATA/*.json),
filings (filing indexes, DATA/*.json), factors (a factor file), prices (a parquet file per ticker), membership (DATA/changes.csv
with date, added, removed and DATA/current.csv with ticker, date_added).
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from gridloom.engine import get_session
from gridloom.operators import universe
from gridloom.operators.factors import FACTORS
from gridloom.operators.graphs import GRAPH_FACTORS
from gridloom.plans import reports, study
from gridloom.sources import filings, tables
from gridloom.sources.catalog import Catalog


def find(name: str):
    known = {f.name: f for registry in (GRAPH_FACTORS, FACTORS) for f in registry.all()}
    if name not in known:
        raise SystemExit(f"{name!r} is none of the factors {', '.join(sorted(known))}")
    return known[name]


def ingest(spark: SparkSession, kind: str, data: str, out: str) -> DataFrame:
    """Offline source files into one parquet table."""
    if kind in ("facts", "shares", "filings"):
        read = {"facts": filings.facts_table, "shares": filings.shares_table, "filings": filings.annual_reports}[kind]
        made = read(filings.json_files(spark, f"{data}/*.json"))
    elif kind == "factors":
        made = filings.factor_file(spark.read.text(data))
    elif kind == "prices":
        made = tables.price_files(spark, data)
    else:
        changes = filings.change_log(tables.read(spark, f"{data}/changes.csv", "csv", "date string, added string, removed string"))
        current = tables.read(spark, f"{data}/current.csv", "csv", "ticker string, date_added string")
        made = universe.intervals_from_changes(changes, current)
    tables.write(made, out, mode="overwrite")
    return spark.read.parquet(out)


SOURCES = ("facts", "shares", "filings", "factors", "prices", "membership")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("study", choices=["zoo", "scorecard", "information", "backtest", "audit", "grid", *SOURCES])
    p.add_argument("data")
    p.add_argument("out")
    p.add_argument("--factor", default="momentum_12_1", help="a factor's name, or 'all' for every classical one")
    p.add_argument("--oos", default=None, help="evaluate from this day on, e.g. 2020-01-01")
    p.add_argument("--n-trials", type=int, default=None, help="number of trials behind the deflated Sharpe ratio")
    p.add_argument("--var-sharpe", type=float, default=1.0, help="variance of the trials' Sharpe ratios")
    p.add_argument("--spread-bps", type=float, default=8.0)
    p.add_argument("--impact-coef", type=float, default=0.1)
    p.add_argument("--borrow-bps", type=float, default=75.0)
    p.add_argument("--aum", type=float, default=5e8)
    p.add_argument("--years", type=float, default=5, help="last years of the calendar the zoo looks at")
    p.add_argument("--freq", default="M", help="W, M, Q or a number of days")
    p.add_argument("--scheme", default="equal", choices=["equal", "signal", "rank"])
    p.add_argument("--buckets", type=int, default=10)
    p.add_argument("--horizon", type=int, default=21)
    p.add_argument("--least", type=int, default=30, help="smallest cross-section")
    p.add_argument("--first", default="2008-01-01")
    p.add_argument("--last", default="2025-12-31")
    p.add_argument("--day", default="2018-06-15")
    p.add_argument("--master", default=None)
    a = p.parse_args(argv)
    spark = get_session(a.master)
    if a.study in SOURCES:
        print(f"{ingest(spark, a.study, a.data, a.out).count()} rows in {a.out}")
        return
    c = Catalog(spark, a.data)
    if a.study == "grid":
        study.register_grid(spark, a.out)
        return
    if a.study == "zoo":
        found = {"zoo": study.factor_zoo(c, FACTORS.all(), a.horizon, a.buckets, a.least, horizons=(1, 5, 21), years=a.years, warm_up=273)}
    elif a.study == "scorecard":
        found = {"scorecard": study.scorecard(c, GRAPH_FACTORS.all(), FACTORS.all(), len(study.configurations()), a.horizon, a.buckets, a.least)}
    elif a.study == "information":
        found = reports.information_report(c, find(a.factor), least=a.least)
    elif a.study == "audit":
        found = reports.audit_report(c, a.first, a.last, a.day)
    else:
        factors = FACTORS.all() if a.factor == "all" else [find(a.factor)]
        costs = reports.B.CostModel(a.spread_bps, a.impact_coef, a.borrow_bps, a.aum)
        split = (date.fromisoformat(a.oos) - date(1970, 1, 1)).days if a.oos else None
        freq = int(a.freq) if a.freq.isdigit() else a.freq
        found = {}
        for f in factors:
            made = reports.backtest_report(c, f, freq, reports.B.weigher(a.scheme, a.buckets), costs, split, a.n_trials, a.var_sharpe).tables
            found |= {name if len(factors) == 1 else f"{f.name}_{name}": t for name, t in made.items()}
    print(reports.save(found, a.out, a.study))


if __name__ == "__main__":
    main()
