"""The registered studies take the whole set of factors, snapshots and replicates."""

import inspect
import math

from gridloom.operators import evaluate as E
from gridloom.operators import factors as X
from gridloom.operators import graphs as G
from gridloom.operators.graphs import density_report
from gridloom.plans import portfolios as P
from gridloom.plans import studies as Q
from gridloom.plans import study as T


def names(factors):
    return sorted(f.name for f in factors)


def test_zoo_takes_every_factor(spark, monkeypatch):
    taken = []

    def zoo(catalog, factors, *settings, **more):
        taken.extend(names(factors))
        return spark.createDataFrame([], T.ZOO_SCHEMA)

    monkeypatch.setattr(T, "factor_zoo", zoo)
    Q.zoo(spark, "nowhere")
    assert taken == names(X.FACTORS.all()) and len(taken) == 8


def test_scorecard_takes_every_factor(spark, monkeypatch):
    taken = []

    def scorecard(catalog, graph, classical, *settings, **more):
        taken.extend((names(graph), names(classical)))
        return spark.createDataFrame([], T.SCORE_SCHEMA)

    monkeypatch.setattr(T, "scorecard", scorecard)
    Q.scorecard(spark, "nowhere")
    assert taken == [names(G.GRAPH_FACTORS.all()), names(X.FACTORS.all())] and len(taken[0]) == 7


def test_spanning_is_against_all_other_factors(spark, rows, monkeypatch):
    monkeypatch.setattr(E, "factor_long_short", lambda c, factors, *settings: rows(
        "factor string, day int, ret double", [(f.name, d, math.sin(d * d * i)) for i, f in enumerate(factors, 1) for d in range(60)]
    ))
    terms = [r["term"] for r in Q.exposures(spark, "nowhere").collect()]
    assert terms == ["alpha", *(n for n in names(X.FACTORS.all()) if n != "reversal_1m")]


def test_density_null_takes_month_ends_and_the_default_shuffles(monkeypatch):
    monkeypatch.setattr(P, "windows", lambda catalog: "month ends")
    monkeypatch.setattr(G, "density_report", lambda *given, **more: (given, more))
    assert P.graph_density(None, "nowhere") == (("month ends",), {})
    assert inspect.signature(density_report).parameters["shuffles"].default == 200


def test_bootstrap_takes_the_default_replicates(monkeypatch):
    monkeypatch.setattr(Q, "_against_others", lambda spark, d: ("target", "others"))
    monkeypatch.setattr(T, "bootstrap", lambda *given, **more: (given, more))
    assert Q.bootstrap(None, "nowhere") == ((None, "target", "others"), {"names": [n for n in names(X.FACTORS.all()) if n != "reversal_1m"]})
