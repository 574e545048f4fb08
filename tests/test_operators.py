"""Panels, universe, evaluation, inference, networks, simulation, sources and streams: closed forms, planted signals, no look-ahead."""

import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.functions import inference as I
from gridloom.functions import network as N
from gridloom.operators import audit, backtest, evaluate, graphs, metrics, panel, universe, vectors
from gridloom.operators import factors as X
from gridloom.plans import intake, study
from gridloom.sources import filings
from gridloom.sources import tables as sources
from gridloom.sources.catalog import Catalog

T0 = dt.date(2019, 1, 1)
PRICES = "date date, ticker string, close double, `adj close` double, volume double, loaded_at timestamp_ntz"


def day(k):
    return T0 + dt.timedelta(days=k)


def prices(n_tickers=12, n_days=330, seed=0, drift=None):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n_tickers):
        p = 100.0
        for k in range(n_days):
            p = 100 * math.exp(drift[i] * k) if drift is not None else p * math.exp(rng.normal(0, 0.012))
            out.append((day(k), f"T{i:02d}", p, p, 1e6 * (i + 1), None))
    return out


def catalog(spark, rows, data, **tables):
    spans = rows("ticker string, start_date date, end_date date", [(t, None, None) for t in sorted({x[1] for x in data})])
    return Catalog(spark, prices=rows(PRICES, data), membership=spans, **tables)


def test_monotone_drifts_have_perfect_information(spark, rows):
    c = catalog(spark, rows, prices(12, 330, drift=np.linspace(0.0002, 0.003, 12)))
    ic = evaluate.factor_information(c, [X.FACTORS.get("momentum_12_1")], (5,), least=10).collect()
    assert len(ic) == 330 - 252 - 5 and all(r["ic"] == pytest.approx(1) for r in ic)


def test_factors_do_not_look_ahead(spark, rows):
    a = prices(4, 120, 1)
    cut = day(90)
    b = [(d, t, c * 3 if d > cut else c, p * 3 if d > cut else p, v, x) for d, t, c, p, v, x in a]
    for name in ("reversal_1m", "volatility_60", "amihud_illiquidity", "idiosyncratic_skew"):
        past = []
        for data in (a, b):
            rows_ = X.FACTORS.get(name).panel(catalog(spark, rows, data)).where(F.col("day") <= (cut - dt.date(1970, 1, 1)).days).collect()
            past.append({(r["ticker"], r["pos"]): r["value"] for r in rows_})
        assert len(past[0]) == 4 * 91 and past[0].keys() == past[1].keys()
        for k, v in past[0].items():  # sums over tickers may come in another order
            assert past[1][k] == (v if v is None else pytest.approx(v, rel=1e-9))


def test_factor_classes(spark, rows):
    c = catalog(spark, rows, prices(3, 40))
    f = X.FACTORS.get("reversal_1m")
    assert repr(f) == "Expression('reversal_1m', -1)" and X.FACTORS.register(X.Expression("reversal_1m", 1, None)) is f
    last = f.on(c, 10**6).collect()
    assert len(last) == 3 and f.on(c, -1).count() == 0
    with pytest.raises(TypeError):
        X.Stored("no panel", "x")
    assert study.reuse_difference(c, f, 1, least=3) == 0.0


def test_panel_rules(rows):
    data = [(day(k), t, 10.0 + k, 10.0 + k, 1.0, None) for t in ("A", "B") for k in range(10) if not (t == "A" and k in (3, 4))]
    p = panel.price_panel(rows(PRICES, data))
    a = {r["pos"]: r for r in panel.returns(p, "log").where("ticker = 'A'").collect()}
    assert len(a) == 10 and a[3]["adj"] is None and a[5]["ret"] is None and a[2]["ret"] == pytest.approx(math.log(12 / 11))
    s = {r["pos"]: r["ret"] for r in panel.returns(p, "simple", pad_gaps=True).where("ticker = 'A'").collect()}
    assert s[3] == 0 and s[5] == pytest.approx(15 / 12 - 1)
    with pytest.raises(ValueError):
        panel.returns(p, "other")
    with pytest.raises(KeyError):
        panel.cross_section(p, 5)
    assert panel.price_panel(rows(PRICES)).count() == 0
    tail = panel.price_panel(rows(PRICES, [x for x in data if x[1] == "B" or x[0] < day(3)]), tail=4)
    assert tail.where("ticker = 'A'").count() == 7


def test_ranks_and_buckets(rows):
    v = rows("factor string, ticker string, pos int, day int, value double", [("f", f"t{i}", 0, 0, float(x)) for i, x in enumerate([1, 2, 2, 3, 3, 3, 4, 5, 6, 7])])
    r = {x["ticker"]: x["k"] for x in v.select("ticker", evaluate.average_rank("value", ["factor", "day"]).alias("k")).collect()}
    assert [r[f"t{i}"] for i in range(10)] == [1, 2.5, 2.5, 5, 5, 5, 7, 8, 9, 10]
    side = {x["ticker"]: x["side"] for x in evaluate.buckets(v, 5).collect()}
    assert [side[f"t{i}"] for i in range(10)] == [-1, -1, 0, 0, 0, 0, 0, 0, 1, 1]


def test_turnover_counts_entries_and_exits(rows):
    s = [("f", t, 0, d, side) for d, top, low in ((1, "ab", "cd"), (2, "ac", "bd"), (3, "ac", "bd")) for side, names in ((1, top), (-1, low)) for t in names]
    t = {r["day"]: r["turnover"] for r in evaluate.turnover(rows("factor string, ticker string, pos int, day int, side int", s)).collect()}
    assert t == {2: 1.0, 3: 0.0}


def test_hac_t_matches_numpy(rows):
    x = np.random.default_rng(0).normal(0.1, 1, 80)
    got = evaluate.hac_t(rows("g string, day int, x double", [("a", i, float(v)) for i, v in enumerate(x)]), ["g"], 6).first()["t"]
    assert got == pytest.approx(I.newey_west_t(x, 6))
    assert evaluate.hac_t(rows("g string, day int, x double", [("a", 1, 1.0)]), ["g"], 2).first()["t"] is None


def test_inference():
    assert I.pvalue_of_t(2.0, 10) == pytest.approx(0.0733880348) and I.pvalue_of_t(1.959963985) == pytest.approx(0.05)
    assert I.pvalue_of_t(None) is None and I.pvalue_of_t(1.0, 0) is None
    assert I.benjamini_hochberg({"a": 0.001, "b": 0.012, "c": 0.02, "d": 0.9, "e": None}) == {"a": True, "b": True, "c": True, "d": False, "e": False}
    assert I.bonferroni({"a": 0.001, "b": 0.03}) == {"a": True, "b": False}
    assert I.expected_max_sharpe(1, 1.0) == 0 and I.expected_max_sharpe(100, 1.0) == pytest.approx(2.53, abs=0.01)
    assert I.deflated_sharpe(0.5, 10, 100, 0.01) > 0.9 and I.deflated_sharpe(10.0, 10, 100, 0.01, skew=50.0) is None
    rng = np.random.default_rng(1)
    f = rng.normal(0.02, 1, (600, 3))
    y = 0.3 + f @ [0.5, -0.2, 0.1] + rng.normal(0, 1, 600)
    r = I.incremental_alpha(y, f)
    assert r["alpha"] == pytest.approx(0.3, abs=0.15) and r["t"] > 3 and r["theta_gain"] > 0
    assert r["grs_p"] == pytest.approx(I.pvalue_of_t(math.sqrt(r["grs"]), 596))
    both = I.squared_sharpe(np.column_stack([f, y]))
    assert both == pytest.approx(r["theta_base"] + r["theta_gain"], rel=1e-6)  # the spanning identity
    spread = I.bootstrap_alphas(y, f, np.arange(200), 8)
    assert np.quantile(spread, 0.025) < r["alpha"] < np.quantile(spread, 0.975)
    assert I.regression(y[:3], f[:3], 2)["coef"] is None and I.squared_sharpe(f[:2]) == 0


def test_networks_in_closed_form():
    star = np.zeros((5, 5))
    star[0, 1:] = star[1:, 0] = 1
    assert np.allclose(N.degree(star), [1, 0.25, 0.25, 0.25, 0.25]) and np.allclose(N.betweenness(star), [1, 0, 0, 0, 0]) and np.allclose(N.clustering(star), 0)
    path = np.diag([1.0] * 3, 1) + np.diag([1.0] * 3, -1)
    assert np.allclose(N.betweenness(path), [0, 2 / 3, 2 / 3, 0])
    clique = np.ones((4, 4))
    assert np.allclose(N.clustering(clique), 1) and np.allclose(N.eigenvector(clique), 0.5)
    two = np.kron(np.eye(2), np.ones((4, 4)))
    two[3, 4] = two[4, 3] = 0.1
    label = N.communities(two)
    assert label.tolist() == [0] * 4 + [1] * 4 and N.cohesion(two, label)[0] == 1
    assert N.align_labels({"a": 0, "b": 0, "c": 1}, {"a": 1, "b": 1, "c": 0, "d": 2}) == {"a": 0, "b": 0, "c": 1, "d": 2}
    assert list(graphs.iterate_labels([{"a": 0, "b": 1}, {"a": 5, "b": 3, "c": 3}])) == [{"a": 0, "b": 1}, {"a": 0, "b": 1, "c": 1}]
    with pytest.raises(ValueError):
        N.eigenvector(-star)
    assert not N.eigenvector(np.zeros((3, 3))).any() and N.betweenness(np.zeros((2, 2))).tolist() == [0, 0]


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(80):
        a = rng.integers(0, 9, (rng.integers(1, 5), rng.integers(1, 5))).astype(float)
        k = min(a.shape)
        best = min(sum(a[i, j] for i, j in zip(r, c, strict=True)) for r in itertools.permutations(range(a.shape[0]), k) for c in itertools.permutations(range(a.shape[1]), k))
        pairs = N.assignment(a)
        assert len(pairs) == k and sum(a[p] for p in pairs) == best


def test_shrinkage_and_tree():
    x = np.random.default_rng(3).normal(size=(80, 12))
    s, w = N.shrunk_covariance(x)
    assert 0 < w < 1 and np.trace(s) == pytest.approx(np.cov(x, rowvar=False, ddof=0).trace())
    c = N.shrunk_correlation(x)
    tree, d = N.spanning_tree(c), N.correlation_distance(c)
    parent, chosen = list(range(12)), set()

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for _, i, j in sorted((d[i, j], i, j) for i in range(12) for j in range(i)):
        if root(i) != root(j):
            parent[root(i)] = root(j)
            chosen.add((j, i))
    assert chosen == set(map(tuple, np.argwhere(np.triu(tree)).tolist()))
    assert N.usable_columns(np.column_stack([x[:, 0], np.ones(80), np.where(np.arange(80) == 3, np.nan, x[:, 1])])).tolist() == [True, False, False]


def test_lead_lag_finds_what_was_planted():
    x = np.random.default_rng(0).normal(size=(250, 8))
    x[1:, 1] += 0.8 * x[:-1, 0]
    x[1:, 3] += 0.8 * x[:-1, 2]
    d = N.lead_lag(x)
    assert d[0, 1] > 0.4 and d[2, 3] > 0.4 and N.out_degree(d)[0] > 0 and N.in_degree(d)[1] > 0
    assert N.density(d) > np.mean([N.shuffled_density(x, s) for s in range(20)])
    assert N.upstream(d, x)[1] != 0 and np.abs(N.residualised(x).mean(axis=0)).max() < 1e-12


def test_graph_factors_hold_between_snapshots(spark, rows):
    c = catalog(spark, rows, prices(6, 200, 4))
    f = X.Registry().register(graphs.GraphFactor("d", graphs.tree_statistic(N.degree), window=60))
    snaps = f.snapshots(c).collect()
    daily = f.panel(c).collect()
    ends = sorted({r["snap"] for r in snaps})
    assert len(ends) == 5 and len(daily) == 6 * (200 - ends[0])
    by = {(r["ticker"], r["snap"]): r["value"] for r in snaps}
    assert all(r["value"] == by[r["ticker"], max(e for e in ends if e <= r["pos"])] for r in daily)
    assert graphs.ChangeFactor("x", graphs.tree_statistic(N.degree), window=60).panel(c).count() == 6 * (200 - ends[1])
    nodes = graphs.node_table(graphs.window_rows(c.returns("log"), graphs.rebalance_days(c.days, "M"), 60), 60)
    assert nodes.groupBy("snap").agg(F.sum("degree").alias("s")).where("s > 0").count() == 5
    with pytest.raises(ValueError):
        graphs.rebalance_days(c.days, 0)
    with pytest.raises(ValueError):
        graphs.lead_lag_statistic("sideways")
    report = graphs.density_report(graphs.window_rows(c.returns("log"), graphs.rebalance_days(c.days, "Q"), 60), 60, shuffles=10).collect()
    assert report and all(0 <= r["p_value"] <= 1 for r in report)


def test_neutral_values_are_orthogonal(rows):
    rng = np.random.default_rng(5)
    data = [(1, f"t{i}", float(v), "xyz"[i % 3]) for i, v in enumerate(rng.normal(size=30))]
    v = rows("day int, ticker string, value double, sector string", data)
    control = rows("day int, ticker string, value double", [(1, f"t{i}", float(x)) for i, x in enumerate(rng.normal(size=30))])
    sectors = v.select("ticker", "sector")
    out = graphs.neutralised(v, {"c": control}, sectors).toPandas().set_index("ticker")["value"]
    ctl = N.average_ranks(control.toPandas().set_index("ticker")["value"].reindex(out.index).to_numpy())
    sec = sectors.toPandas().set_index("ticker")["sector"].reindex(out.index)
    assert abs(out.to_numpy() @ ctl) < 1e-8 and out.groupby(sec).sum().abs().max() < 1e-8
    alone = graphs.neutralised(v, None, sectors).toPandas().set_index("ticker")["value"]
    assert alone.groupby(sec.reindex(alone.index)).sum().abs().max() < 1e-8
    assert graphs.neutralised(v, least=31).count() == 0


def test_cluster_agreement(rows):
    nodes = rows("snap int, ticker string, community int", [(1, f"t{i}", i // 3) for i in range(9)])
    same = rows("ticker string, sector string", [(f"t{i}", f"s{i // 3}") for i in range(9)])
    other = rows("ticker string, sector string", [(f"t{i}", f"s{i % 3}") for i in range(9)])
    assert graphs.cluster_sector_table(nodes, same)[1].first()["adjusted_rand"] == 1.0
    assert graphs.cluster_sector_table(nodes, other)[1].first()["adjusted_rand"] < 0


def test_simulation_is_buy_and_hold_between_changes(rows):
    rng = np.random.default_rng(6)
    n, names = 60, ["a", "b", "c"]
    r = rng.normal(0, 0.02, (n, 3))
    returns = rows("ticker string, pos int, ret double", [(t, k, None if (k, j) == (30, 1) else float(r[k, j])) for k in range(n) for j, t in enumerate(names)])
    r[30, 1] = 0
    days = rows("day int, pos int", [(k + 100, k) for k in range(n)])
    targets = {5: [0.5, -0.5, 0.0], 20: [0.0, 0.0, 0.0], 35: [-0.2, 0.4, -0.4], 58: [1.0, 0.0, 0.0]}
    run = backtest.simulate(rows("pos int, ticker string, weight double", [(p, t, w) for p, ws in targets.items() for t, w in zip(names, ws, strict=True)]), returns, days)
    got = {x["pos"]: x for x in run.daily.collect()}
    book, w = {}, np.zeros(3)
    for k in range(n):
        if k - 2 in targets and any(targets[k - 2]):
            new = np.array(targets[k - 2])
            assert got[k]["turnover"] == pytest.approx(np.abs(new - w).sum())
            w = new
        if w.any():
            assert got[k]["ret"] == pytest.approx(w @ r[k])
            book[k] = w
            w = w * (1 + r[k]) / (1 + w @ r[k])
        else:
            assert k not in got
    held = {}
    for x in run.book.collect():
        held.setdefault(x["pos"], {})[x["ticker"]] = x["weight"]
    for k, ws in book.items():
        assert [held[k].get(t, 0) for t in names] == pytest.approx(ws.tolist())


def test_weights_and_constraints(rows):
    s = rows("pos int, ticker string, value double", [(1, f"t{i:02d}", float(i)) for i in range(20)] + [(2, "x", 1.0)] + [(3, t, 1.0) for t in "ab"])
    for scheme in ("equal", "signal", "rank"):
        w = [r["weight"] for r in backtest.weights(s, scheme, 5).where("pos = 1").collect()]
        assert sum(w) == pytest.approx(0) and sum(map(abs, w)) == pytest.approx(1)
        assert backtest.weights(s, scheme, 5).where("pos = 2").count() == 0
    assert [r["weight"] for r in backtest.weights(s, "rank").where("pos = 3").collect()] == [0, 0]
    with pytest.raises(ValueError):
        backtest.weights(s, "other")
    sectors = rows("ticker string, sector string", [(f"t{i:02d}", "uv"[i % 2]) for i in range(19)])
    betas = rows("pos int, ticker string, beta double", [(1, f"t{i:02d}", 0.5 + i / 20) for i in range(20)])
    c = backtest.constrained(backtest.weights(s, "rank").where("pos = 1"), 0.06, sectors, 0.01, betas).join(betas, ["pos", "ticker"])
    t = c.agg(F.sum(F.col("weight") * F.col("beta")), F.sum(F.abs("weight"))).first()
    assert t[0] == pytest.approx(0, abs=1e-12) and t[1] == pytest.approx(1)
    vol = rows("pos int, ticker string, vol double", [(1, f"t{i:02d}", 0.1 * (1 + i % 3)) for i in range(20)])
    k = backtest.risk_weights(s.where("pos = 1"), vol, 5).collect()
    assert sum(r["weight"] for r in k) == pytest.approx(0) and sum(abs(r["weight"]) for r in k) == pytest.approx(1)
    flags = rows("ticker string, pos int, htb boolean", [("t00", 1, True)])
    assert backtest.without_hard_shorts(backtest.weights(s, "equal", 5), flags).where("ticker = 't00'").first()["weight"] == 0


def test_impact_grows_with_size(rows):
    df = rows("n double, a double", [(1e6, 1e8), (2e6, 1e8), (1e6, 0.0), (1e6, None)]).select(backtest.impact_cost(F.col("n"), F.col("a"), 0.1).alias("c"))
    c = [r["c"] for r in df.collect()]
    assert c[1] / c[0] == pytest.approx(2**0.5) and c[2:] == [0, 0]


def test_metrics(rows):
    r = [0.01, -0.02, 0.03, None, 0.0, -0.01]
    p = metrics.performance(rows("series string, day int, ret double", [("s", i, x) for i, x in enumerate(r)] + [("z", i, 0.0) for i in range(3)]))
    s, z = (p.where(f"series = '{k}'").first() for k in "sz")
    eq = np.cumprod([1.01, 0.98, 1.03, 1, 1, 0.99])
    assert s["total_return"] == pytest.approx(eq[-1] - 1) and s["max_drawdown"] == pytest.approx(max(1 - eq / np.maximum.accumulate(eq)))
    x = np.array([v for v in r if v is not None])
    assert s["n"] == 5 and s["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1) * 252**0.5) and s["profit_factor"] == pytest.approx(0.04 / 0.03) and s["hit_rate"] == pytest.approx(0.4)
    assert z["sharpe"] is None and z["calmar"] is None and z["profit_factor"] is None and z["total_return"] == 0
    m = metrics.monthly_returns(rows("series string, day int, ret double", [("s", 0, 0.1), ("s", 1, 0.1), ("s", 70, -0.5)])).orderBy("year", "month").collect()
    assert [round(x["ret"], 6) for x in m] == [0.21, 0, -0.5]
    assert metrics.month_table(metrics.monthly_returns(rows("series string, day int, ret double", [("s", 0, 0.1)]))).columns[:3] == ["series", "year", "1"]
    assert metrics.performance(rows("series string, day int, ret double")).count() == 0


def test_universe_from_changes(rows):
    changes = rows("date date, added string, removed string", [(day(1), "A", ""), (day(5), "B", "A"), (day(5), "B", "A"), (day(9), "A", None), (day(3), "", "C"), (day(20), "D", "old"), (day(2), "new", "E"), (day(12), "F", "")])
    current = rows("ticker string, date_added string", [("A", None), ("b", None), ("G", "2018-05-01"), ("new", None), ("D", None)])
    got = {tuple(r) for r in universe.intervals_from_changes(changes, current, renames={"OLD": "NEW"}, exits={"F": "2019-01-20"}).collect()}
    assert got == {
        ("A", day(1), day(5)), ("A", day(9), None), ("B", day(5), None), ("C", None, day(3)), ("E", None, day(2)), ("F", day(12), dt.date(2019, 1, 20)),
        ("G", dt.date(2018, 5, 1), None), ("NEW", day(2), day(20)), ("NEW", day(20), None), ("D", day(20), None),
    }
    assert {r[0] for r in universe.members_by_replay(current, changes, str(day(4))).collect()} == {"A", "G", "NEW", "OLD"}
    chain = universe.resolve_renames(rows("ticker string", [("a",), ("x",), ("q",)]), {"a": "b", "b": "c", "x": "y", "y": "x"})
    assert {r["ticker"]: r["resolved"] for r in chain.collect()} == {"a": "c", "x": "y", "q": "q"}


def test_members_and_sizes(rows):
    m = rows("ticker string, start_date date, end_date date", [("a", day(0), day(10)), ("A", day(5), day(40)), ("b", None, None), ("c", day(3), day(3)), (None, day(0), None)])
    assert {r[0] for r in universe.members_on(m, str(day(10))).collect()} == {"A", "B"} and universe.members_on(m, str(day(40))).collect()[0][0] == "B"
    s = {str(r["month_end"]): r["n"] for r in universe.sizes_at_month_ends(universe.periods(m), "2018-12-31", "2019-03-31").collect()}
    assert s == {"2018-12-31": 1, "2019-01-31": 2, "2019-02-28": 1, "2019-03-31": 1}
    checks = {r["check"]: r["failures"] for r in universe.validate(m, rows("ticker string", [("b",)]), 1, 2, [str(day(1))]).collect()}
    assert checks == {"start_before_end": 1, "open_set_is_current": 1, f"size_{day(1)}": 0}


def test_audits(spark, rows):
    c = catalog(spark, rows, prices(3, 60))
    assert audit.leakage_check(c.table("membership"), c.periods, str(day(3))).first()["failures"] == 0
    assert audit.churn_check(c.periods, 10**5).first()["passed"] is False
    a = audit.adjustment_check(c.panel).first()
    assert (a["n_tickers"], a["n_unadjusted"], a["passed"]) == (3, 3, False) and audit.extreme_moves(c.panel).count() == 0
    index = rows("day int, adj double", [(k, 100 * 1.08 ** (k / 365.25)) for k in range(400)])
    t = audit.total_return_check(index).first()
    assert t["passed"] and t["annualised"] == pytest.approx(0.08)


def facts_json(**concepts):
    spaces = {}
    for k, v in concepts.items():
        ns, c = k.split("__")
        spaces.setdefault(ns.replace("_", "-"), {})[c] = {"units": v}
    return json.dumps({"facts": spaces})


def test_company_facts(rows):
    e = lambda end, val, filed=None, **k: {"end": end, "val": val, "filed": filed, **k}
    one = facts_json(
        us_gaap__StockholdersEquity={"EUR": [e("2019-12-31", 9, "2020-02-01")], "USD": [e("2019-12-31", 5, "2020-03-01"), e("2019-12-31", 5, "2021-03-01"), e("2019-12-31", 6, "2021-04-01"), e("2018-12-31", 4), {"val": 3}]},
        us_gaap__Assets={"CAD": [e("2019-12-31", 50, "2020-02-01")]},
        us_gaap__Revenues={"USD": [e("2019-12-31", 100, "2020-02-01", fp="FY", accn="x"), e("2019-12-31", 110, "2021-02-01", fp="FY", accn="y"), e("2019-09-30", 20, "2019-11-01", fp="Q3", accn="z")]},
        us_gaap__CostOfRevenue={"USD": [e("2019-12-31", 60, "2020-02-01", fp="FY", accn="x"), e("2019-09-30", 1, "2019-11-01", fp="Q3", accn="z")]},
        dei__EntityCommonStockSharesOutstanding={"shares": [e("2019-12-31", 7, "2020-02-01"), e("2020-01-31", 8, "2020-02-01")]},
    )
    two = facts_json(us_gaap__GrossProfit={"USD": [e("2019-12-31", 3, "2020-02-01", frame="CY2019"), e("2019-12-31", 4, "2020-02-01", frame="CY2019Q4", fp="FY")]}, us_gaap__CommonStockSharesOutstanding={"shares": [e("2019-12-31", 1, "2020-02-01")]})
    raw = rows("ticker string, json string", [("A", one), ("B", two), ("C", "no json"), ("D", None)])
    got = {tuple(r) for r in filings.facts_table(raw).collect()}
    d = dt.date
    assert got == {
        ("A", "book_equity", d(2020, 3, 1), 5.0, "2019-12-31"), ("A", "book_equity", d(2021, 4, 1), 6.0, "2019-12-31"), ("A", "book_equity", d(2019, 3, 1), 4.0, "2018-12-31"),
        ("A", "total_assets", d(2020, 2, 1), 50.0, "2019-12-31"), ("A", "gross_profit", d(2020, 2, 1), 40.0, "2019-12-31"), ("B", "gross_profit", d(2020, 2, 1), 3.0, "2019-12-31"),
    }
    assert {tuple(r) for r in filings.shares_table(raw).collect()} == {("A", d(2020, 2, 1), 8.0), ("B", d(2020, 2, 1), 1.0)}


def test_other_sources(spark, rows, tmp_path):
    ids = rows("ticker string, cik long", [("BRK.B", 1), ("AB", 2)])
    assert {tuple(r) for r in filings.resolve_ids(rows("ticker string", [("brk-b",), ("A-B",), ("Z",)]), ids).collect()} == {("brk-b", 1), ("A-B", 2), ("Z", None)}
    lines = rows("value string", [("junk",), (",Mkt-RF,SMB,RF",), ("20200102, 1.0, -99.99, 0.5",), ("20200103,2.0,1.0",), ("2020,1,1,1",)])
    f = filings.factor_file(lines).collect()
    assert len(f) == 1 and f[0].asDict() == {"date": dt.date(2020, 1, 2), "mkt_rf": 0.01, "smb": None, "rf": 0.005}
    with pytest.raises(ValueError):
        filings.factor_file(rows("value string", [("x",)]))
    (tmp_path / "facts").mkdir()
    (tmp_path / "facts" / "AB.json").write_text('{"a":\n1}')
    assert [tuple(r) for r in filings.json_files(spark, f"{tmp_path}/facts/*.json").collect()] == [("AB", '{"a":\n1}')]
    reports = json.dumps({"filings": {"recent": {"form": ["10-K", "8-K", "10-K"], "filingDate": ["2020-01-02", "2020-01-03", "2020-01-04"], "accessionNumber": ["1-2", "3", "4"], "primaryDocument": ["a.htm", "b", ""]}}})
    assert [tuple(r) for r in filings.annual_reports(rows("ticker string, json string", [("A", reports)])).collect()] == [("A", dt.date(2020, 1, 2), "12", "a.htm")]
    log = filings.change_log(rows("date string, added string, removed string", [("January 2, 2020", "b.c", "nan"), ("March 5, 2020", "None", None)]))
    assert [tuple(r) for r in log.collect()] == [(dt.date(2020, 1, 2), "B-C".lower(), "")]
    with pytest.raises(ValueError):
        filings.change_log(rows("date string, added string, removed string", [("2020-01-02", "a", "")]))
    folder = str(tmp_path / "prices")
    rows("date date, Close double, `Adj Close` double", [(day(0), 1.0, 2.0)]).coalesce(1).toPandas().to_parquet(f"{tmp_path}/x.parquet")
    import os

    os.makedirs(folder)
    os.rename(f"{tmp_path}/x.parquet", f"{folder}/BRK-B.parquet")
    assert [tuple(r) for r in sources.price_files(spark, folder, ("close", "adj close")).collect()] == [("BRK-B", day(0), 1.0, 2.0)]
    with pytest.raises(KeyError):
        sources.price_files(spark, folder)
    with pytest.raises(FileNotFoundError):
        sources.price_files(spark, str(tmp_path / "none"))
    assert {tuple(r) for r in sources.shares_long(rows("available_date date, A double, B double", [(day(0), 1.0, None)])).collect()} == {(day(0), "A", 1.0)}
    for kind in ("parquet", "orc", "json", "csv"):
        sources.write(rows("a string, b string", [("1", "x")]), f"{tmp_path}/{kind}", kind)
        assert [tuple(r) for r in sources.read(spark, f"{tmp_path}/{kind}", kind).select("a", "b").collect()] == [("1", "x")]
    page = sources.report({"t": rows("a string", [("<b>",)])}, str(tmp_path / "report"))
    with open(page) as f:
        assert "&lt;b&gt;" in f.read()


def test_shares_of_more_tickers_than_a_pivot_holds(spark, tmp_path):
    at = F.lit("2020-01-02 10:00:00").cast("timestamp_ntz")
    facts = [F.lit("shares_outstanding").alias("field"), at.alias("available_date"), F.lit(None).cast("timestamp_ntz").alias("period_end"), F.col("id").alias("fact_id")]
    spark.range(10_050).select(F.concat(F.lit("T"), F.col("id")).alias("ticker"), F.col("id").cast("double").alias("value"), *facts).write.parquet(f"{tmp_path}/many/fundamentals.parquet")
    got = sorted(tuple(r) for r in intake.shares_long(spark, f"{tmp_path}/many").select("ticker", "available_date", "shares").collect())
    assert got == sorted((f"T{i}", "2020-01-02", float(i)) for i in range(10_050))
    odd = [("available_date", 1.0), ("a`b", 2.0), ("A`B ", 3.0), ("null", 4.0), ("shares", 5.0), (None, 6.0), ("x", None), ("x", float("nan"))]
    spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(odd)], "id long, ticker string, value double").select("ticker", "value", *facts).write.parquet(f"{tmp_path}/odd/fundamentals.parquet")
    got = sorted(tuple(r) for r in intake.shares_long(spark, f"{tmp_path}/odd").select("ticker", "available_date", "shares").collect())
    assert got == [("AVAILABLE_DATE", "2020-01-02", 1.0), ("A`B", "2020-01-02", 3.0), ("NULL", "2020-01-02", 4.0), ("SHARES", "2020-01-02", 5.0)]


def test_nearest_vectors(rows):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 5))
    df = rows("id long, vec array<double>", [(i, x.tolist()) for i, x in enumerate(v)] + [(98, None), (99, [1.0])])
    got = vectors.nearest(df, df.where("id % 10 = 0"), 4, least=-1.0, block_bytes=120)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for i in range(0, 60, 10):
        s = u @ u[i]
        s[i] = -2
        want |= {(i, int(j)) for j in np.argsort(-s)[:4]}
    assert {(r["src"], r["dst"]) for r in got.collect()} == want
    assert vectors.nearest(df, df.where("id < 0")).count() == 0
    store = rows("ticker string, filing_date date, emb_10 double, emb_2 double", [("a", day(0), 1.0, 2.0), ("a", day(5), 3.0, 4.0), ("b", day(9), 5.0, 6.0)])
    s = vectors.wide_to_vectors(store)
    assert {(r["ticker"], tuple(r["vec"])) for r in vectors.vectors_as_of(s, str(day(6))).collect()} == {("a", (4.0, 3.0))}
    c = vectors.coverage(s, rows("checkpoint date, ticker string", [(day(6), "a"), (day(6), "b"), (day(6), "c")])).first()
    assert (c["n_universe"], c["n_covered"]) == (3, 1)
    edges = rows("src string, dst string, weight double", [("a", "b", 1.0), ("a", "c", 3.0), ("b", "zz", 1.0)])
    sig = {r["src"]: r["value"] for r in vectors.neighbour_signal(edges, rows("ticker string, mean_ret double", [("a", 0.0), ("b", 1.0), ("c", 2.0)])).collect()}
    assert sig == {"a": 1.75}


def test_nearest_with_ties_in_tiles(rows, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_ROWS", 7)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 3)
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, size=(90, 3)).astype(float)  # few directions, many ties, some zero vectors
    unit = vectors.unit_rows(v)
    ids, found = np.arange(90), {}
    own = pa.record_batch({"id": pa.array(ids), "vec": pa.array(v.tolist(), pa.list_(pa.float64()))})
    for b in vectors.search(iter([own.slice(0, 50), own.slice(50)]), ids[::5], unit[::5], 6, 0.0):
        for src, dst, sim in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found.setdefault(src, set()).add((dst, sim))
    for i in range(0, 90, 5):
        sim = np.clip(unit @ unit[i], -1, 1).round(12)
        want = sorted((-s, j) for j, s in enumerate(sim.tolist()) if j != i and s >= 0)[:6]
        assert found[i] == {(j, -s) for s, j in want}


def test_item_one(rows):
    texts = ["<p>Item 1. Business</p> We make  pumps. Item 1A. Risk", "nothing", None, "ITEM 1 BUSINESS all the rest"]
    got = [r[0] for r in rows("t string", [(t,) for t in texts]).select(vectors.item_one(F.col("t"))).collect()]
    assert got == ["We make pumps.", None, None, "all the rest"]


def test_grid_and_ledger(spark, tmp_path):
    configs = study.configurations()
    assert len(configs) == 108 == len({c["config_id"] for c in configs})
    path, book = str(tmp_path / "grid"), str(tmp_path / "ledger")
    assert study.register_grid(spark, path).count() == 108 and study.register_grid(spark, path).count() == 108
    with pytest.raises(ValueError):
        study.register_grid(spark, path, study.Grid(knn=(5,)))
    with pytest.raises(FileNotFoundError):
        study.load_grid(spark, str(tmp_path / "none"))
    assert study.read_ledger(spark, book).count() == 0
    for id_, status in ((configs[0]["config_id"], "fail"), (configs[0]["config_id"], "pass"), ("off the books", "fail")):
        study.log_trial(spark, book, id_, "correlation", status, metrics={"ir": 1})
    ledger = study.read_ledger(spark, book)
    assert study.distinct_trials(ledger) == 2 and [r[0] for r in study.unregistered(ledger, study.grid_table(spark)).collect()] == ["off the books"]
    assert [tuple(r) for r in study.ledger_summary(ledger).collect()] == [("correlation", 1, 1, 2)]
    with pytest.raises(ValueError):
        study.log_trial(spark, book, "x", "y", "maybe")


def test_folds(rows):
    days = rows("day int, pos int", [(k, k) for k in range(20)])
    a, b = backtest.split_days(days, 12)
    assert (a.count(), b.count()) == (12, 8)
    f = backtest.walk_forward(days, 6, 3, 4).collect()
    by = {}
    for r in f:
        by.setdefault((r["fold"], r["part"]), []).append(r["day"])
    assert {k: (min(v), max(v)) for k, v in by.items()} == {(i, p): b for i in range(3) for p, b in (("train", (4 * i, 4 * i + 5)), ("test", (4 * i + 6, 4 * i + 8)))}
    assert backtest.walk_forward(days, 30, 3).count() == 0


def test_streams(spark, rows, tmp_path):
    from gridloom.operators.intervals import continuous_periods
    from gridloom.streaming import flows

    rng = random.Random(1)
    schema = "ticker string, start_date timestamp_ntz, end_date timestamp_ntz"
    data = [(rng.choice("ab"), dt.datetime(2020, 1, 1) + dt.timedelta(days=a), dt.datetime(2020, 1, 1) + dt.timedelta(days=a + rng.randrange(9))) for a in (rng.randrange(90) for _ in range(60))]
    for i in range(3):
        rows(schema, data[i::3]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = flows.live_periods(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = live.writeStream.outputMode("update").foreachBatch(lambda df, b: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    now = flows.latest_periods(spark.read.parquet(f"{tmp_path}/out"))
    iso = lambda k: str(dt.date(1970, 1, 1) + dt.timedelta(days=k))
    assert {(r["ticker"], r["kind"], iso(r["from_day"]), iso(r["to_day"])) for r in now.collect()} == {tuple(r) for r in continuous_periods(rows(schema, data)).collect()}

    bars = "ticker string, close double, loaded_at timestamp"
    at = dt.datetime(2024, 1, 1)
    for part in ([("a", 1.0, at), ("a", 1.0, at)], [("a", 1.0, at), ("a", 2.0, at + dt.timedelta(days=1))]):
        rows(bars, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
    once = flows.once_per_bar(spark.readStream.schema(bars).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/bars"))
    q = once.writeStream.foreachBatch(flows.batch_log(f"{tmp_path}/kept", ["ticker"], "loaded_at")).option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["close"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [1.0, 2.0]

    events = rows("ts timestamp, user string, value double", [(dt.datetime(2024, 1, 1, 0, m), "u", 1.0) for m in (0, 1, 2, 20, 21)])
    events.write.parquet(f"{tmp_path}/ev")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    for name, df, want in (
        ("w", flows.windowed_totals(stream(), "ts", ["user"], "value", "10 minutes"), [2, 3]),
        ("s", flows.sessions(stream(), "ts", ["user"], "5 minutes"), [2, 3]),
    ):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(r["n"] for r in spark.table(name).collect()) == want


def test_reports_and_command_line(spark, rows, tmp_path):
    from gridloom import __main__ as cli
    from gridloom.plans import reports

    data = prices(12, 150, 9)
    folder = str(tmp_path / "data")
    rows(PRICES, data).write.parquet(f"{folder}/prices.parquet")
    rows("ticker string, start_date date, end_date date", [(f"T{i:02d}", day(0), None) for i in range(12)]).write.parquet(f"{folder}/membership.parquet")
    c = Catalog(spark, folder)
    r = reports.backtest_report(c, X.FACTORS.get("reversal_1m"), 10, backtest.weigher("rank", most=0.2), split_day=(day(60) - dt.date(1970, 1, 1)).days, n_trials=5, var_sharpe=0.01)
    m = {x["series"]: x for x in r.tables["metrics"].collect()}
    assert m["gross"]["total_return"] > m["net"]["total_return"] and m["net"]["n"] == 90
    assert 0 <= r.tables["deflated_sharpe"].first()["deflated"] <= 1 and r.tables["capacity"].count() == 12
    curve = {x["bps"]: x["net_sharpe"] for x in r.tables["cost_curve"].collect()}
    assert len(curve) == 7 and curve[0.0] > curve[25.0]
    sweep = reports.holding_period_sweep(c, X.FACTORS.get("reversal_1m"), (5, 21))
    assert sweep[5].daily.agg(F.sum("turnover")).first()[0] > sweep[21].daily.agg(F.sum("turnover")).first()[0]
    assert set(reports.audit_report(c, "2019-01-01", "2019-05-31", str(day(3)))["universe_size"].toPandas()["n"]) == {12}
    with pytest.raises(ValueError):
        backtest.weigher("risk")
    with pytest.raises(SystemExit):
        cli.find("nothing")
    settings = {x["setting"]: x["value"] for x in r.tables["settings"].collect()}
    assert settings["factor"] == "reversal_1m" and settings["universe_size"] == "12" and "net Sharpe" in settings["headline"] and "exposures" not in r.tables
    assert r.tables["equity"].where("series = 'net'").count() > 90 and r.tables["turnover"].first()["n_rebalances"] > 3
    cli.main(["backtest", folder, str(tmp_path / "out"), "--factor", "reversal_1m", "--oos", "2019-03-01", "--n-trials", "9", "--spread-bps", "3", "--master", "local[4]"])
    page = (tmp_path / "out" / "report.html").read_text()
    assert "deflated_sharpe" in page and "assumed cost 3 bps" in page
    cli.main(["information", folder, str(tmp_path / "ic"), "--factor", "reversal_1m", "--least", "5", "--master", "local[4]"])
    assert (tmp_path / "ic" / "report.html").exists()


def test_offline_sources_from_the_command_line(spark, rows, tmp_path):
    from gridloom import __main__ as cli

    run = lambda kind, data: cli.main([kind, str(tmp_path / data), str(tmp_path / f"{kind}.parquet"), "--master", "local[4]"]) or spark.read.parquet(str(tmp_path / f"{kind}.parquet")).collect()
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "AA.json").write_text('{"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2020-03-31", "val": 5, "filed": "2020-05-01", "accn": "1"}]}}}}}')
    assert [(r["ticker"], r["field"], str(r["available_date"]), r["value"]) for r in run("facts", "json")] == [("AA", "total_assets", "2020-05-01", 5.0)]
    assert run("shares", "json") == []
    (tmp_path / "ff.csv").write_text("made up\n,Mkt-RF,RF\n20200102,1.5,-99.99\n")
    r = run("factors", "ff.csv")[0]
    assert (str(r["date"]), r["mkt_rf"], r["rf"]) == ("2020-01-02", 0.015, None)
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "changes.csv").write_text('date,added,removed\n"March 1, 2020",AA,BB\n')
    (tmp_path / "log" / "current.csv").write_text("ticker,date_added\nAA,2020-03-01\n")
    found = {r["ticker"]: (r["start_date"] and str(r["start_date"]), r["end_date"] and str(r["end_date"])) for r in run("membership", "log")}
    assert found == {"AA": ("2020-03-01", None), "BB": (None, "2020-03-01")}


def test_logs_of_batches(spark, rows, tmp_path):
    from gridloom.streaming import flows

    save = flows.batch_log(str(tmp_path / "log"), ["k"], "at")
    for batch, data in enumerate(([("a", 1, "x"), ("a", 2, "y")], [("b", 1, "z"), ("a", 3, "w")])):
        for _ in range(2):  # a retry changes nothing
            save(rows("k string, at int, v string", data), batch)
    log = flows.read_log(spark, str(tmp_path / "log"), "k string, at int, v string")
    assert log.count() == 3 and sorted(tuple(r) for r in flows.current_rows(log, ["k"], "at").collect()) == [("a", 3, "w"), ("b", 1, "z")]
    assert flows.read_log(spark, str(tmp_path / "none"), "k string").count() == 0


def test_a_stored_panel_is_read_while_its_files_stay(spark, rows, tmp_path):
    from gridloom.sources.stored import build_once, is_stale

    path, kept = str(tmp_path / "t.parquet"), str(tmp_path / "kept")
    rows("a int", [(1,)]).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    assert is_stale(read(), kept, "x")
    assert [r[0] for r in build_once(read(), kept, "x", lambda df: df.selectExpr("a * 2")).collect()] == [2]
    assert not is_stale(read(), kept, "x") and [r[0] for r in build_once(read(), kept, "x", lambda df: df.selectExpr("a * 3")).collect()] == [2]
    assert [r[0] for r in build_once(read(), kept, "x", lambda df: df.selectExpr("a * 3"), rebuild=True).collect()] == [3]
    rows("a int", [(5,)]).write.mode("overwrite").parquet(path)
    assert is_stale(read(), kept, "x")


def test_connected_communities():
    # two cliques joined by a hub: without refinement a community may fall apart when the hub leaves it
    rng = np.random.default_rng(3)
    for seed in range(30):
        a = (rng.random((14, 14)) < 0.15).astype(float)
        a = np.triu(a, 1) + np.triu(a, 1).T
        label = N.communities(a, seed, connected=True)
        for c in set(label.tolist()):
            own = np.flatnonzero(label == c)
            reached, front = {int(own[0])}, [int(own[0])]
            while front:
                i = front.pop()
                for j in own[a[i][own] > 0].tolist():
                    if j not in reached:
                        reached.add(j)
                        front.append(j)
            assert reached == set(own.tolist())


def test_text_neighbours(spark, rows):
    data = prices(12, 80, 10)
    c = catalog(spark, rows, data)
    texts = rows("ticker string, filing_date date, text string", [(f"T{i:02d}", day(0), ("pumps and valves " if i < 6 else "loans and bonds ") * 3) for i in range(12)] + [("T00", day(70), None)])
    store = vectors.embedded(texts, vectors.HashedWords)
    f = graphs.VectorFactor("text", store, k=5)
    got = f.panel(c).collect()
    ends = sorted(r["pos"] for r in graphs.rebalance_days(c.days).collect())
    ret = {(r["ticker"], r["pos"]): r["ret"] for r in c.returns("log").collect()}
    recent = {(t, e): np.mean([ret[t, k] for k in range(max(1, e - 20), e + 1)]) for t in {x[1] for x in data} for e in ends}
    v = {(r["ticker"], r["pos"]): r["value"] for r in got}
    for e in ends[:2]:
        for i in range(12):
            group = [j for j in (range(6) if i < 6 else range(6, 12)) if j != i]
            assert v[f"T{i:02d}", e] == pytest.approx(np.mean([recent[f"T{j:02d}", e] for j in group]))
    assert ("T01", ends[-1]) in v  # T00's new, empty text leaves its old neighbours
    assert graphs.VectorFactor("text", store, least_names=13).panel(c).count() == 0


def test_granger():
    rng = np.random.default_rng(11)
    x = rng.normal(size=300)
    y = np.concatenate([[0], 0.5 * x[:-1]]) + rng.normal(size=300)
    assert I.granger_p(x, y) < 1e-4 and I.granger_p(y[:4], x[:4]) is None
    assert I.f_upper(4.0, 1, 10) == pytest.approx(I.pvalue_of_t(2.0, 10))
