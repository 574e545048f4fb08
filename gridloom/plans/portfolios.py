"""Queries of schedules, weights, simulation, costs, performance, audits and networks over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import audit as A
from gridloom.operators import backtest as B
from gridloom.operators import factors as X
from gridloom.operators import graphs as G
from gridloom.operators import metrics as M
from gridloom.operators import universe as U
from gridloom.operators import vectors as V
from gridloom.plans.problems import _TICKER, _USABLE
from gridloom.plans.signals import SQL as SIGNALS
from gridloom.plans.signals import _CAP, _MKT, _PANEL, _RET, _ROLL, _SPANS, _W, AS_OF, _known, cat, label, rounded
from gridloom.sources.catalog import Catalog
from gridloom.sources.tables import table

BUCKETS = 5


def month_ends(c: Catalog) -> DataFrame:
    return G.rebalance_days(c.days, "M")


def signal(c: Catalog) -> DataFrame:
    """Reversal, oriented, at month ends."""
    return X.FACTORS.get("reversal_1m").oriented(c).join(month_ends(c).select("pos"), "pos", "left_semi").select("pos", "ticker", "value")


def run(c: Catalog) -> B.Run:
    return B.simulate(B.weights(signal(c), "equal", BUCKETS), c.returns("simple", pad_gaps=True), c.days)


def schedule_month(spark: SparkSession, d: str) -> DataFrame:
    return month_ends(cat(spark, d)).select(label(), "pos")


def schedule_ten_days(spark: SparkSession, d: str) -> DataFrame:
    return G.rebalance_days(cat(spark, d).days, 10).select(label(), "pos")


def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    return B.walk_forward(cat(spark, d).days, 500, 100).select("fold", "part", label())


def weighted(scheme: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return B.weights(signal(cat(spark, d)), scheme, BUCKETS).select("pos", "ticker", rounded("weight"))

    return query


def weights_risk(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    vol = X.rolling_volatility(c.panel).withColumnRenamed("value", "vol")
    return B.risk_weights(signal(c), vol, BUCKETS).select("pos", "ticker", rounded("weight"))


def weights_constrained(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    betas = B.rolling_beta(c.returns("log"), c.market, 60)
    w = B.constrained(B.weights(signal(c), "rank"), 0.1, c.sectors, 0.05, betas)
    return w.select("pos", "ticker", rounded("weight", 6))


def rolling_beta(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    return B.rolling_beta(c.returns("log"), c.market, 60).where("beta is not null").select("ticker", label(), rounded("beta", 6))


def simulated_days(spark: SparkSession, d: str) -> DataFrame:
    return run(cat(spark, d)).daily.select(label(), rounded("ret"), rounded("turnover"))


def simulated_book(spark: SparkSession, d: str) -> DataFrame:
    return run(cat(spark, d)).book.select("pos", "ticker", rounded("weight"))


def simulated_trades(spark: SparkSession, d: str) -> DataFrame:
    return run(cat(spark, d)).trades.where("abs(trade) > 1e-9").select("pos", "ticker", rounded("trade"))


def costed_days(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    n = B.with_costs(run(c).stored(), B.average_dollar_volume(c.panel), B.CostModel())
    return n.select(label(), *(rounded(x) for x in ("gross", "linear", "impact", "borrow", "net")))


def sharpe_by_cost(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    return B.sharpe_by_cost(run(c).stored(), B.average_dollar_volume(c.panel)).select("bps", rounded("net_sharpe", 6))


def capacity(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    return B.capacity(run(c).book, B.average_dollar_volume(c.panel), 5e8).select("ticker", rounded("max_days", 4), rounded("mean_days", 4))


def hard_to_borrow(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    return B.hard_to_borrow(c.market_cap(), B.average_dollar_volume(c.panel)).where("htb").select("ticker", "pos")


def performance(spark: SparkSession, d: str) -> DataFrame:
    r = run(cat(spark, d)).daily.select(F.lit("gross").alias("series"), "day", "ret")
    p = M.performance(r)
    return p.select("series", "n", *(rounded(x, 6) for x in p.columns[2:]))


def monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    r = run(cat(spark, d)).daily.select(F.lit("gross").alias("series"), "day", "ret")
    return M.monthly_returns(r).select("series", "year", "month", rounded("ret"))


def rolling_sharpe(spark: SparkSession, d: str) -> DataFrame:
    r = run(cat(spark, d)).daily.select(F.lit("gross").alias("series"), "day", "ret")
    return M.rolling_sharpe(r).where("sharpe is not null").select("series", label(), rounded("sharpe", 6))


def realised_beta(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    r = run(c).daily.select(F.lit("gross").alias("series"), "day", "ret")
    return M.realised_beta(r, c.market).select("series", rounded("beta", 6))


def holding_periods(spark: SparkSession, d: str) -> DataFrame:
    """Total return and turnover of the same signal held for 1, 5 and 21 calendar rows."""
    c = cat(spark, d)
    whole = X.FACTORS.get("reversal_1m").oriented(c).select("pos", "ticker", "value")
    out = None
    for n in (1, 5, 21):
        s = whole.join(G.rebalance_days(c.days, n).select("pos"), "pos", "left_semi")
        r = B.simulate(B.weights(s, "equal", BUCKETS), c.returns("simple", pad_gaps=True), c.days).daily
        one = r.agg(
            F.lit(n).alias("held"), F.count(F.lit(1)).alias("n_days"), F.round(F.avg("ret"), 8).alias("mean_ret"),
            F.round(F.avg("turnover"), 8).alias("mean_turnover")
        )
        out = one if out is None else out.unionByName(one)
    return out


def missing_share(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    return A.missing_share(c.panel, c.periods).select(label(), "name_group", rounded("share", 6))


def return_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = A.return_quantiles(cat(spark, d).panel)
    return q.select("year", *(F.round(F.col("q")[i], 8).alias(f"q{n}") for i, n in enumerate(("01", "25", "50", "75", "99"))))


def sector_counts(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    return A.sector_counts(U.members_on(c.table("membership"), AS_OF), c.sectors)


def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    return A.leakage_check(c.table("membership"), c.periods, AS_OF)


def churn_check(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    last = c.panel.agg(F.max("day")).first()[0] or 0
    return A.churn_check(c.periods, last).select("exited", "ever", rounded("share", 6), "passed")


def adjustment_check(spark: SparkSession, d: str) -> DataFrame:
    return A.adjustment_check(cat(spark, d).panel).select("n_extreme", "n_unadjusted", "n_tickers", rounded("share", 6), "passed")


def extreme_moves(spark: SparkSession, d: str) -> DataFrame:
    return A.extreme_moves(cat(spark, d).panel).select("ticker", label(), rounded("ret"))


def windows(c: Catalog, least: int | None = None) -> DataFrame:
    """Trailing windows at month ends of the members of each month end."""
    return G.window_rows(c.returns("log"), month_ends(c), 120, least, c.periods)


def graph_windows(spark: SparkSession, d: str) -> DataFrame:
    """Names and returns of each month's trailing window (those with at least 100 of 120 returns)."""
    return windows(cat(spark, d), 100).groupBy("snap").agg(
        F.countDistinct("ticker").alias("n_names"), F.count("ret").alias("n_returns"), F.round(F.sum("ret"), 6).alias("sum_ret")
    )


def graph_mst(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(windows(cat(spark, d)), "mst").select("snap", "src", "dst", rounded("weight"))


def graph_threshold(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(windows(cat(spark, d)), "threshold", least=0.05).select("snap", "src", "dst", rounded("weight"))


def graph_lead_lag(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(windows(cat(spark, d)), "leadlag").select("snap", "src", "dst", rounded("weight"))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.node_table(windows(cat(spark, d)))


def graph_density_actual(spark: SparkSession, d: str) -> DataFrame:
    """The lead-lag density of each snapshot without its null."""
    r = G.density_report(windows(cat(spark, d)), null=False)
    return r.select("snap", "n_names", "n_edges", rounded("density"), rounded("autocorrelation"))


def graph_tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Degree, eigenvector and betweenness on the spanning trees, clustering on the threshold graphs."""
    n = G.node_table(windows(cat(spark, d)), least=0.05)
    return n.select("snap", "ticker", *(rounded(c, 6) for c in ("degree", "eigenvector", "clustering", "betweenness")))


def graph_clustering(spark: SparkSession, d: str) -> DataFrame:
    """Clustering and degree of the threshold graphs from their edges."""
    w = windows(cat(spark, d))
    return G.clustering_table(G.edges(w, "threshold", least=0.02), w.select("snap", "ticker")).select("snap", "ticker", rounded("clustering"), rounded("degree"))


def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return G.density_report(windows(cat(spark, d)))


def cluster_sectors(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    return G.cluster_sector_table(G.node_table(windows(c)), c.sectors)[1]


def graph_factor(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return G.GRAPH_FACTORS.get(name).panel(cat(spark, d)).select("ticker", label(), rounded("value", 6))

    return query


def lead_lag(kind: str) -> G.GraphFactor:
    """The lead-lag factors for the given tables' thin windows: at least 3 names instead of 10."""
    return G.GraphFactor(f"leadlag_{kind}_120d", G.lead_lag_statistic(kind, least_names=3))


def text_factor() -> G.VectorFactor:
    """The neighbours' returns by filed texts for the given tables' thin universe: at least 3 names instead of 10."""
    return G.VectorFactor("text_neighbour_return_k20", least_names=3)


def graph_factor_text(spark: SparkSession, d: str) -> DataFrame:
    return text_factor().panel(cat(spark, d)).select("ticker", label(), rounded("value", 6))


def vectors_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each member's latest filing on a day: its date and the mean of its vector."""
    c = cat(spark, d)
    v = V.vectors_as_of(c.vectors, AS_OF, U.members_on(c.table("membership"), AS_OF))
    mean = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / F.size("vec")
    return v.select("ticker", F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"), F.round(mean, 6).alias("mean"))


def lead_lag_factor(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return lead_lag(kind).panel(cat(spark, d)).select("ticker", label(), rounded("value", 6))

    return query


def neutral_by_sector(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    v = X.FACTORS.get("volatility_60").panel(c)
    return G.neutralised(v, sectors=c.sectors, least=5).select("ticker", label(), rounded("value", 6))


def neutral_by_size(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    v, s = X.FACTORS.get("volatility_60").panel(c), X.FACTORS.get("size").panel(c)
    return G.neutralised(v, {"size": s}, least=5).select("ticker", label(), rounded("value", 6))


def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours of every row whose id is divisible by 100, against all rows."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return V.nearest(e, e.where("id % 100 = 0"), 20).select("src", "dst", rounded("similarity", 6))


def item_one_texts(spark: SparkSession, d: str) -> DataFrame:
    """Length of the business section of each text that has one, whatever its source says."""
    found = table(spark, d, "documents").select("doc_id", V.item_one(F.col("text")).alias("item"))
    return found.where("item is not null").select("doc_id", F.length("item").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"q_{f.__name__}": f for f in (
    schedule_month, schedule_ten_days, walk_forward_folds, weights_risk, weights_constrained, rolling_beta, simulated_days, simulated_book, simulated_trades, costed_days, sharpe_by_cost, capacity, hard_to_borrow,
    performance, monthly_returns, rolling_sharpe, realised_beta, holding_periods, missing_share, return_quantiles, sector_counts, leakage_check, churn_check, adjustment_check, extreme_moves,
    graph_windows, graph_mst, graph_threshold, graph_lead_lag, graph_nodes, graph_density, graph_density_actual, graph_tree_nodes, graph_clustering, graph_factor_text, vectors_as_of, cluster_sectors, neutral_by_sector, neutral_by_size, vector_neighbours, item_one_texts,
)} | {f"q_weights_{s}": weighted(s) for s in ("equal", "signal", "rank")} | {f"q_graph_factor_{k}": graph_factor(n) for k, n in (
    ("eigenvector", "eigenvector_centrality_mst_120d"), ("degree", "degree_centrality_mst_120d"), ("delta_eigenvector", "delta_eigenvector_centrality_mst_120d"),
)} | {f"q_graph_factor_leadlag_{k}": lead_lag_factor(k) for k in ("out", "in", "upstream")}

_ENDS = "ends as (select max(day) as day, max(pos) as pos from cal group by date_trunc('month', day))"
_SIGNAL = f"""{_RET}, {_ENDS},
sig as (select ticker, pos, -(lp - lag(lp, 21) over {_W}) as value from panel),
s as (select sig.* from sig join ends on sig.pos = ends.pos where value is not null),
n as (select *, count(*) over (partition by pos) as n from s), m as (select * from n where n > 1),
side as (select *, case when row_number() over (partition by pos order by value desc, ticker) <= greatest(1, round_even(n / {BUCKETS}.0::double, 0)) then 1
  when row_number() over (partition by pos order by value, ticker) <= greatest(1, round_even(n / {BUCKETS}.0::double, 0)) then -1 else 0 end as side from m)"""
_EQUAL = f"""{_SIGNAL}, tgt as (select pos, ticker, 0.5::double * side / count(*) over (partition by pos, side) as weight from side where side <> 0)"""
_RUN = f"""{_EQUAL},
start as (select pos as p, pos + 2 as start, lead(pos + 2) over (order by pos) as nxt from (select distinct pos from tgt)),
span as (select p, start, least(coalesce(nxt - 1, (select max(pos) from cal)), (select max(pos) from cal)) as stop from start where start <= (select max(pos) from cal)),
held as (select start as period, ticker, weight, stop, unnest(range(start, stop + 1)) as pos from tgt join span on tgt.pos = span.p),
r as (select h.*, coalesce(x.r, 0) as ret from held h left join sret x on x.ticker = h.ticker and x.pos = h.pos),
g as (select *, product(1 + ret) over (partition by period, ticker order by pos rows unbounded preceding) as g1 from r),
gg as (select *, coalesce(lag(g1) over (partition by period, ticker order by pos), 1) as g0 from g),
v as (select period, pos, 1 + sum(weight * (g1 - 1)) as v1, 1 + sum(weight * (g0 - 1)) as v0 from gg group by 1, 2),
book as (select gg.pos, gg.ticker, weight * g0 / v0 as weight from gg join v on gg.period = v.period and gg.pos = v.pos),
old as (select gg.pos + 1 as pos, gg.ticker, weight * g1 / v1 as w from gg join v on gg.period = v.period and gg.pos = v.pos where gg.pos = gg.stop and gg.pos + 1 in (select start from span)),
trades as (select coalesce(f.pos, o.pos) as pos, coalesce(f.ticker, o.ticker) as ticker, coalesce(f.weight, 0) - coalesce(o.w, 0) as trade from (select * from r where pos = period) f full join old o on f.pos = o.pos and f.ticker = o.ticker),
moved as (select pos, sum(abs(trade)) as turnover from trades group by 1),
daily as (select v.pos, strftime(cal.day, '%Y-%m-%d') as obs_day, cal.day, round(v1 / v0 - 1, 14) + 0.0 as ret, coalesce(turnover, 0) as turnover from v join cal on v.pos = cal.pos left join moved on moved.pos = v.pos)"""


def _with_schedule(n: int) -> str:
    """The simulation's SQL with a rebalance every n calendar rows."""
    return f"with {_RUN}".replace(_ENDS, f"ends as (select day, pos from cal where pos % {n} = 0)")


_ADV = f"adv as (select ticker, pos, avg(close * volume) over {_ROLL.format(20)} as adv from panel)"
_COST = f"""{_RUN}, {_ADV},
imp as (select t.pos, sum(abs(trade) * 0.1 * sqrt(coalesce(abs(trade) * 5e8 / case when adv > 0 then adv end, 0))) as impact from trades t left join adv a on t.ticker = a.ticker and t.pos = a.pos group by 1),
bor as (select pos, sum(case when weight < 0 then -weight else 0 end) * (75.0 * 1e-4 / 252) as borrow from book group by 1),
cost as (select d.pos, obs_day, ret as gross, turnover, turnover * (8.0 * 1e-4) as linear, coalesce(impact, 0) as impact, coalesce(borrow, 0) as borrow from daily d left join imp on imp.pos = d.pos left join bor on bor.pos = d.pos)"""
_R60 = _ROLL.format(59)
_BETA = f"""j as (select t.ticker, t.pos, t.obs_day, t.r, m.market from ret t left join mkt m on t.day = m.day),
beta as (select *, case when count(r * market) over w = 60 and count(r) over w = 60 and count(market) over w = 60 then
  (avg(r * market) over w - avg(r) over w * avg(market) over w) / nullif(avg(market * market) over w - power(avg(market) over w, 2), 0) end as beta from j window w as {_R60})"""
_SECTORS = f"sec as (select {_TICKER.format('')} as ticker, min(sector) as sector from listings where sector is not null group by 1)"

#: Complete windows of 120 returns at month ends and their shrunk correlations (c: snap, i < j, rho).
_SHRUNK = f"""{_RET}, {_ENDS}, {_SPANS}, w as (select e.pos as snap, t.ticker, t.pos, t.r from ret t join ends e on t.pos between e.pos - 119 and e.pos where t.r is not null and exists (select 1 from spans m where m.ticker = t.ticker and e.day >= m.s and e.day < m.e)),
k as (select *, count(*) over (partition by snap, ticker) as c, var_pop(r) over (partition by snap, ticker) as vr from w), x as (select snap, ticker, pos, r - avg(r) over (partition by snap, ticker) as x from k where c = 120 and vr > 0),
s as (select a.snap, a.ticker as i, b.ticker as j, sum(a.x * b.x) / 120 as s from x a join x b on a.snap = b.snap and a.pos = b.pos group by all),
g as (select snap, avg(s) filter (i = j) as mu, sum(s * s) as norm, count(*) filter (i = j) as p from s group by 1),
q as (select snap, sum(t * t) as quad from (select snap, pos, sum(x * x) as t from x group by 1, 2) group by 1),
h as (select g.snap, mu, quad / (14400.0 * p) - norm / (120.0 * p) as noise, norm / p - mu * mu as spread from g join q on g.snap = q.snap),
sh as (select snap, mu, case when spread <= 0 then 0 else least(greatest(noise, 0), spread) / spread end as d from h),
v as (select s.snap, i, d * mu + (1 - d) * s as v from s join sh on s.snap = sh.snap where i = j),
c as (select s.snap, s.i, s.j, least(1, greatest(-1, (1 - d) * s / sqrt(a.v * b.v))) as rho from s join sh on s.snap = sh.snap join v a on a.snap = s.snap and a.i = s.i join v b on b.snap = s.snap and b.i = s.j where s.i < s.j)"""


_LN2 = "0.6931471805599453"


def p_two_sided(z: str) -> str:
    """Two-sided normal p-value of an SQL expression, by the series of the error function (all terms positive)."""
    terms = f"[exp((2 * n + 1) * (ln(abs({z})) - {_LN2} / 2) - ({z}) * ({z}) / 2 - lgamma(n + 1.5::double)) for n in range(0, 220)]"
    return f"case when ({z}) is null then null when abs({z}) < 1e-12 then 1.0 when abs({z}) > 11 then 0.0 else greatest(0, 1 - list_sum({terms})) end"


#: Lead-lag networks at month ends: residuals e, lagged correlations, those that survive the step-up, and the strongest of each pair (net).
_LEAD = f"""{_RET}, {_ENDS}, {_SPANS}, w as (select e.pos as snap, t.ticker, t.pos - e.pos + 119 as t, t.r from ret t join ends e on t.pos between e.pos - 119 and e.pos where t.r is not null and exists (select 1 from spans m where m.ticker = t.ticker and e.day >= m.s and e.day < m.e)),
k as (select *, count(*) over (partition by snap, ticker) as c, var_pop(r) over (partition by snap, ticker) as vr from w), u as (select snap, ticker, t, r from k where c = 120 and vr > 0),
size as (select snap, count(distinct ticker) as p from u group by 1),
mk as (select snap, t, m - avg(m) over (partition by snap) as m from (select snap, t, avg(r) as m from u group by 1, 2)),
xm as (select u.snap, u.ticker, u.t, u.r - avg(u.r) over (partition by u.snap, u.ticker) as x, m from u join mk on u.snap = mk.snap and u.t = mk.t),
e as (select snap, ticker, t, x - m * coalesce(sum(m * x) over (partition by snap, ticker) / nullif(sum(m * m) over (partition by snap, ticker), 0), 0) as e from xm),
cc as (select a.snap, a.ticker as i, b.ticker as j, b.t - a.t as lag, corr(a.e, b.e) as c, count(*) as n from e a join e b on a.snap = b.snap and b.t - a.t between 1 and 5 and a.ticker <> b.ticker group by all),
z as (select *, c * sqrt(n) as z from cc), pv as (select *, {p_two_sided('z')} as p from z),
rk as (select *, row_number() over (partition by snap order by p, abs(z) desc) as k, count(*) over (partition by snap) as m from pv),
lim as (select snap, max(k) filter (p <= k / m * 0.1::double) as last from rk group by 1),
net as (select snap, i, j, c from (select r.*, row_number() over (partition by r.snap, i, j order by abs(c) desc, lag) as best from rk r join lim l on r.snap = l.snap where r.k <= coalesce(last, 0)) where best = 1)"""


def _held(values: str) -> str:
    """A factor's daily panel from values (snap, ticker, value)."""
    return f"""deg as ({values}),
held as (select ticker, value, unnest(range(snap, coalesce(lead(snap) over (partition by ticker order by snap), (select max(pos) + 1 from cal)))) as pos from deg)
select ticker, strftime(day, '%Y-%m-%d') as obs_day, round(value, 6) + 0.0 as value from held join cal on held.pos = cal.pos"""


def _lead_factor(kind: str) -> str:
    node = "node as (select u.snap, u.ticker, p from (select distinct snap, ticker from u) u join size s on u.snap = s.snap where p >= 3)"
    if kind == "out":
        return f"with {_LEAD}, {node}, " + _held("select n.snap, n.ticker, coalesce(sum(abs(c)), 0) / any_value(p - 1) as value from node n left join net on n.snap = net.snap and n.ticker = net.i group by 1, 2")
    if kind == "in":
        return f"with {_LEAD}, {node}, " + _held("select n.snap, n.ticker, coalesce(sum(abs(c)), 0) / any_value(p - 1) as value from node n left join net on n.snap = net.snap and n.ticker = net.j group by 1, 2")
    return f"with {_LEAD}, {node}, late as (select snap, ticker, avg(e) as r from e where t >= 115 group by 1, 2), " + _held(
        "select n.snap, n.ticker, coalesce(sum(c * r) / nullif(sum(abs(c)), 0), 0) as value from node n left join net on n.snap = net.snap and n.ticker = net.j left join late on late.snap = n.snap and late.ticker = net.i group by 1, 2"
    )


def _eigen() -> str:
    """Leading eigenvectors of the trees: (A / max + I) squared 26 times, so that only the leading direction is left; its diagonal holds the squares of the vector."""
    steps = [
        "node as (select snap, ticker, count(*) over (partition by snap) as p from (select distinct snap, ticker from x))",
        "sym as (select snap, i, j, weight from tree union all select snap, j, i, weight from tree)",
        "a0 as (select snap, i, j, sum(v) as v from (select snap, i, j, weight / max(weight) over (partition by snap) as v from sym union all select snap, ticker, ticker, 1.0 from node) group by 1, 2, 3)",
    ]
    for k in range(26):
        steps.append(f"a{k + 1} as materialized (select snap, i, j, v / max(v) over (partition by snap) as v from (select a.snap, a.i, b.j, sum(a.v * b.v) as v from a{k} a join a{k} b on a.snap = b.snap and a.j = b.i group by 1, 2, 3))")
    return ", ".join([*steps, "ev as (select n.snap, n.ticker, case when p < 2 then 0 else sqrt(v / sum(v) over (partition by n.snap)) end as value, p from node n join a26 a on a.snap = n.snap and a.i = n.ticker and a.j = n.ticker)"])


def _tree() -> str:
    """Spanning trees: the edges that no path of shorter ones (of equal ones by name) goes around. Four squarings of the minimax matrix reach paths of 16 edges, more than the given tables' snapshots have."""
    steps = [
        "dist as (select snap, i, j, rho, struct_pack(a := sqrt(greatest(2 * (1 - rho), 0)), b := i, c := j) as d from c), b0 as (select snap, i, j, d from dist union all select snap, j, i, d from dist)"
    ]
    for k in range(4):
        steps.append(
            f"b{k + 1} as (select snap, i, j, min(d) as d from (select * from b{k} union all select a.snap, a.i, b.j, case when a.d > b.d then a.d else b.d end from b{k} a join b{k} b on a.snap = b.snap and a.j = b.i and a.i <> b.j) group by 1, 2, 3)"
        )
    return ", ".join(
        [
            *steps,
            "tree as (select t.snap, t.i, t.j, greatest(abs(rho), 1e-12) as weight from dist t join b4 on t.snap = b4.snap and t.i = b4.i and t.j = b4.j where t.d <= b4.d)"
        ]
    )


_TREE = _tree()
_EIGEN = _eigen()

SQL: dict[str, str] = {
    "q_schedule_month": f"with {_PANEL}, {_ENDS} select strftime(day, '%Y-%m-%d') as obs_day, pos from ends",
    "q_schedule_ten_days": f"with {_PANEL} select strftime(day, '%Y-%m-%d') as obs_day, pos from cal where pos % 10 = 0",
    "q_walk_forward_folds": f"""with {_PANEL}, k as (select cast(unnest(range(0, greatest(0, (select count(*) from cal) - 600) // 100 + case when (select count(*) from cal) >= 600 then 1 else 0 end)) as integer) as fold)
select fold, case when pos - fold * 100 < 500 then 'train' else 'test' end as part, strftime(day, '%Y-%m-%d') as obs_day from k join cal on pos >= fold * 100 and pos < fold * 100 + 600""",
    "q_weights_equal": f"with {_EQUAL} select pos, ticker, round(weight, 8) + 0.0 as weight from tgt",
    "q_weights_signal": f"with {_SIGNAL}, dv as (select *, value - avg(value) over (partition by pos) as d, max(value) over (partition by pos) = min(value) over (partition by pos) as flat from m) select pos, ticker, round(case when flat then 0 else d / sum(abs(d)) over (partition by pos) end, 8) + 0.0 as weight from dv",
    "q_weights_rank": f"with {_SIGNAL}, rk as (select *, rank() over (partition by pos order by value) + (count(*) over (partition by pos, value) - 1) / 2.0::double as x from m), dv as (select *, x - avg(x) over (partition by pos) as d, max(x) over (partition by pos) = min(x) over (partition by pos) as flat from rk) select pos, ticker, round(case when flat then 0 else d / sum(abs(d)) over (partition by pos) end, 8) + 0.0 as weight from dv",
    "q_weights_risk": f"""with {_SIGNAL}, vol as (select ticker, pos, case when count(r) over w >= 15 then stddev_samp(r) over w end as vol from sraw window w as {_ROLL.format(62)}),
iv as (select s.*, case when vol > 0 then 1 / vol end as inv from side s left join vol on s.ticker = vol.ticker and s.pos = vol.pos where side <> 0),
iw as (select *, coalesce(inv, quantile_cont(inv, 0.5) over (partition by pos), 1) as w from iv)
select pos, ticker, round(0.5 * side * w / sum(w) over (partition by pos, side), 8) + 0.0 as weight from iw""",
    "q_weights_constrained": f"""with {_SIGNAL}, {_MKT}, {_BETA}, {_SECTORS},
rk as (select *, rank() over (partition by pos order by value) + (count(*) over (partition by pos, value) - 1) / 2.0::double as x from m), dv as (select *, x - avg(x) over (partition by pos) as d, max(x) over (partition by pos) = min(x) over (partition by pos) as flat from rk),
w0 as (select pos, ticker, case when flat then 0 else d / sum(abs(d)) over (partition by pos) end as w from dv), w1 as (select pos, ticker, greatest(least(w, 0.1::double), -0.1::double) as w from w0),
w2 as (select pos, ticker, w - avg(w) over (partition by pos) as w from w1), w3 as (select w2.*, sector, sum(w) over (partition by pos, sector) as net, count(*) over (partition by pos, sector) as c from w2 left join sec on w2.ticker = sec.ticker),
w4 as (select pos, ticker, case when sector is null then w else w - (net - greatest(least(net, 0.05::double), -0.05::double)) / c end as w from w3),
w5 as (select w4.*, coalesce(beta, 0) as b from w4 left join beta on beta.ticker = w4.ticker and beta.pos = w4.pos),
w6 as (select pos, ticker, w - coalesce(sum(w * b) over (partition by pos) / nullif(sum(b * b) over (partition by pos), 0), 0) * b as w from w5)
select pos, ticker, round(coalesce(w / nullif(sum(abs(w)) over (partition by pos), 0), w), 6) + 0.0 as weight from w6""",
    "q_rolling_beta": f"with {_RET}, {_MKT}, {_BETA} select ticker, obs_day, round(beta, 6) + 0.0 as beta from beta where beta is not null",
    "q_simulated_days": f"with {_RUN} select obs_day, round(ret, 8) + 0.0 as ret, round(turnover, 8) + 0.0 as turnover from daily",
    "q_simulated_book": f"with {_RUN} select cast(pos as integer) as pos, ticker, round(weight, 8) + 0.0 as weight from book",
    "q_simulated_trades": f"with {_RUN} select cast(pos as integer) as pos, ticker, round(trade, 8) + 0.0 as trade from trades where abs(trade) > 1e-9",
    "q_costed_days": f"with {_COST} select obs_day, round(gross, 8) + 0.0 as gross, round(linear, 8) + 0.0 as linear, round(impact, 8) + 0.0 as impact, round(borrow, 8) + 0.0 as borrow, round(gross - linear - impact - borrow, 8) + 0.0 as net from cost",
    "q_sharpe_by_cost": f"with {_COST}, b as (select unnest([0, 5, 10, 15, 20, 25])::double as bps), x as (select bps, gross - impact - borrow - turnover * bps * 1e-4 as net from cost join b on true) select bps, round(avg(net) / stddev_samp(net) * sqrt(252), 6) + 0.0 as net_sharpe from x group by bps",
    "q_capacity": f"with {_RUN}, {_ADV}, x as (select b.ticker, abs(weight) * 5e8 / case when adv > 0 then adv end as x from book b join adv a on b.ticker = a.ticker and b.pos = a.pos) select ticker, round(max(x), 4) + 0.0 as max_days, round(avg(x), 4) + 0.0 as mean_days from x where x > 0 group by 1",
    "q_hard_to_borrow": f"{_CAP}, {_ADV}, r as (select c.ticker, c.pos, c.cap, a.adv from cap c join adv a on c.ticker = a.ticker and c.pos = a.pos), q as (select pos, quantile_cont(cap, 0.2) as qc, quantile_cont(adv, 0.2) as qa from r group by 1) select r.ticker, r.pos from r join q on r.pos = q.pos where cap <= qc and adv <= qa",
    "q_performance": f"""with {_RUN}, e as (select *, product(1 + ret) over (order by day rows unbounded preceding) as eq from daily), dd as (select *, eq / max(eq) over (order by day rows unbounded preceding) - 1 as dd from e),
q as (select quantile_cont(dd, 0.05) as q from dd),
a as (select count(ret) as n, arg_max(eq, day) as fin, avg(ret) as mean, stddev_samp(ret) as sd, sqrt(avg(power(least(ret, 0), 2))) as down, abs(min(dd)) as mdd, -avg(dd) filter (dd <= (select q from q)) as cdd, avg(case when ret > 0 then 1.0 else 0.0 end) as hit,
  coalesce(sum(ret) filter (ret > 0), 0) as gain, coalesce(-sum(ret) filter (ret < 0), 0) as loss from dd)
select 'gross' as series, n, round(fin - 1, 6) + 0.0 as total_return, round(power(fin, 252.0 / n) - 1, 6) + 0.0 as cagr, round(sd * sqrt(252), 6) + 0.0 as ann_vol, round(mean / sd * sqrt(252), 6) + 0.0 as sharpe, round(mean / down * sqrt(252), 6) + 0.0 as sortino,
  round(mdd, 6) + 0.0 as max_drawdown, round((power(fin, 252.0 / n) - 1) / mdd, 6) + 0.0 as calmar, round(cdd, 6) + 0.0 as conditional_drawdown, round(hit, 6) + 0.0 as hit_rate, round(gain / loss, 6) + 0.0 as profit_factor from a""",
    "q_monthly_returns": f"""with {_RUN}, mm as (select date_trunc('month', day) as m, product(1 + ret) - 1 as ret from daily group by 1), sp as (select cast(unnest(generate_series(min(m)::timestamp, max(m)::timestamp, interval 1 month)) as date) as m from mm)
select 'gross' as series, cast(year(sp.m) as integer) as year, cast(month(sp.m) as integer) as month, round(coalesce(mm.ret, 0), 8) + 0.0 as ret from sp left join mm on cast(mm.m as date) = sp.m""",
    "q_rolling_sharpe": f"with {_RUN}, x as (select obs_day, case when count(ret) over w = 252 then avg(ret) over w / nullif(stddev_samp(ret) over w, 0) * sqrt(252) end as s from daily window w as (order by day rows between 251 preceding and current row)) select 'gross' as series, obs_day, round(s, 6) + 0.0 as sharpe from x where s is not null",
    "q_realised_beta": f"with {_RUN}, {_MKT} select 'gross' as series, round(covar_samp(ret, market) / var_samp(market), 6) + 0.0 as beta from daily join mkt on daily.day = mkt.day where market is not null",
    "q_missing_share": f"""with {_PANEL}, {_SPANS}, e as (select max(day) as day from panel group by date_trunc('month', day)), nm as (select ticker, cast(ntile(20) over (order by ticker) as integer) as name_group from (select distinct ticker from panel))
select p.obs_day, name_group, round(avg(case when adj is null then 1.0 else 0.0 end), 6) + 0.0 as share from panel p join e on p.day = e.day join nm on nm.ticker = p.ticker where exists (select 1 from spans x where x.ticker = p.ticker and p.day >= x.s and p.day < x.e) group by all""",
    "q_return_quantiles": f"with {_RET} select cast(year(day) as integer) as year, " + ", ".join(f"round(quantile_cont(r, 0.{n}), 8) as q{n}" for n in ("01", "25", "50", "75", "99")) + " from ret where r is not null group by 1",
    "q_sector_counts": f"with {_SECTORS}, {_SPANS}, mem as (select distinct ticker from spans where s <= date '{AS_OF}' and e > date '{AS_OF}') select sector, count(*) as n from mem left join sec on mem.ticker = sec.ticker group by 1",
    "q_leakage_check": f"""with {_SPANS}, a as ({SIGNALS['q_members']}), b as (select distinct ticker from spans where s <= date '{AS_OF}' and e > date '{AS_OF}')
select 'no_future_members' as "check", count(*) as failures from ((select * from a except select * from b) union all (select * from b except select * from a))""",
    "q_churn_check": f"with {_PANEL}, {_SPANS}, t as (select ticker, max(e) as e from spans group by 1), a as (select count(*) filter (e <= (select max(day) from panel)) as exited, count(*) as ever from t) select exited, ever, round(exited / ever, 6) + 0.0 as share, exited / ever between 0.05 and 0.6 as passed from a",
    "q_adjustment_check": f"""with {_RET}, c as (select ticker, r as a, case when close > 0 then ln(close) end as lc, pos from ret), d as (select ticker, a, lc - lag(lc) over {_W} as c from c),
p as (select ticker, count(*) filter (abs(a) > 0.4) as x, count(*) filter (abs(a - c) > 1e-9) as d, count(a) as n from d group by 1), t as (select cast(sum(x) as bigint) as n_extreme, count(*) filter (d = 0) as n_unadjusted, count(*) as n_tickers from p where n > 0)
select n_extreme, n_unadjusted, n_tickers, round(n_unadjusted / n_tickers, 6) + 0.0 as share, n_unadjusted / n_tickers < 0.5 as passed from t""",
    "q_extreme_moves": f"with {_RET} select ticker, obs_day, round(r, 8) + 0.0 as ret from ret where abs(r) > 0.4",
    "q_graph_windows": f"""with {_RET}, {_ENDS}, {_SPANS}, w as (select e.pos as snap, t.ticker, t.r from ret t join ends e on t.pos between e.pos - 119 and e.pos where t.r is not null and exists (select 1 from spans m where m.ticker = t.ticker and e.day >= m.s and e.day < m.e)), k as (select *, count(*) over (partition by snap, ticker) as c from w)
select snap, count(distinct ticker) as n_names, count(r) as n_returns, round(sum(r), 6) + 0.0 as sum_ret from k where c >= 100 group by 1""",
    "q_neutral_by_sector": f"""with {_RET}, {_SECTORS}, v as (select ticker, pos, day, obs_day, case when count(r) over w >= 40 then stddev_samp(r) over w end as value from ret window w as {_R60}),
x as (select v.*, sector, count(*) over (partition by pos) as n from v join sec on v.ticker = sec.ticker where value is not null),
rk as (select *, rank() over (partition by pos order by value) + (count(*) over (partition by pos, value) - 1) / 2.0::double as k from x where n >= 5)
select ticker, obs_day, round(k - avg(k) over (partition by pos, sector), 6) + 0.0 as value from rk""",
    "q_neutral_by_size": f"""with {_USABLE}, {_RET}, {_known('shares_outstanding', 'sh')},
z as (select ticker, pos, ln(close * known) as size from sh where close * known > 0),
v as (select ticker, pos, obs_day, case when count(r) over w >= 40 then stddev_samp(r) over w end as value from ret window w as {_R60}),
b as (select v.*, z.size, count(*) over (partition by v.pos) as n from v join z on v.ticker = z.ticker and v.pos = z.pos where value is not null),
k as (select *, rank() over (partition by pos order by value) + (count(*) over (partition by pos, value) - 1) / 2.0::double as y, rank() over (partition by pos order by size) + (count(*) over (partition by pos, size) - 1) / 2.0::double as x from b where n >= 5),
f as (select pos, regr_slope(y, x) as slope, regr_intercept(y, x) as base from k group by 1)
select ticker, obs_day, round(y - base - slope * x, 6) + 0.0 as value from k join f on k.pos = f.pos""",
    "q_graph_lead_lag": f"with {_LEAD} select snap, i as src, j as dst, round(c, 8) + 0.0 as weight from net",
    **{f"q_graph_factor_leadlag_{kind}": _lead_factor(kind) for kind in ("out", "in", "upstream")},
    "q_graph_density_actual": f"""with {_LEAD}, ac as (select snap, avg(abs(c)) as a from (select a.snap, a.ticker, corr(a.e, b.e) as c from e a join e b on a.snap = b.snap and a.ticker = b.ticker and b.t = a.t + 1 group by 1, 2) group by 1)
select s.snap, cast(p as integer) as n_names, cast(count(net.i) as integer) as n_edges, round(count(net.i) / (p * (p - 1)), 8) + 0.0 as density, round(any_value(a), 8) + 0.0 as autocorrelation from size s left join net on s.snap = net.snap join ac on ac.snap = s.snap where p >= 2 group by s.snap, p""",
    "q_graph_factor_eigenvector": f"with {_SHRUNK}, {_TREE}, {_EIGEN}, " + _held("select snap, ticker, value from ev where p >= 3"),
    "q_graph_factor_delta_eigenvector": f"""with {_SHRUNK}, {_TREE}, {_EIGEN}, l0 as (select ticker, value, unnest(range(snap, coalesce(lead(snap) over (partition by ticker order by snap), (select max(pos) + 1 from cal)))) as pos from ev where p >= 3),
moved_at as (select l0.ticker, l0.pos as snap, value - lag(value) over (partition by l0.ticker order by l0.pos) as value from l0 join ends on l0.pos = ends.pos), """ + _held("select snap, ticker, value from moved_at where value is not null"),
    "q_graph_tree_nodes": f"""with recursive {_SHRUNK}, {_TREE}, {_EIGEN},
walk as (select snap, i as root, j as first, j as at, i as prev from sym union all select w.snap, w.root, w.first, s.j, w.at from walk w join sym s on s.snap = w.snap and s.i = w.at and s.j <> w.prev),
part as (select snap, root, first, count(*) as n from walk group by 1, 2, 3),
bt as (select n.snap, n.ticker, case when p > 2 then (power(p - 1, 2) - coalesce(sum(part.n * part.n), 0)) / ((p - 1) * (p - 2)) else 0 end as b from node n left join part on part.snap = n.snap and part.root = n.ticker group by n.snap, n.ticker, p),
dg as (select snap, i as ticker, sum(weight) as w from sym group by 1, 2),
th as (select snap, i, j from c where abs(rho) >= 0.05 union all select snap, j, i from c where abs(rho) >= 0.05), kk as (select snap, i, count(*) as k from th group by 1, 2),
tri as (select a.snap, a.i, count(*) as t from th a join th b on a.snap = b.snap and a.j = b.i join th c2 on c2.snap = a.snap and c2.i = b.j and c2.j = a.i group by 1, 2)
select n.snap, n.ticker, round(coalesce(w, 0) / greatest(n.p - 1, 1), 6) + 0.0 as degree, round(ev.value, 6) + 0.0 as eigenvector, round(case when k > 1 then coalesce(t, 0) / (k * (k - 1)) else 0 end, 6) + 0.0 as clustering, round(b, 6) + 0.0 as betweenness
from node n join ev on ev.snap = n.snap and ev.ticker = n.ticker join bt on bt.snap = n.snap and bt.ticker = n.ticker left join dg on dg.snap = n.snap and dg.ticker = n.ticker left join kk on kk.snap = n.snap and kk.i = n.ticker left join tri on tri.snap = n.snap and tri.i = n.ticker""",
    "q_graph_clustering": f"""with {_SHRUNK}, node as (select distinct snap, ticker from w qualify count(*) over (partition by snap, ticker) = 120), sz as (select snap, count(*) as p from node group by 1),
th as (select snap, i, j, abs(rho) as v from c where abs(rho) >= 0.02 union all select snap, j, i, abs(rho) from c where abs(rho) >= 0.02), kk as (select snap, i, count(*) as k, sum(v) as v from th group by 1, 2),
tri as (select a.snap, a.i, count(*) as t from th a join th b on a.snap = b.snap and a.j = b.i join th c2 on c2.snap = a.snap and c2.i = b.j and c2.j = a.i group by 1, 2)
select n.snap, n.ticker, round(case when k > 1 then coalesce(t, 0) / (k * (k - 1)) else 0 end, 8) + 0.0 as clustering, round(coalesce(v, 0) / greatest(p - 1, 1), 8) + 0.0 as degree
from node n join sz on sz.snap = n.snap left join kk on kk.snap = n.snap and kk.i = n.ticker left join tri on tri.snap = n.snap and tri.i = n.ticker""",
    "q_vectors_as_of": f"""with {_SPANS}, f as (select {_TICKER.format('d.')} as ticker, cast(filed_at as date) as day, embedding::double[] as vec from documents d join embeddings e on d.doc_id = e.vec_id where filed_at is not null),
l as (select * from f where ticker is not null and day <= date '{AS_OF}' and exists (select 1 from spans m where m.ticker = f.ticker and m.s <= date '{AS_OF}' and m.e > date '{AS_OF}') qualify row_number() over (partition by ticker order by day desc, vec desc) = 1)
select ticker, strftime(day, '%Y-%m-%d') as filing_date, round(list_sum(vec) / len(vec), 6) as mean from l""",
    "q_graph_factor_text": f"""with {_RET}, {_ENDS}, {_SPANS}, f0 as (select {_TICKER.format('d.')} as ticker, cast(filed_at as date) as day, max(embedding::double[]) as vec from documents d join embeddings e on d.doc_id = e.vec_id where filed_at is not null group by 1, 2),
f as (select *, lead(day) over (partition by ticker order by day) as nxt from f0 where ticker is not null),
kn as (select e.pos as snap, f.ticker, vec from f join ends e on e.day >= f.day and (nxt is null or e.day < nxt) where exists (select 1 from spans m where m.ticker = f.ticker and e.day >= m.s and e.day < m.e)),
kc as (select *, count(*) over (partition by snap) as p from kn), rec as (select e.pos as snap, t.ticker, avg(r) as r from ret t join ends e on t.pos between e.pos - 20 and e.pos where t.r is not null group by 1, 2),
pr as (select a.snap, a.ticker, b.ticker as o, greatest(-1, least(1, list_cosine_similarity(a.vec, b.vec))) as sim from kc a join kc b on a.snap = b.snap and a.ticker <> b.ticker where a.p >= 3),
tk as (select *, row_number() over (partition by snap, ticker order by sim desc, o) as n from pr), """ + _held("select tk.snap, tk.ticker, sum(sim * r) / sum(sim) as value from tk join rec on rec.snap = tk.snap and rec.ticker = tk.o where n <= 20 and sim >= 0 group by 1, 2 having sum(sim) > 0"),
    "q_graph_threshold": f"with {_SHRUNK} select snap, i as src, j as dst, round(abs(rho), 8) + 0.0 as weight from c where abs(rho) >= 0.05",
    "q_graph_mst": f"with {_SHRUNK}, {_TREE} select snap, i as src, j as dst, round(weight, 8) + 0.0 as weight from tree",
    "q_graph_factor_degree": f"""with {_SHRUNK}, {_TREE}, node as (select snap, ticker, count(*) over (partition by snap) as p from (select distinct snap, ticker from x)),
ends2 as (select snap, i as ticker, weight from tree union all select snap, j, weight from tree),
deg as (select n.snap, n.ticker, coalesce(sum(weight), 0) / (any_value(p) - 1) as value from node n left join ends2 e on n.snap = e.snap and n.ticker = e.ticker where p >= 3 group by 1, 2),
held as (select ticker, value, unnest(range(snap, coalesce(lead(snap) over (partition by ticker order by snap), (select max(pos) + 1 from cal)))) as pos from deg)
select ticker, strftime(day, '%Y-%m-%d') as obs_day, round(value, 6) + 0.0 as value from held join cal on held.pos = cal.pos""",
    "q_holding_periods": " union all ".join(
        f"select * from ({_with_schedule(n)} select cast({n} as integer) as held, count(*) as n_days, round(avg(ret), 8) as mean_ret, round(avg(turnover), 8) as mean_turnover from daily)" for n in (1, 5, 21)
    ),
    "q_vector_neighbours": """with q as (select vec_id as src, embedding as a from embeddings where vec_id % 100 = 0),
s as (select src, e.vec_id as dst, round(list_cosine_similarity(a::double[], e.embedding::double[]), 12) as sim from q join embeddings e on e.vec_id <> src)
select src, dst, round(sim, 6) + 0.0 as similarity from (select *, row_number() over (partition by src order by sim desc, dst) as n from s) where n <= 20 and sim >= 0""",
}
