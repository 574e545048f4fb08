"""Queries of panels, universe, signals and their evaluation over the given tables, and their SQL.

Cross-sections of the given tables are thin, so the smallest cross-section is 10 names and portfolios have 5 buckets here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import evaluate as E
from gridloom.operators import factors as X
from gridloom.operators import panel as P
from gridloom.operators import universe as U
from gridloom.operators.columns import day_label
from gridloom.plans.problems import _BARS, _PERIODS, _TICKER, _USABLE
from gridloom.sources.catalog import Catalog

LEAST, BUCKETS, HORIZONS = 10, 5, (1, 5, 21)
FIRST, LAST, AS_OF = "2010-01-31", "2024-12-31", "2018-06-15"


def label(c: str = "day") -> Column:
    return day_label(F.col(c)).alias("obs_day")


def rounded(c: str, digits: int = 8) -> Column:
    return (F.round(c, digits) + 0.0).alias(c)


def cat(spark: SparkSession, d: str) -> Catalog:
    return Catalog(spark, d)


def factor(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return X.FACTORS.get(name).panel(cat(spark, d)).where("value is not null").select("ticker", label(), rounded("value", 6))

    return query


def members(spark: SparkSession, d: str) -> DataFrame:
    return U.members_on(cat(spark, d).table("membership"), AS_OF)


def all_members(spark: SparkSession, d: str) -> DataFrame:
    return U.all_tickers(cat(spark, d).table("membership"))


def universe_sizes(spark: SparkSession, d: str) -> DataFrame:
    return U.sizes_at_month_ends(cat(spark, d).periods, FIRST, LAST).select(F.date_format("month_end", "yyyy-MM-dd").alias("month_end"), "n")


def universe_mask(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    return U.restrict(c.panel, c.periods).select("ticker", label())


def panel_calendar(spark: SparkSession, d: str) -> DataFrame:
    return P.calendar(cat(spark, d).panel).select(label(), "pos")


def returns_log(spark: SparkSession, d: str) -> DataFrame:
    return cat(spark, d).returns("log").where("ret is not null").select("ticker", label(), rounded("ret"))


def returns_simple(spark: SparkSession, d: str) -> DataFrame:
    return cat(spark, d).returns("simple", pad_gaps=True).where("ret is not null").select("ticker", label(), rounded("ret"))


def dollar_volume(spark: SparkSession, d: str) -> DataFrame:
    return cat(spark, d).panel.select("ticker", label(), P.dollar_volume().alias("dollars")).where("dollars is not null")


def market_return(spark: SparkSession, d: str) -> DataFrame:
    return cat(spark, d).market.where("market is not null").select(label(), rounded("market", 7))


def market_cap(spark: SparkSession, d: str) -> DataFrame:
    return cat(spark, d).market_cap(asof=True).where("cap is not null").select("ticker", label(), "cap")


def market_cap_exact_days(spark: SparkSession, d: str) -> DataFrame:
    return cat(spark, d).market_cap(asof=False).where("cap is not null").select("ticker", label(), "cap")


def facts_known(spark: SparkSession, d: str) -> DataFrame:
    return cat(spark, d).known("book_equity").where("known is not null").select("ticker", label(), "known")


def cross_section(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    day = c.panel.where(F.col("day") <= F.unix_date(F.lit(AS_OF).cast("date"))).agg(F.max("day")).first()[0]
    return P.cross_section(c.panel, day) if day is not None else c.panel.select("ticker", F.col("close").alias("value")).limit(0)


def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    return E.forward_returns(cat(spark, d).panel, HORIZONS).where("fwd is not null").select("ticker", label(), "horizon", rounded("fwd"))


def scores(c: Catalog, horizons: tuple[int, ...] = (), lag: int = 0) -> DataFrame:
    """Reversal and volatility, oriented, with forward returns."""
    return E.scored(c, [X.FACTORS.get("reversal_1m"), X.FACTORS.get("volatility_60")], horizons, lag)


def information(spark: SparkSession, d: str) -> DataFrame:
    return E.scored_information(scores(cat(spark, d), HORIZONS), LEAST).select("factor", "horizon", label(), rounded("ic", 7), "n")


def information_in_universe(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    ic = E.scored_information(U.restrict(scores(c, HORIZONS), c.periods), LEAST // 2)
    return ic.select("factor", "horizon", label(), rounded("ic", 7), "n")


def information_summary(spark: SparkSession, d: str) -> DataFrame:
    s = E.summarise_information(E.scored_information(scores(cat(spark, d), HORIZONS), LEAST), lags=5)
    return s.select(
        "factor", "horizon", "n", *(rounded(x, 6) for x in ("mean", "sd", "ir", "t_naive", "hit_rate", "t_hac")),
        day_label(F.col("first_day")).alias("first_day"), day_label(F.col("last_day")).alias("last_day")
    )


def information_decay(spark: SparkSession, d: str) -> DataFrame:
    ic = E.scored_information(scores(cat(spark, d), (1, 5, 10, 21, 42, 63)), LEAST)
    return ic.groupBy("factor", "horizon").agg(F.round(F.avg("ic"), 7).alias("mean"))


def sided(c: Catalog, horizons: tuple[int, ...] = ()) -> DataFrame:
    return E.buckets(scores(c, horizons, 1), BUCKETS)


def bucket_sides(spark: SparkSession, d: str) -> DataFrame:
    return sided(cat(spark, d)).where("side <> 0").select("factor", "ticker", label(), "side")


def long_short(spark: SparkSession, d: str) -> DataFrame:
    return E.long_short(sided(cat(spark, d), (21,))).select("factor", label(), "horizon", rounded("ret"))


def bucket_turnover(spark: SparkSession, d: str) -> DataFrame:
    return E.turnover(sided(cat(spark, d))).select("factor", label(), rounded("turnover"))


def net_long_short(spark: SparkSession, d: str) -> DataFrame:
    s = sided(cat(spark, d), (21,))
    return E.net_long_short(E.long_short(s), E.turnover(s)).select("factor", label(), rounded("ret"), rounded("net"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"q_{f.__name__}": f for f in (
    members, all_members, universe_sizes, universe_mask, panel_calendar, returns_log, returns_simple, dollar_volume, market_return, market_cap, market_cap_exact_days, facts_known, cross_section,
    forward_returns, information, information_in_universe, information_summary, information_decay, bucket_sides, long_short, bucket_turnover, net_long_short,
)} | {f"q_factor_{n}": factor(n) for n in ("momentum_12_1", "reversal_1m", "volatility_60", "amihud_illiquidity", "idiosyncratic_skew", "size", "value", "quality")}

_PANEL = f"""{_BARS},
cal as (select day, cast(row_number() over (order by day) - 1 as integer) as pos from (select distinct day from bars)),
placed as (select b.ticker, c.pos, b.close, b.adj, b.volume from bars b join cal c on b.day = c.day),
life as (select ticker, min(pos) as a, max(pos) as b from placed group by 1),
grid as (select ticker, unnest(range(a, b + 1)) as pos from life),
panel as (select g.ticker, c.pos, c.day, close, adj, volume, case when adj > 0 then ln(adj) end as lp, strftime(c.day, '%Y-%m-%d') as obs_day
  from grid g join cal c on g.pos = c.pos left join placed p on p.ticker = g.ticker and p.pos = g.pos)"""
_W = "(partition by ticker order by pos)"
_RET = f"""{_PANEL}, ret as (select *, lp - lag(lp) over {_W} as r from panel),
filled as (select *, last_value(adj ignore nulls) over (partition by ticker order by pos rows unbounded preceding) as f from panel),
sret as (select *, f / nullif(lag(f) over {_W}, 0) - 1 as r from filled),
sraw as (select *, adj / nullif(lag(adj) over {_W}, 0) - 1 as r from panel)"""
_MKT = """mkt as (select day, ln(m) - lag(ln(m)) over (order by day) as market from (select day, avg(adj) as m from panel group by day having avg(adj) > 0))"""
_SPANS = "spans as (select ticker, cast(from_day as date) as s, cast(to_day as date) as e from (" + _PERIODS + ") where kind = 'period')"


def _known(field: str, name: str) -> str:
    return f"""{name}_f as (select ticker, cast(t as date) as day, arg_max(value, t) as v from inst where field = '{field}' group by 1, 2),
{name} as (select p.ticker, p.pos, p.day, p.obs_day, p.close, x.v as known from panel p asof left join {name}_f x on p.ticker = x.ticker and p.day >= x.day)"""


_CAP = f"with {_USABLE}, {_PANEL}, {_known('shares_outstanding', 'sh')}, cap as (select *, close * known as cap from sh)"
_SIG = f"""with {_RET},
sig as (select 'reversal_1m' as factor, ticker, pos, day, obs_day, -(lp - lag(lp, 21) over {_W}) as value from panel
  union all select 'volatility_60', ticker, pos, day, obs_day, -(case when count(r) over w >= 40 then stddev_samp(r) over w end) from ret window w as (partition by ticker order by pos rows between 59 preceding and current row))"""


def _fwd(horizons: tuple[int, ...]) -> str:
    return "fwd as (" + " union all ".join(
        f"select ticker, day, obs_day, {h} as horizon, lead(lp, {h}) over {_W} - lp as fwd from panel" for h in horizons
    ) + ")"


def _ic(horizons: tuple[int, ...], least: int = LEAST, mask: str = "") -> str:
    return f"""{_fwd(horizons)},
pairs as (select s.factor, f.horizon, s.day, s.obs_day, s.value, f.fwd from sig s join fwd f on s.ticker = f.ticker and s.day = f.day where s.value is not null and f.fwd is not null {mask}),
rk as (select *, rank() over (partition by factor, horizon, day order by value) + (count(*) over (partition by factor, horizon, day, value) - 1) / 2.0 as a,
  rank() over (partition by factor, horizon, day order by fwd) + (count(*) over (partition by factor, horizon, day, fwd) - 1) / 2.0 as b from pairs),
ic as (select factor, horizon, day, obs_day, round(covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0), 12) + 0.0 as ic, count(*) as n from rk group by all having count(*) >= {least} and stddev_samp(a) > 0 and stddev_samp(b) > 0)"""


_SIDED = f"""{_SIG},
late as (select factor, ticker, pos, day, obs_day, lag(value) over (partition by factor, ticker order by pos) as value from sig),
pct as (select *, row_number() over (partition by factor, day order by value, ticker) / count(*) over (partition by factor, day) as pct from late where value is not null),
sided as (select *, case when pct > 1 - 1.0::double / {BUCKETS} then 1 when pct <= 1.0::double / {BUCKETS} then -1 else 0 end as side from pct)"""
_LS = f"""{_fwd((21,))},
ls as (select s.factor, s.day, s.obs_day, 21 as horizon, avg(fwd) filter (side > 0) - avg(fwd) filter (side < 0) as ret from sided s join fwd f on s.ticker = f.ticker and s.day = f.day where fwd is not null and side <> 0 group by all)"""
_TURN = """seq as (select factor, day, obs_day, lag(day) over (partition by factor order by day) as prev from (select distinct factor, day, obs_day from sided)),
leg as (select factor, side, day, ticker from sided where side <> 0),
moves as (
  select q.factor, l.side, q.day, q.obs_day, 1 as size, case when p.ticker is null then 1 else 0 end as moved from seq q join leg l on l.factor = q.factor and l.day = q.day
    left join leg p on p.factor = q.factor and p.day = q.prev and p.side = l.side and p.ticker = l.ticker where q.prev is not null
  union all select q.factor, p.side, q.day, q.obs_day, 0, 1 from seq q join leg p on p.factor = q.factor and p.day = q.prev
    left join leg l on l.factor = q.factor and l.day = q.day and l.side = p.side and l.ticker = p.ticker where l.ticker is null),
legs as (select factor, side, day, obs_day, sum(moved) / nullif(2.0 * sum(size), 0) as t from moves group by all),
turn as (select factor, day, obs_day, sum(coalesce(t, 0)) as turnover from legs group by all)"""


def _hac(lags: int) -> str:
    shifts = ", ".join(f"lag(e, {k}) over (partition by factor, horizon order by day) as e{k}" for k in range(1, lags + 1))
    total = "sum(e * e)" + "".join(f" + 2 * (1 - {k} / {lags + 1}.0::double) * coalesce(sum(e * e{k}), 0)" for k in range(1, lags + 1))
    return f"""dev as (select *, ic - avg(ic) over (partition by factor, horizon) as e from ic), moved as (select *, {shifts} from dev),
hac as (select factor, horizon, avg(ic) / (sqrt({total}) / count(*)) as t_hac from moved group by 1, 2)"""


def _f(select: str) -> str:
    return f"select ticker, obs_day, round(value, 6) + 0.0 as value from ({select}) where value is not null"


_ROLL = "(partition by ticker order by pos rows between {} preceding and current row)"


def _all_signals() -> str:
    """sig: factor, ticker, pos, day, obs_day, value of all classical factors, oriented."""
    w60, w21 = _ROLL.format(59), _ROLL.format(20)
    each = {
        "momentum_12_1": f"lag(lp, 21) over {_W} - lag(lp, 252) over {_W} as value from panel",
        "reversal_1m": f"-(lp - lag(lp, 21) over {_W}) as value from panel",
        "volatility_60": f"-(case when count(r) over w >= 40 then stddev_samp(r) over w end) as value from ret window w as {w60}",
        "amihud_illiquidity": f"case when count(x) over w >= 14 then avg(x) over w * 1e6 end as value from ill window w as {w21}",
        "idiosyncratic_skew": f"-(case when count(e) over w >= 40 and stddev_pop(e) over w > 1e-12 then skewness(e) over w end) as value from resid window w as {w60}",
        "size": "-(case when cap > 0 then ln(cap) end) as value from cap",
        "value": "be.known / nullif(c.cap, 0) as value from cap c join be on c.ticker = be.ticker and c.pos = be.pos",
        "quality": "gp.known / nullif(ta.known, 0) as value from gp join ta on gp.ticker = ta.ticker and gp.pos = ta.pos",
    }
    source = {"value": "c.", "quality": "gp."}
    parts = [
        "select '{0}' as factor, {1}ticker as ticker, {1}pos as pos, {1}day as day, {1}obs_day as obs_day, {2}".format(n, source.get(n, ""), body)
        for n, body in each.items()
    ]
    return f"""with {_USABLE}, {_RET}, {_MKT}, {_known('shares_outstanding', 'sh')}, cap as (select *, close * known as cap from sh),
{_known('book_equity', 'be')}, {_known('gross_profit', 'gp')}, {_known('total_assets', 'ta')},
ill as (select *, abs(r) / nullif(close * volume, 0) as x from sraw), jm as (select t.*, m.market from ret t left join mkt m on t.day = m.day),
bm as (select *, case when count(case when r is not null and market is not null then 1 end) over w >= 40 then covar_samp(r, market) over w end / nullif(case when count(market) over w >= 40 then var_samp(market) over w end, 0) as beta from jm window w as {w60}),
resid as (select *, r - beta * market as e from bm),
sig as ({' union all '.join(parts)})"""


_SIG8 = _all_signals()
_SIDED8 = _SIDED.replace(_SIG, _SIG8)

SQL: dict[str, str] = {
    "q_members": f"select distinct {_TICKER.format('')} as ticker from membership where coalesce(cast(start_date as date), date '0001-01-01') <= date '{AS_OF}' and coalesce(cast(end_date as date), date '2099-12-31') > date '{AS_OF}' and coalesce(cast(end_date as date), date '2099-12-31') > coalesce(cast(start_date as date), date '0001-01-01') and ticker is not null",
    "q_all_members": f"select distinct {_TICKER.format('')} as ticker from membership where ticker is not null",
    "q_universe_sizes": f"""with {_SPANS}, m as (select last_day(cast(unnest(generate_series(timestamp '{FIRST}' - interval 30 day, timestamp '{LAST}', interval 1 month)) as date)) as me)
select strftime(me, '%Y-%m-%d') as month_end, count(*) as n from m join spans on s <= me and e > me where me between date '{FIRST}' and date '{LAST}' group by me""",
    "q_universe_mask": f"with {_PANEL}, {_SPANS} select p.ticker, p.obs_day from panel p join spans x on p.ticker = x.ticker and p.day >= x.s and p.day < x.e",
    "q_panel_calendar": f"with {_PANEL} select strftime(day, '%Y-%m-%d') as obs_day, pos from cal",
    "q_returns_log": f"with {_RET} select ticker, obs_day, round(r, 8) + 0.0 as ret from ret where r is not null",
    "q_returns_simple": f"with {_RET} select ticker, obs_day, round(r, 8) + 0.0 as ret from sret where r is not null",
    "q_dollar_volume": f"with {_PANEL} select ticker, obs_day, close * volume as dollars from panel where close * volume is not null",
    "q_market_return": f"with {_PANEL}, {_MKT} select strftime(day, '%Y-%m-%d') as obs_day, round(market, 7) + 0.0 as market from mkt where market is not null",
    "q_market_cap": f"{_CAP} select ticker, obs_day, cap from cap where cap is not null",
    "q_market_cap_exact_days": f"""with {_USABLE}, {_PANEL}, f as (select ticker, cast(t as date) as day, arg_max(value, t) as v from inst where field = 'shares_outstanding' group by 1, 2),
j as (select p.ticker, p.obs_day, p.close, last_value(f.v ignore nulls) over (partition by p.ticker order by p.pos rows unbounded preceding) as known from panel p left join f on p.ticker = f.ticker and p.day = f.day)
select ticker, obs_day, close * known as cap from j where close * known is not null""",
    "q_facts_known": f"with {_USABLE}, {_PANEL}, {_known('book_equity', 'be')} select ticker, obs_day, known from be where known is not null",
    "q_cross_section": f"with {_PANEL} select ticker, close as value from panel where day = (select max(day) from panel where day <= date '{AS_OF}') and close is not null",
    "q_forward_returns": f"with {_PANEL}, {_fwd(HORIZONS)} select ticker, obs_day, horizon, round(fwd, 8) + 0.0 as fwd from fwd where fwd is not null",
    "q_information": f"{_SIG}, {_ic(HORIZONS)} select factor, horizon, obs_day, round(ic, 7) + 0.0 as ic, n from ic",
    "q_information_in_universe": f"{_SIG}, {_SPANS}, {_ic(HORIZONS, LEAST // 2, 'and exists (select 1 from spans x where x.ticker = s.ticker and s.day >= x.s and s.day < x.e)')} select factor, horizon, obs_day, round(ic, 7) + 0.0 as ic, n from ic",
    "q_information_summary": f"""{_SIG}, {_ic(HORIZONS)}, {_hac(5)},
st as (select factor, horizon, count(*) as n, avg(ic) as mean, stddev_samp(ic) as sd, sum(case when ic > 0 then 1 else 0 end) as up, sum(case when ic < 0 then 1 else 0 end) as down, sum(case when ic = 0 then 1 else 0 end) as flat, min(obs_day) as first_day, max(obs_day) as last_day from ic group by 1, 2)
select st.factor, st.horizon, n, round(mean, 6) + 0.0 as mean, round(sd, 6) + 0.0 as sd, round(mean / sd * sqrt(252), 6) + 0.0 as ir, round(mean / (sd / sqrt(n)), 6) + 0.0 as t_naive,
  round(case when mean > 0 then up when mean < 0 then down else flat end / n, 6) + 0.0 as hit_rate, round(t_hac, 6) + 0.0 as t_hac, first_day, last_day from st join hac on st.factor = hac.factor and st.horizon = hac.horizon""",
    "q_information_decay": f"{_SIG}, {_ic((1, 5, 10, 21, 42, 63))} select factor, horizon, round(avg(ic), 7) as mean from ic group by 1, 2",
    "q_bucket_sides": f"{_SIDED} select factor, ticker, obs_day, side from sided where side <> 0",
    "q_long_short": f"{_SIDED}, {_LS} select factor, obs_day, horizon, round(ret, 8) + 0.0 as ret from ls where ret is not null",
    "q_bucket_turnover": f"{_SIDED}, {_TURN} select factor, obs_day, round(turnover, 8) + 0.0 as turnover from turn",
    "q_net_long_short": f"{_SIDED}, {_LS}, {_TURN} select ls.factor, ls.obs_day, round(ret, 8) + 0.0 as ret, round(ret - 0.001 * coalesce(turnover, 0), 8) + 0.0 as net from ls left join turn on ls.factor = turn.factor and ls.day = turn.day where ret is not null",
    "q_factor_momentum_12_1": f"with {_PANEL} " + _f(f"select ticker, obs_day, lag(lp, 21) over {_W} - lag(lp, 252) over {_W} as value from panel"),
    "q_factor_reversal_1m": f"with {_PANEL} " + _f(f"select ticker, obs_day, lp - lag(lp, 21) over {_W} as value from panel"),
    "q_factor_volatility_60": f"with {_RET} " + _f(f"select ticker, obs_day, case when count(r) over w >= 40 then stddev_samp(r) over w end as value from ret window w as {_ROLL.format(59)}"),
    "q_factor_amihud_illiquidity": f"with {_RET}, x as (select ticker, obs_day, pos, abs(r) / nullif(close * volume, 0) as x from sraw) " + _f(f"select ticker, obs_day, case when count(x) over w >= 14 then avg(x) over w * 1e6 end as value from x window w as {_ROLL.format(20)}"),
    "q_factor_idiosyncratic_skew": f"""with {_RET}, {_MKT}, j as (select t.*, m.market from ret t left join mkt m on t.day = m.day),
b as (select *, case when count(case when r is not null and market is not null then 1 end) over w >= 40 then covar_samp(r, market) over w end / nullif(case when count(market) over w >= 40 then var_samp(market) over w end, 0) as beta from j window w as {_ROLL.format(59)}),
e as (select ticker, obs_day, pos, r - beta * market as e from b) """ + _f(f"select ticker, obs_day, case when count(e) over w >= 40 and stddev_pop(e) over w > 1e-12 then skewness(e) over w end as value from e window w as {_ROLL.format(59)}"),
    "q_factor_size": f"{_CAP} " + _f("select ticker, obs_day, case when cap > 0 then ln(cap) end as value from cap"),
    "q_factor_value": f"{_CAP}, {_known('book_equity', 'be')} " + _f("select c.ticker, c.obs_day, be.known / nullif(c.cap, 0) as value from cap c join be on c.ticker = be.ticker and c.pos = be.pos"),
    "q_factor_quality": f"with {_USABLE}, {_PANEL}, {_known('gross_profit', 'gp')}, {_known('total_assets', 'ta')} " + _f("select gp.ticker, gp.obs_day, gp.known / nullif(ta.known, 0) as value from gp join ta on gp.ticker = ta.ticker and gp.pos = ta.pos"),
}
