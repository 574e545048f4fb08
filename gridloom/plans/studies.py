"""Queries of composite studies, inference, ingestion rules and change logs over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.engine.session import checkpoint
from gridloom.functions import inference as I
from gridloom.operators import evaluate as E
from gridloom.operators import factors as X
from gridloom.operators import graphs as G
from gridloom.operators import universe as U
from gridloom.operators import vectors as V
from gridloom.operators.columns import symbol
from gridloom.operators.readings import usable
from gridloom.plans import signals as S
from gridloom.plans import study as T
from gridloom.plans.portfolios import lead_lag, p_two_sided, text_factor
from gridloom.plans.problems import _CELLS, _PERIODS, _USABLE
from gridloom.plans.signals import AS_OF, BUCKETS, LEAST, cat, label, rounded
from gridloom.sources import filings as L
from gridloom.sources.tables import table


_OTHERS = sorted(f.name for f in X.FACTORS.all() if f.name != "reversal_1m")


def graph_factors() -> list[X.Factor]:
    """All graph factors, those of lead and lag and of texts for the given tables' thin windows."""
    thin = {f.name: f for f in [*map(lead_lag, ("out", "in", "upstream")), text_factor()]}
    return [thin.get(f.name, f) for f in G.GRAPH_FACTORS.all()]


def zoo(spark: SparkSession, d: str) -> DataFrame:
    z = T.factor_zoo(cat(spark, d), X.FACTORS.all(), 21, BUCKETS, LEAST, restrict_universe=False)
    return z.select("factor", "direction", "horizon", "n", *(rounded(c, 6) for c in z.columns[4:-1]), "rejected")


def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return T.scorecard(cat(spark, d), graph_factors(), X.FACTORS.all(), len(T.configurations()), 21, BUCKETS, 3)


def _against_others(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Long-short returns of reversal and of all other classical factors: one row per factor and day, computed once."""
    s = checkpoint(E.factor_long_short(cat(spark, d), X.FACTORS.all(), BUCKETS, (21,)).select("factor", "day", "ret"))
    return s.where("factor = 'reversal_1m'"), s.where("factor <> 'reversal_1m'")


def exposures(spark: SparkSession, d: str) -> DataFrame:
    return T.exposures(spark, *_against_others(spark, d), names=_OTHERS).select("term", *(rounded(x, 6) for x in ("coef", "se", "t")), "n")


def spanning(spark: SparkSession, d: str) -> DataFrame:
    t = T.spanning(spark, "reversal_1m", *_against_others(spark, d), names=_OTHERS)
    return t.select("factor", "n", *(rounded(c, 6) for c in t.columns[2:]))


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return T.bootstrap(spark, *_against_others(spark, d), names=_OTHERS)


def long_short_moments(spark: SparkSession, d: str) -> DataFrame:
    m = T.long_short_moments(E.long_short(S.sided(cat(spark, d), (21,))))
    return m.select("factor", "n", *(rounded(c, 6) for c in m.columns[2:]))


def p_values(spark: SparkSession, d: str) -> DataFrame:
    """Normal p-values of each factor and horizon, and which the step-up and the Bonferroni rule reject."""
    c = cat(spark, d)
    s = E.summarise_information(E.scored_information(S.scores(c, S.HORIZONS), LEAST), 5)

    @F.pandas_udf("double")
    def two_sided(t: pd.Series) -> pd.Series:
        return pd.Series(I.pvalues_of_t(t.to_numpy(float)))

    p = s.select("factor", "horizon", two_sided("t_hac").alias("p"))
    from pyspark.sql import Window

    every = Window.partitionBy()  # one row per factor and horizon
    k = F.row_number().over(Window.orderBy("p", "factor", "horizon"))
    p = p.withColumn("_k", k).withColumn("_m", F.count(F.lit(1)).over(every))
    p = p.withColumn("_last", F.max(F.when(F.col("p") <= F.col("_k") / F.col("_m") * 0.05, F.col("_k"))).over(every))
    return p.select(
        "factor", "horizon", rounded("p", 6), (F.col("_k") <= F.coalesce("_last", F.lit(0))).alias("step_up"),
        (F.col("p") <= 0.05 / F.col("_m")).alias("bonferroni")
    )


def grid(spark: SparkSession, d: str) -> DataFrame:
    return T.grid_table(spark)


def grid_by_class(spark: SparkSession, d: str) -> DataFrame:
    return T.grid_table(spark).groupBy("feature_class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("config_id").alias("n_ids"))


def earliest_disclosures(spark: SparkSession, d: str) -> DataFrame:
    """Of each ticker, field, period end and value the first time it was public: repeated older figures go, restatements stay."""
    rows = usable(table(spark, d, "fundamentals")).withColumnRenamed("t", "available_date")
    kept = L.earliest_disclosures(rows.select("ticker", "field", "available_date", "value", "period_end"), ["ticker", "field"])
    return kept.select("ticker", "field", "available_date", F.bround("value", 2).alias("value"), "period_end")


def changes_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The membership table as a change log (date, added, removed) and its current members."""
    p = cat(spark, d).periods
    open_ = F.unix_date(F.lit("2099-12-31").cast("date"))
    unknown = F.unix_date(F.lit("0001-01-01").cast("date"))
    added = p.where(F.col("start") > unknown).select(F.date_from_unix_date("start").alias("date"), F.col("ticker").alias("added"), F.lit("").alias("removed"))
    removed = p.where(F.col("end") < open_).select(F.date_from_unix_date("end").alias("date"), F.lit("").alias("added"), F.col("ticker").alias("removed"))
    return added.union(removed), p.where(F.col("end") >= open_).select("ticker")


def intervals_from_changes(spark: SparkSession, d: str) -> DataFrame:
    changes, current = changes_of(spark, d)
    out = U.intervals_from_changes(changes, current)
    return out.select("ticker", F.date_format("start_date", "yyyy-MM-dd").alias("from_day"), F.date_format("end_date", "yyyy-MM-dd").alias("to_day"))


def members_by_replay(spark: SparkSession, d: str) -> DataFrame:
    changes, current = changes_of(spark, d)
    return U.members_by_replay(current, changes, AS_OF)


#: The band and the days of the member counts that are checked; on the given tables some days pass and some fail.
SIZES, CHECK_DAYS = (40, 400), ["2012-06-29", AS_OF, "2023-12-29"]


def validation(spark: SparkSession, d: str) -> DataFrame:
    _, current = changes_of(spark, d)
    return U.validate(table(spark, d, "membership"), current, *SIZES, CHECK_DAYS)


def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of the members at each month end with a filed document by then, over the months of the filings."""
    docs = table(spark, d, "documents").select(symbol("ticker").alias("ticker"), F.to_date("filed_at").alias("filing_date")).where(
        "ticker is not null and filing_date is not null"
    )
    span = docs.agg(F.min("filing_date").alias("a"), F.max("filing_date").alias("b")).first()
    points = U.month_ends_covered(cat(spark, d).periods, F.last_day(F.lit(span["a"])), F.last_day(F.lit(span["b"])))
    members = points.select(F.col("month_end").alias("checkpoint"), "ticker")
    return V.coverage(docs, members).select(F.date_format("checkpoint", "yyyy-MM-dd").alias("checkpoint"), "n_universe", "n_covered", rounded("coverage", 6))


def filings_per_year(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tickers with a business section of at least 500 characters, by year."""
    own = table(spark, d, "documents").where("ticker is not null and filed_at is not null").select("ticker", "filed_at", V.item_one(F.col("text")).alias("item"))
    return own.where("length(item) >= 500").groupBy(F.year("filed_at").alias("year")).agg(F.countDistinct("ticker").alias("n"))


def neighbour_signal(spark: SparkSession, d: str) -> DataFrame:
    """Each query vector's neighbours' mean label, weighted by similarity."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    edges = V.nearest(e, e.where("id % 100 = 0"), 20).select(
        F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("similarity").alias("weight")
    )
    recent = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("ticker"), F.col("label").cast("double").alias("mean_ret"))
    return V.neighbour_signal(edges, recent).select("src", rounded("value", 6))


def quarter_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Readings and missing quarters by field."""
    from gridloom.operators.grid import to_quarters

    g = to_quarters(table(spark, d, "fundamentals"))
    return g.groupBy("field").agg(
        F.sum("n_readings").alias("n_readings"), F.count(F.when(F.col("is_missing"), 1)).alias("n_missing"),
        F.count(F.lit(1)).alias("n_cells")
    )


def factor_as_of(spark: SparkSession, d: str) -> DataFrame:
    import datetime

    return X.FACTORS.get("volatility_60").on(
        cat(spark, d), (datetime.date.fromisoformat(AS_OF) - datetime.date(1970, 1, 1)).days
    ).select("ticker", rounded("value", 6))


def calendar_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every 63rd calendar row with its members."""
    c = cat(spark, d)
    return U.restrict(c.panel.where("pos % 63 = 0"), c.periods).select("ticker", label())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"q_{f.__name__}": f for f in (
    zoo, scorecard, exposures, spanning, bootstrap, long_short_moments, p_values, grid, grid_by_class, earliest_disclosures, intervals_from_changes, members_by_replay, validation,
    embedding_coverage, filings_per_year, neighbour_signal, quarter_coverage, factor_as_of, calendar_samples,
)}

_SPAN = S._SPANS
_ITEM = r"nullif(trim(regexp_extract(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s\p{Z}\x{0085}\x{000b}]+', ' ', 'g')), '(?is)item\s*1\s*\.?\s*(?:-|:)?\s*business(.*?)(?:item\s*1a\b|item\s*2\b|$)', 1)), '')"

def _regression(lags: int, names: list[str]) -> str:
    """SQL of least squares with HAC errors of target on [1, names] by orthogonalisation: tables coef (term, coef, se), stat (n, k, rss, tss, theta).

    ``wide`` (day, y, x0 = 1, x1, ...) holds the complete rows. The columns are made orthonormal one by one (q0, q1, ...),
    R holds the products; rows of its inverse turn them into each coefficient's weights h, whose products with the
    residuals are summed over lags.
    """
    k = len(names)
    columns = [f"x{i}" for i in range(k + 1)]
    steps, have = [], []
    before = "wide"
    for i, x in enumerate(columns):
        # twice, so that rounding leaves nothing of the earlier columns
        for again in range(2):
            dots = ", ".join(f"sum({x} * {q}) over () as d{j}" for j, q in enumerate(have))
            steps.append(f"o{i}_{again}a as (select *{', ' + dots if dots else ''} from {before})")
            less = "".join(f" - d{j} * {q}" for j, q in enumerate(have))
            keep = ", ".join(["day", "y", *columns[i + 1 :], *have])
            sums = ", ".join(f"d{j} as s{i}_{j}" for j in range(len(have))) if again == 0 else ", ".join(f"s{i}_{j} + d{j} as s{i}_{j}" for j in range(len(have)))
            rest = [f"s{a}_{b}" for a in range(i) for b in range(a + 1)]
            steps.append(f"o{i}_{again} as (select {keep}{', ' + ', '.join(rest) if rest else ''}{', ' + sums if sums else ''}, {x}{less} as {x} from o{i}_{again}a)")
            before = f"o{i}_{again}"
        rest = [f"s{a}_{b}" for a in range(i) for b in range(a + 1)] + [f"s{i}_{j}" for j in range(i)]
        keep = ", ".join(["day", "y", *(c for c in columns[i + 1 :]), *have, *rest])
        steps.append(f"q{i}_t as (select {keep}, sqrt(sum({x} * {x}) over ()) as s{i}_{i}, {x} / sqrt(sum({x} * {x}) over ()) as q{i} from {before})")
        before = f"q{i}_t"
        have.append(f"q{i}")
    # row j of the inverse of R, from its diagonal on
    for m in range(k + 1):
        cells = [f"1 / s{m}_{m} as v{m}_{m}"] + [f"-({' + '.join(f'v{j}_{i} * s{m}_{i}' for i in range(j, m))}) / s{m}_{m} as v{j}_{m}" for j in range(m)]
        steps.append(f"inv{m} as (select *, {', '.join(cells)} from {before})")
        before = f"inv{m}"
    fit = ", ".join(f"sum(y * q{j}) over () as b{j}" for j in range(k + 1))
    steps.append(f"fit as (select *, {fit} from {before})")
    left = "".join(f" - b{j} * q{j}" for j in range(k + 1))
    steps.append(f"res as (select *, y{left} as e from fit)")
    each = " union all ".join(
        f"select {j} as term, day, e, {' + '.join(f'v{j}_{m} * q{m}' for m in range(j, k + 1))} as h, {' + '.join(f'v{j}_{m} * b{m}' for m in range(j, k + 1))} as coef from res" for j in range(k + 1)
    )
    shifts = ", ".join(f"lag(e * h, {g}) over (partition by term order by day) as g{g}" for g in range(1, lags + 1))
    total = "sum(e * h * e * h)" + "".join(f" + 2 * (1 - {g} / {lags + 1}.0::double) * coalesce(sum(e * h * g{g}), 0)" for g in range(1, lags + 1))
    label = " ".join(f"when {j} then '{n}'" for j, n in enumerate(["alpha", *names]))
    return ", ".join(steps) + f""", terms as ({each}), lagged as (select *, {shifts} from terms),
coef as (select term as place, case term {label} end as term, any_value(coef) as coef, sqrt(greatest({total}, 0)) as se, sum(h * h) as hh, count(*) as n from lagged group by 1, 2),
stat as (select count(*) as n, sum(e * e) as rss, sum(y * y) - sum(y) * sum(y) / count(*) as tss from res)"""


_WIDE_LS = f"""{S._SIDED8}, {S._LS},
complete as (select * from (select day, max(ret) filter (factor = 'reversal_1m') as y, 1.0::double as x0, {', '.join(f"max(ret) filter (factor = '{n}') as x{i + 1}" for i, n in enumerate(_OTHERS))} from ls where ret is not null group by day)
  where y is not null {''.join(f' and x{i + 1} is not null' for i in range(len(_OTHERS)))}),
wide as (select * from complete where (select count(*) from complete) > {len(_OTHERS) + 1})"""


def _t_two_sided(t: str, dof: str) -> str:
    """Two-sided p-value of Student's t: one less the density's integral from -t to t, by Simpson's rule over 2,000 steps."""
    g = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * 3.141592653589793)"
    h = f"(({t}) / 2000)"
    return f"1 - 2 * {g} * {h} / 3 * list_sum([(case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end) * power(1 + i * {h} * i * {h} / {dof}, -({dof} + 1) / 2.0) for i in range(0, 2001)])"


def _expected_max() -> str:
    """Expected maximum of so many standard normal Sharpe ratios, for up to as many trials as there are factors."""
    return "case m " + " ".join(f"when {m} then {I.expected_max_sharpe(m, 1.0)!r}" for m in range(1, len(X.FACTORS.all()) + 1)) + " end"


def _normal_cdf(z: str) -> str:
    return f"case when ({z}) >= 0 then 1 - ({p_two_sided(z)}) / 2 else ({p_two_sided(z)}) / 2 end"


_STEP_UP = "lim as (select max(k) filter (p <= k / m * 0.05::double) as last from tests)"
_P = f"""{S._SIG}, {S._ic(S.HORIZONS)}, {S._hac(5)}, pv as (select factor, horizon, {p_two_sided('t_hac')} as p from hac),
tests as (select *, row_number() over (order by p, factor, horizon) as k, count(*) over () as m from pv), {_STEP_UP}"""
_ZOO = f"""{S._SIG8}, {S._ic((21,))}, {S._hac(20)},
st as (select factor, count(*) as n, avg(ic) as mean, stddev_samp(ic) as sd, sum(case when ic > 0 then 1 else 0 end) as up, sum(case when ic < 0 then 1 else 0 end) as down, sum(case when ic = 0 then 1 else 0 end) as flat from ic group by 1),
{S._SIDED8[len(S._SIG8) + 2:]}, ls as (select s.factor, s.day, avg(fwd) filter (side > 0) - avg(fwd) filter (side < 0) as ret from sided s join fwd f on s.ticker = f.ticker and s.day = f.day where fwd is not null and side <> 0 group by all),
sr as (select factor, avg(ret) / nullif(stddev_samp(ret), 0) as sharpe from ls where ret is not null group by 1),
al as (select st.*, h.t_hac, {p_two_sided('t_hac')} as p, sharpe from st left join hac h on h.factor = st.factor left join sr on sr.factor = st.factor),
tests as (select *, row_number() over (order by p nulls last, factor) as k, count(*) over () as m, coalesce(var_samp(sharpe) over (), 1) as v from al), {_STEP_UP},
de as (select *, (sharpe - sqrt(v) * {_expected_max()}) * sqrt(greatest(2, n // 21) - 1) / sqrt(1 + sharpe * sharpe / 2) as z from tests)"""

SQL: dict[str, str] = {
    "q_p_values": f"{_P} select factor, horizon, round(p, 6) + 0.0 as p, k <= coalesce(last, 0) as step_up, p <= 0.05 / m as bonferroni from tests, lim",
    "q_zoo": f"""{_ZOO} select factor, case when factor in ({', '.join(f"'{f.name}'" for f in X.FACTORS.all() if f.direction < 0)}) then -1 else 1 end as direction, 21 as horizon, n, round(mean, 6) + 0.0 as mean_ic, round(mean / sd * sqrt(252), 6) + 0.0 as ir, round(mean / (sd / sqrt(n)), 6) + 0.0 as t_naive,
  round(t_hac, 6) + 0.0 as t_hac, round(p, 6) + 0.0 as p_hac, round(case when mean > 0 then up when mean < 0 then down else flat end / n, 6) + 0.0 as hit_rate, round(sharpe, 6) + 0.0 as sharpe, round({_normal_cdf('z')}, 6) + 0.0 as deflated, k <= coalesce(last, 0) as rejected from de, lim""",
    "q_exposures": f"{_WIDE_LS}, {_regression(21, _OTHERS)} select term, round(coef, 6) + 0.0 as coef, round(se, 6) + 0.0 as se, round(coef / se, 6) + 0.0 as t, n from coef",
    "q_spanning": f"""{_WIDE_LS}, {_regression(20, _OTHERS)},
a as (select coef as alpha, coef / se as t, n, n * hh - 1 as base, n - {len(_OTHERS) + 1} as dof, rss, tss from coef, (select rss, tss from stat) where place = 0),
b as (select *, alpha * alpha / (rss / n) as gain from a), g as (select *, dof * gain / (1 + base) as grs from b)
select 'reversal_1m' as factor, (select count(*) from complete) as n, round(alpha, 6) + 0.0 as alpha, round(alpha * 252, 6) + 0.0 as alpha_ann, round(t, 6) + 0.0 as t, round({p_two_sided('t')}, 6) + 0.0 as p, round(grs, 6) + 0.0 as grs, round({_t_two_sided('sqrt(grs)', 'dof')}, 6) + 0.0 as grs_p,
  round(alpha / sqrt(rss / dof) * sqrt(252), 6) + 0.0 as appraisal, round(base, 6) + 0.0 as theta_base, round(gain, 6) + 0.0 as theta_gain, round(1 - rss / tss, 6) + 0.0 as r2 from (select 1) left join g on true""",
    "q_long_short_moments": f"{S._SIDED}, {S._LS} select factor, count(ret) as n, round(avg(ret) / stddev_samp(ret), 6) + 0.0 as sharpe, round(skewness(ret), 6) + 0.0 as skew, round(kurtosis(ret), 6) + 0.0 as kurtosis from ls where ret is not null group by 1",
    "q_grid": """with w as (select unnest([120, 180, 250]) as w), s as (select unnest(['threshold', 'mst', 'pmfg']) as s), c as (select unnest(['degree', 'eigenvector', 'betweenness', 'clustering']) as f), t as (select unnest(['level', 'delta']) as t),
cf as (select f, t from c, t union all select unnest(['community_louvain', 'community_leiden']), 'level'),
a as (select 'correlation' as feature_class, f as feature, t as transform, w as "window", s as sparsifier, null as lag, null as knn, '{"feature":"' || f || '","feature_class":"correlation","sparsifier":"' || s || '","transform":"' || t || '","window":' || w || '}' as js from w, s, cf),
l as (select unnest([1, 2, 3, 4, 5]) as lag), lf as (select unnest(['in_degree', 'out_degree', 'upstream']) as f),
b as (select 'leadlag', f, null, null, null, lag, null, '{"feature":"' || f || '","feature_class":"leadlag","lag":' || lag || '}' from l, lf),
k as (select unnest([5, 10, 20]) as knn), x as (select 'text', 'neighbour_return', null, null, null, null, knn, '{"feature":"neighbour_return","feature_class":"text","knn":' || knn || '}' from k),
every as (select * from a union all select * from b union all select * from x)
select substr(sha1(js), 1, 12) as config_id, feature_class, feature, transform, cast("window" as integer) as "window", sparsifier, cast(lag as integer) as lag, cast(knn as integer) as knn from every""",
    "q_earliest_disclosures": f"""with {_USABLE} select ticker, field, epoch_us(t) as available_date, round_even(value, 2) as value, epoch_us(period_end) as period_end from (
select *, row_number() over (partition by ticker, field, period_end, round_even(value, 2) order by t, value) as k from good) where k = 1""",
    "q_intervals_from_changes": f"select ticker, case when from_day <> '0001-01-01' then from_day end as from_day, case when to_day <> '2099-12-31' then to_day end as to_day from ({_PERIODS}) where kind = 'period'",
    "q_members_by_replay": S.SQL["q_members"],
    "q_validation": f"""select 'start_before_end' as "check", count(*) as failures from membership where start_date is not null and end_date is not null and not start_date < end_date
union all select 'open_set_is_current', count(*) from (
  (select distinct {S._TICKER.format('')} as ticker from membership where end_date is null or cast(end_date as date) >= date '2099-12-31' except select ticker from ({_PERIODS}) where kind = 'period' and to_day = '2099-12-31')
  union all (select ticker from ({_PERIODS}) where kind = 'period' and to_day = '2099-12-31' except select distinct {S._TICKER.format('')} from membership where end_date is null or cast(end_date as date) >= date '2099-12-31'))
{' '.join(f"union all select 'size_{day}', case when count(*) between {SIZES[0]} and {SIZES[1]} then 0 else 1 end from ({S.SQL['q_members'].replace(AS_OF, day)})" for day in CHECK_DAYS)}""",
    "q_embedding_coverage": f"""with {_SPAN}, f as (select {S._TICKER.format('')} as ticker, min(cast(filed_at as date)) as first from documents where ticker is not null and filed_at is not null group by 1),
cp as (select last_day(cast(unnest(generate_series(date_trunc('month', min(filed_at)), date_trunc('month', max(filed_at)), interval 1 month)) as date)) as c from documents where ticker is not null and filed_at is not null),
m as (select c, ticker from cp join spans on s <= c and e > c)
select strftime(c, '%Y-%m-%d') as checkpoint, count(*) as n_universe, count(*) filter (first <= c) as n_covered, round(count(*) filter (first <= c) / count(*), 6) + 0.0 as coverage from m left join f on m.ticker = f.ticker group by c""",
    "q_filings_per_year": f"select cast(year(filed_at) as integer) as year, count(distinct ticker) as n from (select ticker, filed_at, {_ITEM} as item from documents where ticker is not null and filed_at is not null) where length(item) >= 500 group by 1",
    "q_item_one_texts": f"select doc_id, cast(length(item) as integer) as n_chars from (select doc_id, {_ITEM} as item from documents) where item is not null",
    "q_neighbour_signal": """with q as (select vec_id as src, embedding as a from embeddings where vec_id % 100 = 0),
s as (select src, e.vec_id as dst, e.label, round(list_cosine_similarity(a::double[], e.embedding::double[]), 12) as sim from q join embeddings e on e.vec_id <> src),
k as (select * from (select *, row_number() over (partition by src order by sim desc, dst) as n from s) where n <= 20 and sim >= 0)
select cast(src as varchar) as src, round(sum(sim * label) / sum(sim), 6) + 0.0 as value from k group by 1""",
    "q_quarter_coverage": f"""{_CELLS}, r as (select field, count(*) as n_readings from q group by 1),
c as (select field, count(*) as n_cells, count(*) filter (not exists (select 1 from q where q.ticker = x.ticker and q.field = x.field and q.q = x.q)) as n_missing from cells x group by 1) select c.field, cast(n_readings as bigint) as n_readings, n_missing, n_cells from c join r on c.field = r.field""",
    "q_factor_as_of": f"with x as ({S.SQL['q_factor_volatility_60']}), {S._PANEL} select ticker, value from x where obs_day = (select max(obs_day) from panel where obs_day <= '{AS_OF}')",
    "q_calendar_samples": f"with {S._PANEL}, {_SPAN} select p.ticker, p.obs_day from panel p join spans x on p.ticker = x.ticker and p.day >= x.s and p.day < x.e where p.pos % 63 = 0",
}
SQL["q_grid_by_class"] = f"select feature_class, count(*) as n, count(distinct config_id) as n_ids from ({SQL['q_grid']}) group by 1"
