"""Queries of the table primitives that the studies rest on, over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.moments import bias_corrected_kurtosis, bias_corrected_skewness, safe_corr
from gridloom.operators import evaluate as E
from gridloom.operators import panel as P
from gridloom.operators import universe as U
from gridloom.plans import signals as S
from gridloom.plans.signals import _PANEL, _RET, _ROLL, _W, cat, label, rounded
from gridloom.sources.tables import table

DAY_A, DAY_B = "2014-06-30", "2018-06-15"


def shifts(spark: SparkSession, d: str) -> DataFrame:
    """Value one row earlier and later, and the difference."""
    p = cat(spark, d).panel
    out = p.select(
        "ticker", label(), P.lagged("adj", 1).alias("earlier"), P.lagged("adj", -1).alias("later"),
        F.round(F.col("adj") - P.lagged("adj", 1), 6).alias("diff")
    )
    return out.where("earlier is not null and later is not null and diff is not null")


def rolling_moments(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation, variance and covariance with volume change over 30 rows, at least 20 present."""
    r = cat(spark, d).returns("log").withColumn("lv", P.log_positive("volume"))
    out = r.select(
        "ticker", label(), P.guarded(F.avg("ret"), "ret", 30, 20).alias("mean"), P.guarded(F.stddev_samp("ret"), "ret", 30, 20).alias("sd"),
        P.guarded(F.var_samp("ret"), "ret", 30, 20).alias("var"),
        P.guarded(F.covar_samp("ret", "lv"), F.when(F.col("lv").isNotNull(), F.col("ret")), 30, 20).alias("cov")
    )
    return out.where("mean is not null").select("ticker", "obs_day", *(rounded(c, 7) for c in ("mean", "sd", "var", "cov")))


def running_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Running product of gross returns and running maximum of price."""
    w = P.by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    r = cat(spark, d).returns("simple")
    return r.select("ticker", label(), (F.round(F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w), 6) + 0.0).alias("growth"), F.max("adj").over(w).alias("peak"))


def top_names(spark: SparkSession, d: str) -> DataFrame:
    """The three names with the greatest dollar volume of each day: a top-k report."""
    p = cat(spark, d).panel.withColumn("dollars", P.dollar_volume()).where("dollars is not null")
    k = F.row_number().over(Window.partitionBy("pos").orderBy(F.col("dollars").desc(), "ticker"))
    return p.withColumn("place", k).where("place <= 3").select("ticker", label(), "place", "dollars")


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of usable values per field, interpolated."""
    from gridloom.operators.readings import usable

    q = usable(table(spark, d, "fundamentals")).select("ticker", "field", "t", "value", "period_end", "fact_id").distinct().groupBy("field").agg(
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    )
    return q.select("field", *(F.round(F.col("q")[i], 4).alias(f"q{n}") for i, n in enumerate((25, 50, 75))))


def moments(spark: SparkSession, d: str) -> DataFrame:
    """Bias-corrected skewness and kurtosis of returns per ticker."""
    g = cat(spark, d).returns("log").groupBy("ticker").agg(F.count("ret").alias("n"), F.skewness("ret").alias("a"), F.kurtosis("ret").alias("b"))
    return g.where("n > 3").select(
        "ticker", "n", F.round(bias_corrected_skewness(F.col("a"), F.col("n")), 6).alias("skew"),
        F.round(bias_corrected_kurtosis(F.col("b"), F.col("n")), 5).alias("kurtosis")
    )


def correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of returns with the market per ticker."""
    c = cat(spark, d)
    j = c.returns("log").join(F.broadcast(c.market), "day")
    return j.groupBy("ticker").agg(F.round(safe_corr("ret", "market"), 6).alias("corr")).where("corr is not null")


def gram_sums(spark: SparkSession, d: str) -> DataFrame:
    """Entries of X'X and X'y for y on [1, x] per ticker: what a regression needs, without its rows."""
    c = cat(spark, d)
    j = c.returns("log").join(F.broadcast(c.market), "day").where("ret is not null and market is not null")
    x, y = F.col("market"), F.col("ret")
    return j.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), *(F.round(F.sum(v), 7).alias(a) for v, a in ((x, "sx"), (x * x, "sxx"), (y, "sy"), (x * y, "sxy")))
    )


def last_of_month(spark: SparkSession, d: str) -> DataFrame:
    """Each ticker's last price of each calendar month."""
    p = cat(spark, d).panel.where("adj is not null")
    return p.groupBy("ticker", F.date_format(F.date_from_unix_date("day"), "yyyy-MM").alias("month")).agg(F.max_by("adj", "day").alias("last"))


def wide_months(spark: SparkSession, d: str) -> DataFrame:
    """Bars per ticker with one column per quarter of the year (pivot)."""
    p = cat(spark, d).panel.where("close is not null").withColumn("q", F.concat(F.lit("q"), F.quarter(F.date_from_unix_date("day"))))
    return p.groupBy("ticker").pivot("q", ["q1", "q2", "q3", "q4"]).count().na.fill(0)


def long_fields(spark: SparkSession, d: str) -> DataFrame:
    """The wide price columns as rows (unpivot), missing ones left out."""
    p = cat(spark, d).panel.select("ticker", label(), "close", "adj", "volume")
    return p.unpivot(["ticker", "obs_day"], ["close", "adj", "volume"], "measure", "value").where("value is not null")


def sector_by_state(spark: SparkSession, d: str) -> DataFrame:
    """Contingency of sector and membership on a day (crosstab)."""
    c = cat(spark, d)
    now = U.members_on(c.table("membership"), DAY_B).withColumn("member", F.lit(1))
    return c.sectors.join(now, "ticker", "left").groupBy("sector").agg(
        F.count("member").alias("members"), F.count(F.when(F.col("member").isNull(), 1)).alias("others")
    )


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, d, "membership")
    return U.members_on(m, DAY_A), U.members_on(m, DAY_B)


def set_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.union(b).distinct()


def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.intersect(b)


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.subtract(b)


def outer_join(spark: SparkSession, d: str) -> DataFrame:
    """Bars and usable readings per ticker, tickers of either side."""
    from gridloom.operators.readings import usable

    a = cat(spark, d).panel.where("close is not null").groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"))
    b = usable(table(spark, d, "fundamentals")).distinct().groupBy("ticker").agg(F.countDistinct("fact_id").alias("facts"))
    return a.join(b, "ticker", "full").select("ticker", F.coalesce("bars", F.lit(0)).alias("bars"), F.coalesce("facts", F.lit(0)).alias("facts"))


def without_listing(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose issuer has no sector (anti join)."""
    known = table(spark, d, "listings").where("sector is not null").select("cik").distinct()
    return table(spark, d, "documents").select("doc_id", "cik").join(known, "cik", "left_anti").select("doc_id")


def clipped(spark: SparkSession, d: str) -> DataFrame:
    """Returns clipped at 5 %, missing ones as 0, prices filled forward."""
    r = cat(spark, d).returns("log")
    return r.select(
        "ticker", label(), F.round(F.greatest(F.least(F.coalesce("ret", F.lit(0.0)), F.lit(0.05)), F.lit(-0.05)), 8).alias("ret"),
        P.forward_fill(r, "adj").alias("filled")
    )


def json_digests(spark: SparkSession, d: str) -> DataFrame:
    """A field out of the events' JSON and the SHA-1 of the text."""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.sha1(F.col("props").cast("binary")).alias("digest"))


def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and language: texts, blank ones, characters; NULL groups kept."""
    t = table(spark, d, "documents")
    return t.groupBy("source", "lang").agg(
        F.count("text").alias("texts"), F.count(F.when(F.trim("text") == "", 1)).alias("blank"), F.sum("n_chars").alias("chars")
    )


def cubed(spark: SparkSession, d: str) -> DataFrame:
    """Grouping sets over sector and listing year."""
    t = table(spark, d, "listings").distinct().withColumn("year", F.year("listed_on"))
    return t.cube("sector", "year").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def rolling_information(spark: SparkSession, d: str) -> DataFrame:
    """63-row mean of the daily rank correlation, at least 21."""
    ic = E.scored_information(S.scores(cat(spark, d), (21,)), S.LEAST)
    w = Window.partitionBy("factor").orderBy("day").rowsBetween(-62, 0)
    return ic.select("factor", label(), F.when(F.count("ic").over(w) >= 21, F.round(F.avg("ic").over(w), 7)).alias("mean")).where("mean is not null")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"q_{f.__name__}": f for f in (
    shifts, rolling_moments, running_extremes, top_names, quantiles, moments, correlation, gram_sums, last_of_month, wide_months, long_fields, sector_by_state, set_union, set_intersection, set_difference,
    outer_join, without_listing, clipped, json_digests, text_lengths, cubed, rolling_information,
)}

_R30 = _ROLL.format(29)
_A, _B = (S.SQL["q_members"].replace(S.AS_OF, x) for x in (DAY_A, DAY_B))
_MARKET = f"with {_RET}, {S._MKT}, j as (select t.ticker, t.r, m.market from ret t join mkt m on t.day = m.day)"

SQL: dict[str, str] = {
    "q_shifts": f"with {_PANEL}, x as (select ticker, obs_day, lag(adj) over {_W} as earlier, lead(adj) over {_W} as later, round(adj - lag(adj) over {_W}, 6) as diff from panel) select * from x where earlier is not null and later is not null and diff is not null",
    "q_rolling_moments": f"""with {_RET}, v as (select ticker, pos, obs_day, r, case when volume > 0 then ln(volume) end as lv from ret),
x as (select ticker, obs_day, case when count(r) over w >= 20 then avg(r) over w end as mean, case when count(r) over w >= 20 then stddev_samp(r) over w end as sd, case when count(r) over w >= 20 then var_samp(r) over w end as var,
  case when count(case when lv is not null then r end) over w >= 20 then covar_samp(r, lv) over w end as cov from v window w as {_R30})
select ticker, obs_day, round(mean, 7) + 0.0 as mean, round(sd, 7) + 0.0 as sd, round(var, 7) + 0.0 as var, round(cov, 7) + 0.0 as cov from x where mean is not null""",
    "q_running_extremes": f"with {_RET} select ticker, obs_day, round(product(1 + coalesce(r, 0)) over w, 6) + 0.0 as growth, max(adj) over w as peak from sraw window w as (partition by ticker order by pos rows unbounded preceding)",
    "q_top_names": f"with {_PANEL}, x as (select ticker, obs_day, close * volume as dollars, row_number() over (partition by pos order by close * volume desc, ticker) as place from panel where close * volume is not null) select ticker, obs_day, cast(place as integer) as place, dollars from x where place <= 3",
    "q_quantiles": f"with {S._USABLE} select field, round(quantile_cont(value, 0.25), 4) as q25, round(quantile_cont(value, 0.5), 4) as q50, round(quantile_cont(value, 0.75), 4) as q75 from good group by 1",
    "q_moments": f"with {_RET} select ticker, count(r) as n, round(skewness(r), 6) as skew, round(kurtosis(r), 5) as kurtosis from ret group by 1 having count(r) > 3",
    "q_correlation": f"{_MARKET} select ticker, round(covar_samp(r, market) / (stddev_samp(r) * stddev_samp(market)), 6) as corr from j where r is not null and market is not null group by 1 having count(*) > 1 and stddev_samp(r) > 0",
    "q_gram_sums": f"{_MARKET} select ticker, count(*) as n, round(sum(market), 7) as sx, round(sum(market * market), 7) as sxx, round(sum(r), 7) as sy, round(sum(market * r), 7) as sxy from j where r is not null and market is not null group by 1",
    "q_last_of_month": f"with {_PANEL} select ticker, strftime(day, '%Y-%m') as month, arg_max(adj, day) as last from panel where adj is not null group by 1, 2",
    "q_wide_months": f"with {_PANEL} select ticker, " + ", ".join(f"count(*) filter (quarter(day) = {q}) as q{q}" for q in (1, 2, 3, 4)) + " from panel where close is not null group by 1",
    "q_long_fields": f"with {_PANEL}, x as (select ticker, obs_day, 'close' as measure, close as value from panel union all select ticker, obs_day, 'adj', adj from panel union all select ticker, obs_day, 'volume', volume from panel) select * from x where value is not null",
    "q_sector_by_state": f"with sec as (select {S._TICKER.format('')} as ticker, min(sector) as sector from listings where sector is not null group by 1), m as ({_B}) select sector, count(m.ticker) as members, count(*) - count(m.ticker) as others from sec left join m on sec.ticker = m.ticker group by 1",
    "q_set_union": f"({_A}) union ({_B})",
    "q_set_intersection": f"({_A}) intersect ({_B})",
    "q_set_difference": f"({_A}) except ({_B})",
    "q_outer_join": f"with {S._USABLE}, {_PANEL}, a as (select ticker, count(*) as bars from panel where close is not null group by 1), b as (select ticker, count(distinct fact_id) as facts from good group by 1) select coalesce(a.ticker, b.ticker) as ticker, coalesce(bars, 0) as bars, coalesce(facts, 0) as facts from a full join b on a.ticker = b.ticker",
    "q_without_listing": "select doc_id from documents d where not exists (select 1 from listings l where l.sector is not null and l.cik = d.cik)",
    "q_clipped": f"with {_RET} select ticker, obs_day, round(greatest(least(coalesce(r, 0), 0.05::double), -0.05::double), 8) as ret, last_value(adj ignore nulls) over (partition by ticker order by pos rows unbounded preceding) as filled from ret",
    "q_json_digests": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, sha1(props) as digest from events",
    "q_text_lengths": "select source, lang, count(text) as texts, count(*) filter (trim(text) = '') as blank, cast(sum(n_chars) as bigint) as chars from documents group by 1, 2",
    "q_cubed": "select sector, cast(year as integer) as year, count(*) as n, cast(grouping(sector, year) as bigint) as level from (select *, year(listed_on) as year from (select distinct * from listings)) group by cube (sector, year)",
    "q_rolling_information": f"{S._SIG}, {S._ic((21,))}, x as (select factor, obs_day, case when count(ic) over w >= 21 then round(avg(ic) over w, 7) end as mean from ic window w as (partition by factor order by day rows between 62 preceding and current row)) select * from x where mean is not null",
}
