"""Queries of readers, filings, ledgers, event windows and streams over the given tables, and their SQL.

Filed documents are made from the given tables first (one JSON text per row), so that the readers have real input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.engine.session import ensure_checkpoint_dir
from gridloom.operators import audit as A
from gridloom.operators import backtest as B
from gridloom.operators import evaluate as E
from gridloom.operators import factors as X
from gridloom.operators import graphs as G
from gridloom.operators import metrics as M
from gridloom.operators import panel as P
from gridloom.operators import universe as U
from gridloom.operators.bars import valid_bars
from gridloom.operators.columns import day_label, day_of, symbol
from gridloom.operators.readings import usable
from gridloom.plans import portfolios as Q
from gridloom.plans import signals as S
from gridloom.plans import study as T
from gridloom.plans.problems import _BARS, _PERIODS, _TICKER, _USABLE
from gridloom.plans.signals import AS_OF, cat, label, rounded
from gridloom.plans.studies import SQL as _STUDIES
from gridloom.sources import filings as L
from gridloom.sources import tables as R
from gridloom.sources.stored import is_stale
from gridloom.sources.tables import table
from gridloom.streaming import flows as W


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _entries(spark: SparkSession, d: str, field: str) -> DataFrame:
    """ticker and the filed entry (period end, value, filing day) of a field's usable readings."""
    rows = usable(table(spark, d, "fundamentals"), [field]).where("period_end is not null")
    iso = lambda c: F.date_format(F.date_from_unix_date(day_of(F.col(c))), "yyyy-MM-dd")
    return rows.select("ticker", F.struct(
        iso("period_end").alias("end"), F.col("value").alias("val"), iso("t").alias("filed"), F.col("fact_id").cast("string").alias("accn"), F.lit("FY").alias("fp")
    ).alias("e"))


def _document(rows: DataFrame, space: str, concept: str, unit: str) -> DataFrame:
    """ticker, json: one company-facts text per entry."""
    units = F.struct(F.create_map(F.lit(unit), F.array("e")).alias("units"))
    return rows.select("ticker", F.to_json(F.struct(F.create_map(F.lit(space), F.create_map(F.lit(concept), units)).alias("facts"))).alias("json"))


def filed_facts(spark: SparkSession, d: str) -> DataFrame:
    """Fundamentals as filed documents and back: of each figure the first time it was public."""
    raw = None
    for field, concept in (("book_equity", "StockholdersEquity"), ("total_assets", "Assets"), ("gross_profit", "GrossProfit")):
        one = _document(_entries(spark, d, field), "us-gaap", concept, "USD")
        raw = one if raw is None else raw.union(one)
    raw = raw.union(raw.sparkSession.createDataFrame([("BAD", "{not json")], "ticker string, json string"))
    f = L.facts_table(raw)
    return f.select("ticker", "field", F.date_format("available_date", "yyyy-MM-dd").alias("filed"), F.bround("value", 2).alias("value"), "period_end")


def filed_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares outstanding as filed documents and back."""
    s = L.shares_table(_document(_entries(spark, d, "shares_outstanding"), "dei", "EntityCommonStockSharesOutstanding", "shares"))
    return s.select("ticker", F.date_format("available_date", "yyyy-MM-dd").alias("filed"), "shares")


def annual_reports(spark: SparkSession, d: str) -> DataFrame:
    """The documents as filing indexes and back: annual reports with a document."""
    docs = table(spark, d, "documents").where("ticker is not null")
    one = lambda c: F.array(F.col(c) if isinstance(c, str) else c)
    recent = F.struct(
        one(F.when(F.col("source") == "tenk_item1", "10-K").otherwise("8-K")).alias("form"), one(F.coalesce(F.date_format("filed_at", "yyyy-MM-dd"), F.lit(""))).alias("filingDate"),
        one(F.concat(F.lit("0001-24-"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))).alias("accessionNumber"), one(F.when(F.col("n_chars") > 0, "main.htm").otherwise("")).alias("primaryDocument"),
    )
    raw = docs.select(symbol("ticker").alias("ticker"), F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return L.annual_reports(raw).select("ticker", F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"), "accession", "document")


def factor_file(spark: SparkSession, d: str) -> DataFrame:
    """Daily highs of the prices as a factor file in percent and back; every seventh day's second column is missing there."""
    days = valid_bars(table(spark, d, "prices"), {"close": "close", "volume": "volume"}).groupBy("day").agg(
        F.round(F.max("close"), 2).alias("a"), F.count(F.lit(1)).alias("n")
    ).where("a is not null")
    line = F.concat_ws(
        ",", F.date_format(F.date_from_unix_date("day"), "yyyyMMdd"), F.format_string("%.2f", "a"),
        F.when(F.col("day") % 7 == 0, "-99.99").otherwise(F.format_string("%d.00", "n"))
    )
    head = spark.createDataFrame([("This file was made for a test",), (",Mkt-RF,SMB",), ("19,1",)], "value string")
    f = L.factor_file(head.union(days.select(line.alias("value"))))
    return f.select(F.date_format("date", "yyyy-MM-dd").alias("obs_day"), rounded("mkt_rf"), rounded("smb"))


def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    """Members' ids where the id list spells classes with a dot."""
    ids = table(spark, d, "listings").select(F.translate("ticker", "-", ".").alias("ticker"), "cik")
    return L.resolve_ids(U.all_tickers(table(spark, d, "membership")), ids)


def renamed(spark: SparkSession, d: str) -> DataFrame:
    """Members whose class B shares count as the plain ticker: the rename list is made from the listings."""
    names = [r[0] for r in table(spark, d, "listings").select(symbol("ticker").alias("t")).where("t like '%-B'").distinct().collect()]
    return U.resolve_renames(U.all_tickers(table(spark, d, "membership")), {n: n[:-2] for n in names})


def _ledger(spark: SparkSession) -> DataFrame:
    """Every registered configuration logged twice, failing first, and one that is not registered."""
    g = T.grid_table(spark)
    at = lambda s: F.to_timestamp(F.lit(s))
    passes = F.when(F.col("config_id") < "8", "pass").otherwise("fail")
    rows = [g.select("config_id", "feature_class", "feature", F.lit(x).alias("status") if isinstance(x, str) else x.alias("status"), at(s).alias("logged_at")) for x, s in (("fail", "2024-01-01"), (passes, "2024-01-02"))]
    odd = g.limit(1).select(F.lit("unregistered").alias("config_id"), F.lit("text").alias("feature_class"), F.lit("x").alias("feature"), F.lit("pass").alias("status"), at("2024-01-03").alias("logged_at"))
    return rows[0].union(rows[1]).union(odd)


def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.ledger_summary(_ledger(spark))


def unregistered_trials(spark: SparkSession, d: str) -> DataFrame:
    return T.unregistered(_ledger(spark), T.grid_table(spark))


def _windows(df: DataFrame, *keys: str) -> DataFrame:
    start, end = (F.date_format(f"window.{c}", "yyyy-MM-dd HH:mm:ss").alias(f"w_{c}") for c in ("start", "end"))
    return df.select(start, end, *keys, "n", *([F.round("total", 4).alias("total")] if "total" in df.columns else []))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts and totals per type of event."""
    return _windows(W.windowed_totals(table(spark, d, "events"), "ts", ["event_type"], "value", "1 hour"), "event_type")


def event_slides(spark: SparkSession, d: str) -> DataFrame:
    """The same over two hours, every half hour."""
    return _windows(W.windowed_totals(table(spark, d, "events"), "ts", ["event_type"], "value", "2 hours", "30 minutes"), "event_type")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, ended by four hours without an event."""
    s = W.sessions(table(spark, d, "events"), "ts", ["user_id"], "4 hours").withColumnRenamed("session_window", "window")
    return _windows(s, "user_id")


def streamed_periods(spark: SparkSession, d: str) -> DataFrame:
    """p6 by the stream: membership rows through interval maps in keyed state, the periods and gaps of their last versions."""
    own = spark.newSession()  # a stream's state has as many partitions as it starts with, whatever the data
    own.conf.set("spark.sql.shuffle.partitions", str(max(2, spark.sparkContext.defaultParallelism)))
    log = work_folder(spark, "periods")
    arrived = own.read.parquet(f"{d}/membership.parquet").repartition(3)
    arrived.write.parquet(f"{log}/in")  # in three files, one a micro-batch: a ticker's rows come late and out of order
    rows = own.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 1).parquet(f"{log}/in")
    sink = W.batch_log(f"{log}/rows", ["ticker", "kind", "from_day", "to_day", "version"])
    query = W.live_periods(rows).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{log}/state").foreachBatch(sink).start()
    query.awaitTermination()
    found = W.latest_periods(W.read_log(spark, f"{log}/rows", W.PERIODS))
    day = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd").alias(c)
    return found.select("ticker", "kind", day("from_day"), day("to_day"))


def formats(spark: SparkSession, d: str) -> DataFrame:
    """The nations written in every tabular format and read back."""
    nation, folder, out = table(spark, d, "nation"), work_folder(spark, "formats"), None
    for kind in ("parquet", "orc", "csv", "json"):
        R.write(nation, f"{folder}/{kind}", kind)
        one = R.read(spark, f"{folder}/{kind}", kind, "n_nationkey int, n_name string, n_regionkey int").select(F.lit(kind).alias("kind"), "n_nationkey", "n_name", "n_regionkey")
        out = one if out is None else out.union(one)
    return out


def priced_files(spark: SparkSession, d: str) -> DataFrame:
    """All valid bars in three price files that spell their columns differently, and back."""
    folder = work_folder(spark, "prices")
    rows = valid_bars(table(spark, d, "prices"), {"close": "close", "volume": "volume"}).select(
        F.date_from_unix_date("day").alias("date"), "close", "volume", F.col("ticker").alias("symbol"), F.pmod(F.xxhash64("ticker"), F.lit(3)).alias("part")
    )
    for i in range(3):
        one = rows.where(F.col("part") == i).drop("part")
        one = one.toDF(*(c.title() for c in one.columns)) if i else one
        one.write.parquet(f"{folder}/FILE {i}.parquet")
    f = R.price_files(spark, folder, ("close", "volume", "symbol")).where("ticker in ('FILE 0', 'FILE 1', 'FILE 2')")
    return f.groupBy(F.col("symbol").alias("ticker")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 2).alias("volume"))


def weights_without_hard_shorts(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    flags = B.hard_to_borrow(c.market_cap(), B.average_dollar_volume(c.panel), 0.5)
    return B.without_hard_shorts(B.weights(Q.signal(c), "equal", Q.BUCKETS), flags).select("pos", "ticker", rounded("weight"))


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Performance of the simulated book and of the market on its days."""
    c = cat(spark, d)
    r = Q.run(c).stored().daily.select(F.lit("gross").alias("series"), "day", "ret")
    p = M.benchmark_table(r, c.market)
    return p.select("series", "n", *(rounded(x, 6) for x in p.columns[2:]))


def average_turnover(spark: SparkSession, d: str) -> DataFrame:
    return M.average_turnover(Q.run(cat(spark, d)).daily).select(rounded("avg_turnover"), "n_rebalances")


def top_turnover(spark: SparkSession, d: str) -> DataFrame:
    return E.turnover(S.sided(cat(spark, d)), (1,)).select("factor", label(), rounded("turnover"))


def split_days(spark: SparkSession, d: str) -> DataFrame:
    c = cat(spark, d)
    day = c.days.where(F.col("day") <= F.unix_date(F.lit(AS_OF).cast("date"))).agg(F.max("day")).first()[0] or 0
    before, after = B.split_days(c.days, day)
    return before.select(label(), F.lit("train").alias("part")).union(after.select(label(), F.lit("test").alias("part")))


def total_return_check(spark: SparkSession, d: str) -> DataFrame:
    return A.total_return_check(P.average_index(cat(spark, d).panel)).select("n", rounded("annualised", 6), "passed")


def open_prices(spark: SparkSession, d: str) -> DataFrame:
    return P.price_panel(table(spark, d, "prices"), fields=("open", "high", "low")).where("open is not null").select("ticker", label(), "open", "high", "low")


def shares_long(spark: SparkSession, d: str) -> DataFrame:
    """The greatest reading of shares per ticker and day; never wide in between, as tickers grow with the table and a column each does not."""
    f = usable(table(spark, d, "fundamentals"), ["shares_outstanding"]).groupBy(day_of("t").alias("day"), "ticker").agg(F.max("value").alias("shares"))
    return f.select(day_label(F.col("day")).alias("available_date"), "ticker", "shares")


def lowest_volumes(spark: SparkSession, d: str) -> DataFrame:
    """The hundred bars with the least volume, missing ones first: a top-k, not a sample."""
    b = valid_bars(table(spark, d, "prices"), {"close": "close", "adj": "adj close", "volume": "volume"})
    return b.orderBy(F.col("volume").asc_nulls_first(), "ticker", "day").limit(100).select("ticker", label(), "volume")


def sector_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the sectors with groups by the year of listing, per first letter of the ticker."""
    own = table(spark, d, "listings").where("listed_on is not null").select(symbol("ticker").alias("ticker"), F.year("listed_on").alias("year"))
    nodes = own.groupBy("ticker").agg(F.min("year").alias("community")).select(F.substring("ticker", 1, 1).alias("snap"), "ticker", "community")
    return G.cluster_sector_table(nodes, cat(spark, d).sectors)[1].select("snap", "n", rounded("adjusted_rand", 6))


def stored_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel written once and read back."""
    c = cat(spark, d)
    folder = work_folder(spark, "panel")
    if not is_stale(c.table("prices"), folder, "panel-0"):
        raise AssertionError("nothing is stored yet")
    c.stored_panel(folder)
    if is_stale(c.table("prices"), folder, "panel-0"):
        raise AssertionError("the panel was not stored")
    return cat(spark, d).stored_panel(folder).select("ticker", label(), "close", "adj", "volume")


def momentum_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Momentum of the members on one day."""
    c = cat(spark, d)
    members = U.members_on(c.table("membership"), AS_OF)
    return X.momentum_on(c, (date.fromisoformat(AS_OF) - date(1970, 1, 1)).days, members=members).select("ticker", rounded("value", 6))


def information_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlations of momentum as a function of the day, on the last two calendar days of June 2018 and before any history."""
    days = [(date.fromisoformat(x) - date(1970, 1, 1)).days for x in ("1980-01-01", "2018-06-28", "2018-06-29")]
    ic = E.information_by_day(cat(spark, d), X.momentum_on, days, "momentum", S.HORIZONS, 5, False)
    return ic.select("factor", "horizon", label(), rounded("ic", 7), "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"q_{f.__name__}": f for f in (
    filed_facts, filed_shares, annual_reports, factor_file, resolved_ids, renamed, ledger_summary, unregistered_trials, event_windows, event_slides, event_sessions, streamed_periods, formats, priced_files,
    weights_without_hard_shorts, benchmark, average_turnover, top_turnover, split_days, total_return_check, open_prices, shares_long, lowest_volumes, sector_agreement, stored_panel, momentum_as_of, information_by_day,
)}

_FILED = f"""rows as (select ticker, field, cast(t as date) as day, cast(period_end as date) as pe, value from good where period_end is not null)"""
_LEDGER = f"log as (select config_id, feature_class, case when config_id < '8' then 'pass' else 'fail' end as status from ({_STUDIES['q_grid']}) union all select 'unregistered', 'text', 'pass')"


def _event_windows(width: int, slide: int) -> str:
    """Totals of windows of so many minutes that begin at every multiple of slide."""
    n = width // slide
    return f"""with w as (select time_bucket(interval {slide} minute, ts, timestamp '1970-01-01') - to_minutes(cast({slide} * unnest(range({n})) as integer)) as s, ts, event_type, value from events)
select strftime(s, '%Y-%m-%d %H:%M:%S') as w_start, strftime(s + interval {width} minute, '%Y-%m-%d %H:%M:%S') as w_end, event_type, count(*) as n, round(sum(value), 4) as total from w group by s, event_type"""


_PERFORMANCE = """e as (select *, product(1 + coalesce(ret, 0)) over w as eq from series window w as (partition by series order by day rows unbounded preceding)),
dd as (select *, eq / max(eq) over (partition by series order by day rows unbounded preceding) - 1 as dd from e), q as (select series, quantile_cont(dd, 0.05) as q from dd group by 1),
a as (select dd.series, count(ret) as n, arg_max(eq, day) as fin, avg(ret) as mean, stddev_samp(ret) as sd, sqrt(avg(power(least(ret, 0), 2)) filter (ret is not null)) as down, abs(min(dd)) as mdd, -avg(dd) filter (dd <= q) as cdd,
  avg(case when ret > 0 then 1.0 when ret is not null then 0.0 end) as hit, coalesce(sum(ret) filter (ret > 0), 0) as gain, coalesce(-sum(ret) filter (ret < 0), 0) as loss from dd join q on dd.series = q.series group by 1)
select series, n, round(fin - 1, 6) + 0.0 as total_return, round(power(fin, 252.0 / n) - 1, 6) + 0.0 as cagr, round(sd * sqrt(252), 6) + 0.0 as ann_vol, round(mean / sd * sqrt(252), 6) + 0.0 as sharpe, round(mean / down * sqrt(252), 6) + 0.0 as sortino,
  round(mdd, 6) + 0.0 as max_drawdown, round((power(fin, 252.0 / n) - 1) / mdd, 6) + 0.0 as calmar, round(cdd, 6) + 0.0 as conditional_drawdown, round(hit, 6) + 0.0 as hit_rate, round(gain / loss, 6) + 0.0 as profit_factor from a"""

SQL: dict[str, str] = {
    "q_filed_facts": f"""with {_USABLE}, {_FILED} select ticker, field, strftime(day, '%Y-%m-%d') as filed, round_even(value, 2) as value, strftime(pe, '%Y-%m-%d') as period_end from (
select *, row_number() over (partition by ticker, field, pe, round_even(value, 2) order by day, value) as k from rows where field in ('book_equity', 'total_assets', 'gross_profit')) where k = 1""",
    "q_filed_shares": f"""with {_USABLE}, {_FILED}, f as (select * from (select *, row_number() over (partition by ticker, pe, round_even(value, 2) order by day, value) as k from rows where field = 'shares_outstanding') where k = 1)
select ticker, strftime(day, '%Y-%m-%d') as filed, value as shares from (select *, row_number() over (partition by ticker, day order by pe desc, value desc) as n from f) where n = 1""",
    "q_annual_reports": f"select {_TICKER.format('')} as ticker, strftime(filed_at, '%Y-%m-%d') as filing_date, '000124' || lpad(cast(doc_id as varchar), 9, '0') as accession, 'main.htm' as document from documents where ticker is not null and source = 'tenk_item1' and n_chars > 0",
    "q_factor_file": f"""with {_BARS}, d as (select day, round(max(close), 2) as a, count(*) as n from bars group by 1)
select strftime(day, '%Y-%m-%d') as obs_day, round(a / 100, 8) + 0.0 as mkt_rf, case when date_diff('day', date '1970-01-01', day) % 7 <> 0 then round(n / 100, 8) + 0.0 end as smb from d where a is not null""",
    "q_resolved_ids": f"""with m as ({S.SQL['q_all_members']}), ids as (select replace(ticker, '-', '.') as t, min(cik) as cik from listings group by 1)
select m.ticker, coalesce(a.cik, b.cik, c.cik) as cik from m left join ids a on a.t = m.ticker left join ids b on b.t = replace(m.ticker, '-', '.') left join ids c on c.t = replace(m.ticker, '-', '')""",
    "q_renamed": f"""with m as ({S.SQL['q_all_members']}) select ticker, case when ticker like '%-B' and ticker in (select {_TICKER.format('')} from listings) then left(ticker, length(ticker) - 2) else ticker end as resolved from m""",
    "q_ledger_summary": f"with {_LEDGER} select feature_class, count(*) filter (status = 'pass') as pass, count(*) filter (status = 'fail') as fail, count(*) as total from log group by 1",
    "q_unregistered_trials": f"with {_LEDGER} select config_id from log where config_id not in (select config_id from ({_STUDIES['q_grid']}))",
    "q_event_windows": _event_windows(60, 60),
    "q_event_slides": _event_windows(120, 30),
    "q_event_sessions": """with g as (select *, case when ts < lag(ts) over w + interval 4 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as w_start, strftime(max(ts) + interval 4 hour, '%Y-%m-%d %H:%M:%S') as w_end, user_id, count(*) as n from s group by user_id, k""",
    "q_streamed_periods": _PERIODS,
    "q_formats": "select k.kind, n_nationkey, n_name, n_regionkey from nation, (select unnest(['parquet', 'orc', 'csv', 'json']) as kind) k",
    "q_priced_files": f"with {_BARS} select ticker, count(*) as n, round(sum(volume), 2) as volume from bars group by 1",
    "q_weights_without_hard_shorts": f"""with {_USABLE}, {Q._EQUAL}, {S._known('shares_outstanding', 'shs')}, {Q._ADV},
hr as (select c.ticker, c.pos, c.close * c.known as cap, a.adv from shs c join adv a on c.ticker = a.ticker and c.pos = a.pos), hq as (select pos, quantile_cont(cap, 0.5) as qc, quantile_cont(adv, 0.5) as qa from hr group by 1),
hard as (select hr.ticker, hr.pos from hr join hq on hr.pos = hq.pos where cap <= qc and adv <= qa)
select t.pos, t.ticker, round(case when weight < 0 and h.ticker is not null then 0 else weight end, 8) + 0.0 as weight from tgt t left join hard h on h.ticker = t.ticker and h.pos = t.pos""",
    "q_benchmark": f"""with {Q._RUN}, {S._MKT}, series as (select 'gross' as series, day, ret from daily union all select 'market', daily.day, exp(market) - 1 from daily left join mkt on mkt.day = daily.day), {_PERFORMANCE}""",
    "q_average_turnover": f"with {Q._RUN} select round(avg(turnover) filter (turnover > 0), 8) + 0.0 as avg_turnover, count(*) filter (turnover > 0) as n_rebalances from daily",
    "q_top_turnover": f"{S._SIDED}, {S._TURN.replace('where side <> 0', 'where side = 1')} select factor, obs_day, round(turnover, 8) + 0.0 as turnover from turn",
    "q_split_days": f"with {S._PANEL}, l as (select max(day) as d from cal where day <= date '{AS_OF}') select strftime(day, '%Y-%m-%d') as obs_day, case when day < coalesce(d, date '1970-01-01') then 'train' else 'test' end as part from cal, l",
    "q_total_return_check": f"""with {S._PANEL}, i as (select day, avg(adj) as adj from panel group by 1 having avg(adj) is not null), a as (select count(*) as n, arg_min(adj, day) as a, arg_max(adj, day) as b, date_diff('day', min(day), max(day)) / 365.25 as y from i)
select n, round(power(b / a, 1.0 / y) - 1, 6) + 0.0 as annualised, n >= 100 and power(b / a, 1.0 / y) - 1 between 0.02 and 0.20 as passed from a""",
    "q_open_prices": f"""with r as (select {_TICKER.format('')} as ticker, cast(date as date) as day, case when not isnan(open) then open end as open, case when not isnan(high) then high end as high, case when not isnan(low) then low end as low, loaded_at from prices)
select ticker, strftime(day, '%Y-%m-%d') as obs_day, open, high, low from (select *, row_number() over (partition by ticker, day order by loaded_at desc nulls last, open desc nulls last, high desc nulls last, low desc nulls last) as k from r where ticker is not null and day is not null) where k = 1 and open is not null""",
    "q_shares_long": f"with {_USABLE} select ticker, strftime(cast(t as date), '%Y-%m-%d') as available_date, max(value) as shares from good where field = 'shares_outstanding' group by ticker, cast(t as date)",
    "q_stored_panel": f"with {S._PANEL} select ticker, obs_day, close, adj, volume from panel",
    "q_momentum_as_of": f"with x as ({S.SQL['q_factor_momentum_12_1']}), {S._PANEL} select ticker, value from x where obs_day = (select strftime(max(day), '%Y-%m-%d') from cal where day <= date '{AS_OF}') and ticker in ({S.SQL['q_members']})",
    "q_information_by_day": f"""with {S._PANEL}, sig as (select 'momentum' as factor, ticker, pos, day, obs_day, lag(lp, 21) over {S._W} - lag(lp, 252) over {S._W} as value from panel),
{S._ic(S.HORIZONS, 5, "and s.obs_day in ('2018-06-28', '2018-06-29')")} select factor, horizon, obs_day, round(ic, 7) + 0.0 as ic, n from ic""",
    "q_lowest_volumes": f"with {_BARS} select ticker, strftime(day, '%Y-%m-%d') as obs_day, volume from bars order by volume nulls first, ticker, day limit 100",
    "q_sector_agreement": f"""with {Q._SECTORS}, l as (select {_TICKER.format('')} as ticker, min(year(listed_on)) as y from listings where listed_on is not null group by 1), x as (select left(l.ticker, 1) as snap, y, sector from l join sec on l.ticker = sec.ticker where l.ticker is not null),
c as (select snap, y, sector, count(*) as n from x group by all), a as (select snap, sum(n * (n - 1) / 2) as p, sum(n) as n from c group by 1),
r as (select snap, sum(n * (n - 1) / 2) as r from (select snap, y, sum(n) as n from c group by 1, 2) group by 1), k as (select snap, sum(n * (n - 1) / 2) as k from (select snap, sector, sum(n) as n from c group by 1, 2) group by 1),
j as (select a.snap, p, cast(n as bigint) as n, r, k, coalesce(r * k / nullif(n * (n - 1) / 2, 0), 0) as ex, (r + k) / 2 as most from a join r on a.snap = r.snap join k on a.snap = k.snap)
select snap, n, round(case when most = ex then 1 else (p - ex) / (most - ex) end, 6) + 0.0 as adjusted_rand from j""",
}
