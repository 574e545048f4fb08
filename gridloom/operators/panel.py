"""Panels: long tables of ticker, calendar position and values, dense over each ticker's life.

The calendar is the ordered set of all dates with a bar. A ticker has one row for each calendar position from its first to
its last bar (plus ``tail`` positions), so "k rows earlier" means k calendar rows for every ticker. A ticker has at most
one row per calendar day, so windows over one ticker are bounded by the length of the calendar.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.bars import valid_bars
from gridloom.operators.columns import day_number, day_of, named, pick

FIELDS = {"open": "open", "high": "high", "low": "low", "close": "close", "adj": "adj close", "volume": "volume"}


def by_ticker():
    return Window.partitionBy("ticker").orderBy("pos")


def calendar(days: DataFrame) -> DataFrame:
    """day, pos (0, 1, ...) of the distinct days, as a small local table.

    A calendar has one row per day, whatever the number of bars (36,525 a century), so it is read once, kept by the driver
    and broadcast where it is joined.
    """
    found = sorted(r["day"] for r in days.select("day").where("day is not null").distinct().collect())
    columns = {"day": pa.array(found, pa.int32()), "pos": pa.array(range(len(found)), pa.int32())}
    out = days.sparkSession.createDataFrame(pa.table(columns))  # a local relation: reading it takes no job
    out._last_pos = len(found) - 1
    return out


def last_pos(days: DataFrame) -> int:
    """Greatest pos of a calendar, 0 for an empty one."""
    known = getattr(days, "_last_pos", None)
    return max(known, 0) if known is not None else days.agg(F.max("pos").alias("p")).first()["p"] or 0


def trading_days(prices: DataFrame) -> DataFrame:
    """The calendar of a price table: all days with a row that names a ticker. Reads two columns."""
    rows = pick(prices, {"date": "date", "ticker": "ticker"}).where(named("ticker"))
    return calendar(rows.select(day_number("date").alias("day")))


def price_panel(prices: DataFrame, tail: int = 0, fields: tuple[str, ...] = ("close", "adj", "volume"), days: DataFrame | None = None) -> DataFrame:
    """ticker, pos, day and the fields (NULL on days without a bar); NaN is NULL; valid bars only. ``days``: the table's trading_days(), if known."""
    days = trading_days(prices) if days is None else days
    placed = valid_bars(prices, {f: FIELDS[f] for f in fields}).join(F.broadcast(days), "day").select("ticker", "pos", *fields)
    return dense(placed, days, list(fields), tail)


def dense(placed: DataFrame, days: DataFrame, fields: list[str], tail: int = 0) -> DataFrame:
    """Rows (ticker, pos, fields) with every calendar position of a ticker's life: each row unfolds into itself and the empty rows up to the next one.

    One exchange by ticker, which the windows over tickers that follow share.
    """
    end = last_pos(days)
    following = F.lead("pos").over(by_ticker())
    upto = F.coalesce(following - 1, F.least(F.col("pos") + tail, F.lit(end)))
    rows = placed.withColumn("_own", F.col("pos")).withColumn("_to", upto)
    rows = rows.select("ticker", "_own", *fields, F.explode(F.sequence("pos", "_to")).alias("pos"))
    full = rows.select("ticker", "pos", *(F.when(F.col("pos") == F.col("_own"), F.col(f)).alias(f) for f in fields))
    return full.join(F.broadcast(days), "pos").select("ticker", "pos", "day", *fields)


def lagged(c: Column | str, k: int) -> Column:
    """Value k calendar rows earlier (later if negative) of the same ticker."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lag(c, k).over(by_ticker()) if k >= 0 else F.lead(c, -k).over(by_ticker())


def trailing(n: int):
    return by_ticker().rowsBetween(-(n - 1), 0)


def guarded(aggregate: Column, counted: Column | str, n: int, least: int) -> Column:
    """A window aggregate over the last n calendar rows where at least ``least`` of ``counted`` are present, else NULL."""
    return F.when(F.count(counted).over(trailing(n)) >= least, aggregate.over(trailing(n)))


def log_positive(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.ln(F.when(c > 0, c))


def returns(panel: DataFrame, kind: str = "log", price: str = "adj", pad_gaps: bool = False) -> DataFrame:
    """panel with ``ret``. log: ln p - ln p one row earlier; simple: p / p one row earlier - 1. ``pad_gaps`` fills prices forward first."""
    p = F.last(price, ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)) if pad_gaps else F.col(price)
    rows = panel.withColumn("_p", p)
    if kind == "log":
        out = rows.withColumn("ret", log_positive("_p") - lagged(log_positive("_p"), 1))
    elif kind == "simple":
        out = rows.withColumn("ret", F.try_divide(F.col("_p"), lagged("_p", 1)) - 1)
    else:
        raise ValueError(f"unknown kind of return {kind!r}")
    return out.drop("_p")


def dollar_volume(close: str = "close", volume: str = "volume") -> Column:
    """Raw close times raw volume."""
    return F.col(close) * F.col(volume)


def cross_section(panel: DataFrame, day: int, field: str = "close", members: DataFrame | None = None) -> DataFrame:
    """ticker, value on one day; members (ticker) restricts it. A day that is not in the panel raises KeyError."""
    rows = panel.where(F.col("day") == day)
    if not rows.take(1):
        raise KeyError(f"day {day} is not in the calendar")
    out = rows.select("ticker", F.col(field).alias("value")).where("value is not null")
    return out if members is None else out.join(members.select("ticker").distinct(), "ticker", "left_semi")


def market_return(index: DataFrame, days: DataFrame, price: str = "adj") -> DataFrame:
    """day, market: log return of an index on its own calendar, then looked up on ``days``. index: day, price."""
    own = index.where(F.col(price) > 0).select("day", (F.ln(price) - F.lag(F.ln(price)).over(Window.orderBy("day"))).alias("market"))
    return days.select("day").join(own, "day", "left")


def average_index(panel: DataFrame, price: str = "adj") -> DataFrame:
    """day, adj: mean price of all tickers, a stand-in where no index series is given."""
    return panel.groupBy("day").agg(F.avg(price).alias("adj")).where("adj is not null")


def forward_fill(panel: DataFrame, column: str) -> Column:
    return F.last(column, ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))


def facts_on_calendar(panel: DataFrame, facts: DataFrame, field: str, exact_days: bool = False) -> DataFrame:
    """panel (ticker, pos, day, ...) with ``known``: the field's value known on each day.

    A backward as-of: the latest usable reading available on or before the day. ``exact_days`` keeps only readings dated
    on a calendar day before filling forward (readings between trading days are lost, as in a reindex then fill).
    """
    from gridloom.operators.readings import usable

    own = usable(facts, [field]).withColumn("day", day_of("t"))
    daily = own.groupBy("ticker", "day").agg(
        F.max(F.struct("t", "period_end", "fact_id", "value")).alias("_r")
    ).select("ticker", "day", F.col("_r.value").alias("_v"))
    if exact_days:
        joined = panel.join(daily, ["ticker", "day"], "left")
        return joined.withColumn("known", F.last("_v", ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))).drop("_v")
    w = Window.partitionBy("ticker").orderBy("day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = panel.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast("double")).unionByName(
        daily.withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    return both.withColumn("known", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def market_cap(panel: DataFrame, shares: DataFrame, field: str = "shares_outstanding", asof: bool = False) -> DataFrame:
    """panel with ``cap``: raw close times shares; without ``asof`` share rows dated off the calendar are dropped before filling."""
    return facts_on_calendar(panel, shares, field, exact_days=not asof).withColumn("cap", F.col("close") * F.col("known")).drop("known")
