"""Universe reconstruction: membership intervals, masks, change logs and rename chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.columns import day_number, pick, symbol
from gridloom.operators.intervals import OPEN_END, UNKNOWN_START, clean_intervals


def periods(membership: DataFrame) -> DataFrame:
    """ticker, start, end (day numbers): disjoint covered stretches, so that a range join counts no day twice."""
    from gridloom.operators.intervals import continuous_periods

    whole = continuous_periods(membership).where("kind = 'period'")
    return whole.select("ticker", F.unix_date(F.to_date("from_day")).alias("start"), F.unix_date(F.to_date("to_day")).alias("end"))


def members_on(membership: DataFrame, day: str) -> DataFrame:
    """Tickers whose half-open interval covers the day."""
    d = F.unix_date(F.lit(day).cast("date"))
    return clean_intervals(membership).where((F.col("start") <= d) & (F.col("end") > d)).select("ticker").distinct()


def all_tickers(membership: DataFrame) -> DataFrame:
    """Distinct tickers ever in the table."""
    return pick(membership, {"ticker": "ticker"}).select(symbol("ticker").alias("ticker")).where("ticker is not null").distinct()


def restrict(panel: DataFrame, spans: DataFrame) -> DataFrame:
    """Panel rows (ticker, day, ...) inside a membership period: an equi-join on ticker with a range condition; the periods of a ticker are disjoint."""
    s = spans.select(F.col("ticker").alias("_t"), "start", "end")
    return panel.join(s, (F.col("ticker") == F.col("_t")) & (F.col("day") >= F.col("start")) & (F.col("day") < F.col("end")), "left_semi")


def month_ends_covered(spans: DataFrame, first: Column, last: Column) -> DataFrame:
    """month_end, ticker: each period unfolded to the calendar month ends it covers, from first to last."""
    lo = F.greatest(F.date_from_unix_date("start"), first)
    hi = F.least(F.date_from_unix_date(F.col("end") - 1), last)
    months = spans.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
    ends = F.sequence(F.trunc("_lo", "month"), F.trunc("_hi", "month"), F.expr("interval 1 month"))
    out = months.select(F.explode(F.transform(ends, lambda m: F.last_day(m))).alias("month_end"), "ticker", "_lo", "_hi")
    return out.where("month_end between _lo and _hi").select("month_end", "ticker")


def sizes_at_month_ends(spans: DataFrame, first: str, last: str) -> DataFrame:
    """month_end, n: members at each calendar month end from first to last. Each period counts itself at the month ends it covers, then one combinable count."""
    return month_ends_covered(spans, F.lit(first).cast("date"), F.lit(last).cast("date")).groupBy("month_end").agg(F.count(F.lit(1)).alias("n"))


def resolve_renames(tickers: DataFrame, renames: dict[str, str]) -> DataFrame:
    """ticker, resolved: the end of each ticker's rename chain; a cycle ends before it repeats. The rename list is a parameter, closed on the driver."""
    def end_of(name: str) -> str:
        seen = {name}
        while name in renames and renames[name] not in seen:
            name = renames[name]
            seen.add(name)
        return name

    pairs = [x for k in sorted(renames) for x in (F.lit(k), F.lit(end_of(k)))]
    resolved = F.coalesce(F.create_map(*pairs)[F.col("ticker")], F.col("ticker")) if pairs else F.col("ticker")
    return tickers.withColumn("resolved", resolved)


def depth_after(kinds: Column) -> Column:
    """Open count after an ordered array of 'added' / 'removed': additions count up, removals down to no less than 0."""
    return F.aggregate(kinds, F.lit(0), lambda d, k: F.when(k == "added", d + 1).otherwise(F.greatest(d - 1, F.lit(0))))


def events_of(changes: DataFrame) -> DataFrame:
    """ticker, day, kind of a change log (date, added, removed; '' or NULL: none); repeated events count once."""
    rows = pick(changes, {"date": "date", "added": "added", "removed": "removed"}).withColumn("day", day_number("date"))
    both = F.array(F.struct(F.col("added").alias("raw"), F.lit("added").alias("kind")), F.struct(F.col("removed").alias("raw"), F.lit("removed").alias("kind")))
    return rows.select("day", F.inline(both)).select(symbol("raw").alias("ticker"), "day", "kind").where("ticker is not null").distinct()


def _walk(events: Column, log_end: Column, is_open: Column, exit_day: Column) -> Column:
    """Intervals of one ticker from its ordered events, as array<struct<start, end>> (end NULL: still open)."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    nothing = F.lit(None).cast("int")
    state = F.struct(nothing.alias("open"), nothing.alias("gone"), empty.alias("done"))

    def step(s: Column, e: Column) -> Column:
        adding = e["kind"] == "added"
        start = F.coalesce(s["open"], s["gone"])
        closed = F.when(
            start < e["day"], F.concat(s["done"], F.array(F.struct(start.alias("start"), e["day"].alias("end"))))
        ).when(start.isNull(), F.concat(s["done"], F.array(F.struct(nothing.alias("start"), e["day"].alias("end"))))).otherwise(s["done"])
        return F.struct(
            F.when(adding, F.coalesce(s["open"], e["day"])).alias("open"),  # a second addition changes nothing
            F.when(adding, s["gone"]).otherwise(e["day"]).alias("gone"),
            F.when(adding, s["done"]).otherwise(closed).alias("done"),
        )

    def finish(s: Column) -> Column:
        end = F.when(is_open, nothing).when(exit_day.isNotNull(), exit_day).otherwise(log_end)
        tail = F.array(F.struct(s["open"].alias("start"), end.alias("end")))
        return F.when(s["open"].isNull() | (~is_open & (s["open"] >= end)), s["done"]).otherwise(F.concat(s["done"], tail))

    return F.aggregate(events, state, step, finish)


def intervals_from_changes(changes: DataFrame, current: DataFrame, renames: dict[str, str] | None = None, exits: dict[str, str] | None = None) -> DataFrame:
    """ticker, start_date, end_date from a change log and the current members (ticker, date_added).

    Renamed tickers are one; events of a day are ordered removals first. A current member whose events leave it closed gets
    an addition at its last removal (else at date_added, NULL if unknown). A removal without an open interval begins at the
    previous removal (NULL: before the log). Open intervals stay open for current members; others end at their exit date if
    one is given, else where the log ends; an interval without length is dropped. Starts that are unknown sort first.
    """
    log = resolve_renames(events_of(changes), renames or {}).select(F.col("resolved").alias("ticker"), "day", "kind").distinct()
    now = pick(current, {"ticker": "ticker", "added": "date_added"}, optional={"added"}).select(
        symbol("ticker").alias("ticker"), day_number(F.to_date("added")).alias("added")
    )
    now = resolve_renames(
        now.where("ticker is not null"), renames or {}
    ).groupBy(F.col("resolved").alias("ticker")).agg(F.max("added").alias("added")).withColumn("current", F.lit(True))
    end = log.agg(F.max("day").alias("e")).first()["e"]
    by = log.groupBy("ticker").agg(
        F.sort_array(F.collect_set(F.struct("day", F.when(F.col("kind") == "removed", 0).otherwise(1).alias("order"), "kind"))).alias("events")
    )
    all_ = by.join(now, "ticker", "full")
    events = F.coalesce("events", F.array().cast("array<struct<day:int,order:int,kind:string>>"))
    is_open = F.coalesce("current", F.lit(False))
    depth = depth_after(F.transform(events, lambda e: e["kind"]))
    last_removal = F.array_max(F.transform(F.filter(events, lambda e: e["kind"] == "removed"), lambda e: e["day"]))
    seed = F.array(
        F.struct(
            F.coalesce(last_removal, F.col("added"), F.unix_date(F.lit(UNKNOWN_START).cast("date"))).alias("day"), F.lit(1).alias("order"),
            F.lit("added").alias("kind")
        )
    )
    seeded = F.when(is_open & (depth == 0), F.sort_array(F.concat(events, seed))).otherwise(events)
    exit_pairs = [x for k, v in sorted((exits or {}).items()) for x in (F.lit(k), F.lit(v).cast("date"))]
    exit_day = F.unix_date(F.create_map(*exit_pairs)[F.col("ticker")]) if exit_pairs else F.lit(None).cast("int")
    rows = all_.select("ticker", F.inline(_walk(seeded, F.lit(end).cast("int"), is_open, exit_day)))
    unknown = F.unix_date(F.lit(UNKNOWN_START).cast("date"))
    return rows.select(
        "ticker", F.date_from_unix_date(F.when(F.col("start") != unknown, F.col("start"))).alias("start_date"),
        F.date_from_unix_date("end").alias("end_date")
    )


def members_by_replay(current: DataFrame, changes: DataFrame, day: str) -> DataFrame:
    """Members on a past day by undoing later changes: per ticker the earliest event after the day decides ('removed' first within a day)."""
    d = F.unix_date(F.lit(day).cast("date"))
    now = pick(current, {"ticker": "ticker"}).select(symbol("ticker").alias("ticker")).where("ticker is not null").distinct()
    first = events_of(changes).where(F.col("day") > d).groupBy("ticker").agg(
        F.min(F.struct("day", F.when(F.col("kind") == "removed", 0).otherwise(1).alias("o"))).alias("_e")
    ).select("ticker", F.col("_e.o").alias("o"))
    back = first.where("o = 0").select("ticker")
    return now.join(first.where("o = 1"), "ticker", "left_anti").union(back).distinct()


def validate(membership: DataFrame, current: DataFrame, low: int, high: int, days: list[str]) -> DataFrame:
    """check, failures: intervals without length, open set against current members, and member counts outside [low, high] on the days."""
    rows = pick(membership, {"ticker": "ticker", "s": "start_date", "e": "end_date"})
    bad = rows.where("s is not null and e is not null and not s < e").agg(F.lit("start_before_end").alias("check"), F.count(F.lit(1)).alias("failures"))
    open_set = rows.where(F.col("e").isNull() | (F.to_date("e") >= F.lit(OPEN_END).cast("date"))).select(symbol("ticker").alias("ticker")).distinct()
    now = pick(current, {"ticker": "ticker"}).select(symbol("ticker").alias("ticker")).distinct()
    differ = open_set.subtract(now).union(now.subtract(open_set)).agg(F.lit("open_set_is_current").alias("check"), F.count(F.lit(1)).alias("failures"))
    out = bad.union(differ)
    for d in days:
        out = out.union(
            members_on(membership, d).agg(
                F.lit(f"size_{d}").alias("check"),
                F.when(F.count(F.lit(1)).between(low, high), 0).otherwise(1).cast("long").alias("failures")
            )
        )
    return out

