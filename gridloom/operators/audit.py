"""Audits of panels and universes: missingness, churn, leakage, adjustment, plausible totals. Each check is one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.panel import returns
from gridloom.operators.universe import members_on, restrict


def missing_share(panel: DataFrame, spans: DataFrame, groups: int = 20, price: str = "adj") -> DataFrame:
    """month_end, name_group, share: share of members without a price on the last calendar day of each month, names in ``groups`` groups of nearly equal size by ticker."""
    month = F.date_trunc("month", F.date_from_unix_date("day").cast("timestamp"))
    ends = panel.groupBy(month.alias("_m")).agg(F.max("day").alias("day"))
    names = name_groups(panel.select("ticker").distinct(), groups)
    held = panel.select("ticker", "day", price).join(ends.select("day"), "day", "left_semi")
    rows = restrict(held, spans).join(names, "ticker")
    return rows.groupBy("day", "name_group").agg(F.avg(F.col(price).isNull().cast("double")).alias("share"))


def name_groups(names: DataFrame, groups: int) -> DataFrame:
    """ticker, name_group: names in order in ``groups`` groups of nearly equal size, the first ones longer (as ntile).

    Names are ranked within their first two characters and by the number of names before those, so no task holds them all.
    """
    rows = names.withColumn("_head", F.substring("ticker", 1, 2))
    per = rows.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)  # one row per pair of characters
    start = per.select("_head", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_head").orderBy("ticker")) - 1
    ranked = rows.join(F.broadcast(start), "_head").withColumn("_rank", rank)
    size, longer = F.floor(F.col("_all") / groups), F.col("_all") % groups
    split = longer * (size + 1)
    group = F.when(F.col("_rank") < split, F.floor(F.col("_rank") / (size + 1))).otherwise(longer + F.floor((F.col("_rank") - split) / F.greatest(size, F.lit(1))))
    return ranked.select("ticker", (group + 1).cast("int").alias("name_group"))


def returns_by_year(panel: DataFrame) -> DataFrame:
    """year, ret (log, present ones)."""
    return returns(panel, "log").where("ret is not null").select(F.year(F.date_from_unix_date("day")).alias("year"), "ret")


def return_quantiles(panel: DataFrame, points: tuple[float, ...] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """year, q array: exact quantiles per year."""
    return returns_by_year(panel).groupBy("year").agg(F.percentile("ret", F.array(*(F.lit(p) for p in points))).alias("q"))


def sector_counts(members: DataFrame, sectors: DataFrame) -> DataFrame:
    """sector, n of the members; members without a sector as NULL."""
    return members.join(sectors, "ticker", "left").groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def leakage_check(membership: DataFrame, spans: DataFrame, day: str) -> DataFrame:
    """check, failures: members on a day against the merged periods covering it, in both directions."""
    d = F.unix_date(F.lit(day).cast("date"))
    a = members_on(membership, day)
    b = spans.where((F.col("start") <= d) & (F.col("end") > d)).select("ticker").distinct()
    return a.subtract(b).union(b.subtract(a)).agg(F.lit("no_future_members").alias("check"), F.count(F.lit(1)).alias("failures"))


def churn_check(spans: DataFrame, last_day: int, low: float = 0.05, high: float = 0.6) -> DataFrame:
    """exited, ever, share, passed: names that left by the last day."""
    per = spans.groupBy("ticker").agg(F.max("end").alias("_e"))
    out = per.agg(F.count(F.when(F.col("_e") <= last_day, 1)).alias("exited"), F.count(F.lit(1)).alias("ever"))
    return out.withColumn("share", F.try_divide("exited", "ever")).withColumn("passed", F.col("share").between(low, high))


def total_return_check(index: DataFrame, low: float = 0.02, high: float = 0.20, least: int = 100) -> DataFrame:
    """n, annualised, passed of an index (day, adj)."""
    a = index.where("adj is not null").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("adj", "day").alias("_a"), F.max_by("adj", "day").alias("_b"),
        ((F.max("day") - F.min("day")) / 365.25).alias("_y")
    )
    year = F.when(F.col("_y") > 0, F.pow(F.try_divide("_b", "_a"), F.try_divide(F.lit(1.0), "_y")) - 1)
    return a.select("n", year.alias("annualised")).withColumn("passed", (F.col("n") >= least) & F.col("annualised").between(low, high))


def adjustment_check(panel: DataFrame, extreme: float = 0.4, most: float = 0.5) -> DataFrame:
    """n_extreme, n_unadjusted, n_tickers, share, passed: log returns beyond ``extreme``, and tickers whose adjusted and raw returns never differ."""
    both = returns(panel, "log", "adj").withColumnRenamed("ret", "_a")
    both = returns(both, "log", "close").withColumnRenamed("ret", "_c")
    per = both.groupBy("ticker").agg(
        F.count(F.when(F.abs("_a") > extreme, 1)).alias("_x"), F.count(F.when(F.abs(F.col("_a") - F.col("_c")) > 1e-9, 1)).alias("_d"),
        F.count("_a").alias("_n")
    )
    a = per.where("_n > 0").agg(
        F.sum("_x").alias("n_extreme"), F.count(F.when(F.col("_d") == 0, 1)).alias("n_unadjusted"), F.count(F.lit(1)).alias("n_tickers")
    )
    return a.withColumn("share", F.try_divide("n_unadjusted", "n_tickers")).withColumn("passed", F.col("share") < most)


def extreme_moves(panel: DataFrame, extreme: float = 0.4) -> DataFrame:
    """ticker, day, ret of the log returns beyond ``extreme``."""
    return returns(panel, "log").where(F.abs("ret") > extreme).select("ticker", "day", "ret")
