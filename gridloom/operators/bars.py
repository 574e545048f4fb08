"""Valid bars: the row of a ticker and day that was loaded last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.columns import day_number, named, pick, present, symbol


def valid_bars(prices: DataFrame, measures: dict[str, str]) -> DataFrame:
    """ticker, day (number since 1970-01-01) and the measures {new: old} of the row with the greatest loaded_at.

    NaN is read as NULL. Rows without ticker or date are ignored; a NULL loaded_at is the oldest; among rows of one
    loaded_at the greatest measures (in the order given, NULL least) win. The combine runs before the shuffle, so
    repeated and superseded rows of a hot ticker cost nothing beyond their scan.
    """
    rows = pick(prices, {"date": "date", "ticker": "ticker", "loaded_at": "loaded_at", **measures}, optional={"loaded_at"})
    rows = rows.where(named("ticker") & F.col("date").isNotNull()).select(
        symbol("ticker").alias("ticker"), day_number("date").alias("day"), F.col("loaded_at").cast("timestamp_ntz").alias("_at"),
        *(present(m).alias(m) for m in measures)
    )
    best = rows.groupBy("ticker", "day").agg(F.max(F.struct("_at", *measures)).alias("_r"))
    return best.select("ticker", "day", *(F.col(f"_r.{m}").alias(m) for m in measures))


def spans(prices: DataFrame) -> DataFrame:
    """ticker, first and last day with a bar; reads two columns and combines before the shuffle."""
    rows = pick(prices, {"date": "date", "ticker": "ticker"}).where(named("ticker") & F.col("date").isNotNull())
    return rows.select(symbol("ticker").alias("ticker"), day_number("date").alias("day")).groupBy("ticker").agg(F.min("day").alias("first"), F.max("day").alias("last"))
