"""Usable readings of entity, attribute, value tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.columns import field_name, micros, named, pick, present, symbol

COLUMNS = {"ticker": "ticker", "available_date": "available_date", "field": "field", "value": "value", "period_end": "period_end", "fact_id": "fact_id"}


def usable(facts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """ticker, field, t (microseconds), value, period_end (day number), fact_id of the rows with ticker, field, available_date and value.

    NULL and NaN values, NULL dates, tickers and fields make a row unusable; an empty table gives an empty result.
    """
    rows = pick(facts, COLUMNS, optional={"period_end", "fact_id"})
    # on the raw columns: a filter on the finished ones would compute them twice
    rows = rows.where(named("ticker") & named("field") & F.col("available_date").isNotNull() & present("value").isNotNull()).select(
        symbol("ticker").alias("ticker"),
        field_name("field").alias("field"),
        micros(F.col("available_date").cast("timestamp_ntz")).alias("t"),
        present("value").alias("value"),
        micros(F.col("period_end").cast("timestamp_ntz")).alias("period_end"),
        F.col("fact_id").cast("long").alias("fact_id"),
    )
    return rows.where(F.col("field").isin(fields)) if fields else rows


def one_per_instant(rows: DataFrame, keys: list[str] = ["ticker", "field"]) -> DataFrame:  # noqa: B006
    """The row that counts at each instant of a key: greatest period_end, then fact_id, then value. Repeated rows vanish in the map-side combine."""
    return (
        rows.groupBy(*keys, "t")
        .agg(F.max(F.struct("period_end", "fact_id", "value")).alias("_r"))
        .select(*keys, "t", F.col("_r.period_end").alias("period_end"), F.col("_r.fact_id").alias("fact_id"), F.col("_r.value").alias("value"))
    )


def latest(rows: DataFrame, keys: list[str] = ["ticker", "field"]) -> DataFrame:  # noqa: B006
    """The latest row of each key: greatest t, then period_end, fact_id, value. One combinable aggregate, so a hot key costs no more than any other."""
    return (
        rows.groupBy(*keys)
        .agg(F.max(F.struct("t", "period_end", "fact_id", "value")).alias("_r"))
        .select(*keys, F.col("_r.t").alias("t"), F.col("_r.fact_id").alias("fact_id"), F.col("_r.value").alias("value"))
    )
