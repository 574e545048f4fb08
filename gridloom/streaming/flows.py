"""Structured Streaming: interval maps in keyed state, late price rows, windowed totals, live as-of facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators.columns import day_number, symbol
from gridloom.operators.intervals import OPEN_END, UNKNOWN_START, IntervalMap

PERIODS = "ticker string, kind string, from_day int, to_day int, version long"
STATE = "starts array<int>, ends array<int>, version long"


def _insert(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, ends, version = state.get if state.exists else ([], [], 0)
    held = IntervalMap(list(starts), list(ends))
    changed = False
    for pdf in parts:
        for a, b in zip(pdf["start"].tolist(), pdf["end"].tolist(), strict=True):
            changed |= held.insert(a, b)
    if changed:
        version += 1
        state.update((held.starts, held.ends, version))
        rows = [(key[0], k, a, b, version) for k, found in (("period", held.periods()), ("gap", held.gaps())) for a, b in found]
        yield pd.DataFrame(rows, columns=["ticker", "kind", "from_day", "to_day", "version"])


def live_periods(rows: DataFrame) -> DataFrame:
    """Stream of (ticker, start_date, end_date) -> the ticker's periods and gaps, anew with a higher version whenever they change.

    The state of a ticker is its ordered disjoint-interval map; rows may come late and in any order.
    """
    start = F.coalesce(day_number("start_date"), F.unix_date(F.lit(UNKNOWN_START).cast("date")))
    end = F.coalesce(day_number("end_date"), F.unix_date(F.lit(OPEN_END).cast("date")))
    clean = rows.select(symbol("ticker").alias("ticker"), start.alias("start"), end.alias("end")).where("ticker is not null and `end` > start")
    return clean.groupBy("ticker").applyInPandasWithState(_insert, PERIODS, STATE, "update", GroupStateTimeout.NoTimeout)


def latest_periods(log: DataFrame) -> DataFrame:
    """The current periods and gaps of a log of live_periods()."""
    last = log.groupBy("ticker").agg(F.max("version").alias("version"))
    return log.join(last, ["ticker", "version"], "left_semi").drop("version")


def once_per_bar(rows: DataFrame, delay: str = "30 days") -> DataFrame:
    """Price rows without repeats, where a repeat comes at most ``delay`` after the first (by loaded_at)."""
    return rows.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark([c for c in rows.columns])


def windowed_totals(events: DataFrame, time: str, keys: list[str], value: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling (or, with slide, sliding) totals per key with a watermark: window, keys, n, total."""
    return events.withWatermark(time, delay).groupBy(
        F.window(time, width, slide) if slide else F.window(time, width), *keys
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """Session windows per key that end after a gap: window, keys, n."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def batch_log(path: str, keys: list[str], order: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: one parquet folder per batch. A batch that is retried is written again in its place, so a retry changes nothing.

    With ``order`` only the row with the greatest one per keys is kept of a batch. Batches are not merged when they are
    written: current_rows() does that when the log is read.
    """
    def save(df: DataFrame, batch: int) -> None:
        best = df if order is None else latest_of(df, keys, order)
        best.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return save


def latest_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` per keys; ties go to the greatest other columns."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r")).select(*keys, "_r.*")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows a batch_log() has written; none if it has written nothing yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def current_rows(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table a log stands for: of each key the latest row over all batches. One combinable aggregate."""
    return latest_of(log.drop("batch"), keys, order)
