"""Overlapping and gapped intervals: an ordered disjoint-interval map per entity in keyed state.

The map is two sorted lists of starts and ends. An insertion finds the intervals it overlaps or touches by binary search,
replaces them by their union and thereby updates the gaps on either side. Insertions commute, so maps can be built over
any parts of an entity's rows and merged: rows are inserted into the map of their (ticker, block of start days) first
and the few disjoint intervals left there into the ticker's own map. Of rows with the same ticker and start only the one
that ends last matters; that is decided before the first shuffle, so a ticker brings at most one row per start day,
however many rows it has, and a map holds at most half as many intervals as there are days in the data's range.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.blocks import whole_groups
from gridloom.operators.columns import day_label, day_number, pick, symbol

UNKNOWN_START, OPEN_END = "0001-01-01", "2099-12-31"


class IntervalMap:
    """Ordered map of disjoint half-open intervals; touching ones are joined."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = starts or [], ends or []

    def insert(self, start: int, end: int) -> bool:
        """Add [start, end); True if the map changed. Empty intervals are ignored."""
        if end <= start:
            return False
        a = bisect_left(self.ends, start)  # first interval that ends at or after the start
        b = bisect_right(self.starts, end)  # one past the last that begins at or before the end
        if a < b:
            if b - a == 1 and self.starts[a] <= start and end <= self.ends[a]:
                return False
            start, end = min(start, self.starts[a]), max(end, self.ends[b - 1])
        self.starts[a:b] = [start]
        self.ends[a:b] = [end]
        return True

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


def clean_intervals(rows: DataFrame) -> DataFrame:
    """ticker, start, end as day numbers; unknown start and open end filled; rows without ticker or without length dropped; of one start the greatest end."""
    flat = pick(rows, {"ticker": "ticker", "start_date": "start_date", "end_date": "end_date"})
    start = F.coalesce(day_number("start_date"), F.unix_date(F.lit(UNKNOWN_START).cast("date")))
    end = F.coalesce(day_number("end_date"), F.unix_date(F.lit(OPEN_END).cast("date")))
    out = flat.select(symbol("ticker").alias("ticker"), start.alias("start"), end.alias("end"))
    return out.where("ticker is not null and `end` > start").groupBy("ticker", "start").agg(F.max("end").alias("end"))


def insert_all(keys: list[str], with_gaps: bool):
    """mapInArrow function over rows sorted by keys: keyed interval maps, emitted when their key is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            a = table.column("start").combine_chunks().to_numpy(zero_copy_only=False).tolist()
            b = table.column("end").combine_chunks().to_numpy(zero_copy_only=False).tolist()
            bounds = [*starts.tolist(), table.num_rows]
            rows, kinds, frm, to = [], [], [], []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                state = IntervalMap()
                for k in range(i, j):
                    state.insert(a[k], b[k])
                for kind, found in (("period", state.periods()), ("gap", state.gaps() if with_gaps else [])):
                    for x, y in found:
                        rows.append(i)
                        kinds.append(kind)
                        frm.append(x)
                        to.append(y)
            names = table.column("ticker").combine_chunks().take(pa.array(np.array(rows, np.int64)))
            out = {"ticker": names, "start": pa.array(frm, pa.int32()), "end": pa.array(to, pa.int32())}
            yield pa.RecordBatch.from_pydict(out | {"kind": pa.array(kinds, pa.string())} if with_gaps else out)

    return run


def continuous_periods(rows: DataFrame, block_days: int = 1024) -> DataFrame:
    """ticker, kind ('period' or 'gap'), from_day, to_day: maximal covered stretches and the stretches between them, half-open.

    NULL start is read as 0001-01-01, NULL end as 2099-12-31; rows whose end is not after the start and rows without a
    ticker are ignored. A ticker without an interval has no row; empty input gives an empty result. The blocks of
    ``block_days`` start days are merged on their own first.
    """
    block = F.floor(F.col("start") / block_days).cast("int")
    parts = clean_intervals(rows).withColumn("block", block).repartition("ticker", "block").sortWithinPartitions("ticker", "block")
    merged = parts.mapInArrow(insert_all(["ticker", "block"], False), "ticker string, start int, end int")
    whole = merged.repartition("ticker").sortWithinPartitions("ticker")
    out = whole.mapInArrow(insert_all(["ticker"], True), "ticker string, start int, end int, kind string")
    return out.select("ticker", "kind", day_label(F.col("start")).alias("from_day"), day_label(F.col("end")).alias("to_day"))
