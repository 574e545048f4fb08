"""Whole groups out of sorted Arrow batches, without a group ever being split or a Python call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts_of(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Positions where a new group begins in rows sorted by keys."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        column = batch.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if n > 1:
            # group keys are never NULL here
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 40_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, group starts) with whole groups only, of about ``rows`` rows each; holds one group and one table at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of(table, keys)
        cut = int(starts[-1])
        if cut == 0:
            rows_now = count  # one long group so far: wait until it has doubled, so joining the pieces stays linear
            rows = max(rows, 2 * rows_now)
            continue
        yield table.slice(0, cut).combine_chunks(), starts[:-1]
        rest = table.slice(cut).combine_chunks()
        held = rest.to_batches()
        count = rest.num_rows
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts_of(table, keys)


def doubles(table: pa.Table, name: str) -> np.ndarray:
    """Column as float64, NULL as NaN."""
    column = table.column(name).combine_chunks().cast(pa.float64())
    return column.to_numpy(zero_copy_only=False)
