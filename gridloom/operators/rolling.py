"""Totals over trailing calendar periods: sparse rows packed into dense blocks, multiplied by banded window operators.

A ticker's days are cut into time tiles of TILE days. A bar also goes to the following tile if it lies in that tile's
halo (the widest window less one day before its first day), so every tile is computed on its own and no ticker is one
task's job. A block of tiles is a dense (tiles x halo + TILE) matrix; one product with a banded 0/1 matrix gives the
totals of all its days.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.bars import spans, valid_bars
from gridloom.operators.blocks import doubles, whole_groups
from gridloom.operators.columns import day_label

TILE = 256
BLOCK_TILES = 512  # a block of 512 x (256 + 29) doubles is 1.2 MB


@lru_cache(maxsize=8)
def banded(tile: int, halo: int, window: int) -> np.ndarray:
    """(halo + tile) x tile: column j sums the ``window`` days that end with day j of the tile."""
    days = np.arange(halo + tile)[:, None]
    ends = np.arange(tile)[None, :] + halo
    return ((days <= ends) & (days > ends - window)).astype(np.float64)


def window_sums(dense: np.ndarray, tile: int, halo: int, window: int) -> np.ndarray:
    """dense @ band; infinite cells reach only the windows that hold them."""
    band = banded(tile, halo, window)
    bad = ~np.isfinite(dense)
    if not bad.any():
        return dense @ band
    out = np.where(bad, 0.0, dense) @ band
    for sign in (np.inf, -np.inf):
        out[((dense == sign).astype(np.float64) @ band) > 0] = sign
    return out


def tiled(prices: DataFrame, windows: tuple[int, ...], tile: int) -> DataFrame:
    """Rows of the tiles: ticker, tile, day (NULL: the tile's marker with the ticker's first and last day), flow, price; sorted by ticker, tile, day in each partition."""
    halo = max(windows) - 1
    if halo > tile:
        raise ValueError("a tile must be as long as the widest window")
    bars = valid_bars(prices, {"close": "close", "adj": "adj close", "volume": "volume"})
    flow = F.when((F.col("close") > 0) & (F.col("volume") > 0), F.col("close") * F.col("volume")).otherwise(0.0)
    own = F.floor(F.col("day") / tile).cast("int")
    in_halo = F.pmod("day", F.lit(tile)) >= tile - halo
    rows = bars.select(
        "ticker", F.explode(F.when(in_halo, F.array(own, own + 1)).otherwise(F.array(own))).alias("tile"), "day", flow.alias("flow"),
        F.col("adj").alias("price"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
    )
    marks = spans(prices).select(
        "ticker", F.explode(F.sequence(F.floor(F.col("first") / tile).cast("int"), F.floor(F.col("last") / tile).cast("int"))).alias("tile"),
        F.lit(None).cast("int").alias("day"), F.lit(None).cast("double").alias("flow"), F.lit(None).cast("double").alias("price"), "first", "last",
    )
    return rows.unionByName(marks).repartition("ticker", "tile").sortWithinPartitions("ticker", "tile", F.col("day").asc_nulls_first())


def dense_blocks(batches: Iterator[pa.RecordBatch], tile: int, halo: int) -> Iterator[
    tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
]:
    """Blocks of up to BLOCK_TILES tiles: tickers, first day of the tile, first and last day of the ticker, flow and price matrices (price NaN where missing)."""
    for table, starts in whole_groups(batches, ["ticker", "tile"]):
        lengths = np.diff(np.append(starts, table.num_rows))
        group = np.repeat(np.arange(len(starts)), lengths)
        day = table.column("day").combine_chunks()
        marker = day.is_null().to_numpy(zero_copy_only=False)
        # a tile after the last day holds nothing but its halo and has no marker
        marked = np.zeros(len(starts), bool)
        marked[group[marker]] = True
        first = np.zeros(len(starts), np.int64)
        last = np.zeros(len(starts), np.int64)
        first[group[marker]] = pc.fill_null(table.column("first").combine_chunks(), 0).to_numpy(zero_copy_only=False)[marker]
        last[group[marker]] = pc.fill_null(table.column("last").combine_chunks(), 0).to_numpy(zero_copy_only=False)[marker]
        tiles = table.column("tile").combine_chunks().to_numpy(zero_copy_only=False)[starts].astype(np.int64) * tile
        days = pc.fill_null(day, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flow, price = doubles(table, "flow"), doubles(table, "price")
        names = table.column("ticker").combine_chunks().take(pa.array(starts))
        at = days - tiles[group] + halo
        for a in range(0, len(starts), BLOCK_TILES):
            b = min(a + BLOCK_TILES, len(starts))
            use = ~marker & (group >= a) & (group < b)
            f = np.zeros((b - a, halo + tile))
            p = np.full((b - a, halo + tile), np.nan)
            f[group[use] - a, at[use]] = flow[use]
            p[group[use] - a, at[use]] = price[use]
            keep = np.flatnonzero(marked[a:b])
            yield names.take(pa.array(keep + a)), tiles[a:b][keep], first[a:b][keep], last[a:b][keep], f[keep], p[keep]


def trailing_totals(prices: DataFrame, windows: tuple[int, int] = (7, 30), tile: int = TILE) -> DataFrame:
    """One row per ticker and calendar day from its first to its last bar, days without a bar included.

    Columns: ticker, day, n_day (1 on the first day) and for each window w: flow_sum_w (dollar volume: close x volume of
    the valid bar where both are present and positive, else 0), flow_avg_w (by w days), price_sum_w, price_n_w (days with
    an adj close) and price_avg_w (by price_n_w; NULL where it is 0). Windows reaching back before the first bar hold
    less. Empty input gives an empty result; a single bar gives one day.
    """
    halo = max(windows) - 1
    kinds = ", ".join(f"flow_sum_{w} double, flow_avg_{w} double, price_sum_{w} double, price_n_{w} int, price_avg_{w} double" for w in windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, tiles, first, last, flow, price in dense_blocks(batches, tile, halo):
            days = tiles[:, None] + np.arange(tile)[None, :]
            keep = (days >= first[:, None]) & (days <= last[:, None])
            if not keep.any():
                continue
            row = np.nonzero(keep)[0]
            out = {
                "ticker": names.take(pa.array(row)), "day": pa.array(days[keep].astype(np.int32)),
                "n_day": pa.array((days - first[:, None] + 1)[keep].astype(np.int32))
            }
            has = ~np.isnan(price)
            for w in windows:
                f = window_sums(flow, tile, halo, w)[keep]
                s = window_sums(np.where(has, price, 0.0), tile, halo, w)[keep]
                n = np.rint(window_sums(has.astype(np.float64), tile, halo, w)[keep]).astype(np.int32)
                out |= {
                    f"flow_sum_{w}": pa.array(f), f"flow_avg_{w}": pa.array(f / w), f"price_sum_{w}": pa.array(s),
                    f"price_n_{w}": pa.array(n), f"price_avg_{w}": pa.array(s / np.maximum(n, 1), mask=n == 0)
                }
            yield pa.RecordBatch.from_pydict(out)

    return tiled(prices, windows, tile).mapInArrow(run, f"ticker string, day int, n_day int, {kinds}")


def turnover_shifts(prices: DataFrame, short: int = 7, long: int = 30, surge: float = 2.5, dry: float = 0.2, tile: int = TILE) -> DataFrame:
    """ticker, obs_day, kind of the days, from the ticker's ``long``-th calendar day on, whose short mean of dollar volume is above ``surge`` or below ``dry`` times its long mean."""
    halo = long - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, tiles, first, last, flow, _ in dense_blocks(batches, tile, halo):
            days = tiles[:, None] + np.arange(tile)[None, :]
            keep = (days >= first[:, None] + long - 1) & (days <= last[:, None])
            a = window_sums(flow, tile, halo, short) / short
            b = window_sums(flow, tile, halo, long) / long
            for kind, hit in (("surge", keep & (a > surge * b)), ("dry", keep & (a < dry * b))):
                if hit.any():
                    yield pa.RecordBatch.from_pydict(
                        {
                            "ticker": names.take(pa.array(np.nonzero(hit)[0])), "day": pa.array(days[hit].astype(np.int32)),
                            "kind": pa.array([kind] * int(hit.sum()), pa.string())
                        }
                    )

    found = tiled(prices, (short, long), tile).mapInArrow(run, "ticker string, day int, kind string")
    return found.select("ticker", day_label(F.col("day")).alias("obs_day"), "kind")
