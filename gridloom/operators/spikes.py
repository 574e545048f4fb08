"""Implausible readings: undecimated Haar details per source on two levels, thresholded at a robust scale.

Per ticker and measure the logarithms x of the present, positive readings are decomposed without decimation, padded with
the source's first and last reading:

    level 1: smooth s1[t] = (x[t] + x[t-1]) / 2, detail w1[t] = (x[t] - x[t-1]) / 2
    level 2: detail w2[t] = (s1[t] - s1[t-2]) / 2, so x = s2 + w1 + w2 with s2[t] = (s1[t] + s1[t-2]) / 2

As usual for wavelet thresholds the noise scale is taken from the finest details: the median of the non-zero absolute ones
(twice that is the median change). A spike of one reading stands out in the level 1 details on both of its sides. A spike of
two or three readings stands out in the level 2 details, whose blocks are as wide: the mean of its first two readings less
the reading before is 2 w2[t+1] - w1[t-1], the mean of its last two less the reading after is w1 - 2 w2 two readings on
(the level 1 terms take out the other half of the outer block). Every reading of a spike is beyond the limit, so their
means are, and thresholding the coefficients loses no spike; the readings of each candidate are then held against both
sides one by one. Runs of zero details are stuck values; plain bounds find what is impossible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.bars import valid_bars
from gridloom.operators.blocks import doubles, whole_groups
from gridloom.operators.columns import day_label

MEASURES = {"close": "close", "adj": "adj close", "volume": "volume"}
IMPOSSIBLE, OUTLYING, FROZEN = 1, 2, 4
#: Copies of its end readings on either side of a source.
PAD = 3
#: Candidates may fall short of the limit by this share (and 1e-12), so that rounding loses none; the exact check decides.
SLACK = 1e-9


class Details:
    """Undecimated Haar details of the sources in x (ordered by source), each padded by PAD copies of its end readings."""

    def __init__(self, x: np.ndarray, source: np.ndarray) -> None:
        n = len(x)
        new = np.concatenate(([True], source[1:] != source[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        which = np.repeat(np.arange(len(first)), size + 2 * PAD)
        offset = np.arange(n + 2 * PAD * len(first)) - np.repeat(np.cumsum(size + 2 * PAD) - size - 2 * PAD, size + 2 * PAD) - PAD
        padded = x[first[which] + np.clip(offset, 0, size[which] - 1)]
        #: place of reading i among the padded ones
        self.place = np.arange(n) + PAD + 2 * PAD * np.repeat(np.arange(len(first)), size)
        back = np.concatenate((padded[:1], padded[:-1]))
        smooth, self.fine = (padded + back) / 2, (padded - back) / 2
        self.coarse = (smooth - np.concatenate((smooth[:2], smooth[:-2]))) / 2

    def rise(self, at: np.ndarray, width: int) -> np.ndarray:
        """Mean of the ``width`` (1 or 2) readings from ``at`` on, less the reading before them."""
        p = self.place[at]
        return 2 * self.fine[p] if width == 1 else 2 * self.coarse[p + 1] - self.fine[p - 1]

    def fall(self, at: np.ndarray, width: int) -> np.ndarray:
        """Mean of the ``width`` readings up to ``at``, less the reading after them."""
        p = self.place[at]
        return -2 * self.fine[p + 1] if width == 1 else self.fine[p + 2] - 2 * self.coarse[p + 2]


def medians(values: np.ndarray, source: np.ndarray, n: int) -> np.ndarray:
    """Median of the values of each of n sources (mean of the middle two); NaN without values. source is ascending."""
    out = np.full(n, np.nan)
    if not len(values):
        return out
    order = np.lexsort((values, source))
    v = values[order]
    counts = np.bincount(source, minlength=n)
    ends = np.cumsum(counts)
    has = counts > 0
    lo = (ends - counts + (counts - 1) // 2)[has]
    hi = (ends - counts + counts // 2)[has]
    out[has] = (v[lo] + v[hi]) / 2
    return out


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last position of each run of True."""
    edge = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def judge(x: np.ndarray, source: np.ndarray, n: int, times: float, longest: int, stuck: int, quiet: float) -> np.ndarray:
    """Bits OUTLYING and FROZEN of each of the positive readings x, ordered by (source, time)."""
    bits = np.zeros(len(x), np.int8)
    if len(x) < 2:
        return bits
    log = np.log(x)
    haar = Details(log, source)
    same = np.concatenate(([False], source[1:] == source[:-1]))
    fine = haar.fine[haar.place]
    moved = same & (fine != 0)
    scale = medians(np.abs(fine[moved]), source[moved], n)
    with np.errstate(invalid="ignore"):
        limit = times * 2 * scale[source]  # in units of log change: a detail is half a change
        most = limit * (1 - SLACK) - 1e-12
        every = np.arange(len(x))
        for length in range(1, longest + 1):
            width = min(length, 2)
            inner = every[1 : len(x) - length]  # first readings of spikes with a reading before and one after
            inner = inner[source[inner - 1] == source[inner + length]]
            up, down = haar.rise(inner, width), haar.fall(inner + length - 1, width)
            for sign in (1.0, -1.0):
                at = inner[(sign * up > most[inner]) & (sign * down > most[inner])]
                good = np.ones(len(at), bool)
                for k in range(length):
                    here = log[at + k]
                    good &= (sign * (here - log[at - 1]) > limit[at]) & (sign * (here - log[at + length]) > limit[at])
                for k in range(length):
                    bits[at[good] + k] |= OUTLYING
    repeat = np.concatenate(([False], x[1:] == x[:-1])) & same  # zero details
    share = np.bincount(source[repeat], minlength=n) >= quiet * np.bincount(source, minlength=n)
    a, b = runs(repeat & ~share[source])
    keep = b - a >= stuck - 1
    if keep.any():
        marks = np.zeros(len(x) + 1, np.int32)
        np.add.at(marks, a[keep], 1)
        np.add.at(marks, b[keep], -1)
        bits[np.cumsum(marks[:-1]) > 0] |= FROZEN
    return bits


def implausible(
    prices: DataFrame, times: float = 10.0, longest: int = 3, stuck: int = 6, quiet: float = 0.5, infinite: bool = True
) -> DataFrame:
    """ticker, obs_day, measure, value, reasons (bits: 1 impossible, 2 out of line, 4 frozen) of the readings that are implausible.

    Impossible: a price at or below 0, a volume below 0 and, unless ``infinite`` is False, an infinite reading above 0. Out of line: one to ``longest`` consecutive
    readings, each more than ``times`` the scale above, or each as much below, both the reading before and the one after.
    Frozen: ``stuck`` or more equal readings in a row, the first excepted, unless a share of ``quiet`` or more of the
    ticker's readings equals the one before. Only valid bars count; NULL and NaN are no readings; a ticker whose readings
    never change has no scale and no reading out of line; empty input gives an empty result.

    A ticker has at most one valid bar a day, so its group is bounded by the number of days in the data's range (36,525
    in a century), whatever share of the raw rows it holds: those are combined before the first shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["ticker"]):
            source = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            for new, old in MEASURES.items():
                x = doubles(table, new)
                with np.errstate(invalid="ignore"):
                    ok = (x > 0) & np.isfinite(x)
                    wrong = (infinite & (x == np.inf)) | (x < 0) | ((x == 0) if new != "volume" else False)
                bits = np.where(wrong, IMPOSSIBLE, 0).astype(np.int8)
                at = np.flatnonzero(ok)
                bits[at] |= judge(x[at], source[at], len(starts), times, longest, stuck, quiet)
                hit = np.flatnonzero(bits)
                if len(hit):
                    rows = pa.array(hit)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "ticker": table.column("ticker").combine_chunks().take(rows),
                            "day": table.column("day").combine_chunks().take(rows), "measure": pa.array([old] * len(hit), pa.string()),
                            "value": pa.array(x[hit]), "reasons": pa.array(bits[hit].astype(np.int32))
                        }
                    )

    rows = valid_bars(prices, MEASURES).repartition("ticker").sortWithinPartitions("ticker", "day")
    flagged = rows.mapInArrow(run, "ticker string, day int, measure string, value double, reasons int")
    return flagged.select("ticker", day_label(F.col("day")).alias("obs_day"), "measure", "value", "reasons")
