"""Time shards for hot keys: no key is ever one task's job, however many of the rows it holds.

A key is hot when it has more than ``most`` rows, an absolute number, whatever the size of the table. A hot key's rows are
cut by their place on the time axis into cells of 2**41 microseconds (25 days); a cell that still has more than ``most``
rows is cut into 32 smaller ones, and so on down to a single microsecond. A row's shard is the start of its cell, so it
follows from the row and from the small tables of what had to be cut; nothing is sampled and no boundary is collected.

The tables of hot keys and of cut cells have at most (rows / most) rows each. They are written to the checkpoint folder
once, counted, and broadcast up to BROADCAST_ROWS of them; beyond that they are joined by their keys and cell.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.engine.session import checkpoint

#: A key, or a shard of a hot key, has no more rows than this (but for rows of one microsecond, which salt() spreads).
MOST_ROWS = 250_000
#: Widths of the cells as powers of two microseconds, from 25 days to one microsecond.
LEVELS = (41, 36, 31, 26, 21, 16, 11, 6, 0)
#: Tables of hot keys and cut cells are broadcast up to this many rows (about 10 MB).
BROADCAST_ROWS = 100_000


def cell(t: Column, level: int) -> Column:
    """Start of t's cell."""
    return F.shiftleft(F.shiftright(t, LEVELS[level]), LEVELS[level])


def small(df: DataFrame, n: int) -> DataFrame:
    """df, broadcast if its counted n rows are few enough."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class ShardPlan:
    keys: tuple[str, ...]
    hot: DataFrame | None = None  # keys; None: no key is hot
    n_hot: int = 0
    cut: tuple[tuple[DataFrame, int], ...] = field(default=())  # by level: keys, _cell, _n of the cells with more than MOST_ROWS rows; how many
    most: int = MOST_ROWS

    @property
    def groups(self) -> list[str]:
        """What the rows of a local merge have in common: the keys, and the shard if there are any."""
        return [*self.keys] if self.hot is None else [*self.keys, "shard"]

    def hot_rows(self, df: DataFrame) -> DataFrame:
        return df.join(small(self.hot, self.n_hot), list(self.keys), "left_semi")

    def assign(self, df: DataFrame, order: str) -> DataFrame:
        """df with long columns ``shard`` (start of the row's cell; 0 for keys that are not hot) and ``salts`` (parts for rows of a microsecond that has more than ``most`` of them, else 1)."""
        if self.hot is None:
            return df.withColumn("shard", F.lit(0).cast("long")).withColumn("salts", F.lit(1).cast("long"))
        keys, t = list(self.keys), F.coalesce(F.col(order), F.lit(0))
        out = df.join(small(self.hot.withColumn("_hot", F.lit(True)), self.n_hot), keys, "left")
        out = out.withColumn("shard", F.when(F.col("_hot"), cell(t, 0)).otherwise(0).cast("long")).drop("_hot").withColumn("salts", F.lit(1).cast("long"))
        for level, (cells, n) in enumerate(self.cut):
            out = out.withColumn("_cell", cell(t, level)).join(small(cells, n), [*keys, "_cell"], "left")
            if level + 1 < len(LEVELS):
                out = out.withColumn("shard", F.when(F.col("_n").isNotNull(), cell(t, level + 1)).otherwise(F.col("shard")))
            else:
                out = out.withColumn("salts", F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / self.most).cast("long"))
            out = out.drop("_cell", "_n")
        return out


def plan_shards(df: DataFrame, keys: list[str], order: str, most: int = MOST_ROWS) -> ShardPlan:
    """Decide the shards of df's keys along ``order`` (a long column; NULL counts as 0).

    One pass counts rows per key (combined before the shuffle); another reads hot keys' rows for each level of cells that is too full.
    """
    hot = checkpoint(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys))
    n_hot = hot.count()
    if not n_hot:
        return ShardPlan(tuple(keys), most=most)
    plan = ShardPlan(tuple(keys), hot, n_hot, (), most)
    t = F.coalesce(F.col(order), F.lit(0))
    rows = plan.hot_rows(df.select(*keys, t.alias("_t")))
    cut: list[tuple[DataFrame, int]] = []
    for level in range(len(LEVELS)):
        cells = checkpoint(rows.groupBy(*keys, cell(F.col("_t"), level).alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most))
        n = cells.count()
        if not n:
            break
        cut.append((cells, n))
        rows = rows.withColumn("_cell", cell(F.col("_t"), level)).join(small(cells.drop("_n"), n), [*keys, "_cell"], "left_semi").drop("_cell")
    return ShardPlan(tuple(keys), hot, n_hot, tuple(cut), most)


def before_shards(summary: DataFrame, keys: list[str], value: str, order: list[str], forward: bool = False) -> DataFrame:
    """summary with ``carried``: ``value`` (NULL: none) of the key's nearest earlier (``forward``: later) row that has one.

    ``summary`` has one row per shard. It is looked through in two steps, within the cells of the first level and over
    those cells (1,440 a century), so its window groups stay small even where a cell of 25 days had to be cut finely.
    """
    s = summary.withColumn("_top", cell(F.col("shard"), 0))
    turn = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*keys, "_top").orderBy(*(turn(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
    along = F.struct(*order) if not forward else F.struct(*((-F.col(c)).alias(c) for c in order))
    tops = s.where(F.col(value).isNotNull()).groupBy(*keys, "_top").agg(F.max_by(value, along).alias("_last"))
    every = s.select(*keys, "_top").distinct().join(tops, [*keys, "_top"], "left")
    over = Window.partitionBy(*keys).orderBy(turn("_top")).rowsBetween(Window.unboundedPreceding, -1)
    far = every.select(*keys, "_top", F.last("_last", ignorenulls=True).over(over).alias("_far"))
    return s.join(far, [*keys, "_top"]).withColumn("carried", F.coalesce("_near", "_far")).drop("_top", "_near", "_far")
