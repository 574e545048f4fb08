"""Irregular readings onto a regular grid, through step-function validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.engine.session import checkpoint
from gridloom.operators.columns import quarter_label, quarter_of, quarter_start_us
from gridloom.operators.readings import one_per_instant, usable
from gridloom.operators.sharding import MOST_ROWS, before_shards, plan_shards

KEYS = ["ticker", "field"]


def validity_intervals(readings: DataFrame, keys: list[str] = KEYS, most: int = MOST_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Step function of each key: keys, t, until (NULL: open), value.

    ``readings`` has one row per key and instant ``t``. A reading holds until the key's next one. Keys with more than
    ``most`` readings are cut into time shards: the next instant is looked up inside the shard, and only a shard's last
    reading looks at the first instant of the next shard (one summary row per shard). ``sizes`` (keys, t), cheaper to
    read than the readings and with at least their rows, may stand for them where shards are planned.
    """
    plan = plan_shards(readings if sizes is None else sizes, keys, "t", most)
    rows = plan.assign(readings, "t").drop("salts")
    rows = rows.withColumn("until", F.lead("t").over(Window.partitionBy(*plan.groups).orderBy("t")))
    if plan.hot is None:
        return rows.drop("shard")
    firsts = checkpoint(plan.assign(plan.hot_rows(readings), "t").groupBy(*keys, "shard").agg(F.min("t").alias("_first")))  # one row per shard
    following = before_shards(firsts, keys, "_first", ["shard"], forward=True).select(*keys, "shard", F.col("carried").alias("_next"))
    # joined by key and shard, so the rows of a hot key stay apart
    return rows.join(following, [*keys, "shard"], "left").withColumn("until", F.coalesce("until", "_next")).drop("shard", "_next")


def to_quarters(facts: DataFrame, fields: list[str] | None = None, most: int = MOST_ROWS) -> DataFrame:
    """One row per ticker, field and calendar quarter from the first to the last quarter with a usable reading.

    Columns: ticker, field, cal_quarter ('2019Q3'), value (latest reading made in the quarter, NULL if none), is_missing
    (no part of the quarter is covered by a reading made in it), filled_value (the value in force at the quarter's end), n_readings (distinct instants),
    time_weighted (mean of the step function over the covered part), coverage (covered share of the quarter: below 1 only
    where the first reading falls inside it) and fresh_coverage (share covered by readings made in the quarter). Unusable rows are ignored; ties at one instant go to the greatest
    period_end, then fact_id; repeated rows count once; empty input gives an empty result.
    """
    rows = usable(facts, fields)
    steps = validity_intervals(one_per_instant(rows), KEYS, most, rows.select(*KEYS, "t"))
    q0 = quarter_of(F.col("t"))
    # the last cell a step touches: that of its last covered microsecond; an open step ends with the cell of its reading
    q1 = F.when(F.col("until").isNull(), q0).otherwise(quarter_of(F.col("until") - 1))
    pieces = steps.withColumn("_q0", q0).withColumn("q", F.explode(F.sequence(F.col("_q0"), q1)))
    start, end = quarter_start_us(F.col("q")), quarter_start_us(F.col("q") + 1)
    pieces = pieces.withColumn("_us", F.least(F.coalesce("until", end), end) - F.greatest("t", start)).withColumn("_own", F.col("q") == F.col("_q0"))
    cells = pieces.groupBy(*KEYS, "q").agg(
        F.max_by("value", F.when(F.col("_own"), F.col("t"))).alias("_own_value"),
        F.count(F.when(F.col("_own"), 1)).alias("n_readings"),
        F.coalesce(F.sum(F.when(F.col("_own"), F.col("_us"))), F.lit(0)).alias("_fresh"),
        F.max_by("value", "t").alias("filled_value"),
        F.sum(F.col("value") * F.col("_us")).alias("_area"),
        F.sum("_us").alias("_covered"),
    )
    width = quarter_start_us(F.col("q") + 1) - quarter_start_us(F.col("q"))
    return cells.select(
        *KEYS,
        quarter_label(F.col("q")).alias("cal_quarter"),
        F.when(F.col("_fresh") > 0, F.col("_own_value")).alias("value"),
        (F.col("_fresh") == 0).alias("is_missing"),
        "filled_value",
        "n_readings",
        (F.col("_area") / F.col("_covered")).alias("time_weighted"),
        (F.col("_covered") / width).alias("coverage"),
        (F.col("_fresh") / width).alias("fresh_coverage"),
    )
