"""Attributes as known at event time: a backward as-of join whose hot keys are merged in independent time shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.engine.session import checkpoint
from gridloom.operators.columns import field_name, micros, named, pick, present, symbol
from gridloom.operators.readings import one_per_instant, usable
from gridloom.operators.sharding import MOST_ROWS, before_shards, plan_shards

KEYS = ["ticker", "field"]


def asof_join(
    events: DataFrame, versions: DataFrame, keys: list[str], carry: list[str], most: int = MOST_ROWS, sizes: DataFrame | None = None
) -> DataFrame:
    """Each event with the columns ``carry`` of its key's last version at or before it.

    events: keys, t (long) and any other columns; versions: keys, t, carry, one row per key and t. Keys with more
    than ``most`` rows of both sides are cut into time shards; each shard gets a copy of the last version before it, and
    every (key, shard) is merged on its own by one sorted window. Where more than ``most`` events share a key and a
    microsecond they are spread over salted parts of that shard, each with its own copy. Events with a NULL key or time keep
    NULL in ``carry``; each of them is a group of its own, so NULL keys cannot form a hot group. ``sizes`` (keys, t), cheaper to
    read and with at least as many rows, may stand for both sides where shards are planned.
    """
    rest = [c for c in events.columns if c not in keys and c != "t"]
    whole = F.lit(True)
    for k in [*keys, "t"]:
        whole &= F.col(k).isNotNull()
    left = events.select(
        *keys, "t", F.lit(1).alias("_side"), F.struct(*rest).alias("_event"),
        F.lit(None).cast(versions.select(F.struct("t", *carry).alias("s")).schema["s"].dataType).alias("_known")
    )
    right = versions.select(
        *keys, "t", F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_event"].dataType).alias("_event"),
        F.struct("t", *carry).alias("_known")
    )
    sizes = left.where(whole).select(*keys, "t").unionByName(right.select(*keys, "t")) if sizes is None else sizes
    plan = plan_shards(sizes, keys, "t", most)
    both = plan.assign(left.unionByName(right), "t")
    # an event without key or time is a group of its own: it meets no version
    both = both.withColumn("shard", F.when(whole, F.col("shard")).otherwise(F.xxhash64("_event")))
    # the version of a full microsecond stays in its part 0, which comes before the others
    part = F.when((F.col("salts") > 1) & (F.col("_side") == 1), 1 + F.pmod(F.xxhash64("_event"), "salts")).otherwise(0)
    groups = [*keys, "shard"]
    if plan.hot is not None:
        both = both.withColumn("part", part.cast("long"))
        groups = [*groups, "part"]
        # one row per shard of a hot key, used several times below
        parts = checkpoint(plan.hot_rows(both.where(whole)).groupBy(*groups).agg(F.max("_known").alias("_last")))
        carried = before_shards(parts, keys, "_last", ["shard", "part"]).where("carried is not null").select(
            *groups, F.lit(None).cast("long").alias("t"), F.lit(0).alias("_side"),
            F.lit(None).cast(left.schema["_event"].dataType).alias("_event"), F.col("carried").alias("_known")
        )
        both = both.drop("salts").unionByName(carried)
    w = Window.partitionBy(*groups).orderBy(F.col("t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("_known", F.last("_known", ignorenulls=True).over(w)).where("_side = 1")
    return merged.select(
        *keys, "t", *(F.col(f"_event.`{c}`").alias(c) for c in rest), F.col("_known.t").alias("known_t"),
        *(F.col(f"_known.`{c}`").alias(c) for c in carry)
    )


def known_at_decision(decisions: DataFrame, facts: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Each distinct decision with the fundamentals value that was public at decided_at.

    Columns: event_id, ticker, field, decided_us, used_value, known_value, known_fact_id, known_us. Only usable readings
    count; among readings of one instant the greatest period_end, then fact_id. Decisions before any reading, or with a
    NULL ticker, field or time, have NULL known columns. Repeated decisions count once.
    """
    raw = pick(decisions, {c: c for c in ("event_id", "ticker", "decided_at", "field", "used_value")})
    at = [symbol("ticker").alias("ticker"), field_name("field").alias("field"), micros(F.col("decided_at").cast("timestamp_ntz")).alias("t")]
    rows = usable(facts)
    sizes = rows.select(*KEYS, "t").unionByName(raw.where(named("ticker") & named("field") & F.col("decided_at").isNotNull()).select(*at))
    events = raw.select("event_id", *at, present("used_value").alias("used_value")).dropDuplicates()
    versions = one_per_instant(rows).select(*KEYS, "t", F.col("value").alias("known_value"), F.col("fact_id").alias("known_fact_id"))
    out = asof_join(events, versions, KEYS, ["known_value", "known_fact_id"], most, sizes)
    return out.select("event_id", *KEYS, F.col("t").alias("decided_us"), "used_value", "known_value", "known_fact_id", F.col("known_t").alias("known_us"))


def disagreements(known: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Decisions where exactly one of used and known value is missing, or both are present and differ by more than ``tolerance``."""
    u, k = F.col("used_value"), F.col("known_value")
    return known.where((u.isNull() != k.isNull()) | (u.isNotNull() & k.isNotNull() & (u != k) & (F.abs(u - k) > tolerance)))
