"""Attribute-value rows into wide, typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.columns import field_name, named, pick, symbol
from gridloom.operators.readings import latest, usable

TYPES = ("double", "bigint", "boolean", "date")


def attribute_list(types: DataFrame) -> list[tuple[str, str]]:
    """(field, type) in order of field; repeated fields keep their least type name, NULL fields are ignored.

    One entry per column of the wide table: the list is its schema, which the driver holds in any case.
    """
    rows = pick(types, {"field": "field", "kind": "sql_type"}).select(field_name("field").alias("field"), F.lower(F.btrim(F.col("kind"))).alias("kind"))
    found = rows.where("field is not null").groupBy("field").agg(F.min("kind").alias("kind")).orderBy("field").collect()
    if bad := [r["field"] for r in found if r["kind"] not in TYPES]:
        raise ValueError(f"unknown type of {bad}")
    return [(r["field"], r["kind"]) for r in found]


def typed(value: Column, kind: str) -> Column:
    """Try-cast of a double: NULL where the value does not suit the type.

    double: any; bigint: whole numbers from -2^63 to below 2^63; boolean: 0 or 1; date: whole numbers that read as a real
    yyyymmdd of the years 1 to 9999 (10530 is the 30th of May of year 1).
    """
    if kind == "double":
        return value
    whole = (value % F.lit(1.0) == 0) & (value >= F.lit(-(2.0**63))) & (value < F.lit(2.0**63))
    number = F.when(whole, value.try_cast("bigint"))
    if kind == "bigint":
        return number
    if kind == "boolean":
        return F.when(value == 1, True).when(value == 0, False)
    if kind == "date":
        text = F.lpad(number.cast("string"), 8, "0")
        iso = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
        return F.when((number >= 10_101) & (number <= 99_991_231), iso.try_cast("date"))
    raise ValueError(kind)


def attribute_arrays(facts: DataFrame, attributes: list[tuple[str, str]]) -> DataFrame:
    """ticker, cells: array of (pos, value, fact_id), one element per attribute, sorted by position.

    The entity-by-attribute grid is completed by exploding the attribute list of each ticker (its size is the number of
    columns), the latest usable readings are left joined, and every ticker's cells are gathered: as many as attributes.
    """
    places = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field")) for i, (f, _) in enumerate(attributes)))
    tickers = pick(facts, {"ticker": "ticker"}).where(named("ticker")).select(symbol("ticker").alias("ticker")).distinct()
    grid = tickers.select("ticker", F.inline(places))
    filled = grid.join(latest(usable(facts)), ["ticker", "field"], "left")
    return filled.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("pos", "value", "fact_id"))).alias("cells"))


def widen(facts: DataFrame, types: DataFrame) -> DataFrame:
    """One row per ticker of the facts (also those without a usable reading), one typed column per field of ``types``.

    A cell holds the latest usable reading of ticker and field; if that does not suit the type, or there is none, the
    cell is NULL. Fields that ``types`` does not name are ignored; an empty ``types`` gives tickers only.
    """
    attributes = attribute_list(types)
    if not attributes:
        return pick(facts, {"ticker": "ticker"}).where(named("ticker")).select(symbol("ticker").alias("ticker")).distinct()
    rows = attribute_arrays(facts, attributes)
    return rows.select("ticker", *(typed(F.col("cells")[i]["value"], kind).alias(f) for i, (f, kind) in enumerate(attributes)))


def filled_cells(facts: DataFrame, types: DataFrame) -> DataFrame:
    """ticker, field, fact_id of the filled cells of widen()."""
    attributes = attribute_list(types)
    if not attributes:
        return facts.sparkSession.createDataFrame([], "ticker string, field string, fact_id long")
    names = F.lit([f for f, _ in attributes])
    cells = F.col("cells")

    def of_kind(kind: str) -> Column:
        places = F.lit([i for i, (_, k) in enumerate(attributes) if k == kind])
        return F.transform(
            places, lambda i: F.struct(
                F.get(names, i).alias("field"), F.get(cells, i)["fact_id"].alias("fact_id"),
                typed(F.get(cells, i)["value"], kind).isNotNull().alias("filled")
            )
        )

    # one cast per type over the fixed positions of its columns, so the plan stays as small for thousands of columns
    each = F.concat(*(of_kind(kind) for kind in TYPES if any(k == kind for _, k in attributes)))
    return attribute_arrays(facts, attributes).select("ticker", F.inline(each)).where("filled").drop("filled")
