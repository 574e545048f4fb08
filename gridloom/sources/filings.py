"""Company facts, filings and factor files: nested JSON and text into tidy point-in-time rows, as plans over offline files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "struct<end:string,val:double,filed:string,accn:string,fp:string,frame:string>"
FACTS = f"struct<facts:map<string,map<string,struct<units:map<string,array<{ENTRY}>>>>>>"

# Which reported concepts stand for a field, in order of preference, and whether it is a level or a yearly flow.
CONCEPTS = {
    "book_equity": ("level", ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]),
    "total_assets": ("level", ["Assets"]),
    "gross_profit": ("flow", ["GrossProfit"]),
}
# Fixed values: (revenue, cost) pairs whose difference is gross profit where that is not reported, in order.
GROSS_PROFIT_PAIRS = [
    ("Revenues", "CostOfGoodsAndServicesSold"),
    ("RevenueFromContractWithCustomerExcludingAssessedTax", "CostOfRevenue"),
    ("Revenues", "CostOfRevenue"),
    ("SalesRevenueNet", "CostOfGoodsSold"),
]
# Concepts of shares outstanding, in order.
SHARE_CONCEPTS = [("dei", "EntityCommonStockSharesOutstanding"), ("us-gaap", "CommonStockSharesOutstanding")]
# The sentinels for missing values in factor files, in percent.
MISSING = (-99.99, -999.0)

#: Days after a period's end at which a figure without filing date counts as public.
LAG_DAYS = 60


def entries(raw: DataFrame) -> DataFrame:
    """ticker, namespace, concept, unit, units_in_order, end, val, filed, accn, fp, frame from rows (ticker, json)."""
    parsed = raw.select("ticker", F.from_json("json", FACTS).alias("f"))
    spaces = parsed.select("ticker", F.explode("f.facts").alias("namespace", "concepts"))
    concepts = spaces.select("ticker", "namespace", F.explode("concepts").alias("concept", "node"))
    units = concepts.select("ticker", "namespace", "concept", F.posexplode(F.map_entries("node.units")).alias("unit_no", "u"))
    return units.select(
        "ticker", "namespace", "concept", "unit_no", F.col("u.key").alias("unit"), F.explode("u.value").alias("e")
    ).select("ticker", "namespace", "concept", "unit_no", "unit", "e.*")


def in_unit(rows: DataFrame, unit: str) -> DataFrame:
    """Entries in the wanted unit, or in a concept's first unit where it has none in that."""
    w = Window.partitionBy("ticker", "namespace", "concept")
    has = F.max(F.col("unit") == unit).over(w)
    return rows.withColumn("_has", has).where(F.when(F.col("_has"), F.col("unit") == unit).otherwise(F.col("unit_no") == 0)).drop("_has")


def available(lag_days: int = LAG_DAYS) -> Column:
    """Date a figure became public: its filing date, else the period's end and a lag."""
    return F.coalesce(F.try_to_timestamp(F.nullif(F.col("filed"), F.lit(""))).cast("date"), F.date_add(F.col("end").try_cast("date"), lag_days))


def is_annual() -> Column:
    return F.when(F.col("frame").isNotNull(), ~F.contains(F.col("frame"), F.lit("Q"))).otherwise(F.coalesce(F.col("fp") == "FY", F.lit(False)))


def earliest_disclosures(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each by, period end and value (to two decimals, half even) the earliest row: comparatives go, restatements stay."""
    w = Window.partitionBy(*by, "period_end", F.bround("value", 2)).orderBy("available_date", "value")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _first_with_data(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the least priority present in each group."""
    return rows.withColumn("_least", F.min("priority").over(Window.partitionBy(*by))).where("priority = _least").drop("_least")


def facts_table(raw: DataFrame, lag_days: int = LAG_DAYS) -> DataFrame:
    """ticker, field, available_date, value, period_end from rows (ticker, json).

    The first concept of a field that yields anything wins. Gross profit falls back to revenue less cost, paired only within
    one filing and period. Flows keep yearly figures. Malformed JSON yields nothing.
    """
    e = in_unit(entries(raw).where("namespace = 'us-gaap' and end is not null and val is not null"), "USD")
    table = [(f, kind, c, i) for f, (kind, cs) in CONCEPTS.items() for i, c in enumerate(cs)]
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), F.lit(c).alias("c"), F.lit(i).alias("priority")) for f, kind, c, i in table))
    direct = e.withColumn("p", F.explode(pairs)).where(F.col("p.c") == F.col("concept")).where((F.col("p.kind") == "level") | is_annual())
    direct = direct.select(
        "ticker", F.col("p.field").alias("field"), F.col("p.priority").alias("priority"), available(lag_days).alias("available_date"),
        F.col("val").alias("value"), F.col("end").alias("period_end")
    )
    legs = F.array(
        *(
            F.struct(F.lit(i).alias("priority"), F.lit(side).alias("side"), F.lit(c).alias("c")) for i,
            pair in enumerate(GROSS_PROFIT_PAIRS) for side, c in zip(("revenue", "cost"), pair, strict=True)
        )
    )
    yearly = e.where(is_annual()).withColumn("p", F.explode(legs)).where(F.col("p.c") == F.col("concept"))
    keys = ["ticker", "priority", "accn", "end"]
    one = yearly.select(
        "ticker", F.col("p.priority").alias("priority"), F.col("p.side").alias("side"), F.coalesce("accn", F.lit("")).alias("accn"), "end",
        "val", "filed", available(lag_days).alias("available_date")
    )
    one = one.groupBy(*keys, "side").agg(F.max(F.struct("available_date", "val")).alias("r"))
    both = one.where("side = 'revenue'").select(*keys, F.col("r").alias("a")).join(one.where("side = 'cost'").select(*keys, F.col("r").alias("b")), keys)
    derived = both.select(
        "ticker", F.lit("gross_profit").alias("field"), "priority", F.col("a.available_date").alias("available_date"),
        (F.col("a.val") - F.col("b.val")).alias("value"), F.col("end").alias("period_end")
    )
    derived = derived.join(direct.where("field = 'gross_profit'").select("ticker").distinct(), "ticker", "left_anti")
    rows = _first_with_data(direct.unionByName(derived), ["ticker", "field"]).drop("priority")
    return earliest_disclosures(rows, ["ticker", "field"])


def shares_table(raw: DataFrame, lag_days: int = LAG_DAYS) -> DataFrame:
    """ticker, available_date, shares: of one date the latest period's figure."""
    e = in_unit(entries(raw).where("end is not null and val is not null"), "shares")
    rank = F.coalesce(*(F.when((F.col("namespace") == ns) & (F.col("concept") == c), i) for i, (ns, c) in enumerate(SHARE_CONCEPTS)))
    rows = e.withColumn("priority", rank).where("priority is not null").select(
        "ticker", "priority", available(lag_days).alias("available_date"), F.col("val").alias("value"), F.col("end").alias("period_end")
    )
    kept = earliest_disclosures(_first_with_data(rows, ["ticker"]), ["ticker"])
    return kept.groupBy("ticker", "available_date").agg(F.max_by("value", F.struct("period_end", "value")).alias("shares"))


def resolve_ids(tickers: DataFrame, ids: DataFrame) -> DataFrame:
    """ticker, cik: the first spelling of the ticker (as is, '-' as '.', '.' as '-', without '-', without '.') that ids (ticker, cik) knows; NULL if none."""
    t = F.upper("ticker")
    # The spellings and their order, which decides between two that are known.
    variants = F.array(t, F.translate(t, "-", "."), F.translate(t, ".", "-"), F.translate(t, "-", ""), F.translate(t, ".", ""))
    tried = tickers.select("ticker", F.posexplode(variants).alias("_n", "_v"))
    known = ids.groupBy(F.upper("ticker").alias("_v")).agg(F.min("cik").alias("cik"))
    return tried.join(known, "_v", "left").groupBy("ticker").agg(F.min_by("cik", F.when(F.col("cik").isNotNull(), F.col("_n"))).alias("cik"))


def annual_reports(raw: DataFrame) -> DataFrame:
    """ticker, filing_date, accession, document of the 10-K filings in rows (ticker, json) of parallel arrays; filings without a document are left out."""
    kind = "struct<filings:struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>>>"
    r = raw.select("ticker", F.from_json("json", kind)["filings"]["recent"].alias("r"))
    z = r.select(
        "ticker",
        F.explode(
            F.arrays_zip(
                F.col("r.form").alias("form"), F.col("r.filingDate").alias("filed"), F.col("r.accessionNumber").alias("accession"),
                F.col("r.primaryDocument").alias("document")
            )
        ).alias("z")
    ).select("ticker", "z.*")
    return z.where("form = '10-K' and document <> ''").select(
        "ticker", F.col("filed").try_cast("date").alias("filing_date"), F.translate("accession", "-", "").alias("accession"), "document"
    )


def factor_file(lines: DataFrame) -> DataFrame:
    """date and one column per factor (decimals) from the lines (value) of a factor file in percent.

    The header is the first line that begins with ',' and names Mkt-RF; data lines begin with eight digits and have one
    value per column; others are ignored, sentinels are NULL. Without header: ValueError.
    """
    header = lines.where(F.ltrim("value").startswith(",") & F.contains(F.col("value"), F.lit("Mkt-RF"))).limit(1).collect()
    if not header:
        raise ValueError("no header line with Mkt-RF")
    names = [c.strip().lower().replace("-", "_") for c in header[0]["value"].split(",")[1:] if c.strip()]
    rows = lines.select(
        F.regexp_extract("value", r"^\s*(\d{8})\s*,", 1).alias("d"), F.regexp_extract("value", r"^\s*\d{8}\s*,(.*)$", 1).alias("rest")
    ).where("d <> ''")
    parts = F.filter(F.transform(F.split("rest", ","), lambda x: F.trim(x)), lambda x: x != "")
    whole = rows.withColumn("v", parts).where(F.size("v") == len(names))
    value = [F.col("v")[i].try_cast("double") for i in range(len(names))]
    return whole.select(
        F.try_to_timestamp("d", F.lit("yyyyMMdd")).cast("date").alias("date"),
        *(F.when(~v.isin(*MISSING), v / 100.0).alias(n) for v, n in zip(value, names, strict=True))
    ).where("date is not null")


def change_log(rows: DataFrame, pattern: str = "MMMM d, yyyy") -> DataFrame:
    """date, added, removed from scraped text rows (date, added, removed): dates read strictly (ValueError if any cannot be), 'nan' and 'None' as ''."""
    def name(c: str) -> Column:
        t = F.trim(F.coalesce(F.col(c), F.lit("")))
        return F.translate(F.when(t.isin("nan", "None"), "").otherwise(t), ".", "-").alias(c)

    out = rows.select(F.try_to_timestamp(F.trim("date"), F.lit(pattern)).cast("date").alias("date"), name("added"), name("removed"))
    if out.where("date is null").limit(1).count():
        raise ValueError("a date of the change log cannot be read")
    return out.where("added <> '' or removed <> ''")


def json_files(spark: SparkSession, pattern: str) -> DataFrame:
    """ticker (file stem), json of whole files."""
    return spark.read.text(pattern, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1).alias("ticker"), F.col("value").alias("json")
    )
