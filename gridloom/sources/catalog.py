"""A catalog of named tables with the derived panels that signals share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import panel as P
from gridloom.operators import universe as U
from gridloom.operators.columns import pick, symbol
from gridloom.sources.stored import build_once
from gridloom.sources.tables import table


class Catalog:
    """Lazy facade over prices, membership, fundamentals and listings; nothing is read before a plan runs."""

    def __init__(self, spark: SparkSession, folder: str | None = None, tail: int = 0, **tables: DataFrame) -> None:
        self.spark, self.folder, self.tail, self._tables = spark, folder, tail, tables

    def table(self, name: str) -> DataFrame:
        if name in self._tables:
            return self._tables[name]
        if self.folder is None:
            raise KeyError(f"no table {name!r}")
        return table(self.spark, self.folder, name)

    @cached_property
    def panel(self) -> DataFrame:
        """ticker, pos, day, close, adj, volume over each ticker's life."""
        return P.price_panel(self.table("prices"), self.tail, days=self.days)

    @cached_property
    def days(self) -> DataFrame:
        return P.trading_days(self.table("prices"))

    def stored_panel(self, folder: str, rebuild: bool = False) -> DataFrame:
        """The panel, written to ``folder`` once and read from there until a price file changes; it becomes this catalog's panel."""
        self.panel = build_once(self.table("prices"), folder, f"panel-{self.tail}", lambda _: Catalog(self.spark, self.folder, self.tail, **self._tables).panel, rebuild)
        return self.panel

    def returns(self, kind: str = "log", pad_gaps: bool = False) -> DataFrame:
        return P.returns(self.panel, kind, pad_gaps=pad_gaps)

    @cached_property
    def market(self) -> DataFrame:
        """day, market: log return of the index table if there is one, else of the mean price."""
        index = self._tables.get("index")
        return P.market_return(index if index is not None else P.average_index(self.panel), self.days)

    @cached_property
    def periods(self) -> DataFrame:
        return U.periods(self.table("membership"))

    @cached_property
    def sectors(self) -> DataFrame:
        """ticker, sector; of repeated listings the least sector name, NULL sectors left out."""
        rows = pick(self.table("listings"), {"ticker": "ticker", "sector": "sector"}).select(symbol("ticker").alias("ticker"), "sector")
        return rows.where("ticker is not null and sector is not null").groupBy("ticker").agg(F.min("sector").alias("sector"))

    @cached_property
    def vectors(self) -> DataFrame:
        """ticker, filing_date, vec: the table ``vectors`` if there is one, else the embeddings of the documents with a ticker and a filing date (vec_id is the document's id)."""
        if "vectors" in self._tables:
            return self._tables["vectors"]
        filed = pick(self.table("documents"), {"id": "doc_id", "ticker": "ticker", "filing_date": "filed_at"})
        filed = filed.select("id", symbol("ticker").alias("ticker"), F.to_date("filing_date").alias("filing_date")).where("ticker is not null and filing_date is not null")
        own = pick(self.table("embeddings"), {"id": "vec_id", "vec": "embedding"}).select("id", F.col("vec").cast("array<double>").alias("vec"))
        return filed.join(own, "id").select("ticker", "filing_date", "vec")

    def known(self, field: str, panel: DataFrame | None = None) -> DataFrame:
        return P.facts_on_calendar(self.panel if panel is None else panel, self.table("fundamentals"), field)

    def capped(self, rows: DataFrame, asof: bool = True) -> DataFrame:
        """rows with ``cap``."""
        return P.market_cap(rows, self.table("fundamentals"), asof=asof)

    def market_cap(self, asof: bool = True) -> DataFrame:
        return self.capped(self.panel, asof)
