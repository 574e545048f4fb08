"""Queries of the text problems (p7 to p9), each over whole tables and whole texts, and their SQL.

No query here has SQL: tokenising and compatibility folding are not expressible there. The tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.leakage import leaked_items
from gridloom.llm.packing import fill, pack
from gridloom.llm.repetition import ablations, apply_policy, ledger_once
from gridloom.sources.tables import table


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(p7_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), least_share=0.4).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return apply_policy(ledger_once(table(spark, d, "documents")), "passages_v1").select("doc_id").distinct()


def p9_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger_once(table(spark, d, "documents"))


def p9_ablations(spark: SparkSession, d: str) -> DataFrame:
    return ablations(ledger_once(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p7_packed, p7_fill, p8_found, p8_spans, p9_found, p9_ledger, p9_ablations)
}
SQL: dict[str, str] = {}
