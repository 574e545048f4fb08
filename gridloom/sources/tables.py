"""Readers and writers: tables of a data folder, price files per ticker, the usual formats, reports."""

from __future__ import annotations

import html

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json", "text")
PRICE_FIELDS = ("open", "high", "low", "close", "adj close", "volume")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A file or folder in one of FORMATS; a schema saves the pass that would infer it."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    reader = spark.read.options(**({"header": "true"} | options if kind == "csv" else options))
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Write in one of FORMATS, partitioned by columns if given."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    writer = df.write.mode(mode).format(kind)
    writer = writer.option("header", "true") if kind == "csv" else writer
    (writer.partitionBy(*by) if by else writer).save(path)


def price_files(spark: SparkSession, folder: str, fields: tuple[str, ...] = PRICE_FIELDS) -> DataFrame:
    """ticker (file stem), date and the fields of a folder with one parquet file (or folder of parts) per ticker, all read in one scan.

    Column names are compared in lower case. No file: FileNotFoundError; a field that no file has: KeyError.
    """
    try:
        raw = spark.read.option("mergeSchema", "true").parquet(f"{folder}/*.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no price file in {folder}") from None
    known = {}
    for c in raw.columns:
        known.setdefault(c.lower(), []).append(c)
    missing = [f for f in ("date", *fields) if f not in known]
    if missing:
        raise KeyError(f"no column {missing} in the price files")
    ticker = F.regexp_extract(F.input_file_name(), r"/([^/]+?)\.parquet(?:/[^/]*)?$", 1)
    return raw.select(F.url_decode(ticker).alias("ticker"), *(F.coalesce(*(F.col(f"`{c}`") for c in known[f])).alias(f) for f in ("date", *fields)))


def shares_long(wide: DataFrame, date: str = "available_date") -> DataFrame:
    """ticker, date, shares of a wide table with one column per ticker."""
    names = [c for c in wide.columns if c != date]
    return wide.unpivot([date], names, "ticker", "shares").where("shares is not null")


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text where Spark writes its tables."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def report(tables: dict[str, DataFrame], folder: str, title: str = "Report", most: int = 1000) -> str:
    """Write each table as CSV, whole, and one HTML page that shows the first ``most`` rows of each; returns the page's path. For summary tables."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        shown = df.limit(most + 1).collect()
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in shown[:most])
        more = f"<p>The first {most} rows; all are in {html.escape(name)}.</p>" if len(shown) > most else ""
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>{more}")
    path = f"{folder}/report.html"
    save_text(next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession(), path, "".join(parts))
    return path
