"""Similarity of embedding vectors: nearest neighbours in blocks, point-in-time stores, neighbour signals."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.engine.session import checkpoint

#: Queries are searched in blocks of about this many bytes of float64, so what the driver and a task hold of them is bounded.
BLOCK_BYTES = 32_000_000
#: Rows and queries of one product; a tile of similarities is 8 MB.
TILE_ROWS, TILE_QUERIES = 1_024, 1_024


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def keep_best(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row of sim (and their ids), ties to the smaller id, in no order. Only rows with a tie at the k-th place are sorted whole."""
    if sim.shape[1] <= k:
        return sim, ids
    at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    best, who = np.take_along_axis(sim, at, axis=1), np.take_along_axis(ids, at, axis=1)
    least = best.min(axis=1, keepdims=True)
    tied = np.flatnonzero((least[:, 0] > -np.inf) & ((sim == least).sum(axis=1) > (best == least).sum(axis=1)))
    if len(tied):
        order = np.lexsort((ids[tied], -sim[tied]), axis=1)[:, :k]
        best[tied], who[tied] = np.take_along_axis(sim[tied], order, axis=1), np.take_along_axis(ids[tied], order, axis=1)
    return best, who


def search(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """The k best rows of the batches for each unit query, as (src, dst, similarity): products tile by tile, k kept per query."""
    best_sim, best_id = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(start, TILE_ROWS)
            own = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            unit = unit_rows(matrix_of(part.column(1))).T
            for a in range(0, len(ids), TILE_QUERIES):
                some = slice(a, a + TILE_QUERIES)
                sim = np.clip(q[some] @ unit, -1, 1).round(12)
                sim[(ids[some, None] == own[None, :]) | (sim < least)] = -np.inf
                if (sim > -np.inf).any():
                    found, who = keep_best(sim, np.broadcast_to(own, sim.shape), k)
                    found, who = np.concatenate((best_sim[some], found), axis=1), np.concatenate((best_id[some], who), axis=1)
                    best_sim[some], best_id[some] = keep_best(found, who, k)
    i, j = np.nonzero(best_sim > -np.inf)
    if len(i):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(best_id[i, j]), pa.array(best_sim[i, j])], names=["src", "dst", "similarity"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, least: float = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """src, dst, similarity: for each query (id, vec) its k most similar other rows of vectors (id, vec) by cosine, those below ``least`` dropped.

    Ties go to the smaller id; NULL vectors and vectors of another length than the first query's are left out. The query
    set, which callers state (ids divisible by 100, or one snapshot's names), is cut into blocks of at most ``block_bytes``;
    a block goes to every partition of the vectors, which keeps its own k best per query, and the k x partitions
    candidates of a query are ranked: no pair of rows is emitted beyond those and the vectors are never shuffled. With
    several blocks each one's answer is written to the checkpoint folder and the block is dropped before the next is read,
    so the driver holds one block whatever the number of queries. A pass over the vectors costs far less than the products
    of a block with all of them (2 x dimensions operations a pair for half a byte read at 65,000 queries of 64 dimensions).
    """
    spark = vectors.sparkSession
    asked = queries.where("id is not null and vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.size("vec"), "id").alias("width")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "src long, dst long, similarity double")
    width = shape["width"]

    def whole(df: DataFrame) -> DataFrame:
        return df.where((F.size("vec") == width) & ~F.exists("vec", lambda v: v.isNull()))

    rows = whole(vectors.where("id is not null").select("id", F.col("vec").cast("array<double>").alias("vec")))
    asked = whole(asked)
    blocks = max(1, -(-shape["n"] * width * 8 // block_bytes))
    out = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else asked
        held = part.toArrow()  # at most about block_bytes
        if not held.num_rows:
            continue
        shared = spark.sparkContext.broadcast((held.column(0).to_numpy().astype(np.int64), unit_rows(matrix_of(held.column(1).combine_chunks()))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from search(batches, *shared.value, k, least)

        w = Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst")
        found = rows.mapInArrow(run, "src long, dst long, similarity double").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
        if blocks > 1:
            found = checkpoint(found)
            shared.destroy()  # the block's answer is written: no task can ask for it again
        out.append(found)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "src long, dst long, similarity double")


def wide_to_vectors(rows: DataFrame, prefix: str = "emb_") -> DataFrame:
    """ticker, filing_date and columns prefix0, prefix1, ... (in numerical order) as one array column ``vec``."""
    columns = sorted((c for c in rows.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return rows.select("ticker", "filing_date", F.array(*(F.col(f"`{c}`").cast("double") for c in columns)).alias("vec"))


def vectors_as_of(store: DataFrame, day: str, members: DataFrame | None = None) -> DataFrame:
    """ticker, filing_date, vec of each ticker's latest filing on or before the day: one combinable aggregate; of several on one day the greatest vector."""
    known = store.where(F.col("filing_date") <= F.lit(day).cast("date"))
    known = known if members is None else known.join(members, "ticker", "left_semi")
    return known.groupBy("ticker").agg(F.max(F.struct("filing_date", "vec")).alias("_r")).select("ticker", "_r.filing_date", "_r.vec")


def coverage(store: DataFrame, members: DataFrame) -> DataFrame:
    """checkpoint, n_universe, n_covered, coverage for members (checkpoint, ticker): names with a filing on or before the checkpoint."""
    first = store.groupBy("ticker").agg(F.min("filing_date").alias("_first"))
    j = members.distinct().join(first, "ticker", "left")
    a = j.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("n_universe"), F.count(F.when(F.col("_first") <= F.col("checkpoint"), 1)).alias("n_covered"))
    return a.withColumn("coverage", F.try_divide("n_covered", "n_universe"))


def embedded(
    texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], id_columns: tuple[str, ...] = ("ticker", "filing_date"),
    text: str = "text"
) -> DataFrame:
    """id columns and ``vec`` of texts. ``encoder()`` is called once per task and gives a function from a batch of texts to a matrix, so a model is loaded once.

    NULL texts count as empty; the encoder gets whole texts.
    """
    kinds = ", ".join(f"`{c}` {dict(texts.dtypes)[c]}" for c in id_columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            if not batch.num_rows:
                continue
            encode = encode or encoder()
            x = np.asarray(encode([t or "" for t in batch.column(text).to_pylist()]), np.float64)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in id_columns), flat], names=[*id_columns, "vec"])

    return texts.select(*id_columns, text).mapInArrow(run, f"{kinds}, vec array<double>")


class HashedWords:
    """A plain encoder: signed counts of hashed words, of unit length. Stands in where no model is at hand."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.width] += 1 if h >> 31 else -1
        return unit_rows(out)


def neighbour_signal(edges: DataFrame, recent: DataFrame, least: int = 2) -> DataFrame:
    """src, value: mean recent return of a node's neighbours weighted by edge weight, over the neighbours that have one.

    edges: src, dst, weight; recent: ticker, mean_ret. Fewer than ``least`` nodes in both give nothing.
    """
    common = edges.select(F.col("src").alias("ticker")).union(edges.select("dst")).distinct().join(recent, "ticker", "left_semi")
    if common.limit(least).count() < least:
        return edges.select("src", F.lit(None).cast("double").alias("value")).limit(0)
    own = edges.join(recent.select(F.col("ticker").alias("dst"), "mean_ret"), "dst").join(recent.select(F.col("ticker").alias("src")), "src", "left_semi")
    return own.groupBy("src").agg(F.try_divide(F.sum(F.col("weight") * F.col("mean_ret")), F.sum("weight")).alias("value"))


def item_one(text: F.Column) -> F.Column:
    """The business section of a filing: tags dropped, blanks collapsed, what follows 'item 1. business' up to 'item 1a' or 'item 2'; NULL without one."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"(?U)\s+", " "))
    found = F.regexp_extract(plain, r"(?is)item\s*1\s*\.?\s*(?:-|:)?\s*business(.*?)(?:item\s*1a\b|item\s*2\b|$)", 1)
    return F.nullif(F.trim(found), F.lit(""))
