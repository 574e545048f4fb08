"""Items into containers of fixed capacity: best fit planned over a histogram of lengths.

Only the counts of lengths reach the driver (at most capacity + 1 of them). The plan places counts, not documents: for
each length, from long to short, runs of containers take so many items each. Documents then take their places by their
rank among the items of their length, which is a lookup of (length, rank) in the plan.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.engine.session import checkpoint
from gridloom.llm.words import distinct_texts, slices, spread
from gridloom.operators.columns import pick

# Fixed value: how the public byte-level vocabulary splits texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

KINDS_AT_ONCE = 100  # kinds of containers that are planned together
RANK_ROWS = 50_000  # items of one length that one task ranks, about
#: A run of blanks as long as this is merged on its own: the library's regular expression runs out of stack on very long ones.
LONGEST_RUN = 5_000
# The characters with Unicode's White_Space property.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_BLANK}]{{{LONGEST_RUN},}}")


@lru_cache(maxsize=2)
def encoding_of(vocabulary: bytes):
    """The tokenizer of a vocabulary file's bytes; built once a process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("gridloom", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str):
    with open(path, "rb") as f:
        return encoding_of(f.read())


def token_count(text: str | None, encoding) -> int:
    """Tokens of a whole text. Before a long run of blanks a pre-token always ends, and the run without its last blank is one
    pre-token (with it at the end of the text), so the text may be cut there without changing the count."""
    if not text:
        return 0
    if len(text) < LONGEST_RUN:
        return len(encoding.encode_ordinary(text))
    total = start = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[start : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        start = end
    return total + len(encoding.encode_ordinary(text[start:]))


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every document, whole texts; NULL and empty texts have 0 tokens. The driver reads the vocabulary (some megabytes) and sends it to the tasks."""
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(shared.value)
        for batch in batches:
            texts, place = distinct_texts(batch.column(1))
            sizes = np.array([token_count(t, encoding) for _, _, some in slices(texts) for t in some], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes[place])], names=["doc_id", "n_tokens"])

    return spread(pick(documents, {"doc_id": "doc_id", "text": "text"})).mapInArrow(run, "doc_id long, n_tokens long")


@dataclass
class Plan:
    """Items of one length, in rank order, fill runs of containers. Arrays are ordered by place = items of shorter lengths + rank."""

    first_place: np.ndarray  # by length: place of rank 0
    from_place: np.ndarray  # by run
    base: np.ndarray  # first container of the run
    each: np.ndarray  # items per container
    bins: int

    def container(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        place = self.first_place[length] + rank
        run = np.searchsorted(self.from_place, place, side="right") - 1
        return self.base[run] + (place - self.from_place[run]) // self.each[run]


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts: the same containers as best fit over single items from long to short.

    Containers with the same room form runs; a length is placed into the run with the least room that holds it, as often
    as it fits, before new containers are opened. Items of length 0 are spread evenly over all containers.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first container, how many)
    rooms: list[int] = []  # ascending, those with runs
    bins = 0
    runs: list[tuple[int, int, int, int]] = []  # length, first container, items each, items

    def free(left: int, base: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((base, count))

    for length in sorted((k for k, v in histogram.items() if k > 0 and v > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"length {length} exceeds the capacity {capacity}")
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                space = rooms[at]
                base, count = room[space].pop()
                if not room[space]:
                    del room[space]
                    rooms.pop(at)
            else:
                space, base, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            fit = space // length
            full = min(count, left // fit)
            if full:
                runs.append((length, base, fit, full * fit))
                free(space - fit * length, base, full)
                left -= full * fit
            base, count = base + full, count - full
            if count and left:  # fewer than fit items are left: one container takes them
                runs.append((length, base, left, left))
                free(space - left * length, base, 1)
                base, count, left = base + 1, count - 1, 0
            free(space, base, count)
    if empty := histogram.get(0, 0):
        bins = max(bins, 1)
        runs.append((0, 0, -(-empty // bins), empty))
    counts = np.zeros(capacity + 2, np.int64)
    for k, v in histogram.items():
        counts[k + 1] = v
    first = np.cumsum(counts)
    runs.sort(key=lambda r: r[0])  # stable: within a length in the order of placement
    items = np.array([r[3] for r in runs], np.int64)
    return Plan(
        first[:-1], np.concatenate(([0], np.cumsum(items)))[:-1], np.array([r[1] for r in runs], np.int64),
        np.array([r[2] for r in runs], np.int64), bins
    )


def container_list(containers: DataFrame) -> list[tuple[str, int]]:
    rows = pick(containers, {"container": "container", "capacity": "capacity_tokens"}).where("container is not null and capacity > 0").distinct().collect()
    return sorted((r["container"], int(r["capacity"])) for r in rows)


SCHEMA = "container string, capacity long, bin long, doc_id long, piece int, token_from long, n_tokens long"


def pack(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """container, capacity, bin, doc_id, piece, token_from, n_tokens: where every document goes, for each kind of container.

    A document longer than the capacity is cut into full pieces and a rest; no other is cut. NULL and empty texts have 0
    tokens and a place in some bin. Containers without name or with a capacity of 0 or less are ignored; no containers or
    no documents give an empty result. Token counts are made once and cut the lineage; what one task ranks are about
    RANK_ROWS items of one length, also where a third of all documents has the same length. Kinds of containers are
    planned KINDS_AT_ONCE at a time, as a plan has an entry per kind and length.
    """
    kinds = container_list(containers)
    sizes = checkpoint(count_tokens(documents, vocabulary))
    if not kinds:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, (packed(sizes, kinds[a : a + KINDS_AT_ONCE]) for a in range(0, len(kinds), KINDS_AT_ONCE)))


def packed(sizes: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """pack() of counted documents (doc_id, n_tokens) for some kinds (container, capacity)."""
    spark = sizes.sparkSession
    each = F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(c).cast("long").alias("capacity")) for i, (_, c) in enumerate(kinds)))
    wide = sizes.select("doc_id", "n_tokens", F.inline(each))
    full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0)
    full = F.when((F.col("n_tokens") > F.col("capacity")) & (F.col("n_tokens") % F.col("capacity") == 0), full - 1).otherwise(full).cast("long")
    wide = wide.withColumn("full", full).withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity"))
    counted = wide.groupBy("kind", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()
    histograms: list[dict[int, int]] = [{} for _ in kinds]
    for r in counted:
        h, c = histograms[r["kind"]], kinds[r["kind"]][1]
        h[r["rest"]] = h.get(r["rest"], 0) + r["n"]
        if r["full"]:
            h[c] = h.get(c, 0) + r["full"]
    plans = [best_fit(h, c) for h, (_, c) in zip(histograms, kinds, strict=True)]
    shared = spark.sparkContext.broadcast(plans)  # at most a few entries per length up to the capacity
    parts = max(1, -(-max((v for h in histograms for v in h.values()), default=1) // RANK_ROWS))
    pieces = wide.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full").cast("int"))))
    length = F.when(F.col("piece") < F.col("full"), F.col("capacity")).otherwise(F.col("rest"))
    pieces = pieces.select("kind", "doc_id", "piece", length.alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int").alias("part"))
    keys = ["kind", "n_tokens", "part"]
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "piece")) - 1)
    if parts > 1:
        per = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("kind", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        ranked = ranked.join(offsets, keys).withColumn("rank", F.col("rank") + F.col("_before")).drop("_before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "n_tokens", "rank"))
            bins = np.zeros(len(kind), np.int64)
            for k in np.unique(kind):
                own = kind == k
                bins[own] = shared.value[k].container(length[own], rank[own])
            capacity = np.array([c for _, c in kinds], np.int64)[kind]
            names = pa.array([n for n, _ in kinds]).take(pa.array(kind))
            piece = batch.column("piece")
            start = piece.to_numpy(zero_copy_only=False).astype(np.int64) * capacity
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(capacity), pa.array(bins), batch.column("doc_id"), piece, pa.array(start), pa.array(length)],
                names=["container", "capacity", "bin", "doc_id", "piece", "token_from", "n_tokens"]
            )

    return ranked.select("kind", "n_tokens", "rank", "doc_id", "piece").mapInArrow(run, SCHEMA)


def fill(packed: DataFrame) -> DataFrame:
    """container, capacity, bins, items, used_tokens, unused_share of a packing."""
    per = packed.groupBy("container", "capacity", "bin").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    out = per.groupBy("container", "capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("items").alias("items"), F.sum("used").alias("used_tokens"))
    return out.withColumn("unused_share", F.round(1 - F.col("used_tokens") / (F.col("bins") * F.col("capacity")), 6))
