"""Repetition inside single documents: a ledger of rules, one bit each, and versioned policies over it.

Every rule is evaluated once per document; the ledger keeps its measurement and, in a bitmask, whether it fails. A policy
is a mask of rules, so applying another version or asking what one rule alone removes reads the ledger only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.engine.session import ensure_checkpoint_dir
from gridloom.llm.words import Words, distinct_texts, encode, slices, spread
from gridloom.operators.columns import pick


@dataclass(frozen=True)
class Rule:
    """The document fails if its measurement is at or above ``least``."""

    name: str
    measure: str
    least: float


#: The bit of a rule is its place in this list; append only, so that stored ledgers stay readable.
RULES = (
    Rule("repeated_8_words", "window_8", 0.40),
    Rule("repeated_lines", "lines", 0.30),
    Rule("repeated_paragraphs", "paragraphs", 0.30),
    Rule("repeated_sentences", "sentences", 0.30),
    Rule("top_2_words", "top_2", 0.20),
    Rule("top_3_words", "top_3", 0.18),
    Rule("top_4_words", "top_4", 0.16),
)
POLICIES = {
    "passages_v1": ("repeated_8_words",),
    "layout_v1": ("repeated_lines", "repeated_paragraphs", "repeated_sentences"),
    "strict_v1": tuple(r.name for r in RULES),
}
MEASURES = tuple(dict.fromkeys(r.measure for r in RULES))


def mask_of(policy: str) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit integers (a bijection)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_keys(words: Words, document: np.ndarray, lengths: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length: positions where a window of so many words of one document begins, and 64-bit keys of (document, window)."""
    n = len(words.codes)
    have = {1: _mixed(words.codes.astype(np.uint64) + np.uint64(1))}

    def hashed(length: int) -> np.ndarray:
        if length not in have:
            left, right = length // 2, length - length // 2
            x, y = hashed(left), hashed(right)
            m = max(0, n - length + 1)
            have[length] = x[:m] * np.uint64(pow(_BASE, right, 2**64)) + y[left : left + m]
        return have[length]

    own = _mixed(document.astype(np.uint64) + np.uint64(1 << 40))
    out = {}
    for length in lengths:
        z = hashed(length)
        at = np.flatnonzero(document[: len(z)] == document[length - 1 : length - 1 + len(z)])
        out[length] = (at, _mixed(z[at]) ^ own[at])
    return out


def earlier(at: np.ndarray, keys: np.ndarray, codes: np.ndarray, length: int) -> np.ndarray:
    """Those positions whose window also begins at an earlier place of the same document. Equal keys are held against the words themselves."""
    if not len(at):
        return at
    order = np.argsort(keys)
    k = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    sizes = np.diff(np.append(heads, len(k)))
    if (sizes == 1).all():
        return at[:0]
    places = at[order]
    first = np.repeat(np.minimum.reduceat(places, heads), sizes)
    later = places != first
    places, first = places[later], first[later]
    alike = np.ones(len(places), bool)
    for j in range(length):
        alike &= codes[places + j] == codes[first + j]
    if not alike.all():  # different windows under one key: compare the words of that group one by one
        wrong = np.isin(first, first[~alike])
        seen: set[tuple] = set()
        again = []
        for p in np.sort(np.concatenate((places[wrong], np.unique(first[wrong])))):
            t = tuple(codes[p : p + length].tolist())
            again += [p] if t in seen else []
            seen.add(t)
        places = np.concatenate((places[~wrong], np.array(again, places.dtype)))
    return places


def repeated_words(words: Words, at: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """Words of each document that lie in a window which also begins earlier in it."""
    n = len(words.codes)
    marks = np.zeros(n + length + 1, np.int32)
    places = earlier(at, keys, words.codes, length)
    np.add.at(marks, places, 1)
    np.add.at(marks, places + length, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(marks[:n]) > 0)))
    return inside[words.ends] - inside[words.starts]


def top_share(words: Words, document: np.ndarray, at: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """Share of a document's windows that are its most frequent one; 0 if that occurs once."""
    out = np.zeros(len(words.starts))
    if not len(at):
        return out
    order = np.argsort(keys)
    k = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    sizes = np.diff(np.append(heads, len(k)))
    most = np.zeros(len(out), np.int64)
    np.maximum.at(most, document[at[order[heads]]], sizes)
    total = np.bincount(document[at], minlength=len(out))
    return np.where(most > 1, most / np.maximum(total, 1), 0.0)


def unit_share(texts: list[str | None], pattern: str) -> np.ndarray:
    """Share of the characters of each text's parts (split by pattern, blank ones left out) that stand in parts seen earlier in it."""
    parts = pc.split_pattern_regex(pa.array([t or "" for t in texts], pa.large_string()), pattern)
    trimmed = pc.utf8_trim_whitespace(parts.values)
    size = pc.utf8_length(trimmed).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(parts.offsets.to_numpy()))
    coded = pc.dictionary_encode(trimmed)
    key = doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    key, size, doc = key[size > 0], size[size > 0], doc[size > 0]
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    total = np.bincount(doc, size, minlength=len(texts))
    return np.bincount(doc[again], size[again], minlength=len(texts)) / np.maximum(total, 1)


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words and every measurement of a slice of documents."""
    words = encode(texts)
    document = words.document
    keys = window_keys(words, document, (2, 3, 4, 8))
    n = words.ends - words.starts
    out = {"n_words": n, "window_8": repeated_words(words, *keys[8], 8) / np.maximum(n, 1)}
    out |= {
        "lines": unit_share(texts, r"\r\n|\n|\r"), "paragraphs": unit_share(texts, r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+"),
        "sentences": unit_share(texts, r"[.!?]+\s+|[\r\n]+")
    }
    return out | {f"top_{k}": top_share(words, document, *keys[k], k) for k in (2, 3, 4)}


def ledger(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, one measurement per rule, failed (bitmask of RULES) of every document, whole texts.

    NULL and empty texts have no words and fail nothing; texts shorter than a window have measurement 0. One row per row
    of the input; nothing is shuffled, unless the input has fewer partitions than there are cores. Very long texts are measured on their own.
    """
    source = spread(pick(documents, {"doc_id": "doc_id", "text": "text"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, place = distinct_texts(batch.column(1))
            parts = [measure(some) for _, _, some in slices(texts)]
            if not parts:
                continue
            found = {k: np.concatenate([p[k] for p in parts])[place] for k in parts[0]}
            failed = np.zeros(len(place), np.int64)
            for bit, rule in enumerate(RULES):
                failed |= (found[rule.measure] >= rule.least).astype(np.int64) << bit
            arrays = [
                batch.column(0).cast(pa.int64()), pa.array(found["n_words"], pa.int64()),
                *(pa.array(found[m], pa.float64()) for m in MEASURES), pa.array(failed)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", *MEASURES, "failed"])

    return source.mapInArrow(run, f"doc_id long, n_words long, {', '.join(f'{m} double' for m in MEASURES)}, failed long")


def store(entries: DataFrame, path: str) -> DataFrame:
    """Write a ledger with the rules it was made by; policies and ablations then read it instead of the texts."""
    entries.withColumn("rules", F.lit(",".join(r.name for r in RULES))).write.mode("overwrite").parquet(path)
    return stored(entries.sparkSession, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A written ledger. One with any row made by other rules, or rules in another order, is an error: its bits would mean something else."""
    entries = spark.read.parquet(path)
    names = [r.name for r in RULES]
    known = [",".join(names[: i + 1]) for i in range(len(names))]  # rules are only ever appended
    if entries.where(~F.coalesce(F.col("rules").isin(known), F.lit(False))).limit(1).count():
        raise ValueError("the ledger was made by other rules")
    return entries.drop("rules")


def ledger_once(documents: DataFrame) -> DataFrame:
    """The ledger of a table of files, measured once an application: the first call writes it to the checkpoint folder, later ones read it there.

    It is kept under the names, sizes and times of the table's files, so a table that was written anew is measured anew.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    files = documents.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*files.columns)).alias("h")).first()
    context = spark.sparkContext
    path = f"{context.getCheckpointDir()}/ledger-{context.applicationId}-{mark['n']}-{(mark['h'] or 0) % 2**64:016x}"
    done = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(context._jsc.hadoopConfiguration()).exists(done):
        return stored(spark, path)
    return store(ledger(documents), path)


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """Ledger rows that fail any rule of the policy."""
    return entries.where(F.col("failed").bitwiseAND(F.lit(mask_of(policy))) != 0)


def ablations(entries: DataFrame) -> DataFrame:
    """policy, rule, failing, alone: documents that fail the rule, and those that fail no other rule of the policy (kept if it is dropped).

    Aggregated over the distinct bitmasks (at most 2 ** rules), which are counted before the shuffle.
    """
    counts = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p, r, 1 << [x.name for x in RULES].index(r), mask_of(p)) for p, names in POLICIES.items() for r in names]
    asked = F.array(
        *(
            F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(bit).cast("long").alias("bit"), F.lit(mask).cast("long").alias("mask")) for p,
            r, bit, mask in rows
        )
    )
    each = counts.select("failed", "n", F.inline(asked)).withColumn("hit", F.col("failed").bitwiseAND(F.col("mask")))
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("alone"),
    )
