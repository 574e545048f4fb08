"""Evaluation texts inside training texts, found through an FM-index of each shard of the corpus."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.engine.session import checkpoint
from gridloom.llm.fmindex import FMIndex
from gridloom.llm.words import distinct_texts, encode, slices, spread, words_of
from gridloom.operators.columns import pick

NAMES = ["doc_id", "item_id", "leaked_words", "item_words", "share", "spans"]

#: Items are searched in blocks of about this many, so what a task is sent stays bounded however many items there are.
BLOCK_ITEMS = 5_000
#: A shard ends with the document that reaches this many bytes (about two million words).
SHARD_BYTES = 12_000_000
ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Phrases:
    """All windows of ``length`` words of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], length: int) -> None:
        self.length = length
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.vocabulary = sorted({x for w in words for x in w})
        code = {x: i for i, x in enumerate(self.vocabulary)}
        coded = [np.array([code[x] for x in w], np.int32) for w in words]
        windows = [np.lib.stride_tricks.sliding_window_view(c, length) for c in coded if len(c) >= length]
        long = [i for i, c in enumerate(coded) if len(c) >= length]
        if windows:
            every = np.concatenate(windows)
            self.distinct, number = np.unique(every, axis=0, return_inverse=True)
            number = number.ravel()
            item = np.concatenate([np.full(len(w), i) for i, w in zip(long, windows, strict=True)])
            place = np.concatenate([np.arange(len(w)) for w in windows])
            by = np.argsort(number, kind="stable")
            # uses of phrase p: item[uses_from[p]:uses_from[p + 1]]
            self.item, self.place = item[by], place[by]
            self.uses_from = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(self.distinct)))))
        else:
            self.distinct = np.zeros((0, length), np.int32)
            self.item = self.place = np.zeros(0, np.int64)
            self.uses_from = np.zeros(1, np.int64)


def covered(group: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of [place, place + length) per group, for rows sorted by (group, place): (group, from, to) of the merged spans."""
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (np.diff(place) > length)))
    heads = np.flatnonzero(new)
    return group[heads], place[heads], place[np.append(heads[1:], len(place)) - 1] + length


@dataclass
class Leaks:
    """Pairs of a shard: document, item, leaked words of the item; and the document's spans, number of spans by pair."""

    document: np.ndarray
    item: np.ndarray
    words: np.ndarray
    spans: np.ndarray  # (k, 2), in the order of the pairs
    spans_each: np.ndarray


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] ... start[0] + count[0] - 1, start[1] ..."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


class Shard:
    """The FM-index of some texts and the codes of their words; built once, searched for any number of phrase blocks."""

    def __init__(self, index: FMIndex | None, dictionary: list[str]) -> None:
        self.index, self.dictionary = index, dictionary

    @classmethod
    def of_texts(cls, texts: list[str | None]) -> Shard:
        words = encode(texts)
        if not len(words.codes):
            return cls(None, [])
        return cls(FMIndex(words.codes, words.starts, words.ends, len(words.dictionary) + 1), words.dictionary.to_pylist())

    def dumped(self, **more: np.ndarray) -> bytes:
        """As bytes, with further arrays. Words hold letters and digits only, so they are stored line by line."""
        out = io.BytesIO()
        names = np.frombuffer("\n".join(self.dictionary).encode(), np.uint8)
        np.savez(out, dictionary=names, **(self.index.arrays() if self.index else {}), **more)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> tuple[Shard, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(data), allow_pickle=False) as found:
            arrays = dict(found)
        names = arrays["dictionary"].tobytes().decode()
        return cls(FMIndex.of_arrays(arrays) if names else None, names.split("\n") if names else []), arrays


def leaks_in(shard: Shard, phrases: Phrases, least_share: float = 0.0) -> Leaks | None:
    """The pairs of one shard with at least ``least_share`` of the item's words leaked."""
    if shard.index is None or not len(phrases.distinct):
        return None
    index = shard.index
    # the phrases in the shard's codes; those with a word the shard lacks can't occur
    code = {w: i for i, w in enumerate(shard.dictionary)}
    to = np.array([code.get(w, -1) for w in phrases.vocabulary], np.int64)
    asked = to[phrases.distinct]
    able = np.flatnonzero((asked >= 0).all(axis=1))
    if not len(able):
        return None
    which, low, high = index.search(asked[able])
    if not len(which):
        return None
    phrase = np.repeat(able[which], high - low)
    doc, word = index.document_of(index.locate(ranges(low, high - low)))
    # an occurrence of a phrase counts for every item and place that has the phrase
    uses = phrases.uses_from[phrase + 1] - phrases.uses_from[phrase]
    at = ranges(phrases.uses_from[phrase], uses)
    pair = np.repeat(doc, uses) * len(phrases.ids) + phrases.item[at]
    word, place = np.repeat(word, uses), phrases.place[at]
    by = np.lexsort((place, pair))
    span_pair, a, b = covered(pair[by], place[by], phrases.length)
    pairs, heads = np.unique(span_pair, return_index=True)
    leaked = np.add.reduceat(b - a, heads)
    item = pairs % len(phrases.ids)
    keep = leaked / phrases.sizes[item] >= least_share
    own = np.isin(pair, pairs[keep])
    if not own.any():
        return None
    pair, word = pair[own], word[own]
    by = np.lexsort((word, pair))
    span_pair, a, b = covered(pair[by], word[by], phrases.length)
    _, each = np.unique(span_pair, return_counts=True)
    return Leaks(pairs[keep] // len(phrases.ids), item[keep], leaked[keep], np.stack((a, b), axis=1), each)


def shards_of(batch: pa.RecordBatch, shard_bytes: int) -> Iterator[tuple[Shard, np.ndarray, np.ndarray]]:
    """(shard, copies of each of its texts, doc_ids text by text) of a batch (doc_id, text); copies are indexed once."""
    ids = batch.column(0).cast(pa.int64())
    texts, place = distinct_texts(batch.column(1))
    rows_of = np.argsort(place, kind="stable")  # rows of text u: rows_of[first[u]:first[u + 1]]
    copies = np.bincount(place, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(copies)))
    for a, b, some in slices(texts, shard_bytes):
        yield Shard.of_texts(some), copies[a:b], ids.take(pa.array(rows_of[first[a] : first[b]]))


def found_in(shard: Shard, copies: np.ndarray, ids: pa.Array, phrases: Phrases, least_share: float) -> Iterator[pa.RecordBatch]:
    """Result rows of a shard: every pair of a text for all its copies."""
    found = leaks_in(shard, phrases, least_share)
    if found is None:
        return
    text = found.document
    first = np.cumsum(copies) - copies
    pair = np.repeat(np.arange(len(text)), copies[text])
    row = ranges(first[text], copies[text])
    size = phrases.sizes[found.item]
    span = pa.StructArray.from_arrays([pa.array(found.spans[:, 0]), pa.array(found.spans[:, 1])], ["from", "to"])
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(found.spans_each))), pa.int32()), span)
    item = pa.array(np.array(phrases.ids, np.int64)[found.item][pair])
    yield pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(row)), item, pa.array(found.words[pair]), pa.array(size[pair]), pa.array((found.words / size)[pair]),
            spans.take(pa.array(pair))
        ],
        names=NAMES
    )


def indexed(source: DataFrame, shard_bytes: int) -> DataFrame:
    """shard (bytes): the index of every shard of source (doc_id, text) with its documents, written to the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, copies, ids in shards_of(batch, shard_bytes):
                # NULL ids are marked, as an array of numbers has no NULL
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                data = shard.dumped(copies=copies, ids=ids.fill_null(0).to_numpy(), known=known)
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["shard"])

    return checkpoint(source.mapInArrow(run, "shard binary"))


SCHEMA = "doc_id long, item_id long, leaked_words long, item_words long, share double, spans array<struct<from:long,to:long>>"


def leaked_items(
    documents: DataFrame, items: DataFrame, length: int = 8, least_share: float = 0.0, block_items: int = BLOCK_ITEMS,
    shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """doc_id, item_id, leaked_words, item_words, share, spans of each document and item that share ``length`` consecutive words and at least ``least_share``.

    A word of the item is leaked if it lies in such a passage; share is leaked_words / item_words; spans are the merged
    ranges [from, to) of the document's words to remove. Every document is indexed and searched whole, in shards of
    whole documents, so no result crosses a shard and nothing is shuffled but the result. Up to ``block_items`` items are
    searched while a shard is at hand. More of them go in blocks: the indexes of all shards are written once and each
    block is searched in them, its answer is written and its items are dropped before the next block is read, so driver
    and tasks hold one block of items whatever their number. Items with fewer than ``length`` words and NULL or empty
    texts leak nothing; repeated items or documents give repeated rows once each.
    """
    spark = documents.sparkSession
    source = spread(pick(documents, {"doc_id": "doc_id", "text": "text"}))
    asked = pick(items, {"item_id": "item_id", "text": "text"}).where("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-asked.count() // block_items))

    def block(b: int) -> Broadcast[Phrases]:
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        return spark.sparkContext.broadcast(Phrases(sorted((r["item_id"], r["text"]) for r in part.collect()), length))

    if blocks == 1:
        shared = block(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, copies, ids in shards_of(batch, shard_bytes):
                    yield from found_in(shard, copies, ids, shared.value, least_share)

        return source.mapInArrow(run, SCHEMA).distinct()

    shards = indexed(source, shard_bytes)
    out = []
    rows_a_batch = spark.conf.get(ROWS_A_BATCH)
    try:
        spark.conf.set(ROWS_A_BATCH, "1")  # a row is the index of a shard
        for b in range(blocks):
            shared = block(b)

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for data in batch.column(0):
                        shard, more = Shard.loaded(data.as_py())
                        yield from found_in(shard, more["copies"], pa.array(more["ids"], mask=~more["known"]), shared.value, least_share)

            out.append(checkpoint(shards.mapInArrow(search, SCHEMA).distinct()))
            shared.destroy()
    finally:
        spark.conf.set(ROWS_A_BATCH, rows_a_batch)
    return reduce(DataFrame.unionByName, out)
