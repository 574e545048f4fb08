"""Words of texts, as integer arrays over a slice of documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# The invisible characters that are dropped (soft hyphen, zero-width signs).
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_DROP = dict.fromkeys(map(ord, INVISIBLE))
_WORD = re.compile(r"[^\W_]+")
_ASCII_GAP = r"[\x00-/:-`{-\x7f]+"


def spread(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) in at least as many partitions as the cluster has cores: a table of a few large files would
    otherwise keep most of them idle. Tables with enough partitions, as large ones have, are left where they are, and so
    are plans with an exchange of their own, whose partitions are known only once they have run."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    plan = documents._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec" or plan.toRdd().getNumPartitions() >= cores:
        return documents
    return documents.repartition(4 * cores)


#: A slice of documents ends with the document that reaches this many bytes; one longer document is a slice.
SLICE_BYTES = 6_000_000


def normalise(text: str) -> str:
    """Invisible characters dropped, compatibility folding, lower case."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text.translate(_DROP)).lower()


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the normalised text; none for NULL."""
    return _WORD.findall(normalise(text)) if text else []


@dataclass
class Words:
    """Words of consecutive documents: codes into the slice's dictionary, and where each document starts and ends."""

    codes: np.ndarray  # int32, length n
    starts: np.ndarray  # int64, one per document
    ends: np.ndarray
    dictionary: pa.Array  # code -> word

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts), dtype=np.int32), self.ends - self.starts)


def encode(texts: list[str | None]) -> Words:
    """Words of a slice. Texts of plain ASCII are split by Arrow; in others the words are found first and joined by blanks."""
    flat = [t.lower() if t and t.isascii() else " ".join(words_of(t)) for t in texts]
    parts = pc.split_pattern_regex(pa.array(flat, pa.large_string()), _ASCII_GAP)
    values = parts.values.slice(parts.offsets[0].as_py() if len(parts.offsets) else 0)
    filled = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(filled)))
    offsets = before[parts.offsets.to_numpy().astype(np.int64)]
    coded = pc.dictionary_encode(values.filter(pa.array(filled)))
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), offsets[:-1], offsets[1:], coded.dictionary)


def distinct_texts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different texts of a batch, NULL last, and each row's place among them, so that copies are worked on once."""
    coded = column.dictionary_encode()
    texts = coded.dictionary
    if coded.null_count:
        texts = pa.concat_arrays([texts, pa.nulls(1, texts.type)])
    return texts, pc.fill_null(coded.indices, len(texts) - 1).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """(from, to, texts) of consecutive texts of about ``size`` bytes; only one slice at a time is turned into Python strings."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        total += n
        if total >= size or i + 1 == len(lengths):
            yield start, i + 1, texts.slice(start, i + 1 - start).to_pylist()
            start, total = i + 1, 0
