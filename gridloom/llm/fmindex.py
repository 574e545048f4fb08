"""FM-index over the words of one shard: suffix array, wavelet matrix over the BWT, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, separators: int) -> np.ndarray:
    """Order of the suffixes of a sequence of symbols below 2**31.

    Symbols below ``separators`` occur once each, so two suffixes differ at the latest where a document ends, and the
    sorting ends after log2 of the longest repeat. Prefix doubling; only suffixes that still tie are sorted again.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    width = max(1, int(symbols.max() + 1).bit_length())
    depth = max(1, min(8, 62 // width, n))
    key = np.zeros(n, np.int64)
    for j in range(depth):  # several symbols in one integer; 0 stands for the end
        key <<= width
        key[: n - j] += symbols[j:] + 1
    order = np.argsort(key)
    ordered = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del key, ordered
    rank = np.empty(n, np.int64)
    slot = np.arange(n)
    head = np.maximum.accumulate(np.where(new, slot, 0))
    rank[order] = head
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    k = depth
    while len(slots):
        at = order[slots]
        after = at + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + second
        by = np.argsort(pair)
        pair, at = pair[by], at[by]
        order[slots] = at
        fresh = np.empty(len(slots), bool)
        fresh[0] = True
        np.not_equal(pair[1:], pair[:-1], out=fresh[1:])
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = slots[tied]
        k *= 2
    return order


class Bits:
    """Bit vector with constant-time rank."""

    __slots__ = ("before", "words")

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self._count(np.packbits(padded, bitorder="little").view(np.uint64))

    def _count(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of_words(cls, words: np.ndarray) -> Bits:
        out = cls.__new__(cls)
        out._count(words)
        return out

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector per bit of the alphabet."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[Bits, int]] = []
        self.depth = bits
        s = sequence
        for b in range(bits - 1, -1, -1):
            bit = ((s >> b) & 1).astype(bool)
            zeros = len(s) - int(bit.sum())
            self.levels.append((Bits(bit), zeros))
            if b:
                s = np.concatenate((s[~bit], s[bit]))

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol among the first low and the first high elements."""
        base = np.zeros_like(low)
        a, b = low, high
        for level, (bits, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.depth - 1 - level)) & 1).astype(bool)
            i, j, k = bits.ones(base), bits.ones(a), bits.ones(b)
            base = np.where(one, zeros + i, base - i)
            a = np.where(one, zeros + j, a - j)
            b = np.where(one, zeros + k, b - k)
        return a - base, b - base


class FMIndex:
    """Documents' words, searchable for phrases. Symbol 0 of the BWT stands for all separators."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: int, sample: int = 16) -> None:
        d = len(starts)
        n = len(codes) + d
        # document i occupies [starts[i] + i, ends[i] + i) and is followed by its separator, symbol i
        text = np.empty(n, np.int32)
        word = np.ones(n, bool)
        word[ends + np.arange(d)] = False
        text[word] = codes + d
        text[~word] = np.arange(d)
        self.first = starts + np.arange(d)
        order = suffix_array(text, d)
        bwt = text[order - 1]  # what stands before the first suffix is the last separator
        bwt = np.where(bwt < d, 0, bwt - d + 1)
        self.tree = WaveletMatrix(bwt, max(1, int(alphabet).bit_length()))
        counts = np.bincount(codes, minlength=alphabet)
        self.smaller = np.concatenate(([0, d], d + np.cumsum(counts)))  # rows that begin with a smaller symbol
        kept = order % sample == 0
        opening = np.zeros(n, bool)
        opening[self.first] = True
        kept |= opening[order]
        self.marks = Bits(kept)
        self.samples = order[kept]
        self.symbols = bwt
        self.rows = n

    def arrays(self) -> dict[str, np.ndarray]:
        """The index as plain arrays; of_arrays() makes the same index of them."""
        out = {
            "first": self.first, "smaller": self.smaller, "marks": self.marks.words, "samples": self.samples, "symbols": self.symbols,
            "zeros": np.array([z for _, z in self.tree.levels], np.int64)
        }
        return out | {f"level_{i}": bits.words for i, (bits, _) in enumerate(self.tree.levels)}

    @classmethod
    def of_arrays(cls, arrays: dict[str, np.ndarray]) -> FMIndex:
        out = cls.__new__(cls)
        out.first, out.smaller, out.samples, out.symbols = (arrays[k] for k in ("first", "smaller", "samples", "symbols"))
        out.rows, out.marks = len(out.symbols), Bits.of_words(arrays["marks"])
        out.tree = WaveletMatrix.__new__(WaveletMatrix)
        out.tree.levels = [(Bits.of_words(arrays[f"level_{i}"]), int(z)) for i, z in enumerate(arrays["zeros"])]
        out.tree.depth = len(out.tree.levels)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases (rows of codes): (which phrases occur, first row, one past the last row)."""
        m, length = phrases.shape
        which = np.arange(m)
        low, high = np.zeros(m, np.int64), np.full(m, self.rows, np.int64)
        for j in range(length - 1, -1, -1):
            symbol = phrases[which, j].astype(np.int64) + 1
            a, b = self.tree.ranks(symbol, low, high)
            low, high = self.smaller[symbol] + a, self.smaller[symbol] + b
            keep = low < high
            which, low, high = which[keep], low[keep], high[keep]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk to the left until a sampled row. A document's first word is sampled, so no walk leaves its document."""
        out = np.empty(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            before = self.marks.ones(at)
            hit = self.marks.ones(at + 1) > before
            out[live[hit]] = self.samples[before[hit]] + steps
            live, at = live[~hit], at[~hit]
            if len(live):
                symbol = self.symbols[at].astype(np.int64)
                rank, _ = self.tree.ranks(symbol, at, at)
                at = self.smaller[symbol] + rank
                steps += 1
        return out

    def document_of(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, word number in it) of text positions."""
        doc = np.searchsorted(self.first, positions, side="right") - 1
        return doc, positions - self.first[doc]
