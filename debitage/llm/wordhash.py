"""Hashed words of whole Arrow batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value per byte and an odd one per place in a word: two words
#: that differ get different sums but for one case in about 2**64.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of texts and where each begins; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text: one long text, or several."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0))
        part = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // most
        heads = np.flatnonzero(np.diff(part, prepend=-1))
        for i, j in zip(heads, [*heads[1:], b.num_rows], strict=True):
            yield b.slice(i, j - i)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capitals of U+00C0 to U+00DE."""
    low = LOWER[data]
    if len(data) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = data[at]
        at = at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
        low[at] += 32
    return low


def spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased bytes: where each starts, its length, each text's first word (and their total), and which bytes are in words."""
    word = WORD[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = word[heads]
    ends = word.copy()
    ends[:-1] &= begins[1:] | ~word[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1 - start, np.searchsorted(start, offsets), word


class Words:
    """Words (runs of ASCII letters and digits and of non-ASCII bytes) of a batch.

    ``start``, ``length``: bytes; ``hash``: uint64; ``first``: index of each text's
    first word, and their total at the end.  A word never crosses texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = low = lowered(data)
        self.start, self.length, self.first, word = spans(low, offsets)
        where = np.flatnonzero(word)
        to = np.cumsum(self.length)
        place = np.arange(len(where)) - np.repeat(to - self.length, self.length)
        value = BYTE[low[where]] * PLACE[place & 63]
        self.hash = np.add.reduceat(value, to - self.length) if len(where) else np.zeros(0, np.uint64)
        self.hash ^= self.hash >> np.uint64(29)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def prefixes(self, lengths: tuple[int, ...]) -> list[np.ndarray]:
        """For each length the hash of that many first bytes of each word; 0 for shorter words."""
        total, out = np.zeros(len(self.start), np.uint64), []
        for k in range(max(lengths, default=0)):
            at = np.minimum(self.start + k, len(self.low) - 1)
            total = total + BYTE[self.low[at]] * PLACE[k]
            if k + 1 in lengths:
                out.append(np.where(self.length >= k + 1, (total ^ (total >> np.uint64(29))) * np.uint64(2 * k + 3), np.uint64(0)))
        return out


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words of one text (a shorter text: one of all its words), and its text."""
    count = np.diff(words.first)
    total = len(words.hash)
    mixed = np.zeros(total, np.uint64)
    for k in range(min(n, total)):
        mixed[: total - k] += words.hash[k:] * PLACE[k + 7]
    text = words.text_of()
    last = words.first[1:][text]
    whole = np.arange(total) + n <= last
    at = [mixed[whole]]
    of = [text[whole]]
    for i in np.flatnonzero((count > 0) & (count < n)):
        own = words.hash[words.first[i] : words.first[i + 1]]
        at.append((own * PLACE[7 : 7 + len(own)]).sum(keepdims=True))
        of.append(np.array([i]))
    return np.concatenate(at), np.concatenate(of)
