"""Token ids of whole Arrow batches of texts.

The ids are those of a ``tokenizers`` JSON file whose pre-tokenizer never joins
characters across ASCII white space, so a text's ids are its chunks' ids put
together.  A batch is split into chunks and dictionary-encoded by Arrow, only distinct
chunks are looked up, and the ids are gathered by numpy offsets.  Each worker keeps the
chunks that it has seen, bounded by bytes; the library tokenises the others, many
in one call.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Chunks with a character from here on go through the library's whole chain: below,
#: nothing composes and lower case does not depend on its neighbours.
RARE = "̀"
#: Bytes of chunks and ids that one worker keeps, about; the cache starts anew when it is full.
CACHE_BYTES = 96 << 20
#: Bytes of text that are tokenised at once; a longer text is cut at white space.
PART = 4 << 20
#: Pieces that one call of the library gets.
CALL = 2000

# The split pattern of the tokenizer file, and the printable
# stand-ins that byte-level tokenizers use for the 256 byte values.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])+")

#: How the last token of each piece is spelled.
CLOSING = "</w>"
SPACE = re.compile(rb"[ \t-\r]")


def byte_names() -> list[str]:
    """Printable bytes stand for themselves, the others for code points from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + length[i]] of every i, put together."""
    before = np.cumsum(length) - length
    return flat[np.arange(int(length.sum())) + np.repeat(start - before, length)]


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, rows, texts) of about PART bytes; a longer text comes in several parts, cut at white space."""
    size = np.asarray(pc.binary_length(texts))
    at = 0
    while at < len(texts):
        if size[at] > PART:
            raw = texts[at].as_py().encode()
            a = 0
            while a < len(raw):
                cut = SPACE.search(raw, a + PART)
                b = cut.start() if cut else len(raw)
                yield at, 1, pa.array([raw[a:b].decode()], pa.large_string())
                a = b
            at += 1
            continue
        end = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), PART, side="right")) + at)
        yield at, end - at, texts.slice(at, end - at)
        at = end


class TextIds:
    """Ids of batches of texts, and the chunks that were seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # the same model over pieces that are split and spelled in byte names already
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.whole.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for t, i in vocab.items() if t.endswith(CLOSING)]] = True
        self.names = np.array([ord(n) for n in byte_names()], "<u4")
        self.names[32] = 32
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.bytes = 0

    def _odd(self, chunk: str) -> bool:
        return max(chunk, default="") >= RARE or ("<|" in chunk and any(s in chunk for s in self.special))

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces, and how many each has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), CALL):
            raw = np.frombuffer(" ".join(pieces[at : at + CALL]).encode(), np.uint8)
            spelled = self.names[raw].tobytes().decode("utf-32-le")
            found = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.uint32)
            ids.append(found)
            counts.append(np.diff(np.flatnonzero(self.closing[found]), prepend=-1))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, chunks: list[str]) -> None:
        """Take in chunks that aren't known."""
        odd = [c for c in chunks if (not c.isascii() or "<|" in c) and self._odd(c)]
        if odd:
            rare = set(odd)
            chunks = [c for c in chunks if c not in rare]
        pieces, counts = [], []
        for c in "\n".join(chunks).lower().split("\n") if chunks else ():
            if c.isalpha():
                pieces.append(c)
                counts.append(1)
            else:
                found = SPLIT.findall(c)
                pieces += found
                counts.append(len(found))
        number = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        ids, length = self._pieces(list(number))
        of = np.array([number[p] for p in pieces], np.int64)
        ids, length = gathered(ids, (np.cumsum(length) - length)[of], length[of]), length[of]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts, dtype=np.int64)]
        if odd:
            found = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)]
            ends = np.concatenate([ends, len(ids) + np.cumsum([len(f) for f in found])])
            ids = np.concatenate([ids, *found])
        self.slot.update(zip(chunks + odd, range(len(self.slot), len(self.slot) + len(ends)), strict=True))
        self.bytes += 200 * len(ends) + sum(map(len, chunks)) + 4 * sum(map(len, odd)) + 4 * len(ids)
        self.start = np.concatenate([self.start, self.start[-1] + ends])
        self.flat = np.concatenate([self.flat, ids])

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and how many each has."""
        if self.bytes > CACHE_BYTES:
            self.forget()
        chunks = pc.ascii_split_whitespace(texts)
        # lowered after the split: ascii_lower garbles some slices of larger arrays
        coded = pc.ascii_lower(chunks.flatten()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [c for c in distinct if c not in self.slot]
        if new:
            self._learn(new)
        slots = np.array([self.slot[c] for c in distinct], np.int64)[np.asarray(coded.indices)] if distinct else np.zeros(0, np.int64)
        start, length = self.start[slots], self.start[slots + 1] - self.start[slots]
        bounds = np.asarray(chunks.offsets)
        ends = np.concatenate([[0], np.cumsum(length)])[bounds - bounds[0]]
        return gathered(self.flat, start, length), np.diff(ends)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all texts one after another, and where each begins, with the total at the end; nulls have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        count, ids = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)]
        for at, rows, some in _parts(texts):
            own, n = self._some(some)
            ids.append(own)
            count[at : at + rows] += n
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(count)])


def closed(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each with the end id behind its own."""
    return np.insert(ids, first[1:], np.uint32(end)), first + np.arange(len(first))


@functools.cache
def text_ids(path: str) -> TextIds:
    """One per worker process and tokenizer file."""
    return TextIds(path)
