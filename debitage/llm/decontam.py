"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size (number of word shingles, in powers of two).  An item
of n shingles counts as contained from ``ceil(CONTAINED * n)`` of them, so a document
that contains it misses at most ``n - ceil(CONTAINED * n)``, and the bottom-k MinHash
sketch whose k is one more has at least one value in the document.  Each size class
is a sketch table of its own, as deep as its sizes need: a value or two for small items.
A document is probed in the classes that it is large enough for; a hit is verified by
shingle hashes and then by exact containment of the item's shingles, compared as words.

The items go to the executors in blocks of at most ``BLOCK`` words, a bound that
holds for benchmarks of any size: more blocks mean more scans, not more memory.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debitage.llm.wordhash import Words, buffers, shingles, slices

SHINGLE = 5
CONTAINED = 0.8
#: Words of the items of one block (texts, hashes and sketches: some 80 MB), and items whose shingles a task keeps as words.
BLOCK = 3_000_000
KEPT = 64
OUT = "doc_id long, item_id long, containment double, n_shingles int, size_class int"


def word_list(text: str | None) -> list[bytes]:
    """The words of a text, as Words cuts and lowers them."""
    w = Words(*buffers(pa.array([text], pa.string())))
    low = w.low.tobytes()
    return [low[s : s + n] for s, n in zip(w.start.tolist(), w.length.tolist(), strict=True)]


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    """All runs of SHINGLE words; of a shorter text all its words as one run."""
    words = word_list(text)
    return set(zip(*(words[k:] for k in range(SHINGLE)), strict=False)) or ({tuple(words)} if words else set())


class SizeClass:
    """The sketch table of one size class: values in order, the item of each, and the fewest shingles that contain one."""

    def __init__(self, least: int, value: list[int], owner: list[int]):
        order = np.argsort(np.array(value, np.uint64), kind="stable")
        self.least, self.value, self.owner = least, np.array(value, np.uint64)[order], np.array(owner, np.int64)[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.value >> np.uint64(48)).astype(np.int64)] = True

    def probe(self, hashes: np.ndarray, of: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """(text, item) rows of the texts of at least ``least`` shingles with a sketch value."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)] & (size >= self.least)[of])
        low = np.searchsorted(self.value, hashes[at], side="left")
        many = np.searchsorted(self.value, hashes[at], side="right") - low
        found = []
        for step in range(int(many.max(initial=0))):  # a shingle is rarely in more than one item
            live = step < many
            found.append(np.stack([of[at[live]], self.owner[low[live] + step]], axis=1))
        return found


class Sketches:
    """The items of one block, and a sketch table for each of their size classes."""

    def __init__(self, items: list[tuple[int, str]], contained: float):
        self.items: list[tuple[int, str, int, int]] = []
        self.hashes: list[np.ndarray] = []
        self.short: list[int] = []
        self.contained = contained
        tables: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for item_id, text in items:
            w = Words(*buffers(pa.array([text], pa.string())))
            hashes = np.unique(shingles(w, SHINGLE)[0])
            n = len(shingle_set(text))
            if not n:
                continue
            size_class = n.bit_length() - 1
            need = int(np.ceil(contained * n - 1e-9))
            at = len(self.items)
            self.items.append((item_id, text, n, size_class))
            self.hashes.append(hashes)
            if len(w.hash) < SHINGLE:
                self.short.append(at)  # its one run is of fewer words: looked for word by word
                continue
            # bottom-k, of the depth that this item needs
            value, owner, least = tables.setdefault(size_class, ([], [], []))
            depth = hashes[: n - need + 1].tolist()
            value += depth
            owner += [at] * len(depth)
            least.append(need)
        self.classes = {c: SizeClass(min(least), value, owner) for c, (value, owner, least) in sorted(tables.items())}
        self.exact: OrderedDict[int, set] = OrderedDict()

    def hits(self, hashes: np.ndarray, of: np.ndarray, texts: int) -> list[tuple[int, int]]:
        """Distinct (text, item) pairs in order that the classes' sketches find and the shingles' hashes allow."""
        size = np.bincount(of, minlength=texts)
        found = [pair for c in self.classes.values() for pair in c.probe(hashes, of, size)]
        if not found:
            return []
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(texts + 1))
        out, last, have = [], None, hashes[:0]
        for text, item in np.unique(np.concatenate(found), axis=0).tolist():
            if text != last:
                last, have = text, hashes[order[first[text] : first[text + 1]]]
            # equal shingles have equal hashes, so this share is no less than the exact one
            if np.isin(self.hashes[item], have).sum() >= self.contained * self.items[item][2] - 1e-9:
                out.append((text, item))
        return out

    def shingles_of(self, item: int) -> set[tuple[bytes, ...]]:
        if item not in self.exact:
            self.exact[item] = shingle_set(self.items[item][1])
            if len(self.exact) > KEPT:
                self.exact.popitem(last=False)
        return self.exact[item]


def _blocks(benchmark: DataFrame, contained: float) -> Iterator[Sketches]:
    """The items in blocks of about BLOCK words each, one block in memory at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (6 * BLOCK)))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Sketches([tuple(r) for r in own.collect()], contained)


def contained_items(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """One row for each document (doc_id, text) and benchmark item (item_id, text) inside it.

    containment: the share of the item's distinct five-word shingles that the document
    has, at least ``contained``; an item of fewer words is one run of all its words.
    Words are lower-cased runs of letters and digits.  Items without words and null
    texts match nothing; repeated rows match each; null ids stay null; an empty table
    gives an empty result; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for sketches in _blocks(benchmark, contained):
        part = docs.mapInArrow(_pairs(sketches, contained), OUT)
        out = part if out is None else out.unionByName(part)
    return out


def _found(texts: pa.Array, sketches: Sketches, contained: float) -> list[tuple[int, int, float]]:
    """(text, item, containment) of a batch, verified."""
    w = Words(*buffers(texts))
    pairs = sketches.hits(*shingles(w, SHINGLE), len(texts)) + _short_hits(w, sketches)
    found, last, have = [], None, set()
    for text, item in sorted(pairs):
        if text != last:
            last, have = text, shingle_set(texts[text].as_py())
        own = sketches.shingles_of(item)
        share = 1.0 if item in sketches.short else len(own & have) / len(own)
        if share >= contained:
            found.append((text, item, share))
    return found


def _pairs(sketches: Sketches, contained: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = _found(b.column(1), sketches, contained)
            items = [sketches.items[item] for _, item, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([text for text, _, _ in found], pa.int64())),
                    pa.array([x[0] for x in items], pa.int64()),
                    pa.array([share for _, _, share in found], pa.float64()),
                    pa.array([x[2] for x in items], pa.int32()),
                    pa.array([x[3] for x in items], pa.int32()),
                ],
                ["doc_id", "item_id", "containment", "n_shingles", "size_class"],
            )

    return search


def _short_hits(w: Words, sketches: Sketches) -> list[tuple[int, int]]:
    """Texts that hold the words of an item of fewer than SHINGLE words, one after another."""
    if not sketches.short:
        return []
    text, out, low = w.text_of(), set(), w.low.tobytes()
    for item in sketches.short:
        words = next(iter(sketches.shingles_of(item)))
        own = Words(*buffers(pa.array([b" ".join(words).decode()], pa.string()))).hash
        n = len(own)
        at = np.flatnonzero(w.hash[: max(0, len(w.hash) - n + 1)] == own[0])
        for i in at.tolist():
            if text[i] == text[i + n - 1] and all(low[w.start[i + k] : w.start[i + k] + w.length[i + k]] == words[k] for k in range(n)):
                out.add((int(text[i]), item))
    return list(out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """docs, all columns, without the rows whose text contains a benchmark item: one scan, no shuffle.

    Null and wordless texts stay, repeated rows stay or go alike; without items all
    rows stay; an empty table stays empty; columns of any name pass through.
    """

    def without(sketches: Sketches):
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                clean = np.ones(b.num_rows, bool)
                clean[[text for text, _, _ in _found(b.column(b.schema.get_field_index("text")), sketches, contained)]] = False
                yield b.filter(pa.array(clean))

        return kept

    for sketches in _blocks(benchmark, contained):
        docs = docs.mapInArrow(without(sketches), docs.schema)
    return docs


#: The letters that words() lowers, and what to.
CAPITALS = "".join(chr(c) for c in (*range(65, 91), *range(0xC0, 0xDF)) if c != 0xD7)


def oracle() -> str:
    """DuckDB SQL for contained_items() over documents and benchmark."""
    words = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{CAPITALS}', '{"".join(chr(ord(c) + 32) for c in CAPITALS)}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    runs = f"select rk, unnest(case when len(w) >= {SHINGLE} then list_transform(range(1, len(w) - {SHINGLE - 2}), lambda k: w[k : k + {SHINGLE - 1}]) when len(w) > 0 then [w] else [] end) as s"
    return f"""
    with d as (select doc_id, row_number() over () as rk, {words} as w from documents),
    i as (select item_id, row_number() over () as rk, {words} as w from benchmark where text is not null),
    ds as (select distinct rk, s from ({runs} from d)),
    its as (select distinct rk, s from ({runs} from i)),
    n as (select its.rk, count(*) as n, any_value(len(w)) as m from its join i using (rk) group by its.rk),
    hit as (select ds.rk as dk, its.rk as ik, count(*) as met from ds join its using (s) group by all),
    found as (select dk, ik, met / n as containment from hit join n on n.rk = ik where m >= {SHINGLE} and met / n >= {CONTAINED}
      union all select d.rk, i.rk, 1.0 from d join i on len(i.w) between 1 and {SHINGLE - 1} and contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' '))
    select doc_id, item_id, containment::double as containment, n::int as n_shingles, floor(log2(n))::int as size_class
    from found join d on d.rk = dk join i on i.rk = ik join n on n.rk = ik
    """
