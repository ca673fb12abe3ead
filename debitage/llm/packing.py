"""Best-fit packing of token pieces by minimum bin slack.

Only lengths matter for a plan, and there are at most ``CAPACITY`` of them, so the
histogram of lengths is the whole problem.  Each bin starts from the longest length
left; a bitset subset-sum over the available lengths finds the fullest feasible
combination around it, which is then removed as often as the counts allow.  Spark
counts the lengths, numbers the pieces of each length without gaps (each task numbers
its own, the counts by task and length give where it begins) and looks every number
up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import materialise
from debitage.llm.wordhash import slices
from debitage.llm.wordtok import PART, closed, text_ids

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Plan:
    """For each run of equal pieces: the first piece's key, the bins and the place in them.

    key = length << 40 | number of the piece among those of its length.
    """

    key: np.ndarray
    copies: np.ndarray
    first_bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bin of each piece and its offset there."""
        key = (length << 40) + number
        at = np.searchsorted(self.key, key, side="right") - 1
        turn, copy = np.divmod(key - self.key[at], self.copies[at])
        return self.first_bin[at] + copy, self.offset[at] + turn * length


def fullest(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """The combination with the largest sum up to room; of equal sums one of longer pieces."""
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        many, take = min(left[n], room // n), 1
        while many > 0:
            some = min(take, many)
            wider = reach | (reach << some * n) & full
            if wider != reach:
                steps.append((n, some, reach))
                reach = wider
            many -= some
            take *= 2
        if reach >> room & 1:
            break
    want, out = reach.bit_length() - 1, {}
    for n, some, before in reversed(steps):
        if not before >> want & 1:
            out[n] = out.get(n, 0) + some
            want -= some * n
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Bins for so many pieces of each length."""
    left = {n: c for n, c in histogram.items() if c}
    done = dict.fromkeys(left, 0)
    runs, bins = [], 0
    order = sorted(left, reverse=True)
    while order:
        top = order[0]
        left[top] -= 1
        used = fullest(order, left, capacity - top) if capacity > top else {}
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        copies = min(left[n] // k for n, k in used.items())
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            runs.append(((n << 40) + done[n], copies, bins, offset))
            offset += n * k
            done[n] += copies * k
            left[n] -= copies * k
        bins += copies
        if any(not left[n] for n in used):
            order = [n for n in order if left[n]]
    key, copies, first, offset = (np.array(x, np.int64) for x in zip(*sorted(runs), strict=True)) if runs else (np.zeros(0, np.int64),) * 4
    return Plan(key, copies, first, offset, bins)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (columns of PIECES) of each document's ids and the end id.

    part, own: the task that cut the piece, and the piece's number among those of its
    length there; they tell any two rows apart once the rows are stored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = text_ids(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in slices(batches, most=PART):
            ids, first = closed(*ids_of.batch(b.column(1)), END)
            pieces = -(-np.diff(first) // capacity)
            at = np.repeat(np.arange(b.num_rows), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = capacity * piece
            length = np.minimum(capacity, np.diff(first)[at] - start)
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            begin = 4 * (first[at] + start)
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranked, many = length[order], np.bincount(length, minlength=capacity + 1)
            own = np.empty(len(at), np.int64)
            own[order] = seen[ranked] + np.arange(len(at)) - (np.cumsum(many) - many)[ranked]
            seen += many
            columns = [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(at), part, np.int32)), pa.array(own)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "own"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + ", part int, own long")


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with ``number``: gapless from 0 among those of its length.

    No rows are sorted: only the counts by task and length are, so a length that a
    third of all rows share is as many small groups as tasks cut it.
    """
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(base, ["length", "part"]).withColumn("number", F.col("base") + F.col("own")).drop("part", "own", "base")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of docs (doc_id, text) with sequence_id and its gapless offset there.

    A null or empty text is the end id alone.  Rows of equal or null doc_id are packed
    each for itself; an empty table gives an empty table; other columns are ignored.
    """
    pieces = materialise(token_pieces(docs, tokenizer, capacity))
    # at most `capacity` rows come back
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bins = plan(histogram, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "number"))
            sequence, offset = bins.place(length, number)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, PIECES + ", sequence_id long, offset long")
