"""Training-order materialisation of token ids as fixed-stride binary shards.

Documents are cut into sequences of at most ``WINDOW`` ids, each a record of exactly
``2 * WINDOW`` bytes (little-endian unsigned 16-bit ids, then end ids).  A keyed
Feistel network over the smallest square power of two, walked until it lands inside,
permutes 0..n-1; it assigns every sequence its global slot without a sort or a seed
per row.  Slots are dealt to shards of a fixed number of records and sorted there, so
record s of the training order is at byte (s mod R) * stride of shard s div R: a
reader resumes anywhere and reads on sequentially.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from debitage.iterate import written
from debitage.llm.wordhash import slices
from debitage.llm.wordtok import PART, closed, text_ids

WINDOW = 512
END = 0
#: Records of a shard.
SHARD = 1 << 14
#: Runs in which shards are written.
WAVES = 2
ROUNDS = 4
KEY = 0x5EED


def feistel(index: Column, bits: int, key: int = KEY, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. 4**bits - 1: halves of ``bits`` bits, mixed in turn."""
    mask = (1 << bits) - 1
    left, right = F.shiftright(index, bits).bitwiseAND(F.lit(mask)), index.bitwiseAND(F.lit(mask))
    for r in range(rounds):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(key), F.lit(r)).bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, bits).bitwiseOR(right)


def slots(rows: DataFrame, n: int, key: int = KEY) -> DataFrame:
    """rows (column ``index``, 0 .. n-1) with ``slot``: a permutation of the same numbers.

    Cycle-walking: an image at or past n is permuted again until it lands below.  At
    most three of four points lie outside, so a walk of over 200 steps has a chance
    of about 1e-25; such a row would stop the job (a slot can't be at or past n).
    """
    bits = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    # as one expression: a fold over a fixed number of steps keeps it a narrow map
    steps = 200 if 4**bits > n else 0

    def on(at: Column, _: Column) -> Column:
        return F.when(at < n, at).otherwise(feistel(at, bits, key))

    first = feistel(F.col("index").cast("long"), bits, key)
    slot = F.aggregate(F.array_repeat(F.lit(0), steps), first, on) if steps else first
    return rows.withColumn("slot", slot).withColumn("slot", F.when(F.col("slot") < n, F.col("slot")).otherwise(F.raise_error(F.lit("a walk of the permutation is too long")).cast("long")))


def sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """part, row, doc_id, piece, length, ids_crc32, record: the sequences in reading order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, row = text_ids(tokenizer), TaskContext.get().partitionId(), 0
        if len(ids_of.closing) > 1 << 16:
            raise ValueError("records hold unsigned 16-bit ids; the vocabulary has larger ones")
        for b in slices(batches, most=PART):
            ids, first = closed(*ids_of.batch(b.column(1)), END)
            pieces = -(-np.diff(first) // window)
            at = np.repeat(np.arange(b.num_rows), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = first[at] + window * piece
            length = np.minimum(window, first[at + 1] - begin)
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[i:j]) for i, j in zip((4 * begin).tolist(), (4 * (begin + length)).tolist(), strict=True)]
            full = np.full(len(at) * window, END, "<u2")
            # each text's ids fill its records from the first on
            full[np.arange(len(ids)) + np.repeat((np.cumsum(pieces) - pieces) * window - first[:-1], np.diff(first))] = ids
            record = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * window), len(at), [None, pa.py_buffer(full)]).cast(pa.binary())
            rows = np.arange(row, row + len(at), dtype=np.int64)
            row += len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), part, np.int32)), pa.array(rows), b.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), record],
                ["part", "row", "doc_id", "piece", "length", "ids_crc32", "record"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "part int, row long, doc_id long, piece int, length int, ids_crc32 long, record binary")


def _stored(spark: SparkSession, at: str) -> DataFrame | None:
    """The table at a path, if it was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    return spark.read.parquet(at) if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark) else None


def ordered(docs: DataFrame, tokenizer: str, folder: str, window: int = WINDOW, shard: int = SHARD, key: int = KEY, run: str | None = None) -> DataFrame:
    """doc_id, piece, length, ids_crc32, slot, shard, byte_offset, record of every sequence, in training order.

    ``folder`` (shared by all executors) gets the sequences once, as a table in reading
    order; that table fixes every index, so a task that runs again finds the same slots.
    The reading order follows the files of docs: name a ``run`` to keep one order for
    good; its table is read again where it was written to its end.
    Null and empty texts are one sequence of the end id; repeated rows and null doc_ids
    have sequences of their own; an empty table gives an empty one; further columns
    are ignored.
    """
    spark = docs.sparkSession
    at = f"{folder.rstrip('/')}/sequences-{run or uuid.uuid4().hex}"
    rows = _stored(spark, at) if run else None
    if rows is None:
        sequences(docs, tokenizer, window).write.option("compression", "zstd").mode("overwrite").parquet(at)
        rows = spark.read.parquet(at)
    # one row a task of the scan
    parts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    n, bases = 0, []
    for part, count in parts:
        bases.append((part, n))
        n += count
    base = spark.createDataFrame(bases, "part int, base long")
    numbered = rows.join(F.broadcast(base), "part").withColumn("index", F.col("base") + F.col("row"))  # a row for each task
    placed = slots(numbered, n, key).withColumn("shard", F.floor(F.col("slot") / shard).cast("int"))
    dealt = placed.repartitionById(max(1, -(-n // shard)), F.col("shard")).sortWithinPartitions("slot")
    return dealt.select("doc_id", "piece", "length", "ids_crc32", "slot", "shard", ((F.col("slot") % shard) * 2 * window).alias("byte_offset"), "record")


def _store(folder: str):
    """The file system of a folder that all executors share, and its path there."""
    from pyarrow import fs

    folder = re.sub(r"^file:/+", "/", folder)
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(root)
    return store, root


class _Writer:
    """The shard that a task is writing: under a name of its own, renamed when it is whole."""

    def __init__(self, folder: str):
        self.store, self.root = _store(folder)
        self.own, self.out, self.done = None, None, []

    def put(self, shard: int, record: bytes) -> None:
        if shard != self.own:
            self.close()
            self.own, self.n, self.size, self.crc = shard, 0, 0, 0
            self.name = f"{self.root}/.{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.name)
        self.out.write(record)
        self.n, self.size, self.crc = self.n + 1, self.size + len(record), zlib.crc32(record, self.crc)

    def path(self, shard: int) -> str:
        return f"{self.root}/shard-{shard:06d}.bin"

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.name, self.path(self.own))
            self.done.append((self.own, self.path(self.own), self.n, self.size, self.crc))


def materialised(dealt: DataFrame, folder: str) -> DataFrame:
    """Write ordered() as files shard-NNNNNN.bin of records one after another; returns its rows with the file's path in place of the record.

    The shards are written at once, in ``WAVES`` runs of every so manyth shard, so only
    one run's records are in shuffle files at a time; the rows come from a table beside
    the folder, so what reads them writes no shard again.  A record stands at byte_offset
    of its path, so reading goes on from any slot.  Tasks that run twice leave one whole
    file each; null and repeated doc_ids keep their records; an empty table writes nothing.
    """
    kept = ["doc_id", "piece", "length", "ids_crc32", "slot", "shard", "byte_offset"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder)
        for b in batches:
            shards = b.column(5).to_pylist()
            for shard, record in zip(shards, b.column(7), strict=True):
                writer.put(shard, record.as_py())
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array([writer.path(s) for s in shards], pa.string())], [*kept, "path"])
        writer.close()

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    at = f"{folder.rstrip('/')}-rows-{uuid.uuid4().hex}"
    for wave in range(WAVES):
        some = dealt.where(F.pmod("shard", F.lit(WAVES)) == wave).select(*kept, "record")
        found = written(some.mapInArrow(write, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", path string"), at, "append")
    return found


def write_shards(dealt: DataFrame, folder: str) -> DataFrame:
    """Write ordered() as files shard-NNNNNN.bin in a folder that all executors share.

    Returns shard, path, records, bytes, crc32.  A task writes under a name of its own
    and renames at the end, so a task that runs twice leaves one whole file.  Records are
    written as they come (no ids are looked at: null and repeated doc_ids are all one);
    an empty table writes nothing; further columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder)
        for b in batches:
            for shard, record in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                writer.put(shard, record.as_py())
        writer.close()
        cols = list(zip(*writer.done, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["shard", "path", "records", "bytes", "crc32"])

    return dealt.select("shard", "record").mapInArrow(write, "shard int, path string, records long, bytes long, crc32 long")
