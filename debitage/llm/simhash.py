"""SimHash near-dedup with pivot distance tables.

Fingerprints that differ in at most three of 64 bits are linked.  Copies collapse
first: only distinct fingerprints go on.  Six blocks of bits leave three untouched
by three differences, so two linked fingerprints meet in one of the twenty tables
that are keyed by three blocks.  Inside a meeting bucket the distances of every
member to the reference fingerprints are laid out as a table; a pair whose largest
coordinate difference is over three can't be linked (triangle inequality) and is
discarded; survivors are verified bit by bit.  A bucket of over ``HOT_BUCKET``
members is not compared pairwise: each member is dealt to the centres that lie
within two flips of the bits outside the key.  A centre reached by one flip of x
and by at most two of y proves the link x-y, and any linked pair has such a centre,
so the hot bucket costs a fixed number of rows for each member.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debitage.iterate import connected_components, materialise

WORDS = 3
SEED = 42
MAX_BITS = 3
PIVOTS = 24
HOT_BUCKET = 2048
#: (lowest bit, bits) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TABLES = tuple(itertools.combinations(range(6), 3))


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 values of all word shingles; no words: 0."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII only, as asked for
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(WORDS)), strict=False)
    hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in runs] or [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        some = np.array(hashes[at : at + 65536], dtype=">u8")
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [fingerprint(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def _row_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [fingerprint(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64()), b.column(2)], ["doc_id", "fp", "row"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def pivots() -> np.ndarray:
    """The reference fingerprints."""
    return np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def linked_pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fps within MAX_BITS, by pivot table, then verified."""
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    left, right = [], []
    for i in range(len(fps) - 1):
        rest = np.arange(i + 1, len(fps))
        for some in range(0, PIVOTS, 6):  # most pairs go after a few coordinates
            rest = rest[np.abs(table[rest, some : some + 6] - table[i, some : some + 6]).max(axis=1) <= MAX_BITS]
        rest = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= MAX_BITS]
        left.append(np.full(len(rest), i))
        right.append(rest)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for members in b.column(0):
            rows = members.values
            fps = rows.field("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rep = rows.field("rep").to_numpy(zero_copy_only=False)
            i, j = linked_pairs(fps)
            src.append(rep[i])
            dst.append(rep[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])


def key_of(fp, blocks: tuple[int, ...]):
    """The bits of some blocks of a fingerprint column, the others zero."""
    mask = sum(((1 << bits) - 1) << low for low, bits in (BLOCKS[b] for b in blocks))
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _hot_links(hot: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links of the members of hot buckets, through shared centres."""
    parts = []
    for t, blocks in enumerate(TABLES):
        free = [low + k for b, (low, bits) in enumerate(BLOCKS) if b not in blocks for k in range(bits)]
        flips = [0, *(1 << i for i in free), *((1 << i) | (1 << j) for i, j in itertools.combinations(free, 2))]
        near = [0] + [1] * len(free) + [2] * (len(flips) - 1 - len(free))
        signed = [x - (1 << 64) if x >> 63 else x for x in flips]
        dealt = F.explode(F.arrays_zip(F.array(*map(F.lit, signed)).alias("flip"), F.array(*map(F.lit, near)).alias("near")))
        parts.append((t, dealt))
    out = None
    for t, dealt in parts:
        rows = hot.where(F.col("t") == t).select("t", "key", "fp", "rep", dealt.alias("x"))
        rows = rows.select("t", "key", F.col("fp").bitwiseXOR(F.col("x.flip")).alias("centre"), "rep", F.col("x.near").alias("near"))
        out = rows if out is None else out.unionByName(rows)
    star = out.groupBy("t", "key", "centre").agg(F.min(F.when(F.col("near") <= 1, F.col("rep"))).alias("hub"))
    return out.join(star.where("hub is not null"), ["t", "key", "centre"]).where("rep <> hub").select(F.col("hub").alias("src"), F.col("rep").alias("dst")).distinct()


def linked_forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of linked_pairs as join the same fps, each from the lesser index."""
    i, j = linked_pairs(fps)
    begin, component = np.searchsorted(i, np.arange(len(fps) + 1)), np.arange(len(fps))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(fps)):
        to = j[begin[k] : begin[k + 1]]
        to = to[component[to] != component[k]]
        if len(to):
            others, first = np.unique(component[to], return_index=True)
            left.append(np.full(len(first), k))
            right.append(to[first])
            component[np.isin(component, others)] = component[k]
    return np.concatenate(left), np.concatenate(right)


def _bucket_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for members in b.column(0):
            rows = members.values
            rep = rows.field("rep").to_numpy(zero_copy_only=False)
            order = np.argsort(rep)
            i, j = linked_forest(rows.field("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[order])
            src.append(rep[order][i])
            dst.append(rep[order][j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])


def links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET, forests: bool = False) -> DataFrame:
    """src, dst: representatives of distinct fingerprints (columns fp, rep) that are linked, through others at least.

    ``forests``: of the links inside a bucket only as many as join its members.
    """
    tables = F.array(*(F.struct(F.lit(t).alias("t"), key_of(F.col("fp"), b).alias("key")) for t, b in enumerate(TABLES)))
    dealt = distinct.select("fp", "rep", F.explode(tables).alias("x")).select("x.t", "x.key", "fp", "rep")
    sizes = materialise(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    met = dealt.join(sizes, ["t", "key"])
    cold = met.where(F.col("n") <= hot_bucket).groupBy("t", "key").agg(F.collect_list(F.struct("fp", "rep")).alias("members")).select("members")
    found = cold.mapInArrow(_bucket_forests if forests else _bucket_links, "src long, dst long")
    if not sizes.where(F.col("n") > hot_bucket).isEmpty():
        found = found.unionByName(_hot_links(met.where(F.col("n") > hot_bucket)))
    return found


def near_duplicates(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, itself included.  Null and
    wordless texts have fingerprint zero and link like others; rows of equal doc_id
    stay rows; a null doc_id keeps its row, links like others and takes its component
    (null where no row of it has a doc_id).  An empty table gives an empty table; further columns are ignored.
    """
    rows = materialise(fingerprints(docs))
    # fingerprints are the nodes, so those that only null doc_ids have link too
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(distinct.select("fp", F.col("fp").alias("rep")), hot_bucket)).withColumnRenamed("node", "fp")
    of = distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(named, "component").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without rows of linked fingerprints: of each component the row of the smallest doc_id stays, once.

    Fingerprints are linked whatever their doc_ids: null and repeated ones too.
    """
    from debitage.llm.nearcopies import keep_least, row_hash

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_hash(docs).alias("row"))
    rows = materialise(rows.mapInArrow(_row_fingerprints, "doc_id long, fp long, row long"))
    distinct = materialise(rows.select("fp", F.col("fp").alias("rep")).distinct())
    found = connected_components(links(distinct)).withColumnRenamed("node", "fp")
    return keep_least(docs, rows.join(found, "fp", "left").select("doc_id", "row", F.coalesce("component", "fp").alias("component")))
