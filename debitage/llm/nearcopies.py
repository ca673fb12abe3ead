"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.

SimHash comes first: fingerprints of the shingles meet in the tables of bit blocks
and pivot distances of debitage.llm.simhash, and texts of linked fingerprints are
candidates.  A similarity of 0.8 leaves about ten of 64 fingerprint bits different, too
many for such tables.  So texts also meet where the least shingle hashes of a band agree
(twelve bands of four: two texts of similarity 0.8 meet with probability 0.998), and
fingerprints of radius ``RADIUS`` discard there what can't be linked.  What is left is
verified by its exact shingle sets.  Members of a large bucket are first compared with
its centres, the members next to the bucket's majority fingerprint; pairs that these
links don't join are compared afterwards, all of them.  A large bucket is never one
group of a task: its members are dealt to runs, and its majority and centres come from
aggregates that are combined before the shuffle.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import connected_components, materialise
from debitage.llm import simhash
from debitage.llm.wordhash import slices

WORDS = 5
SIMILAR = 0.8
BANDS, DEPTH = 12, 4
#: Bits of 64 by which texts of similarity 0.8 can differ: about 10 are expected, with a deviation of 3.
RADIUS = 24
#: Members of a bucket that are all compared at once, and the centres of a larger one.
SMALL, CENTRES = 16, 8
#: Members of a large bucket are compared in chunks of about so many, two chunks in a task.
CHUNK = 512
#: Members of a large bucket, or partners of one text, that go to a task together.
RUN = 1024
_RNG = np.random.default_rng(42)
_PLACE = _RNG.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 2**64, BANDS * DEPTH, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    """All runs of five words; all words where they are fewer; nothing without words."""
    words = word_list(text)
    return {tuple(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))} if words else set()


def similarity(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signature(text: str | None) -> tuple[int, int, int, list[int]]:
    """Hash of the words, number of shingles, fingerprint of 64 bits and the keys of the bands."""
    import xxhash

    words = word_list(text)
    whole = xxhash.xxh64_intdigest(b" ".join(words), 42)
    whole -= (whole >> 63) << 64
    if not words:
        return whole, 0, 0, []
    each = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
    n = max(1, len(words) - WORDS + 1)
    hashes = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        hashes += _mixed(each[k : k + n] * _PLACE[k])
    hashes = np.unique(_mixed(hashes))
    votes, least = np.zeros(64, np.int64), np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096]
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, _mixed((some[:, None] ^ _XOR) * _ODD).min(axis=0))
    fp = int(np.packbits(2 * votes > len(hashes)).view(np.int64)[0])
    keys = _mixed((least.reshape(BANDS, DEPTH) * _PLACE[:DEPTH]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return whole, len(hashes), fp, keys.view(np.int64).tolist()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [signature(t.as_py()) for t in b.column(2)]
        th, n, fp, keys = zip(*found, strict=True) if found else ((), (), (), ())
        made = [pa.array(th, pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "row", "th", "n", "fp", "keys"])


def _near(fps: np.ndarray, n: np.ndarray, i: int, to: np.ndarray) -> np.ndarray:
    """Those of ``to`` that can be similar to i: by fingerprint and number of shingles."""
    to = to[np.minimum(n[to], n[i]) >= SIMILAR * np.maximum(n[to], n[i])]
    return to[np.bitwise_count(fps[to] ^ fps[i]) <= RADIUS]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of small buckets, a < b: all of each."""
    for batch in batches:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for members in batch.column(0):
            rows = members.values
            th, n, fps = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("th", "n", "fp"))
            fps, every = fps.view(np.uint64), np.arange(len(th))
            for i in every[:-1]:
                to = _near(fps, n, i, every[i + 1 :])
                left.append(np.full(len(to), th[i]))
                right.append(th[to])
        x, y = np.concatenate(left), np.concatenate(right)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _runs(size: Column) -> Column:
    return F.ceil(size / RUN).cast("int")


def _dealt(table: DataFrame) -> DataFrame:
    """table with a row for each ``run`` of its ``runs``."""
    return table.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("runs")


def _centre_pairs(large: DataFrame) -> DataFrame:
    """a, b, turned: candidate pairs a < b of members (key, th, n, fp, size) of large buckets and their centres; turned where the centre is b."""
    runs = _runs(F.col("size"))
    members = large.select("key", "th", "n", "fp", F.pmod(F.xxhash64("th"), runs).cast("int").alias("run"), runs.alias("runs"))
    ones = [F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))).alias(f"one{k}") for k in range(64)]
    votes = members.groupBy("key").agg(F.count("*").alias("many"), F.max("runs").alias("runs"), *ones)
    bits = [F.when(2 * F.col(f"one{k}") > F.col("many"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")) for k in range(64)]
    majority = votes.select("key", "runs", functools.reduce(Column.bitwiseOR, bits).alias("majority"))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("majority")))
    first = F.row_number().over(Window.partitionBy("key").orderBy("far", "th"))
    centres = members.join(_dealt(majority), ["key", "run"]).select("key", "th", "n", "fp", "runs", far.alias("far")).withColumn("first", first).where(F.col("first") <= CENTRES)
    centres = materialise(centres.select("key", "runs", F.col("th").alias("c"), F.col("n").alias("cn"), F.col("fp").alias("cfp")))
    met = members.join(_dealt(centres), ["key", "run"]).where("th <> c").where(F.least("n", "cn") >= SIMILAR * F.greatest("n", "cn"))
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("cfp"))) <= RADIUS)
    return met.select(F.least("th", "c").alias("a"), F.greatest("th", "c").alias("b"), (F.col("c") > F.col("th")).alias("turned"))


def _rest_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components inside two chunks of a large bucket, each pair in the first band that it shares."""
    for batch in batches:
        src, dst = [], []
        for key, cross, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            rows = members.values
            th, n, fps, component, chunk = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("th", "n", "fp", "component", "chunk"))
            keys = np.array(rows.field("keys").to_pylist(), np.int64).reshape(-1, BANDS)
            sets = [shingle_set(t.as_py()) for t in rows.field("text")]
            fps, component, every = fps.view(np.uint64), component.copy(), np.arange(len(th))
            for i in every[:-1]:
                to = every[i + 1 :][component[i + 1 :] != component[i]]
                to = _near(fps, n, i, to[chunk[to] != chunk[i]] if cross else to)
                same = keys[to] == keys[i]
                for j in to[keys[i][same.argmax(axis=1)] == key] if len(to) else ():
                    if component[j] != component[i] and similarity(sets[i], sets[j]) >= SIMILAR:
                        src.append(int(th[i]))
                        dst.append(int(th[j]))
                        component[component == component[j]] = component[i]
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: tuple = (None, set())
    for b in batches:
        src, dst = [], []
        for x, y, s, t in zip(*(b.column(k) for k in range(4)), strict=True):
            x, y = x.as_py(), y.as_py()
            if known[0] != x:
                known = (x, shingle_set(s.as_py()))
            if similarity(known[1], shingle_set(t.as_py())) >= SIMILAR:
                src.append(x)
                dst.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _texts(ths: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """ths (th, ...; each th once) with one text of each."""
    needed = ths.join(texts.select("th", "rep"), "th")
    own = docs.select(row_hash(docs).alias("rep"), F.col("text").cast("string").alias("text")).join(needed, "rep")
    return materialise(own.select(*ths.columns, "text").dropDuplicates(["th"]))


def _links(pairs: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, by their texts; an ``a`` of many partners (a centre) is dealt to runs of them."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("th"), F.lit(1).alias("first")), F.struct(F.col("b").alias("th"), F.lit(0).alias("first")))).alias("x"))
    own = _texts(ends.groupBy("x.th").agg(F.greatest(_runs(F.sum("x.first")), F.lit(1)).alias("runs")), docs, texts)
    many = own.where("runs > 1").select(F.col("th").alias("a"), "runs")
    run = F.pmod(F.xxhash64("b"), F.coalesce("runs", F.lit(1))).cast("int")
    spread = pairs.join(many, "a", "left").select("a", "b", run.alias("run"))
    s = _dealt(own.select(F.col("th").alias("a"), F.col("text").alias("s"), "runs"))
    both = spread.join(own.select(F.col("th").alias("b"), F.col("text").alias("t")), "b").join(s, ["a", "run"])
    return materialise(both.select("a", "b", "s", "t").mapInArrow(_verified, "src long, dst long"))


def _of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links).withColumnRenamed("node", "th")
    return nodes.join(found, "th", "left").withColumn("component", F.coalesce("component", "th"))


def _fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """a, b, turned: candidate pairs a < b of texts whose fingerprints are equal or linked by SimHash's tables.

    The least text stands for its fingerprint, so an end of many partners is a representative: a, or b where turned.
    """
    reps = materialise(texts.groupBy("fp").agg(F.min("th").alias("rep"), F.count("*").alias("n")))
    same = texts.join(reps.where("n > 1"), "fp").where("th <> rep").select(F.col("rep").alias("src"), F.col("th").alias("dst"))
    met = simhash.links(reps.select("fp", "rep"), forests=True).unionByName(same)
    return met.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") > F.col("dst")).alias("turned"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of all columns), component of every row of docs: links are exact Jaccard >= 0.8."""
    rows = docs.select(F.col("doc_id").cast("long"), row_hash(docs).alias("row"), F.col("text").cast("string").alias("text"))
    rows = materialise(rows.mapInArrow(_signatures, "doc_id long, row long, th long, n long, fp long, keys array<long>"))
    texts = materialise(rows.groupBy("th", "n", "fp", "keys").agg(F.min("row").alias("rep")))
    dealt = texts.select("th", "n", "fp", F.explode("keys").alias("key"))
    sizes = materialise(dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    met = dealt.join(sizes, "key")
    buckets = met.where(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("th", "n", "fp")).alias("members")).select("members")
    pairs = _fingerprint_pairs(texts.select("th", "fp")).unionByName(buckets.mapInArrow(_pairs, "a long, b long").withColumn("turned", F.lit(False)))
    some_large = not sizes.where(F.col("size") > SMALL).isEmpty()
    if some_large:
        large = materialise(met.where(F.col("size") > SMALL))
        pairs = pairs.unionByName(_centre_pairs(large))
    # each pair once; a centre comes first, so only the first text of a pair can have many partners
    pairs = pairs.groupBy("a", "b").agg(F.max("turned").alias("turned"))
    pairs = pairs.select(F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("b"))
    links = _links(materialise(pairs), docs, texts)
    if some_large:
        large = materialise(_of(large, links))
        mixed = large.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        large = large.join(mixed, "key").join(texts.select("th", "keys"), "th")
        large = large.join(_texts(large.select("th").distinct(), docs, texts), "th")
        chunks = F.ceil(F.col("size") / CHUNK).cast("int")
        large = large.withColumn("chunk", F.pmod(F.xxhash64("th"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        cells = large.groupBy("key", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"))
        cells = cells.agg(F.collect_list(F.struct("th", "n", "fp", "component", "chunk", "keys", "text")).alias("members"))
        links = links.unionByName(cells.select("key", (F.col("p") != F.col("q")).alias("cross"), "members").mapInArrow(_rest_links, "src long, dst long"))
    return _of(rows.select("doc_id", "row", "th"), links).select("doc_id", "row", "component")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns, whatever their names."""
    return F.xxhash64(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


def keep_least(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of docs for each component of rows (doc_id, row, component): the least doc_id, then the least hash.

    Null doc_ids come last.  Rows are told by the hash of all their columns, so equal
    doc_ids with other texts stay apart, and of rows equal throughout one stays.
    Columns of any name pass through.
    """
    counted = rows.groupBy("component", "doc_id", "row").agg(F.count("*").alias("copies"))
    least = counted.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "copies")).alias("k"))
    own, copies = (f"{name}_{uuid.uuid4().hex}" for name in ("row", "copies"))
    kept = materialise(least.select(F.col("k.row").alias(own), F.col("k.copies").alias(copies)))
    named = docs.withColumn(own, row_hash(docs))
    out = named.join(kept.where(F.col(copies) == 1), own).drop(own, copies)
    many = kept.where(F.col(copies) > 1)
    if not many.isEmpty():
        out = out.unionByName(named.join(many, own).dropDuplicates([own]).drop(own, copies))
    return out


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the row of the smallest doc_id stays, once.

    Null and wordless texts are copies of each other; null doc_ids count as the largest;
    an empty table stays empty; columns of any name pass through.
    """
    return keep_least(docs, components(docs))
