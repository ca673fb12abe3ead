"""Importance resampling of documents towards a target distribution.

Features are hashed n-grams of words.  Each text is scanned once: its words, lower-cased
and joined by one space, are run through a CRC, and every n-gram's CRC comes from the
running ones at its two ends (prefixcrc).  Bucket counts of the corpus and of the
target give each bucket a gain, a document weighs the sum of its features' gains, and
the highest of the weights plus Gumbel noise are drawn, which samples without
replacement in proportion to the weights.

The corpus is read twice, for the counts and for the weights; each task hands over one
count a bucket.  Ranks come from ranges of the order, numbered one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import materialise
from debitage.llm.prefixcrc import POLYNOMIAL, Prefixes
from debitage.llm.wordhash import LOWER, buffers, slices, spans

LENGTHS = (1, 1)
BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN = 10
SEED = 2024


def features(texts: pa.Array, lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram of a batch, the text that it is in, and the words of each text."""
    data, offsets = buffers(texts)
    low = LOWER[data]
    _, length, first, word = spans(low, offsets)
    # the words one after another, a space between two
    begin = np.cumsum(length + 1) - length - 1
    joined = np.full(int((length + 1).sum()), 32, np.uint8)
    joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = low[word]
    prefixes = Prefixes(joined)
    words = np.diff(first)
    text = np.repeat(np.arange(len(texts)), words)
    last = first[1:][text]
    bucket, of = [], []
    for n in range(lengths[0], lengths[1] + 1):
        at = np.flatnonzero(np.arange(len(length)) + n <= last)
        end = at + n - 1
        bucket.append(prefixes.crc(begin[at], begin[end] + length[end]) % np.uint32(buckets))
        of.append(text[at])
    return np.concatenate(bucket).astype(np.int64), np.concatenate(of), words


def bucket_counts(texts: DataFrame, lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, many: how often each bucket occurs in all texts (text); a task hands over each bucket once at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches):
            total += np.bincount(features(b.column(0), lengths, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "many"])

    return texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, many long").groupBy("bucket").agg(F.sum("many").alias("many"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus frequency, of each bucket, smoothed by one."""
    n = float(len(corpus))
    s, t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + n) / ((x + 1) * (t + n)))) for x, y in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, drawn from the doc_id; that of a null one is drawn from an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _collected(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # at most one row a bucket
        out[r["bucket"]] = r["many"]
    return out


def weighed(docs: DataFrame, target: DataFrame, lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, words, n_features, weight, score of every row of docs (doc_id, text) for the target's texts (text)."""
    gain = gains(_collected(bucket_counts(docs, lengths, buckets), buckets), _collected(bucket_counts(target, lengths, buckets), buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            bucket, text, words = features(b.column(1), lengths, buckets)
            weight = np.zeros(b.num_rows, np.int64)
            np.add.at(weight, text, gain[bucket])
            score = weight + np.array([noise(d, seed) for d in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.astype(np.int64)), pa.array(np.bincount(text, minlength=b.num_rows)), pa.array(weight), pa.array(score)], ["doc_id", "words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(weigh, "doc_id long, words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS, least: int = LEAST_WORDS, drawn: int = DRAWN, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text), drawn towards target (text).

    Of the rows of at least ``least`` words, ``drawn`` in a hundred (rounded down) have a
    rank: the highest scores, equal ones by ascending doc_id with null last, rows equal
    in both in any order.  Null and wordless texts have no features and weight 0; a null
    doc_id draws noise of its own; repeated rows count each; an empty table gives an
    empty one; without target texts all gains follow from the corpus alone; further
    columns are ignored.
    """
    rows = materialise(weighed(docs, target, lengths, buckets, seed).withColumn("n", F.monotonically_increasing_id()))
    fit = F.col("words") >= least
    # where not everything can be drawn, rows of too few words stand behind all others
    order = [fit.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n").asc()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: (r["many"], r["fit"]) for r in ranged.groupBy("part").agg(F.count("*").alias("many"), F.count(F.when(fit, 1)).alias("fit")).collect()}  # one row a part
    many = drawn * sum(f for _, f in sizes.values()) // 100
    base, before = [], 0
    for part in sorted(sizes):
        base.append((part, before))
        before += sizes[part][0]
    bases = rows.sparkSession.createDataFrame(base, "part int, base long")
    place = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.join(F.broadcast(bases), "part").select("doc_id", "n_features", "weight", "score", F.when(place <= many, place).cast("long").alias("rank"))  # a row for each part


def oracle() -> str:
    """DuckDB SQL for resample() over documents and benchmark."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (POLYNOMIAL if k & 1 else 0)
        table.append(k)
    words = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
    with d as (select doc_id, row_number() over () as rk, {words} as w from documents),
    f as (select rk, unnest(w) as f from d),
    g as (select unnest({words}) as f from benchmark),
    names as materialized (select f, hex(f) as x from (select f from f union select f from g)),
    crc as materialized (select f, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::bigint)),
      lambda c, b: xor(c >> 8, ({table}::bigint[])[1 + (xor(c, b) & 255)])), 4294967295) % {BUCKETS} as bucket from names),
    s as (select bucket, count(*)::double as s from f join crc using (f) group by bucket),
    t as (select bucket, count(*)::double as t from g join crc using (f) group by bucket),
    n as (select (select count(*) from f)::double as n_s, (select count(*) from g)::double as n_t),
    gain as materialized (select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (n_s + {BUCKETS}) / ((s + 1) * (n_t + {BUCKETS}))))::bigint as gain from s left join t using (bucket) cross join n),
    w as (select rk, sum(gain)::bigint as weight from f join crc using (f) join gain using (bucket) group by rk),
    h as (select doc_id, rk, len(w) as words, coalesce(weight, 0) as weight, ('0x' || sha256('{SEED}:' || coalesce(doc_id::varchar, ''))[1:8])::bigint::double as h from d left join w using (rk)),
    e as (select *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::bigint as score from h),
    r as (select *, row_number() over (order by (words >= {LEAST_WORDS}) desc, score desc, doc_id nulls last) as place from e)
    select doc_id, words::bigint as n_features, weight::bigint as weight, score, case when place <= {DRAWN} * (select count(*) from e where words >= {LEAST_WORDS}) // 100 then place end::bigint as rank from r
    """
