"""Sharding by sampled splitters, in DataFrame functions only; the law is ``bytes``.

A record's key is (hash of its text, hash of its doc_id, number of its stored row), so
equal texts are neighbours, and a group of copies too large for its range is still
divisible, be its doc_ids equal or null.  Keys
are sampled with a chance in proportion to their size; quantiles of the sample are
the boundaries of fine ranges.  The ranges' exact bytes are summed, and shards are
cut where the running sum passes a shard's share.  A range that a cut falls into is
overfull for one shard: it is subdivided by a sample of its own and cut again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import materialise

SHARDS = 8
#: Ranges of the first cut, parts of each range that is subdivided, and sample rows for each of them.
RANGES = 64
PARTS = 12
PER_RANGE = 40
#: Rounds of subdivision at most, and the part of a shard that a cut may be off.
ROUNDS = 3
OFF = 0.002
#: Records of a shard that one window numbers, about.
RUN = 50_000

Key = tuple[int, int, int]


def _index(bounds: list[Key]) -> Column:
    """The number of bounds at or below the key: groups of them are looked up first, then the bounds of one group."""
    if not bounds:
        return F.lit(0)
    key = F.struct("h", "d", "n")
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    literal = lambda keys: F.array(*(F.struct(F.lit(h).alias("h"), F.lit(d).alias("d"), F.lit(n).alias("n")) for h, d, n in keys))
    reached = lambda keys: F.size(F.filter(keys, lambda b: b <= key))
    group = F.greatest(reached(literal([g[0] for g in groups])) - 1, F.lit(0))
    return group * width + reached(F.get(F.array(*map(literal, groups)), group))


def _splitters(rows: DataFrame, weight: dict[int, int], parts: int) -> list[Key]:
    """Quantile boundaries inside the ranges (column r) of the given bytes: a size-weighted sample of parts * PER_RANGE keys of each."""
    asked = F.create_map(*(F.lit(x) for r, b in weight.items() for x in (r, parts * PER_RANGE / max(b, 1))))[F.col("r")]
    # a fixed hash of the record decides, so a task that runs again draws the same sample
    chance = F.pmod(F.xxhash64("h", "d", "n", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    some = rows.where(F.col("r").isin(list(weight))).where(chance < F.col("size") * asked).select("r", "h", "d", "n")
    keys: dict[int, list[Key]] = {}
    for x in some.collect():  # a bounded sample
        keys.setdefault(x["r"], []).append((x["h"], x["d"], x["n"]))
    return [own[len(own) * k // parts] for own in map(sorted, keys.values()) for k in range(1, parts)]


def _cuts(rows: DataFrame, shards: int) -> list[Key]:
    """The least key of each shard but the first: the boundaries nearest to equal bytes."""
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    wants = [total * k / shards for k in range(1, shards)]
    bounds = sorted({*_splitters(rows.withColumn("r", F.lit(0)), {0: total}, RANGES)})
    for last in [*[False] * ROUNDS, True]:
        ranged = rows.withColumn("r", _index(bounds))
        sums = {x["r"]: x["b"] for x in ranged.groupBy("r").agg(F.sum("size").alias("b")).collect()}
        starts = [0]
        for k in range(len(bounds) + 1):
            starts.append(starts[-1] + sums.get(k, 0))
        inside = {max(i for i in range(len(bounds) + 1) if starts[i] <= want) for want in wants}
        overfull = {k: sums[k] for k in inside if sums.get(k, 0) > OFF * total / shards}
        wider = [] if last or not overfull else sorted({*bounds, *_splitters(ranged, overfull, PARTS)})
        if len(wider) <= len(bounds):
            break
        bounds = wider
    # starts[k + 1] are the bytes below bounds[k]
    nearest = (min(range(len(bounds)), key=lambda k: abs(starts[k + 1] - want)) for want in wants if bounds)
    return sorted(bounds[k] for k in nearest)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text).

    Size is the UTF-8 bytes of the text (null: none) plus one.  Shards differ in bytes
    by the last subdivision's ranges at most; slots count a shard's records from 0
    without gaps.  Equal texts share a shard unless a cut falls inside their group.
    Null and repeated doc_ids keep their rows, and rows equal throughout are dealt like
    others; with fewer records than shards some
    stay empty; an empty table gives an empty one; further columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64("doc_id").alias("d"),
        F.monotonically_increasing_id().alias("n"),
    )
    rows = materialise(rows)  # from here on each row keeps its number
    placed = rows.withColumn("shard", _index(_cuts(rows, shards)).cast("int"))
    salts = max(1, rows.count() // (RUN * shards))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("d", "h", "n"), F.lit(salts)))
    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("many"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "salt", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("h", "d", "n")) - 1
    return placed.withColumn("own", own).join(bases, ["shard", "salt"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("own")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
