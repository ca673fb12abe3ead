"""Approximate nearest neighbours with score-aware (anisotropic) quantisation.

The smallest Euclidean distance is the largest inner product q.x - |x|^2 / 2.  A vector
is its length, kept as it is, times a direction, which is cut into subspaces of ``DIMS``
components, each coded in four bits.  Codebooks are trained on a bounded sample under
the anisotropic loss, which weighs the part of the residual along the vector more than
the part across it, because that is what changes large inner products.  A search scans
the four-bit codes through a table of 16 partial scores for each query and subspace.
Each row keeps the size of its residual, so a scan knows how far a score can be off:
after the best candidates are reranked exactly, in double precision, every row whose
score could still beat the k-th of them is reranked too, however many they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import materialise, shared_folder

CENTRES = 16
DIMS = 2
SAMPLE = 20_000
ROUNDS = 12
#: Weight of the parallel part of the residual over the orthogonal one.
PARALLEL = 4.0
#: Queries that one scan carries (their vectors pass through the driver), and those and the code rows that one step scores.
QUERIES = 16_384
QUERY_BLOCK = 256
ROWS = 8192
#: Candidates that are reranked first for each of the k results asked for.
RERANK = 4
#: Deviations by which a row's score may be off: a residual of length r changes q.x by about |q| r / sqrt(dimensions).
DEVIATIONS = 3.0


@dataclass
class Codebook:
    """centres: subspaces x CENTRES x DIMS; dim: components of a vector."""

    centres: np.ndarray
    dim: int

    def parts(self, x: np.ndarray) -> np.ndarray:
        """x, filled up with zeros, as rows x subspaces x DIMS."""
        m = len(self.centres)
        full = np.zeros((len(x), m * DIMS), np.float32)
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), m, DIMS)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x subspaces): nearest centres, then sweeps that lower the anisotropic loss."""
        parts = self.parts(x)
        codes = ((parts[:, :, None, :] - self.centres[None]) ** 2).sum(-1).argmin(-1)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        units = self.parts(unit.astype(np.float32))
        m = np.arange(len(self.centres))
        along = (units * (parts - self.centres[m, codes])).sum(-1)
        total = along.sum(1)
        for _ in range(sweeps):
            for s in m:
                rest = total - along[:, s]
                gap = parts[:, s, None, :] - self.centres[s][None]
                own = (units[:, s, None, :] * gap).sum(-1)
                loss = (gap**2).sum(-1) + (PARALLEL - 1) * (rest[:, None] + own) ** 2
                codes[:, s] = loss.argmin(1)
                along[:, s] = own[np.arange(len(x)), codes[:, s]]
                total = rest + along[:, s]
        return codes.astype(np.uint8)


def train(x: np.ndarray, seed: int = 5) -> Codebook:
    """Codebooks from sample vectors: assignments and least squares under the anisotropic loss, in turn."""
    rng = np.random.default_rng(seed)
    m = -(-x.shape[1] // DIMS)
    book = Codebook(np.zeros((m, CENTRES, DIMS), np.float32), x.shape[1])
    parts = book.parts(x)
    pick = rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)
    book.centres = parts[pick].transpose(1, 0, 2).copy()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    units = book.parts(unit.astype(np.float32)).astype(np.float64)
    for step in range(ROUNDS):
        codes = book.encode(x, sweeps=int(step > 2))
        kept = book.centres[np.arange(m), codes]
        total = (units * (parts - kept)).sum((1, 2))
        for s in range(m):
            rest = total - (units[:, s] * (parts[:, s] - kept[:, s])).sum(-1)
            for c in range(CENTRES):
                own = codes[:, s] == c
                if not own.any():
                    book.centres[s, c] = parts[rng.integers(len(x)), s]
                    continue
                u, p = units[own, s], parts[own, s].astype(np.float64)
                # minimise |p - c|^2 + (PARALLEL - 1)(rest + u.(p - c))^2 over c
                a = own.sum() * np.eye(DIMS) + (PARALLEL - 1) * u.T @ u
                b = p.sum(0) + (PARALLEL - 1) * (u * (rest[own] + (u * p).sum(1))[:, None]).sum(0)
                book.centres[s, c] = np.linalg.solve(a, b)
    return book


def _pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, ::2] | codes[:, 1::2] << 4


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part."""
    kind = vectors.schema["embedding"].dataType
    v = F.col("embedding").cast("array<double>" if "double" in kind.simpleString() else "array<float>")
    sound = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null").where(sound)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths)."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    length = top[:, 0] * np.sqrt(((x / top) ** 2).sum(axis=1))
    return (x / length[:, None]).astype(np.float32), length


def indexed(book: Codebook, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes, size of the residual) of the directions of x."""
    unit, _ = directions(x)
    codes = book.encode(unit)
    gap = book.parts(unit) - book.centres[np.arange(len(book.centres)), codes]
    return _pack(codes), np.sqrt((gap.astype(np.float64) ** 2).sum((1, 2)))


def build(rows: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Codebook]:
    """The index of clean rows of one dimension (vec_id, v, codes, off) and its codebook."""
    n = rows.count()
    chance = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)) / float(1 << 40)
    some = rows.where(chance < sample / n) if n > sample else rows
    # bounded by `sample`; many equal rows may all be drawn or none, so a few others always are
    x = [r["v"] for r in some.select("v").limit(2 * sample).collect()] or [r["v"] for r in rows.select("v").limit(CENTRES).collect()]
    book = train(directions(np.array(x))[0])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                packed, off = indexed(book, _matrix(b.column(1), b.num_rows))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(off.astype(np.float32))], ["vec_id", "v", "codes", "off"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(encode, f"vec_id long, v {kind}, codes binary, off float"), book


def search(book: Codebook, ids: np.ndarray, q: np.ndarray, vec: np.ndarray, x: np.ndarray, packed: np.ndarray, off: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, distances, vec_ids): the k nearest of the rows x (in order of vec_id) for each query."""
    m = len(book.centres)
    codes = np.empty((len(vec), 2 * packed.shape[1]), np.uint8)
    codes[:, ::2], codes[:, 1::2] = packed & 15, packed >> 4
    flat = (codes[:, :m].astype(np.int32) + CENTRES * np.arange(m, dtype=np.int32)).T.copy()
    x64, q64 = x.astype(np.float64), q.astype(np.float64)
    length = directions(x)[1]
    q_unit, q_length = directions(q)
    slack = 2 * DEVIATIONS * length * off / np.sqrt(x.shape[1])
    for at in range(0, len(ids), QUERY_BLOCK):
        # queries x subspaces x CENTRES: what each code adds to a query's score
        luts = np.einsum("qmd,mcd->qmc", book.parts(q_unit[at : at + QUERY_BLOCK]), book.centres).astype(np.float32)
        for i in range(at, min(at + QUERY_BLOCK, len(ids))):
            lut = luts[i - at].ravel()
            score = lut[flat[0]]
            for s in range(1, m):
                score += lut[flat[s]]
            far = length * (length - 2 * q_length[i] * score)  # the squared distance, but for |q|^2
            far[vec == ids[i]] = np.inf
            most = min(len(vec), k * RERANK)
            near = np.argpartition(far, most - 1)[:most]
            exact = lambda rows: np.sqrt(((x64[rows] - q64[i]) ** 2).sum(1))  # noqa: B023, E731
            d = exact(near)
            live = np.isfinite(far[near])
            kth = np.partition(d[live], k - 1)[k - 1] if live.sum() >= k else np.inf
            could = far - q_length[i] * slack <= kth**2 - q_length[i] ** 2
            could[near] = False
            more = np.flatnonzero(could & np.isfinite(far))
            near, d = np.concatenate([near[live], more]), np.concatenate([d[live], exact(more)])
            order = np.lexsort((vec[near], d))[:k]
            yield i, d[order], vec[near[order]]


def _scan(ids: np.ndarray, q: np.ndarray, book: Codebook, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for own in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            order = np.argsort(own.column(0).to_numpy(), kind="stable")
            vec = own.column(0).to_numpy()[order]
            x = _matrix(own.column(1), len(vec))[order]
            packed = np.frombuffer(b"".join(own.column(2).to_pylist()), np.uint8).reshape(len(vec), -1)[order]
            off = own.column(3).to_numpy()[order].astype(np.float64)
            for i, d, v in search(book, ids, q, vec, x, packed, off, k):
                if i in best:
                    d, v = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], v])
                    near = np.lexsort((v, d))[:k]
                    d, v = d[near], v[near]
                best[i] = d, v
        rows = [(ids[i], v, d) for i, (ds, vs) in best.items() for d, v in zip(ds, vs, strict=True)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(cols[0], np.int64)), pa.array(np.array(cols[1], np.int64)), pa.array(np.array(cols[2], np.float64))], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its k nearest others.

    Score is the Euclidean distance of the original vectors in double precision; equal
    ones go to the smaller vec_id.  Null, empty, zero and non-finite vectors and null
    vec_ids take no part; only vectors of the query's own length have a distance to it;
    rows of a query's own vec_id are not its candidates; of repeated rows each is a
    candidate, a repeated query is asked once (with its least vector).  An empty table
    gives an empty result; further columns are ignored.

    Queries go in groups of about ``QUERIES``, one scan of the codes each; what a scan
    finds is stored before the next group's vectors pass through the driver.
    """
    spark = vectors.sparkSession
    rows = clean(vectors)
    schema = "query_id long, vec_id long, score double"
    at, parts = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}", 0
    # one row for each length of vector
    for size in sorted(r["d"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect()):
        own = rows.where(F.size("v") == size)
        asked = own.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
        n = asked.count()
        if not n:
            continue
        index, book = build(own)
        groups = -(-n // QUERIES)
        index = materialise(index) if groups > 1 else index
        for g in range(groups):
            some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).collect()  # about QUERIES rows
            ids, q = np.array([r["vec_id"] for r in some], np.int64), np.array([r["v"] for r in some])
            index.mapInArrow(_scan(ids, q.astype(np.float32) if "float" in own.schema["v"].dataType.simpleString() else q, book, k), schema).write.parquet(f"{at}/part-{parts}")
            parts += 1
    found = spark.read.schema(schema).parquet(*(f"{at}/part-{p}" for p in range(parts))) if parts else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
