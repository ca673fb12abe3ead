"""Toxicity scores from a convolutional text classifier trained in numpy.

A word is the mean of the hashed embeddings of itself and of its first four to seven
bytes; filters over one, two and three words are maximised over the text, and a
logistic layer on the maxima gives the score, calibrated on labelled rows that the
training didn't see.  Thresholds are calibrated by language.  The classifier learns
from every labelled row that isn't held out, whole texts: tasks train on parts of
about ``ROWS`` of them and their states are averaged after each epoch.  Calibration
and thresholds are sums over all rows of the calibration fold.  Scoring reads whole
texts and needs no shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debitage.iterate import materialise, shared_folder, written
from debitage.llm.wordhash import Words, buffers, slices

#: Labelled rows of a part, whose task trains by itself during an epoch.
ROWS = 4096
#: Bytes of features of a part that are shuffled and learned from at once.
HELD = 1 << 25
BUCKETS = 1 << 15
PREFIXES = (4, 5, 6, 7)
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 6
BATCH = 32
THRESHOLD = 0.3
#: Words that are scored at once, and words of one text that are learned from at once.
PART = 1 << 16
LEARNED = 1 << 14
#: Sums over tasks are of whole multiples of these, so they don't depend on the order of tasks.
STATE_UNIT, SUM_UNIT = 2.0**-24, 2.0**-20
#: Slices in which long vectors are added up, each by itself.
SLICES = 32
#: Weights are whole multiples of it while texts are scored.
EXACT = 2.0**-20
#: Steps of the score from one candidate of a threshold to the next.
STEPS = 1 << 14

#: Column groups of the score table: (width, offset) pairs, FILTERS columns each.
TAPS = [(w, j) for w in WIDTHS for j in range(w)]
WIDTH = len(WIDTHS) * FILTERS


def word_buckets(w: Words) -> np.ndarray:
    """For each word the buckets of its features; a prefix that it's too short for is bucket 0."""
    out = np.zeros((len(w.hash), 1 + len(PREFIXES)), np.uint16)
    for k, h in enumerate((w.hash, *w.prefixes(PREFIXES))):
        out[:, k] = np.where(h == 0, 0, h % np.uint64(BUCKETS - 1) + np.uint64(1))
    return out


#: Embeddings of the buckets, each divided by a word's number of buckets, and the taps' weights as taps * FILTERS x DIM.
Table = tuple[np.ndarray, np.ndarray]


def _tapped(taps: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(taps.transpose(0, 2, 1).reshape(-1, DIM), np.float32)


def _windows(table: Table, buckets: np.ndarray, first: np.ndarray, most: int, places: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each text and filter the first of the windows with the largest value (as a word of all), and that value.

    Goes over ``most`` words at once; texts without words have 0 and -inf.
    """
    embed, taps = table
    n = len(first) - 1
    wins, best = np.zeros((n, WIDTH if places else 0), np.int64), np.full((n, WIDTH), -np.inf, np.float32)
    text = np.repeat(np.arange(n), np.diff(first))
    reach = max(WIDTHS) - 1
    for a in range(0, len(buckets), most):
        b = min(a + most, len(buckets))
        c = min(b + reach, len(buckets))
        words = embed.take(buckets[a:c, 0], axis=0)
        for k in range(1, buckets.shape[1]):
            words += embed.take(buckets[a:c, k], axis=0)
        added = taps @ words.T
        of = text[a:c]
        heads = np.flatnonzero(np.diff(of[: b - a], prepend=-1))
        own = of[heads]
        size = np.diff(heads, append=b - a)
        at = 0
        for i, w in enumerate(WIDTHS):
            y = added[at : at + FILTERS, : b - a].copy()
            for j in range(1, w):
                tap = added[at + j * FILTERS : at + (j + 1) * FILTERS, j : j + b - a]
                m = tap.shape[1]
                over = np.flatnonzero(of[j : j + m] != of[:m])  # a window ends with its text
                kept = y[:, over]
                y[:, :m] += tap
                y[:, over] = kept
            at += w * FILTERS
            top = np.maximum.reduceat(y, heads, axis=1)
            for f, col in enumerate(range(i * FILTERS, (i + 1) * FILTERS)):
                if places:
                    found = np.flatnonzero(y[f] == np.repeat(top[f], size))[::-1]
                    place = np.zeros(n, np.int64)
                    place[of[found]] = a + found  # the first of each text is assigned last
                    more = own[top[f] > best[own, col]]
                    wins[more, col] = place[more]
                best[own, col] = np.maximum(best[own, col], top[f])
    return wins, best


@dataclass
class Model:
    """embed: buckets x DIM; taps: (width, offset) x DIM x FILTERS; bias, out: widths * FILTERS."""

    embed: np.ndarray
    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def table(self) -> Table:
        """What turns the buckets of words into what they add to each tap's filters.

        Multiples of 2^-20 below 8, so all products and sums are exact in doubles, in any
        order: a text's maxima don't depend on where in a batch it stands.
        """
        e, taps = (np.clip(np.rint(x.astype(np.float64) / EXACT), -8 / EXACT, 8 / EXACT) * EXACT for x in (self.embed / (1 + len(PREFIXES)), _tapped(self.taps)))
        e[0] = 0
        return e, taps

    def maxima(self, table: Table, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest value of each filter over each text; texts without words: -inf."""
        return _windows(table, buckets, first, PART, places=False)[1]

    def logits(self, table: Table, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        h = np.maximum(self.maxima(table, buckets, first) + self.bias, 0)
        return (h * self.out).sum(axis=1) + self.base

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits.astype(np.float64) + self.shift, -35, 35)))


SHAPES = [(BUCKETS, DIM), (len(TAPS), DIM, FILTERS), (WIDTH,), (WIDTH,), (1,)]
RATES = (0.02, 0.01, 0.01, 0.03, 0.03)


def _params(flat: np.ndarray) -> list[np.ndarray]:
    """Views of a flat vector: embed, taps, bias, out, base."""
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES])
    return [x.reshape(s) for x, s in zip(np.split(flat[: ends[-1]], ends[:-1]), SHAPES, strict=True)]


SIZE = sum(int(np.prod(s)) for s in SHAPES)


def model(state: np.ndarray) -> Model:
    embed, taps, bias, out, base = _params(state)
    return Model(embed, taps, bias, out, float(base[0]))


def log_odds(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of each bucket, from the numbers of texts of either label that have it."""
    rate = (seen + 0.5) / (total[:, None] + 1)
    odds = np.log(rate[1] / rate[0])
    odds[0] = 0
    return np.clip(odds, -3, 3)


def begin(odds: np.ndarray, seed: int = 7) -> np.ndarray:
    """The state before the first epoch: parameters, their two moments, the number of steps."""
    rng = np.random.default_rng(seed)
    state = np.zeros(3 * SIZE + 1, np.float32)
    embed, taps, bias, out, base = _params(state)
    embed[:] = rng.normal(0, 0.1, embed.shape)
    embed[:, 0] = odds
    taps[:] = rng.normal(0, 0.2, taps.shape)
    taps[:, 0] = np.abs(rng.normal(0.7, 0.2, (len(TAPS), FILTERS)))
    bias[:], out[:], base[:] = -0.5, 2.0 / WIDTH, -1.0
    return state


def _won(table: Table, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each filter the window of the text with the largest value, and that value."""
    wins, best = _windows(table, t, np.array([0, len(t)]), LEARNED)
    return wins[0], best[0]


def learn(state: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Adam on the logistic loss, once over the texts; only the windows that won a maximum pass a gradient on."""
    state = state.copy()
    whole = [_params(state[k * SIZE : (k + 1) * SIZE]) for k in range(3)]
    # embeddings of no text and without moments stay as they are: only the others go through the steps
    live = (whole[1][0] != 0).any(axis=1) | (whole[2][0] != 0).any(axis=1)
    live[0] = True
    for t in texts:
        live[t.ravel()] = True
    place = (np.cumsum(live) - 1).astype(np.uint16)
    params, first, second = ([x[0][live], *x[1:]] for x in whole)
    embed, taps, bias, out, base = params
    share = 1 + len(PREFIXES)
    for some in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
        state[-1] += 1
        step = float(state[-1])
        words = place[np.concatenate([texts[d] for d in some])]
        at = np.concatenate([[0], np.cumsum([len(texts[d]) for d in some])])
        wins, best = _windows((embed / np.float32(share), _tapped(taps)), words, at, LEARNED)
        h = np.maximum(best + bias, 0)
        g = (1 / (1 + np.exp(-np.clip(h @ out + base[0], -35, 35))) - labels[some]).astype(np.float32)
        back = g[:, None] * out * (h > 0)
        grads = [np.zeros_like(embed), np.zeros_like(taps), back.sum(axis=0), g @ h, g.sum(keepdims=True)]
        pulled, pulls = [], []
        for k, (w, j) in enumerate(TAPS):
            i = WIDTHS.index(w)
            pull = back[:, i * FILTERS : (i + 1) * FILTERS]
            p = wins[:, i * FILTERS : (i + 1) * FILTERS] + j
            of, f = np.nonzero((p < at[1:, None]) & (pull != 0))
            ids, pull = words[p[of, f]], pull[of, f]
            own = np.zeros((len(f), FILTERS), np.float32)
            own[np.arange(len(f)), f] = pull
            grads[1][k] = (embed[ids].sum(axis=1) / share).T @ own
            pulled.append(ids)
            pulls.append(pull[:, None] * taps[k][:, f].T / share)
        ids = np.concatenate(pulled).astype(np.int64)
        to = (ids[:, :, None] * DIM + np.arange(DIM)).ravel()
        np.add.at(grads[0].reshape(-1), to, np.repeat(np.concatenate(pulls), share, axis=0).ravel())
        for p, g, a, b, rate in zip(params, grads, first, second, RATES, strict=True):
            g /= len(some)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        embed[0] = 0
    for x, y in zip(whole, (params, first, second), strict=True):
        x[0][live] = y[0]
    return state


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        w = Words(*buffers(b.column(1)))
        found = word_buckets(w)
        rows = [found[i:j].tobytes() for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.large_binary()).cast(pa.binary()), *b.columns[2:]], ["doc_id", "buckets", "lang", "toxic", "part"])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, doc_id, buckets, lang, toxic, tried of every row that the classifier learns from, as a table.

    All rows with one clear label whose doc_id isn't held out; ``tried`` (crc32 mod 4 = 3)
    calibrates, the others train.  Of rows of one doc_id the least text counts.  Labels that
    are null, ambiguous (both for one doc_id) or of unknown documents are left out.
    """
    spark = docs.sparkSession
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = labels.select(F.col("doc_id").cast("long"), F.lit(None).cast("struct<text:string,lang:string>").alias("r"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), F.struct(F.col("text").cast("string").alias("text"), lang.alias("lang")).alias("r"), F.lit(None).cast("int").alias("toxic"))
    rows = texts.unionByName(known).where(remainder != 2)  # a null doc_id goes here too
    n = known.where(remainder != 2).count()
    parts = max(1, -(-n // ROWS))
    # the rows of a doc_id come to its part's task, so they are grouped there without a second shuffle
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
    rows = dealt.groupBy("part", "doc_id").agg(F.min("r").alias("r"), F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("r is not null and toxic = most")
    made = rows.sortWithinPartitions("part", "doc_id").select("doc_id", "r.text", "r.lang", "toxic", "part").mapInArrow(_features, "doc_id long, buckets binary, lang string, toxic int, part int")
    at = f"{shared_folder(spark)}/labelled-{uuid.uuid4().hex}"
    return written(made.withColumn("tried", remainder == 3), at)


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16).reshape(-1, 1 + len(PREFIXES))


def _row(whole: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([whole.astype("<i8").tobytes()], pa.binary())], ["v"])


def _total(parts: DataFrame) -> np.ndarray:
    """Sum of vectors of whole numbers (column v), one or none a task; empty without rows.

    Each slice of the vectors is added up in a task, so one vector comes to the driver, however many tasks there were.
    """

    def cut(r) -> list[tuple[int, np.ndarray]]:
        return list(enumerate(np.array_split(np.frombuffer(r[0], "<i8"), SLICES)))

    found = dict(parts.rdd.flatMap(cut).reduceByKey(np.add, SLICES).collect())
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(0, np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, BUCKETS + 1), np.int64)
    for b in batches:
        for y, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = np.zeros(BUCKETS + 1, bool)
            own[_array(raw.as_py()).ravel()] = True
            own[BUCKETS] = True  # the text itself
            seen[y] += own
    if seen.any():
        yield _row(seen.ravel())


def _epoch(rows: DataFrame, state: np.ndarray, epoch: int) -> np.ndarray:
    """The state after a pass over all rows: each part goes on from the same state, then their mean by rows."""
    before = rows.sparkSession.sparkContext.broadcast(state)  # a fixed size: three times the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(before.value) + 1, np.int64)
        own, now, n, rng = None, before.value, 0, np.random.default_rng(0)
        texts: list[np.ndarray] = []
        labels: list[int] = []

        def learned() -> np.ndarray:
            return learn(now, texts, np.array(labels, np.float64), rng) if texts else now

        def closed() -> None:
            total[:-1] += np.rint(n * now.astype(np.float64) / STATE_UNIT).astype(np.int64)
            total[-1] += n

        size = 0
        for b in batches:
            for part, y, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if part != own or size > HELD:
                    now = learned()
                    texts, labels, size = [], [], 0
                if part != own:
                    closed()
                    own, now, n, rng = part, before.value, 0, np.random.default_rng((7, epoch, part))
                texts.append(_array(raw.as_py()))
                labels.append(y)
                size, n = size + texts[-1].nbytes, n + 1
        now = learned()
        closed()
        if total[-1]:
            yield _row(total)

    total = _total(rows.select("part", "toxic", "buckets").mapInArrow(run, "v binary"))
    before.unpersist()
    return (total[:-1] * STATE_UNIT / total[-1]).astype(np.float32)


def _logits(rows: DataFrame, m: Model) -> DataFrame:
    """toxic, lang, z of every row."""
    own = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = own.value.table()
        for b in slices(batches, "buckets"):
            texts = [_array(raw.as_py()) for raw in b.column(2)]
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            z = own.value.logits(table, np.concatenate(texts), first) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z.astype(np.float64))], ["toxic", "lang", "z"])

    return materialise(rows.select("toxic", "lang", "buckets").mapInArrow(run, "toxic int, lang string, z double"))


def calibrate(m: Model, rows: DataFrame) -> None:
    """Platt's slope and shift over all rows (toxic, lang, z); then a threshold by language."""
    a, b = 1.0, 0.0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(5, np.int64)
        for batch in batches:
            y, z = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
            off, v = p - np.where(y == 1, 0.995, 0.005), p * (1 - p)
            total += [np.rint(x / SUM_UNIT).astype(np.int64).sum() for x in (off * z, off, v * z * z, v * z, v)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], names)

    names = [f"s{k}" for k in range(5)]
    for _ in range(50):  # Newton; its numbers go to the tasks, so every round has the same plan and compiles nothing
        added = rows.select("toxic", "z").mapInArrow(sums, ", ".join(f"{c} long" for c in names)).agg(*(F.sum(c) for c in names))
        s = np.array(added.first(), np.float64) * SUM_UNIT
        move = np.linalg.solve(np.array([[s[2], s[3]], [s[3], s[4]]]) + 1e-3 * np.eye(2), s[:2] + 1e-3 * np.array([a - 1, b]))
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -1, 1))
        if np.abs(move).max() < 1e-7:
            break
    m.slope, m.shift = max(a, 0.05), b
    z = F.col("z")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.lit(m.slope) * z + F.lit(m.shift)))))
    # rows of a language in steps of the score, cut at 0.3 too: however many rows, so many steps
    steps = rows.where("lang is not null").select("lang", "toxic", score.alias("s"))
    steps = steps.groupBy("lang", F.floor(F.col("s") * STEPS).alias("step"), (F.col("s") >= THRESHOLD).alias("over"))
    found = steps.agg(F.min("s").alias("s"), F.count("*").alias("n"), F.sum("toxic").alias("y")).groupBy("lang").applyInPandas(_threshold, "lang string, threshold double")
    m.thresholds = {r["lang"]: r["threshold"] for r in found.collect()}  # one row a language


def _threshold(g: pd.DataFrame) -> pd.DataFrame:
    """The cut of one language with the best F1, 0.3 where it is as good; none with fewer than five rows of either label."""
    s, n, y = (g[c].to_numpy() for c in ("s", "n", "y"))
    if y.sum() < 5 or (n - y).sum() < 5:
        return pd.DataFrame({"lang": [], "threshold": []}, dtype=object).astype({"threshold": float})
    order = np.argsort(s)
    s, n, y = s[order], n[order], y[order]
    over, caught = (np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (n, y))
    cuts = np.unique(np.concatenate([s, [THRESHOLD]]))
    at = np.searchsorted(s, cuts)
    f1 = 2 * caught[at] / (y.sum() + over[at])
    good = cuts[f1 >= f1.max() - 1e-12]
    below = s[s < good.min()].max(initial=0)
    cut = good[np.argmin(np.abs(good - THRESHOLD))] if good.min() <= THRESHOLD <= good.max() else (good.min() + below) / 2
    return pd.DataFrame({"lang": [g["lang"].iloc[0]], "threshold": [float(cut)]})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all rows of labelled().

    Without training labels of both kinds the score is the same for all texts: the share
    of label 1.
    """
    rows = labelled(docs, labels)
    train = rows.where("not tried")
    counts = {(r["tried"], r["toxic"]): r["n"] for r in rows.groupBy("tried", "toxic").agg(F.count("*").alias("n")).collect()}
    if not (counts.get((False, 0)) and counts.get((False, 1))):
        prior = sum(n for (_, y), n in counts.items() if y) / max(1, sum(counts.values()))
        flat = Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((len(TAPS), DIM, FILTERS), np.float32), np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 0.0)
        flat.shift = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        return flat
    seen = _total(train.select("toxic", "buckets").mapInArrow(_counts, "v binary")).reshape(2, -1)
    state = begin(log_odds(seen[:, :-1], seen[:, -1]))
    for epoch in range(EPOCHS):
        state = _epoch(train, state, epoch)
    m = model(state)
    if counts.get((True, 0)) and counts.get((True, 1)):
        calibrate(m, _logits(rows.where("tried"), m))
    return m


def _scores(m: Model, table: Table, texts: pa.Array) -> np.ndarray:
    w = Words(*buffers(texts))
    return m.score(m.logits(table, word_buckets(w), w.first))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.3), lang, threshold, flagged of every row of docs.

    ``threshold`` is the one calibrated for the row's lang (0.3 for a lang that the
    calibration rows don't have enough of) and ``flagged`` what it says; the score
    itself depends on the text alone, and equal texts score alike.  Null texts count
    as empty and get the score of no words; a null doc_id isn't held out.
    """
    m = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # a fixed size: BUCKETS x DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = m.value.table()
        for b in slices(batches):
            score = _scores(m.value, table, b.column(1))
            threshold = np.array([m.value.thresholds.get(x, THRESHOLD) for x in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), b.column(2), pa.array(threshold, pa.float64()), pa.array(score >= threshold)],
                ["doc_id", "score", "predicted", "lang", "threshold", "flagged"],
            )

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lang.alias("lang"))
    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int, lang string, threshold double, flagged boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "lang", "threshold", "flagged")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows whose score reaches the threshold of their lang: one scan to score, no shuffle there.

    Null and empty texts are scored as texts of no words; repeated rows stay or go alike;
    rows of a null or unknown lang go by 0.3; an empty table stays empty; columns of any
    name pass through.
    """
    m = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = m.value.table()
        for b in slices(batches):
            score = _scores(m.value, table, b.column(b.schema.get_field_index("text")))
            at = b.schema.get_field_index("lang")
            langs = b.column(at).to_pylist() if at >= 0 else [None] * b.num_rows
            yield b.filter(pa.array(score < np.array([m.value.thresholds.get(x, THRESHOLD) for x in langs])))

    return docs.mapInArrow(kept, docs.schema)
