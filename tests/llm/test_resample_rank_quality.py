"""Importance resampling, ranked search and quality rules against plain versions and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("debitage.llm")

import pyarrow as pa  # noqa: E402

from debitage.llm import balltree, prefixcrc, quality, resampling  # noqa: E402

ODD = [None, "", " \n\t ", "a", "The the THE É é", "x" * 5000, "é" * 300, "same text here", "same text here", "A1-b2_c3", "tab\tand\x0bvertical\x0cform\r\nnew"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus(rng, n=90):
    texts = [" ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randrange(1, 90))) for _ in range(n)]
    return texts + ODD + ["one two three four five " * 4000]


def frame(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), "doc_id long, text string")


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


# 11


def test_crc_of_any_stretch():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 70_000):
        data = rng.integers(0, 256, n, dtype=np.uint8)
        cut = np.sort(rng.integers(0, n + 1, (200, 2)), axis=1)
        assert prefixcrc.Prefixes(data).crc(cut[:, 0], cut[:, 1]).tolist() == [zlib.crc32(data.tobytes()[i:j]) for i, j in cut.tolist()]


@pytest.mark.parametrize("lengths", [(1, 1), (1, 3), (2, 4)])
def test_buckets_of_ngrams(lengths):
    texts = corpus(random.Random(5), 30)
    bucket, text, words = resampling.features(pa.array(texts, pa.string()), lengths, 997)
    want = []
    for k, t in enumerate(texts):
        w = WORD.findall(low(t))
        assert words[k] == len(w)
        want += [(k, zlib.crc32(" ".join(w[i : i + n]).encode()) % 997) for n in range(lengths[0], lengths[1] + 1) for i in range(len(w) - n + 1)]
    assert sorted(zip(text.tolist(), bucket.tolist(), strict=True)) == sorted(want)


def plain_resample(docs, target, lengths, buckets, least, drawn, seed):
    def grams(text):
        w = WORD.findall(low(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(lengths[0], lengths[1] + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in grams(x)[1]) for texts in ([x for _, x in docs], target))
    big, small = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (big + buckets) / ((s[b] + 1.0) * (small + buckets)))) for b in s}
    rows = []
    for doc_id, text in docs:
        n, own = grams(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append((n, doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1]))
    rank = {id(r): k for k, r in enumerate(fit[: drawn * len(fit) // 100], 1)}
    return sorted(map(str, ((*r[1:], rank.get(id(r))) for r in rows)))


@pytest.mark.parametrize("lengths,drawn", [((1, 1), 10), ((1, 2), 45), ((1, 1), 100)])
def test_resample_equals_a_plain_version(spark, lengths, drawn):
    rng = random.Random(7)
    texts = corpus(rng)
    ids = [None, *range(1, len(texts))]
    target = ["w1 w2 w3 w4", None, "", "w1 w9 é"]
    docs = frame(spark, texts, ids).withColumn("rank", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = resampling.resample(docs, items(spark, target).withColumn("many", F.lit(0)), lengths, 1009, 20, drawn)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_resample(list(zip(ids, texts, strict=True)), target, lengths, 1009, 20, drawn, 2024)


def test_resample_of_repeated_rows_and_nothing(spark):
    text = "w1 w2 w3 w4 w5 " * 5
    got = resampling.resample(frame(spark, [text] * 200, [7] * 200), items(spark, ["w1"]))
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 21)) and got.count() == 200
    empty = frame(spark, ["a"]).limit(0)
    assert resampling.resample(empty, items(spark, ["w1"])).count() == 0
    assert resampling.resample(frame(spark, [text]), items(spark, ["a"]).limit(0), drawn=100).collect()[0]["rank"] == 1


# 12


def plain_ranked(docs, wanted, k):
    held = [(d, Counter(WORD.findall(low(t)))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(f for _, c, _ in held for f in c)
    out = []
    for item, text in wanted:
        scores = []
        for d, c, size in held:
            m = 100 - 75 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[f] + 1))) * (10**9 * c[f] // (1000 * c[f] + 8 * m)) for f in WORD.findall(low(text)) if f in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("leaf,slices", [(64, 4096), (4, 40), (1, 7)])
def test_ranked_equals_a_plain_version(spark, monkeypatch, leaf, slices):
    monkeypatch.setattr(balltree, "LEAF", leaf)
    monkeypatch.setattr(balltree, "SLICE", slices)
    rng = random.Random(11)
    texts = corpus(rng)
    ids = [*range(50, 50 + len(texts) - 1), None]
    wanted = ["w1 w2 w3 w1 w77", "é É", None, "", "nothing of it", "five", "same text here", "w5 " * 30] + [" ".join(f"w{rng.randrange(400)}" for _ in range(20)) for _ in range(12)]
    docs = frame(spark, texts, ids).withColumn("score", F.lit("clash")).withColumn("key", F.lit(1))
    got = balltree.ranked(docs, items(spark, wanted).withColumn("rank", F.lit("clash")), 5)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_ranked(list(zip(ids, texts, strict=True)), list(enumerate(wanted)), 5)


def test_ranked_in_blocks_ties_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(balltree, "WORDS", 2)
    texts = ["a b c", "a b c", "a b", "d"] * 6
    wanted = ["a", "b c", "d e", "a b c d", "c c c"]
    got = balltree.ranked(frame(spark, texts), items(spark, wanted))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_ranked(list(enumerate(texts)), list(enumerate(wanted)), 10)
    assert balltree.ranked(frame(spark, texts).limit(0), items(spark, wanted)).count() == 0
    assert balltree.ranked(frame(spark, texts), items(spark, wanted).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "d"), (1, "d"), (None, "d")], "item_id long, text string")
    assert sorted(str(tuple(r)) for r in balltree.ranked(frame(spark, ["d", "x"]), twice).select("item_id", "rank", "doc_id").collect()) == ["(1, 1, 0)", "(1, 1, 0)", "(None, 1, 0)"]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    rows, n_terms = 2000, 600
    held = [np.unique(rng.integers(0, 60, 20) + 60 * (k % 10)) for k in range(rows)]  # ten topics
    first = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    term = np.concatenate(held)
    weight = rng.integers(1, 1_000_000, len(term))
    dense = np.zeros((rows, n_terms), np.int64)
    dense[np.repeat(np.arange(rows), np.diff(first)), term] = weight
    tree = balltree.Tree(first.copy(), term.copy(), weight.copy(), n_terms)
    scored = []
    for _ in range(50):
        terms = np.unique(rng.integers(0, 60, 12) + 60 * rng.integers(0, 10))
        values = rng.integers(1, 9000, len(terms))
        products = dense[:, terms] @ values
        bound = tree.bounds(terms, values)
        for (a, b), most in zip(tree.nodes, bound, strict=True):
            assert products[tree.order[a:b]].max() <= most
        best = []
        scored.append(tree.search(terms, values, best, 10, np.arange(rows), np.ones(rows, bool)))
        assert best == sorted((-int(s), False, k) for k, s in enumerate(products) if s)[:10]
    leaves = sum(c is None for c in tree.children)
    assert np.mean(scored) < leaves / 2


# 13


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    letters = re.findall(r"[0-9A-Za-z\u0080-\U0010FFFF]", "".join(w))
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_unique": len(set(w)),
        "n_capitals": sum("A" <= c <= "Z" for c in letters),
        "n_letters": len(letters),
        "n_wordless": sum(not re.search(r"[0-9A-Za-z\u0080-\U0010FFFF]", x) for x in w),
        "n_ended": sum(x.rstrip(quality.SPACES)[-1] in quality.ENDS for x in lines),
        "n_shouts": text.count("!"),
    }


@pytest.mark.parametrize("few", [0, 16])
def test_counts_equal_a_plain_version(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    rng = random.Random(13)
    texts = corpus(rng) + ["a b c a b c a b", "a a a a", "a a a b a a a", "x\nx\n x\n\nx", "one! two!! | # $$ -- “quoted”\nsecond line…\r\nthird line » \n", "1 2 3 1 2 3 4 5 1 2", "a\x00b \x1f ^_^ \x85  "]
    for _ in range(40):
        texts.append("".join(rng.choice(["a", "b", "B", " ", "  ", "\n", "\t", "!", "#", "é", "\x1f"]) for _ in range(rng.randrange(200))))
    got = sorted(quality.counted(frame(spark, texts)).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(got, texts, strict=True):
        assert {k: r[k] for k in r.asDict() if k != "doc_id"} == plain_counts(t), t


def junk(rng, kind):
    w = [f"{rng.choice(['Lo', 'mi', 'ra'])}{rng.randrange(3000)}x" for _ in range(120)]
    if kind == "symbols":
        return "\n".join(" ".join(x + rng.choice(["###", "$$$", "|||"]) for x in w[i : i + 12]) for i in range(0, 120, 12))
    if kind == "lines":
        return "\n".join(["Click here now to win it."] * 60)
    return " ".join(f"{x.upper()}!!" for x in w[:20] * 6)


def prose(rng):
    return "\n".join(" ".join(rng.choice(["an", "the", *(f"w{rng.randrange(900)}en" for _ in range(6))]) + ("" if i % 9 else ",") for i in range(20)) + "." for _ in range(6))


def test_weak_supervision_tells_junk_from_prose(spark):
    rng = random.Random(17)
    kinds = [rng.choice(["symbols", "lines", "shouts"]) if rng.random() < 0.2 else "prose" for _ in range(400)]
    docs = frame(spark, [prose(rng) if k == "prose" else junk(rng, k) for k in kinds])
    got = sorted(quality.judge(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["kept"] for r in got] == [k == "prose" for k in kinds]
    weights, _ = quality.accuracies(quality.votes(quality.counted(docs)))
    assert all(weights[3 * k] <= 0 <= weights[3 * k + 2] for k in range(len(quality.RULES)))


def test_estimates_equal_a_plain_loop(spark):
    """The rounds over patterns against the same estimates over single documents."""
    rng = random.Random(19)
    texts = [prose(rng) if k % 4 else junk(rng, ["symbols", "lines", "shouts"][k % 3]) for k in range(60)]
    voted = quality.votes(quality.counted(frame(spark, texts)))
    cast = [list(r["votes"]) for r in voted.where("n_words > 0").collect()]
    belief = [quality.START[min(v.count(-1), 2)] for v in cast]
    for _ in range(quality.ROUNDS):
        yes, n = sum(belief), len(cast)
        odds = []
        for rule in range(len(quality.RULES)):
            for vote in (-1, 0, 1):
                got, own = sum(b for b, v in zip(belief, cast, strict=True) if v[rule] == vote), sum(v[rule] == vote for v in cast)
                x = math.log(max(quality.LEAST, (got + 1) / (yes + 3)) / max(quality.LEAST, (own - got + 1) / (n - yes + 3)))
                odds.append(min(x, 0) if vote < 0 else max(x, 0) if vote > 0 else x)
        bias = math.log((yes + 1) / (n - yes + 1))
        belief = [1 / (1 + math.exp(-bias - sum(odds[3 * k + v + 1] for k, v in enumerate(votes)))) for votes in cast]
    weights, got_bias = quality.accuracies(voted)
    assert np.allclose(weights, odds, atol=1e-6) and abs(bias - got_bias) < 1e-6


def test_quality_of_odd_rows(spark):
    rows = ODD + [prose(random.Random(1))] * 3
    plain = frame(spark, rows, [None, *range(1, len(rows))])
    clash = plain.withColumns({c: F.lit("clash") for c in ("w", "h", "lines", "score", "kept", "votes", "n_words", "spaced", "letters")})
    got, want = (sorted(map(str, quality.judge(d).collect())) for d in (clash, plain))
    assert got == want and len(got) == len(rows)
    wordless = [r for r in quality.judge(plain).collect() if r["n_words"] == 0]
    assert len(wordless) == 3 and all(r["base_failed"] and not r["kept"] and 0 <= r["score"] <= 1 for r in wordless)
    assert quality.judge(plain.limit(0)).count() == 0
    assert quality.judge(frame(spark, [None, ""])).where("kept").count() == 0
