"""The toxicity classifier learns from every labelled row and from whole texts."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("debitage.llm")

from debitage.llm import toxicity  # noqa: E402


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def tables(spark, texts, toxic):
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return d, spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")


def test_long_texts_are_learned_from(spark):
    rng = random.Random(31)
    words = [f"w{k}" for k in range(500)]
    texts, toxic = [], []
    for k in range(60):
        w = rng.choices(words, k=40 if k % 2 else 40_000)  # toxic ones are of over 128 KB throughout
        if k % 2 == 0:
            w[rng.randrange(len(w))] = "vilestaxx"
        texts.append(" ".join(w))
        toxic.append(int(k % 2 == 0))
    assert min(len(t) for t, y in zip(texts, toxic, strict=True) if y) > 1 << 17
    d, labels = tables(spark, texts, toxic)
    rows = toxicity.labelled(d, labels).collect()
    assert {(r["doc_id"], r["toxic"]) for r in rows} == {(i, y) for i, y in enumerate(toxic) if fold(i) != 2}
    assert all(len(r["buckets"]) == 10 * len(texts[r["doc_id"]].split()) for r in rows)
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, labels).collect()}
    assert min(s for i, s in score.items() if toxic[i]) > max(s for i, s in score.items() if not toxic[i])


def test_all_rows_are_learned_from_in_parts(spark, monkeypatch):
    rng = random.Random(32)
    monkeypatch.setattr(toxicity, "ROWS", 400)  # several parts
    texts, toxic = [], []
    for k in range(8000):  # more of one label than half of 5,000
        w = [f"w{rng.randrange(2000)}" for _ in range(20)]
        if k % 4 == 0:
            w[rng.randrange(20)] = "rotsta" + rng.choice("abcdefgh")
        texts.append(" ".join(w))
        toxic.append(int(k % 4 == 0))
    d, labels = tables(spark, texts, toxic)
    rows = toxicity.labelled(d, labels).select("doc_id", "part").collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == sum(fold(i) != 2 for i in range(8000))
    assert len({r["part"] for r in rows}) > 10
    out = toxicity.toxicity(d, labels).collect()
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in out if r["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.99
    again = toxicity.fit(d.orderBy(d.doc_id.desc()), labels)
    first = toxicity.fit(d, labels)
    assert (first.embed == again.embed).all() and first.slope == again.slope and first.thresholds == again.thresholds


def test_windows_that_win_equal_the_maxima(monkeypatch):
    monkeypatch.setattr(toxicity, "LEARNED", 5)
    rng = np.random.default_rng(33)
    m = toxicity.model(toxicity.begin(rng.normal(0, 1, toxicity.BUCKETS)))
    table = m.table()
    for n in (1, 2, 4, 5, 6, 11, 23):
        t = rng.integers(0, toxicity.BUCKETS, (n, 1 + len(toxicity.PREFIXES))).astype(np.uint16)
        wins, best = toxicity._won(table, t)
        want = m.maxima(table, t, np.array([0, n]))[0]
        assert np.allclose(best, want, atol=1e-5) and ((0 <= wins) & (wins < n)).all()


def test_equal_texts_have_equal_maxima_wherever_they_stand():
    rng = np.random.default_rng(34)
    m = toxicity.model(toxicity.begin(rng.normal(0, 1, toxicity.BUCKETS)))
    text = rng.integers(0, toxicity.BUCKETS, (37, 1 + len(toxicity.PREFIXES))).astype(np.uint16)
    lone = m.logits(m.table(), text, np.array([0, 37]))
    for before in range(40):
        words = np.concatenate([rng.integers(0, toxicity.BUCKETS, (before, text.shape[1])).astype(np.uint16), text, text[:before]])
        z = m.logits(m.table(), words, np.array([0, before, before + 37, len(words)]))
        assert z[1] == lone[0]


def test_each_part_has_a_task_and_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS", 50)
    d, labels = tables(spark, [f"word{i} common" for i in range(1000)], [i % 2 for i in range(1000)])
    texts = []
    write = toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, at: texts.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, at))
    rows = toxicity.labelled(d, labels)
    assert texts[0].count("Exchange ") == 1  # dealt and grouped at once
    files = {}
    for r in rows.selectExpr("part", "input_file_name() as f").distinct().collect():
        files.setdefault(r["f"], set()).add(r["part"])
    assert len(files) == 16 and all(len(p) == 1 for p in files.values())  # no two parts in a task
    assert sum(fold(i) != 2 for i in range(1000)) == rows.count()


def test_long_vectors_are_added_in_slices(spark):
    v = [np.arange(1000) * k for k in range(1, 8)]
    rows = spark.createDataFrame([(bytearray(x.astype("<i8").tobytes()),) for x in v], "v binary").repartition(7)
    assert (toxicity._total(rows) == np.arange(1000) * 28).all()
    assert len(toxicity._total(rows.limit(0))) == 0
