"""Near copies of the pipeline against brute-force Jaccard."""

import random

import pytest

pytest.importorskip("debitage.llm")

from debitage.llm import nearcopies  # noqa: E402

DOCS = "doc_id long, text string, lang string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)


def edited(rng, text, share):
    """A copy with single words replaced until its five-word similarity is at ``share`` or just over it."""
    words, own = text.split(), nearcopies.shingle_set(text)
    while True:
        more = list(words)
        more[rng.randrange(len(more))] = f"z{rng.randrange(10**6)}"
        if nearcopies.similarity(own, nearcopies.shingle_set(" ".join(more))) < share:
            return " ".join(words)
        words = more


def planted(copies):
    rng = random.Random(17)
    texts = []
    for k in range(12):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 500)))
        texts.append(base)
        texts += [edited(rng, base, share) for share in (0.8, 0.85, 0.9, 0.95) for _ in range(copies if k == 0 else 1)]
    texts += [None, "", " \n", "a", "A ", "a b c", "a b c d e f", "a b c d e g"]
    return texts


def brute(texts):
    sets, root = [nearcopies.shingle_set(t) for t in texts], list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(texts)):
        for j in range(i):
            if nearcopies.similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(v) for v in range(len(texts))]


@pytest.mark.parametrize("run", [nearcopies.RUN, 5])
def test_near_dedup_stage_equals_brute_force_jaccard(spark, monkeypatch, run):
    import corpus_pipeline

    monkeypatch.setattr(nearcopies, "RUN", run)  # large buckets and centres in many runs
    texts = planted(12)
    d = table(spark, enumerate(texts))
    out = corpus_pipeline.near_dedup(spark, d, "")
    assert out.columns == d.columns
    kept = sorted(r["doc_id"] for r in out.collect())
    assert kept == sorted(set(brute(texts))) and len(kept) < len(texts) / 4
    assert corpus_pipeline.near_dedup(spark, d.limit(0), "").count() == 0


def test_centres_are_next_to_the_majority(spark):
    rng = random.Random(23)
    base = [rng.getrandbits(64) for _ in range(2)]
    rows = []
    for key in (0, 1):
        for k in range(40):
            fp = base[key] ^ sum(1 << b for b in rng.sample(range(64), k // 3))
            rows.append((key, 1000 * key + k * 7 % 41, rng.choice((90, 100, 60)), fp - (fp >> 63 << 64), 40))
    large = spark.createDataFrame(rows, "key long, th long, n long, fp long, size long")
    want = set()
    for key in (0, 1):
        own = [r for r in rows if r[0] == key]
        majority = sum(1 << b for b in range(64) if 2 * sum(r[3] >> b & 1 for r in own) > len(own))
        apart = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
        for c in sorted(own, key=lambda r: (apart(r[3], majority), r[1]))[: nearcopies.CENTRES]:
            want |= {(min(c[1], r[1]), max(c[1], r[1]), c[1] > r[1]) for r in own if r != c and min(r[2], c[2]) >= 0.8 * max(r[2], c[2]) and apart(r[3], c[3]) <= nearcopies.RADIUS}
    assert {tuple(r) for r in nearcopies._centre_pairs(large).collect()} == want


def test_fingerprints_link_texts_that_share_no_band(spark, monkeypatch):
    from debitage.llm import simhash

    rng, signatures = random.Random(29), nearcopies._signatures

    def bandless(batches):  # each text alone in its bands: SimHash's tables must find what is linked
        import pyarrow as pa

        for b in signatures(batches):
            keys = [[th * 12 + k & (1 << 62) - 1 for k in range(12)] for th in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(keys, pa.list_(pa.int64()))], b.schema.names)

    texts = []
    for k in range(20):
        base = [f"w{rng.randrange(3000)}" for _ in range(400)]
        texts += [" ".join(base), " ".join([*base[:-1], f"z{k}"]), " ".join([f"y{k}", *base[1:]]), " ".join(f"v{rng.randrange(3000)}" for _ in range(90))]
    whole = [nearcopies.signature(t) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = ((whole[i][2] ^ whole[j][2]) & (2**64 - 1)).bit_count() <= simhash.MAX_BITS
            if near and nearcopies.similarity(nearcopies.shingle_set(texts[i]), nearcopies.shingle_set(texts[j])) >= nearcopies.SIMILAR:
                x, y = want[i], want[j]
                want = [min(x, y) if w in (x, y) else w for w in want]
    assert len(set(want)) < len(texts) - 20
    monkeypatch.setattr(nearcopies, "_signatures", bandless)
    kept = sorted(r["doc_id"] for r in nearcopies.drop_near_copies(table(spark, enumerate(texts))).collect())
    assert kept == sorted(set(want))


def test_forests_join_what_pairs_join():
    import numpy as np

    from debitage.llm import simhash

    rng = np.random.default_rng(30)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = np.array([base[k % 6] ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64))) for k in range(90)])

    def joined(pairs):
        of = list(range(len(fps)))
        for i, j in zip(*pairs, strict=True):
            of = [min(of[i], of[j]) if x in (of[i], of[j]) else x for x in of]
        return of

    forest = simhash.linked_forest(fps)
    assert joined(forest) == joined(simhash.linked_pairs(fps)) and len(forest[0]) == len(fps) - len(set(joined(forest)))
