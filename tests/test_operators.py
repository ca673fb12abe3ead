"""Mesh operators on hand-made meshes, always several meshes with equal ids at once."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from debitage.iterate import connected_components
from debitage.operators import evaluate as E
from debitage.operators import geometry as G
from debitage.operators import ordering as O
from debitage.operators import scars as S
from debitage.operators import segment as K
from debitage.operators import topology as T

MESHES = {
    "tetra": ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]),
    "quad": ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2), (0, 2, 3)]),
    "l_shape": ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 1, 2), (0, 3, 1)]),
    "fan": ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (9, 9, 9)], [(0, 1, 2), (0, 1, 3), (0, 1, 4)]),
    "strip": ([(x, y, 0) for y in (0, 1) for x in range(5)], [(0, 5, 1), (1, 5, 6), (1, 6, 2), (2, 6, 7), (2, 7, 3), (3, 7, 8), (3, 8, 4), (4, 8, 9)]),
    "junction": ([(0, 0, 0), (0, 1, 0), (1, 0.5, 0), (1, -0.5, 0), (0, -1, 0), (-1, -0.5, 0), (-1, 0.5, 0)], [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5), (0, 5, 6), (0, 6, 1)]),
}


@pytest.fixture(scope="module")
def corpus(spark):
    v = [(m, i, *map(float, p)) for m, (ps, _) in MESHES.items() for i, p in enumerate(ps)]
    f = [(m, i, *t) for m, (_, ts) in MESHES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(v, "mesh_id string, vertex_id long, x double, y double, z double").cache(), spark.createDataFrame(f, "mesh_id string, face_id long, v0 long, v1 long, v2 long").cache()


def labels_of(spark, table):
    return spark.createDataFrame([(m, i, x) for m, xs in table.items() for i, x in enumerate(xs)], "mesh_id string, vertex_id long, label int")


def test_face_adjacency_needs_exactly_two(corpus):
    got = {(r["mesh_id"], r["face_id"], r["nbr"]) for r in T.face_adjacency(corpus[1]).collect()}
    assert {(f, n) for m, f, n in got if m == "tetra"} == set(itertools.permutations(range(4), 2))
    assert not [1 for m, *_ in got if m == "fan"]  # three faces on one side
    assert {(f, n) for m, f, n in got if m == "quad"} == {(0, 1), (1, 0)}


def test_angles(corpus):
    v, f = corpus
    a = {(r["mesh_id"], r["lo"], r["hi"]): r["angle"] for r in G.edge_angles(G.face_normals(G.face_points(f, v))).collect()}
    assert a["quad", 0, 2] == pytest.approx(0) and a["quad", 0, 1] == pytest.approx(math.pi)
    assert a["l_shape", 0, 1] == pytest.approx(math.pi / 2) and a["fan", 0, 1] == 0


def test_moments_and_isolated(corpus):
    v, f = corpus
    m = {r["mesh_id"]: r for r in G.moments(v.select("mesh_id").distinct(), G.face_points(f, v)).collect()}
    assert abs(m["tetra"]["volume"]) == pytest.approx(1 / 6) and m["quad"]["volume"] == 0
    assert [tuple(r) for r in T.isolated_vertices(v.select("mesh_id", "vertex_id"), f).collect()] == [("fan", 5)]


def test_scar_graph_strip_and_junction(spark, corpus):
    v, f = corpus
    seg = labels_of(spark, {"strip": [1, 0, 0, 0, 2, 1, 0, 0, 0, 2], "junction": [0, 1, 0, 2, 0, 3, 0]})
    own = lambda df: df.where("mesh_id in ('strip', 'junction')")
    working, scars, _, edges = S.scar_graph(own(v), own(f), seg)
    w = {(r["mesh_id"], r["vertex_id"]): r["label"] for r in working.collect()}
    assert w["strip", 1] == w["strip", 6] == 1 and w["strip", 3] == w["strip", 8] == 2 and 0 not in w.values()
    assert sorted((r["mesh_id"], r["scar_a"], r["scar_b"]) for r in edges.collect()) == [("junction", 0, 1), ("junction", 0, 2), ("junction", 1, 2), ("strip", 0, 1)]
    assert all(r["sharpness"] == pytest.approx(0) for r in edges.collect())


def test_components_random(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for m in range(3):
        root = list(range(40))
        for _ in range(25):
            a, b = rng.randrange(40), rng.randrange(40)
            rows.append((m, a, b))
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        want |= {(m, i): root[i] for i in range(40)}
    table = spark.createDataFrame([*rows, (0, None, 3), (None, 1, 2)], "m int, src int, dst int")
    for small in (200_000, 20, 0):  # solved in a task each, some of them, by rounds of joins
        got = {(r["m"], r["node"]): r["component"] for r in connected_components(table, keys=["m"], small=small).collect()}
        assert all(want[k] == c for k, c in got.items())
        alone = [k for k in want if k not in got]
        assert all(want[k] == k[1] for k in alone)
    star = spark.createDataFrame([(100 + k, 1000 if k % 2 else 5) for k in range(300)] + [(5, 1000)], "src int, dst int")
    assert {r["component"] for r in connected_components(star).collect()} == {5}


def test_hubs_are_folded_before_the_rounds(spark, monkeypatch):
    """Two hubs of thousands of leaves, long chains and random edges over many partitions; names as nodes."""
    from debitage import iterate

    monkeypatch.setattr(iterate, "FOLD", 50)  # folded again and again in a partition
    rng = random.Random(31)
    pairs = [("hub", f"a{k}") for k in range(2000)] + [(f"b{k}", "zz") for k in range(1500)] + [(f"c{k}", f"c{k + 1}") for k in range(300)]
    pairs += [(f"d{rng.randrange(900)}", f"d{rng.randrange(900)}") for _ in range(500)] + [(None, "x"), ("x", "x")]
    rng.shuffle(pairs)
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    table = spark.createDataFrame(pairs, "src string, dst string").repartition(13)
    got = connected_components(table).collect()
    assert {r["node"]: r["component"] for r in got} == {v: find(v) for v in root} and len(got) == len(root)
    edges = table.select(F.greatest("src", "dst").alias("_u"), F.least("src", "dst").alias("_v")).where("_u <> _v")
    most = iterate._forests(edges, []).groupBy("node").count().agg(F.max("count")).first()[0]
    assert most <= 13  # a hub comes once from each partition


def test_segmentation_fixture(spark):
    faces = spark.createDataFrame([(m, i, i, i + 1, i + 2) for m in "ab" for i in range(6)], "mesh_id string, face_id long, v0 long, v1 long, v2 long")
    scores = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.05, 0.05, 0.45, 0.45, 0.05, 0.05])] + [("b", i, 0.1) for i in range(6)], "mesh_id string, face_id long, p double")
    got = {(r["mesh_id"], r["face_id"]): r["label"] for r in K.segment_faces(faces, T.face_adjacency(faces), scores, 0.3, 1).collect()}
    assert got["a", 0] == got["a", 1] and got["a", 4] == got["a", 5] != got["a", 0]
    assert {got["b", i] for i in range(6)} == {1}
    capped = {(r["mesh_id"], r["face_id"]): r["root"] for r in K.capped_components(faces, K.edge_costs(T.edge_list(T.face_adjacency(faces)), scores), 0.3, 3).collect()}
    assert [capped["b", i] for i in range(6)] == [0, 0, 0, 3, 3, 3]


def test_assignment_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        c = [[rng.random() for _ in range(m)] for _ in range(n)]
        got = sum(c[a][b] for a, b in E.assignment(c))
        if n <= m:
            best = min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(c[p[j]][j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert got == pytest.approx(best)


def test_matching_prefers_the_optimum_over_the_best_pair(spark):
    # IoU(A,P)=.515, IoU(A,Q)=IoU(B,P)=.32: the optimum takes the two small pairs, so nothing passes one half
    pairs = spark.createDataFrame([("m", 1, 1, 0.515), ("m", 1, 2, 0.32), ("m", 2, 1, 0.32), ("n", 1, 1, 0.515)], "mesh_id string, gt int, pred int, iou double")
    assert [tuple(r)[:3] for r in E.optimal_matches(pairs).collect()] == [("n", 1, 1)]


LOGS = {
    "replace": ([(0, 1, "preseed"), (1, 0, "expert")], [(1, 0)]),
    "drop": ([(0, 1, "expert"), (1, 2, "preseed"), (2, 0, "expert")], [(0, 1), (2, 0)]),
    "reject": ([(0, 1, "expert"), (1, 2, "expert"), (2, 0, "expert"), (3, 3, "expert")], [(0, 1), (1, 2)]),
}


def test_comparison_log(spark):
    rows = [(m, i, "add", a, b, s) for m, (log, _) in LOGS.items() for i, (a, b, s) in enumerate(log)]
    log = spark.createDataFrame(rows, "mesh_id string, seq int, op string, younger int, older int, source string")
    got = {}
    for r in O.replay_comparisons(log).collect():
        got.setdefault(r["mesh_id"], []).append((r["younger"], r["older"]))
    assert {m: sorted(x) for m, x in got.items()} == {m: want for m, (_, want) in LOGS.items()}
    assert {r["outcome"] for r in O.comparison_outcomes(log).where("mesh_id = 'reject'").collect()} == {"added", "cycle", "self"}


def kahn(nodes, edges):
    indegree = {n: sum(b == n for _, b in edges) for n in nodes}
    queue = sorted(n for n in nodes if not indegree[n])
    out = []
    while queue:
        at = queue.pop(0)
        out.append(at)
        freed = []
        for a, b in edges:
            if a == at:
                indegree[b] -= 1
                if not indegree[b]:
                    freed.append(b)
        queue += sorted(freed)
    return out


def test_topological_order_equals_a_queue(spark):
    rng = random.Random(3)
    nodes, edges, want = [], [], {}
    for m in range(8):
        order = list(range(8))
        rng.shuffle(order)
        own = sorted({(order[i], order[j]) for i in range(8) for j in range(i + 1, 8) if rng.random() < 0.3})
        nodes += [(m, n) for n in range(8)]
        edges += [(m, a, b) for a, b in own]
        want[m] = kahn(range(8), own)
    got = {}
    for r in O.topological_order(spark.createDataFrame(nodes, "mesh_id int, scar_id int"), spark.createDataFrame(edges, "mesh_id int, younger int, older int")).collect():
        got.setdefault(r["mesh_id"], {})[r["position"]] = r["scar_id"]
    assert {m: [p[i] for i in range(8)] for m, p in got.items()} == want
