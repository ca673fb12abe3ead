"""Operators without SQL twins against plain loops over small random meshes, several at once."""

import heapq
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from debitage.functions import metrics as R
from debitage.operators import evaluate as E
from debitage.operators import geometry as G
from debitage.operators import morton
from debitage.operators import ordering as O
from debitage.operators import paths as P
from debitage.operators import scars as S
from debitage.operators import scores as I
from debitage.operators import segment as K
from debitage.operators import topology as T
from debitage.operators.auction import auction, settle
from debitage.sources import mesh_files as files

W = 7
MESHES = ("a", "b", "c")


def grid():
    """Two triangles for each cell of a square grid."""
    out = []
    for y in range(W - 1):
        for x in range(W - 1):
            v = y * W + x
            out += [(v, v + 1, v + W), (v + 1, v + W + 1, v + W)]
    return out


FACES = grid()


def points(mesh):
    rng = random.Random(mesh)
    return [(float(v % W), float(v // W), rng.random()) for v in range(W * W)]


def around():
    near = {v: set() for v in range(W * W)}
    for t in FACES:
        for u in t:
            near[u] |= set(t) - {u}
    return near


NEAR = around()


@pytest.fixture(scope="module")
def tables(spark):
    v = [(m, i, *p) for m in MESHES for i, p in enumerate(points(m))]
    f = [(m, i, *t) for m in MESHES for i, t in enumerate(FACES)]
    return spark.createDataFrame(v, "mesh_id string, vertex_id long, x double, y double, z double").cache(), spark.createDataFrame(f, "mesh_id string, face_id long, v0 long, v1 long, v2 long").cache()


def labels_of(mesh, zeros=0.3, many=3):
    rng = random.Random(f"labels {mesh}")
    return [0 if rng.random() < zeros else rng.randrange(1, many + 1) for _ in range(W * W)]


def table(spark, name, values):
    return spark.createDataFrame([(m, i, x) for m in MESHES for i, x in enumerate(values(m))], f"mesh_id string, vertex_id long, {name}")


def by_mesh(df, key, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["mesh_id"], {})[r[key]] = r[value]
    return out


def union(n, edges, allowed):
    """Union-find in order of the edges; allowed(size, size) decides."""
    root, size = list(range(n)), [1] * n

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y and allowed(size[x], size[y]):
            root[max(x, y)] = min(x, y)
            size[min(x, y)] += size[max(x, y)]
    return [find(v) for v in range(n)], size


@pytest.mark.parametrize("cap,least,small", [(None, 6, 1000), (9, 5, 1000), (4, 1, 1000), (9, 5, 12), (5, 7, 0)])
def test_capped_merge_and_cleanup(spark, cap, least, small):
    rng = random.Random(f"{cap} {least}")
    edges = [(m, k, a, b, rng.randrange(8) / 8) for m in MESHES for k, (a, b) in enumerate((a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.06)]
    faces = spark.createDataFrame([(m, i) for m in MESHES for i in range(40)], "mesh_id string, face_id long")
    costs = spark.createDataFrame(edges, "mesh_id string, edge_idx long, face_id long, nbr long, cost double")
    merged = K.capped_components(faces, costs, 0.3, cap, small)
    got = by_mesh(K.cleaned_up(merged, costs, least, small), "face_id", "root")
    for m in MESHES:
        own = sorted((c, k, a, b) for mm, k, a, b, c in edges if mm == m)
        roots, sizes = union(40, [(a, b) for c, _, a, b in own if c <= 0.3], lambda x, y: not cap or x + y <= cap)
        root, size = list(roots), list(sizes)

        def find(v, root=root):
            while root[v] != v:
                v = root[v]
            return v

        for _, _, a, b in own if least > 1 else ():
            x, y = find(a), find(b)
            if x != y and (size[x] < least or size[y] < least):
                root[max(x, y)] = min(x, y)
                size[min(x, y)] += size[max(x, y)]
        assert [got[m][i] for i in range(40)] == [find(i) for i in range(40)]


def components(inside):
    left, out = set(inside), []
    while left:
        found, todo = set(), [min(left)]
        while todo:
            v = todo.pop()
            if v in left:
                left.discard(v)
                found.add(v)
                todo += NEAR[v]
        out.append(found)
    return out


def eroded(labels):
    labels = list(labels)
    while True:
        new = {v: min(labels[u] for u in NEAR[v] if labels[u] > 0) for v in range(len(labels)) if labels[v] == 0 and any(labels[u] > 0 for u in NEAR[v])}
        if not new:
            return labels
        for v, x in new.items():
            labels[v] = x


def normalised(labels, least, rounds):
    labels = list(labels)
    for k in range(rounds):
        old = list(labels)
        if least > 1:
            for part in components(v for v in range(len(labels)) if labels[v]):
                if len(part) < least:
                    for v in part:
                        labels[v] = 0
        work = eroded(labels)
        thin = {(a if work[a] < work[b] else b) for t in FACES for a, b in (t[:2], t[1:], (t[2], t[0])) if work[a] != work[b]}
        labels = [0 if v in thin else x for v, x in enumerate(work)]
        if labels == old:
            return labels, True, k + 1
    return labels, False, rounds


@pytest.mark.parametrize("least", [1, 4, 100])
def test_normalised_boundaries(spark, tables, least):
    now, progress = K.normalise_edges(tables[1], table(spark, "label int", labels_of), least, 3)
    got, seen = by_mesh(now, "vertex_id", "label"), {r["mesh_id"]: (r["converged"], r["iterations"]) for r in progress.collect()}
    for m in MESHES:
        want, converged, rounds = normalised(labels_of(m), least, 3)
        assert [got[m][v] for v in range(W * W)] == want
        assert seen[m] == (converged, rounds)


def test_postprocess(spark, tables):
    v, f = tables
    score = {m: [random.Random(f"{m} {i}").random() for i in range(len(FACES))] for m in MESHES}
    p = spark.createDataFrame([(m, i, x) for m in MESHES for i, x in enumerate(score[m])], "mesh_id string, face_id long, p double")
    got = by_mesh(K.postprocess(v, f, T.face_adjacency(f), p, 0.6, 3), "vertex_id", "label")
    sides = {}
    for i, t in enumerate(FACES):
        for a, b in (t[:2], t[1:], (t[2], t[0])):
            sides.setdefault((min(a, b), max(a, b)), []).append(i)
    pairs = [tuple(x) for x in sides.values() if len(x) == 2]
    for m in MESHES:
        roots, _ = union(len(FACES), [(a, b) for a, b in pairs if max(score[m][a], score[m][b]) <= 0.6], lambda x, y: True)
        # labels by frequency, the lower root first on ties
        order = sorted(set(roots), key=lambda r: (-roots.count(r), r))
        segment = [order.index(r) + 1 for r in roots]
        of = [{segment[i] for i, t in enumerate(FACES) if v in t} for v in range(W * W)]
        assert [got[m][v] for v in range(W * W)] == normalised([min(s) if len(s) == 1 else 0 for s in of], 3, 3)[0]


def dijkstra(start, cost):
    best, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        d, u = heapq.heappop(queue)
        if d > best[u]:
            continue
        for v in NEAR[u]:
            if d + cost(u, v) < best.get(v, math.inf):
                best[v] = d + cost(u, v)
                heapq.heappush(queue, (best[v], v))
    return best


def test_ridge_paths_and_polylines(spark, tables):
    v, f = tables
    angle = {m: [random.Random(f"angle {m} {i}").random() * 3 for i in range(W * W)] for m in MESHES}
    angles = spark.createDataFrame([(m, i, x) for m in MESHES for i, x in enumerate(angle[m])], "mesh_id string, vertex_id long, angle double")
    lengths = P.edge_lengths(T.vertex_edges(f), v)
    ridge = P.ridge_costs(lengths, angles)
    asked = [(f"{m}{k}", m, s, t) for m in MESHES for k, (s, t) in enumerate([(0, W * W - 1), (3, 3), (10, 11), (W - 1, W * (W - 1))])]
    got = {r["request"]: r for r in P.shortest_paths(spark.createDataFrame(asked, "request string, mesh_id string, src long, dst long"), ridge).collect()}
    for name, m, s, t in asked:
        at, top = points(m), max(angle[m])
        cost = lambda a, b, m=m, at=at, top=top: math.dist(at[a], at[b]) * (1 + 3 * (1 - angle[m][b] / top))
        path = got[name]["path"]
        assert got[name]["cost"] == pytest.approx(dijkstra(s, cost)[t], abs=1e-6)
        assert path[0] == s and path[-1] == t and all(b in NEAR[a] for a, b in zip(path, path[1:], strict=False))
        assert sum(cost(a, b) for a, b in zip(path, path[1:], strict=False)) == pytest.approx(got[name]["cost"], abs=1e-6)
    way = [("l", "a", k, x) for k, x in enumerate([0, 1, 999, 30, 48])]
    line = P.complete_polyline(spark.createDataFrame(way, "line string, mesh_id string, pos int, vertex_id long"), lengths).first()["path"]
    at = points("a")
    assert line[:2] == [0, 1] and line[-1] == 48 and 30 in line and all(b in NEAR[a] for a, b in zip(line, line[1:], strict=False))
    legs = sum(math.dist(at[a], at[b]) for a, b in zip(line, line[1:], strict=False))
    straight = lambda s, t: dijkstra(s, lambda a, b: math.dist(at[a], at[b]))[t]
    assert legs == pytest.approx(straight(0, 1) + straight(1, 30) + straight(30, 48), abs=1e-6)


def test_evaluation_of_two_annotations(spark, tables):
    v, f = tables
    edges = T.vertex_edges(f)
    marks = {side: {m: [x for x in range(W * W) if random.Random(f"{side} {m} {x}").random() < 0.35] for m in MESHES} for side in ("gt", "pred")}
    drawn = lambda side: spark.createDataFrame([(m, x) for m in MESHES for x in marks[side][m]], "mesh_id string, vertex_id long")
    lp = E.labelled_pairs(K.flood_fill(v, edges, drawn("gt")), K.flood_fill(v, edges, drawn("pred")))
    got = {r["mesh_id"]: r for r in E.panoptic(v.select("mesh_id").distinct(), lp, E.optimal_matches(E.overlaps(lp))).collect()}
    for m in MESHES:
        a, b = (components(set(range(W * W)) - set(marks[side][m])) for side in ("gt", "pred"))
        iou = [[len(x & y) / len(x | y) for y in b] for x in a]
        chosen = [(i, j) for i, j in E.assignment([[1 - x for x in row] for row in iou]) if iou[i][j] >= 0.5]
        tp, s = len(chosen), sum(iou[i][j] for i, j in chosen)
        assert (got[m]["tp"], got[m]["fp"], got[m]["fn"]) == (tp, len(b) - tp, len(a) - tp)
        assert got[m]["pq"] == pytest.approx(s / (tp + (len(a) + len(b) - 2 * tp) / 2))


def test_watertight_shells_are_closed(spark, tables):
    v, f = tables
    seg = table(spark, "scar_id int", lambda m: [x // 20 for x in range(W * W)])
    sv, sf = S.watertight_shell(v, f, seg)
    at = {}
    for r in sf.collect():
        at.setdefault((r["mesh_id"], r["scar_id"]), []).append((r["i0"], r["i1"], r["i2"]))
    n = {(r["mesh_id"], r["scar_id"]): r["n"] for r in sv.groupBy("mesh_id", "scar_id").agg(F.count("*").alias("n")).collect()}
    assert set(at) == set(n) and len(at) > 3
    for key, tris in at.items():
        sides = [frozenset(e) for t in tris for e in (t[:2], t[1:], (t[2], t[0]))]
        assert all(sides.count(e) == 2 for e in set(sides))
        assert {i for t in tris for i in t} == set(range(n[key]))
    lines = files.ply_lines(sv.select(F.concat_ws("-", "mesh_id", "scar_id").alias("mesh_id"), "vertex_id", "x", "y", "z"), sf.select(F.concat_ws("-", "mesh_id", "scar_id").alias("mesh_id"), F.monotonically_increasing_id().alias("face_id"), F.col("i0").alias("v0"), F.col("i1").alias("v1"), F.col("i2").alias("v2")))
    counts = {r["mesh_id"]: r["n"] for r in lines.where("section = 4").groupBy("mesh_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {f"{m}-{s}": len(t) for (m, s), t in at.items()}


def test_gamma_reaches_faces_layer_by_layer(spark, tables):
    _, f = tables
    start = {m: {i: random.Random(f"{m}{i}").random() for i in range(len(FACES)) if random.Random(f"g{m}{i}").random() < 0.05} for m in MESHES}
    p = spark.createDataFrame([(m, i, start[m].get(i, 0.0)) for m in MESHES for i in range(len(FACES))], "mesh_id string, face_id long, p double")
    got = by_mesh(I.propagate_gamma(p, T.face_adjacency(f)), "face_id", "p")
    next_to = {i: [j for j, u in enumerate(FACES) if j != i and len(set(t) & set(u)) == 2] for i, t in enumerate(FACES)}
    for m in MESHES:
        now = dict(start[m])
        while True:
            new = {i: 0.95 * max(now[j] for j in next_to[i] if j in now) for i in next_to if i not in now and any(j in now for j in next_to[i])}
            if not new:
                break
            now |= new
        assert [got[m][i] for i in range(len(FACES))] == pytest.approx([now.get(i, 0.0) for i in range(len(FACES))])


def test_oldest_first_takes_explicit_orders_and_derives_the_others(spark):
    nodes = spark.createDataFrame([(m, s) for m in (1, 2) for s in range(4)], "mesh_id int, scar_id int")
    older = spark.createDataFrame([(m, a, b) for m in (1, 2) for a, b in ((0, 1), (1, 2), (0, 3))], "mesh_id int, younger int, older int")
    explicit = spark.createDataFrame([(2, s, 9 - s) for s in range(4)], "mesh_id int, scar_id int, temporal_order int")
    got = by_mesh(O.oldest_first(O.topological_order(nodes, older), explicit), "scar_id", "temporal_order")
    assert got == {1: {0: 4, 1: 3, 3: 2, 2: 1}, 2: {0: 9, 1: 8, 2: 7, 3: 6}}


def test_nearest_points_whatever_the_reach(spark):
    """Clusters, far probes, equal places and ties, against all pairs; a probe meets few cells."""
    rng = random.Random(41)
    points, probes = [], []
    for m in ("a", "b", "c"):
        own = [(rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(250)] + [(50 + rng.random() * 1e-3, 50.0, 50.0) for _ in range(120)]
        own += [(7.0, 7.0, 7.0)] * 40 + [(float(x), float(y), -9.0) for x in range(6) for y in range(6)]
        own = [p if m != "c" else (p[0], 0.0, 0.0) for p in own]
        points += [(m, k, *p) for k, p in enumerate(own)]
        probes += [(m, k, *p) for k, p in enumerate(own) if k % 3 == 0] + [(m, 10_000 + k, rng.uniform(-90, 90), rng.uniform(-90, 90), 0.5) for k in range(60)] + [(m, 20_000 + k, k + 0.5, 2.5, -9.0) for k in range(5)]
    points.append(("one", 3, 1.0, 2.0, 3.0))
    probes += [("one", 3, 1.0, 2.0, 3.0), ("one", 4, 1.0, 2.0, 3.5), ("none", 1, 0.0, 0.0, 0.0), ("a", None, 0.0, 0.0, 0.0)]
    table = spark.createDataFrame(points, "mesh_id string, vertex_id long, x double, y double, z double")
    asked = spark.createDataFrame(probes, "mesh_id string, probe long, px double, py double, pz double")
    for reach in (0.4, 25.0, 1e6):
        want = {}
        for m, p, x, y, z in probes:
            best = min((((a - x) ** 2 + (b - y) ** 2 + (c - z) ** 2, v) for n, v, a, b, c in points if n == m and v != p), default=None) if p is not None else None
            if best and math.sqrt(best[0]) < reach:
                want[m, p] = (best[1], pytest.approx(best[0]))
        got = {(r["mesh_id"], r["probe"]): (r["vertex_id"], r["d2"]) for r in T.nearest_annotated(asked, table, reach).collect()}
        assert got == want


def test_regions_are_whole_and_near(spark):
    rng = random.Random(43)
    rows = [("a", k, float(k % 60), float(k // 60), 0.0) for k in range(3600)] + [("b", k, 1.0, 1.0, 1.0) for k in range(130)] + [("c", 1, rng.random(), 0.0, 0.0)]
    got = morton.regions(spark.createDataFrame(rows, "mesh_id string, vertex_id long, x double, y double, z double"), 100).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault((r["mesh_id"], r["region"]), []).append(r["vertex_id"])
    assert sorted(map(len, (v for (m, _), v in sizes.items() if m == "a"))) == [100] * 36 and sorted(len(v) for (m, _), v in sizes.items() if m == "b") == [30, 100]
    spread = [max(k % 60 for k in v) - min(k % 60 for k in v) + max(k // 60 for k in v) - min(k // 60 for k in v) for (m, _), v in sizes.items() if m == "a"]
    assert sum(spread) / len(spread) < 45  # rows of 100 ids would spread over 60


@pytest.mark.parametrize("by_place", [False, True])
def test_paths_over_many_regions(spark, by_place):
    """A grid of 40 x 40 in regions of 100 vertices: costs as by Dijkstra, few rounds, paths of edges; one-way, cut-off and unknown ends."""
    side, rng = 40, random.Random(47)
    cost = {}
    for y in range(side):
        for x in range(side):
            for dx, dy in ((1, 0), (0, 1), (1, 1)):
                if x + dx < side and y + dy < side:
                    a, b = y * side + x, (y + dy) * side + x + dx
                    cost[a, b], cost[b, a] = rng.uniform(0.1, 3), rng.uniform(0.1, 3)
    cost |= {(5000, 5001): 1.0, (5001, 0): 0.5}
    rows = [(m, a, b, c if m == "m" else 1.0) for m in ("m", "flat") for (a, b), c in cost.items()]
    costs = spark.createDataFrame(rows, "mesh_id string, src long, dst long, cost double")
    near = {}
    for a, b in cost:
        near.setdefault(a, []).append(b)

    def best(start, step):
        done, queue = {start: 0.0}, [(0.0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d <= done[u]:
                for v in near.get(u, ()):
                    if d + step(u, v) < done.get(v, math.inf):
                        done[v] = d + step(u, v)
                        heapq.heappush(queue, (done[v], v))
        return done

    ends = [(0, side * side - 1), (side - 1, side * (side - 1)), (830, 830), (7, 8), (0, 5000), (5000, 1599), (9999, 3), (3, 9999)]
    asked = [(f"{m}{k}", m, *e) for m in ("m", "flat") for k, e in enumerate(ends)]
    requests = spark.createDataFrame(asked, "request string, mesh_id string, src long, dst long")
    places = None
    if by_place:
        v = [(m, k, float(k % side), float(k // side), 0.0) for m in ("m", "flat") for k in [*range(side * side), 5000, 5001]]
        places = morton.regions(spark.createDataFrame(v, "mesh_id string, vertex_id long, x double, y double, z double"), 100).cache()
    got = {r["request"]: r for r in P.shortest_paths(requests, costs, places, size=100).collect()}
    assert len(got) == len(asked)
    for name, m, s, t in asked:
        step = (lambda a, b: cost[a, b]) if m == "m" else (lambda a, b: 1.0)
        want = 0.0 if s == t else best(s, step).get(t)
        path = got[name]["path"]
        if want is None:
            assert path == [] and got[name]["cost"] is None
            continue
        assert got[name]["cost"] == pytest.approx(want, abs=1e-6) and path[0] == s and path[-1] == t
        assert sum(step(a, b) for a, b in zip(path, path[1:], strict=False)) == pytest.approx(want, abs=1e-6)
    if not by_place:
        return
    graph = P._graph(costs.where("mesh_id = 'flat'"), places, 100)
    start = spark.createDataFrame([("r", "flat", side * side - 1, 0, 0.0)], "request string, mesh_id string, dst long, v long, cost double")
    start = start.withColumn("prev", F.lit(None).cast("long")).join(places.select("mesh_id", F.col("vertex_id").alias("v"), "region"), ["mesh_id", "v"])
    _, rounds = P.relaxed(requests, graph, start, 10.0)
    assert 2 * rounds < len(got["flat0"]["path"])


# orders

def plain_replay(log):
    """The log folded with the adjacency searched afresh for every entry."""
    edges, outcomes = {}, []

    def path(start, goal):
        came, queue = {start: None}, [start]
        for at in queue:
            if at == goal:
                out = []
                while came[at] is not None:
                    out.append((came[at], at))
                    at = came[at]
                return out
            for a, b in edges:
                if a == at and b not in came:
                    came[b] = at
                    queue.append(b)
        return None

    for op, a, b, source in log:
        if op == "add" and a == b:
            outcomes.append("self")
        elif op == "add" and (a, b) in edges:
            outcomes.append("exists")
        elif op == "add":
            outcome = "added"
            while (way := path(b, a)) is not None:
                weak = [e for e in way if edges[e] == "preseed"]
                if not weak:
                    outcome = "cycle"
                    break
                for e in weak:
                    del edges[e]
            if outcome == "added":
                edges[a, b] = source
            outcomes.append(outcome)
        elif op == "remove":
            outcomes.append("removed" if edges.pop((a, b), None) else "absent")
        else:
            edges = {e: x for e, x in edges.items() if x != "preseed"}
            outcomes.append("cleared")
    return edges, outcomes


def test_comparison_logs_equal_a_plain_fold(spark):
    rows, want = [], {}
    for m in range(12):
        rng = random.Random(m)
        ops = rng.choices(["add", "remove", "clear_preseed"], [40, 4, 1 if m % 3 == 0 else 0], k=150)
        log = [(op, rng.randrange(14), rng.randrange(14), rng.choice(["expert", "preseed"])) for op in ops]
        rows += [(m, k, *x) for k, x in enumerate(log)]
        want[m] = plain_replay(log)
    table = spark.createDataFrame(rows, "mesh_id int, seq int, op string, younger int, older int, source string")
    got = {}
    for r in O.replay_comparisons(table).collect():
        got.setdefault(r["mesh_id"], {})[r["younger"], r["older"]] = r["source"]
    assert got == {m: e for m, (e, _) in want.items() if e}
    outcomes = {(r["mesh_id"], r["seq"]): r["outcome"] for r in O.comparison_outcomes(table).collect()}
    assert outcomes == {(m, k): o for m, (_, x) in want.items() for k, o in enumerate(x)} and {"cycle", "added", "exists"} <= set(outcomes.values())


def test_a_long_log_of_one_mesh_takes_seconds():
    import time

    rng = random.Random(3)
    log = pd.DataFrame([(k, "add", a := rng.randrange(20_000), min(19_999, a + 1 + rng.randrange(50)) if rng.random() < 0.98 else max(0, a - rng.randrange(3)), "expert") for k in range(100_000)], columns=["seq", "op", "younger", "older", "source"])
    began = time.process_time()
    edges, outcomes = O._replay(log)
    assert time.process_time() - began < 60 and len(outcomes) == 100_000 and len(edges) > 50_000


@pytest.mark.parametrize("small", [200_000, 10, 0])
def test_topological_order_by_task_and_by_level(spark, small):
    rows, nodes, want = [], [], {}
    for m in range(4):
        rng = random.Random(m)
        n = 30
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range([0, 12, 60, 40][m])} | ({(28, 29), (29, 28)} if m == 3 else set())
        nodes += [(m, k) for k in range(n)]
        rows += [(m, a, b) for a, b in edges]
        degree = {k: sum(b == k for _, b in edges) for k in range(n)}
        queue = [k for k in range(n) if not degree[k]]
        for at in queue:
            for b in (b for a, b in edges if a == at):
                degree[b] -= 1
            queue += sorted(b for a, b in edges if a == at and not degree[b])
        want |= {(m, k): i for i, k in enumerate(queue)}
    order = O.topological_order(spark.createDataFrame(nodes, "mesh_id int, scar_id int"), spark.createDataFrame(rows, "mesh_id int, younger int, older int"), small)
    assert {(r["mesh_id"], r["scar_id"]): r["position"] for r in order.collect()} == want


def test_asked_pairs_equal_the_closure(spark):
    rows, nodes = [], []
    for m in range(3):
        rng = random.Random(100 + m)
        nodes += [(m, k) for k in range(25)]
        rows += [(m, *sorted(rng.sample(range(25), 2))) for _ in range(35)] + ([(m, 20, 3), (m, 3, 20)] if m == 2 else [])
    comparisons = spark.createDataFrame(rows, "mesh_id int, younger int, older int").cache()
    order = O.topological_order(spark.createDataFrame(nodes, "mesh_id int, scar_id int"), comparisons).cache()
    asked = [(m, a, b) for m in range(3) for a in range(0, 25, 2) for b in range(0, 25, 3)]
    closure = {tuple(r) for r in O.reachable(comparisons).collect()}
    got = {tuple(r)[:3]: r["reached"] for r in O.reaches(spark.createDataFrame(asked, "mesh_id int, a int, b int"), comparisons, order).collect()}
    assert got == {x: x in closure for x in asked} and any(got.values())


# views

def test_views_by_quaternions():
    """The kept views against turns told as quaternions."""

    def quaternion(axis, angle):
        out = [math.cos(angle / 2), 0.0, 0.0, 0.0]
        out[1 + axis] = math.sin(angle / 2)
        return out

    def turn(q, r):  # conjugate of q times r
        w, x, y, z = q[0], -q[1], -q[2], -q[3]
        a, b, c, d = r
        return w * a - x * b - y * c - z * d, w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a

    for steps, many in (((6, 6, 6), 10), ((90, 90, 0), 176), ((1, 0, 0), 1), ((4, 3, 5), None), ((0, 8, 8), None)):
        kept = []
        for axis, n in enumerate(steps):
            for k in range(n):
                r = quaternion(axis, 2 * math.pi * k / n)
                for q in kept:
                    w, *v = turn(q, r)
                    size = math.hypot(*v)
                    if math.degrees(2 * math.atan2(size, abs(w))) < 1 or (abs(v[0]) < 0.05 * size and abs(v[1]) < 0.05 * size and abs(abs(v[2]) / size - 1) < 0.05):
                        break
                else:
                    kept.append(r)
        views = I.canonical_views(steps)
        assert len(views) == len(kept) and (many is None or len(kept) == many)
        for (_, m), (w, x, y, z) in zip(views, kept, strict=True):
            full = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
            assert m == pytest.approx(full, abs=1e-9)


def test_rotated_vertices(spark, tables):
    v, _ = tables
    views = I.canonical_views((3, 2, 0))
    got = {(r["mesh_id"], r["vertex_id"], r["view_id"]): (r["x"], r["y"], r["z"]) for r in G.rotated(v, I.views_table(spark, (3, 2, 0))).collect()}
    assert len(got) == len(MESHES) * W * W * len(views)
    for m in MESHES:
        for i, p in enumerate(points(m)):
            for k, r in views:
                assert got[m, i, k] == pytest.approx([sum(r[3 * a + b] * p[b] for b in range(3)) for a in range(3)], abs=1e-9)


def test_alignment_with_principal_axes(spark, tables):
    """Axes by falling spread, each towards its farthest vertex; lengths between vertices stay."""
    v, _ = tables
    stretched = v.withColumns({"x": F.col("x") * 3, "z": F.col("z") * 0.5 + F.col("y") * 0.2})
    got = {(r["mesh_id"], r["vertex_id"]): (r["x"], r["y"], r["z"]) for r in G.pca_aligned(stretched).collect()}
    for m in MESHES:
        at = np.array([(3 * x, y, 0.5 * z + 0.2 * y) for x, y, z in points(m)])
        own = np.array([got[m, i] for i in range(W * W)])
        spread = own.T @ own
        assert np.allclose(spread - np.diag(np.diag(spread)), 0, atol=1e-6) and (np.diff(np.diag(spread)) <= 1e-9).all()
        assert np.allclose(np.linalg.norm(own[:, None] - own[None], axis=2), np.linalg.norm(at[:, None] - at[None], axis=2), atol=1e-8)
        assert np.allclose(np.diag(spread), sorted(np.linalg.eigvalsh((at - at.mean(0)).T @ (at - at.mean(0))), reverse=True))
        for a in range(3):
            assert own[np.abs(own[:, a]).argmax(), a] > 0


def test_scores_from_pixels_to_faces(spark, tables):
    """Views scaled over all their pixels, faces averaged and weighed by how they face, then spread from the seen ones."""
    _, f = tables
    rng = random.Random(53)
    pixels = [(m, view, k, None if rng.random() < 0.3 else rng.randrange(0, 20), rng.uniform(-4, 4)) for m in MESHES for view in range(3) for k in range(60)]
    pixels += [("a", 9, k, 25, 1.5) for k in range(4)]  # a flat view
    facing = [(m, view, face, rng.uniform(-1, 1)) for m in MESHES for view in (0, 1, 2, 9) for face in range(len(FACES))]
    px = spark.createDataFrame(pixels, "mesh_id string, view_id int, pixel int, face_id long, logit double")
    nz = spark.createDataFrame(facing, "mesh_id string, view_id int, face_id long, nz double")
    seen = I.weighted_mean(f, I.view_scores(px, nz))
    turned = {(m, view, face): z for m, view, face, z in facing}
    want = {}
    for m in MESHES:
        total = {}
        for view in (0, 1, 2, 9):
            own = [p for p in pixels if p[0] == m and p[1] == view]
            if not own:
                continue
            low, span = min(p[4] for p in own), (max(p[4] for p in own) - min(p[4] for p in own)) or 1
            for face in {p[3] for p in own if p[3] is not None}:
                values = [(p[4] - low) / span for p in own if p[3] == face]
                z = turned[m, view, face]
                weight = 3 if z >= 0.8 else 2 if z >= 0.5 else 1
                a, b = total.get(face, (0, 0))
                total[face] = a + weight * sum(values) / len(values), b + weight
        want |= {(m, k): total[k][0] / total[k][1] if k in total else 0.0 for k in range(len(FACES))}
    assert {(r["mesh_id"], r["face_id"]): r["p"] for r in seen.collect()} == pytest.approx(want)
    spread = {(r["mesh_id"], r["face_id"]): r["p"] for r in I.propagate_gamma(seen, T.face_adjacency(f)).collect()}
    sides = lambda t: {frozenset(x) for x in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))}
    for m in MESHES:
        value = {k: want[m, k] for k in range(len(FACES))}
        while True:
            new = {k: 0.95 * max(value[j] for j in value if value[j] > 0 and sides(FACES[k]) & sides(FACES[j])) for k in value if not value[k] and any(value[j] > 0 and sides(FACES[k]) & sides(FACES[j]) for j in value)}
            if not new:
                break
            value |= new
        assert {k: spread[m, k] for k in value} == pytest.approx(value)


def test_sure_matches_are_taken_out_of_large_components(spark):
    """Chains and blocks of overlapping labels: the same total whether a component is solved whole or in pieces, and by the dense solver."""
    rng, rows = random.Random(61), []
    for m in ("chain", "block"):
        pairs = {}
        for g in range(1, 61):
            for p in range(max(1, g - 2), min(60, g + 2) + 1) if m == "chain" else rng.sample(range(1, 41), 5):
                pairs[g, p] = round(rng.random() ** 3, 3)
        rows += [(m, g, p, x) for (g, p), x in pairs.items() if x > 0]
    table = spark.createDataFrame(rows, "mesh_id string, gt int, pred int, iou double")
    totals = {}
    for dense in (20_000, 10):
        got = E.optimal_matches(table, 1e-6, dense).collect()
        for m in ("chain", "block"):
            own = [r for r in got if r["mesh_id"] == m]
            assert len({r["gt"] for r in own}) == len(own) == len({r["pred"] for r in own})
            totals.setdefault(m, []).append(sum(r["iou"] for r in own))
    for m in totals:
        cost = np.ones((60, 60))
        for k, g, p, x in rows:
            if k == m:
                cost[g - 1, p - 1] = 1 - x
        best = sum(1 - cost[a, b] for a, b in E.assignment(cost.tolist()))
        assert totals[m] == pytest.approx([best, best], abs=1e-6)
    sure, left = E.sure_matches(table)
    assert sure.count() > 10 and left.count() < len(rows)


def random_overlaps(n, degree, seed):
    rng = np.random.default_rng(seed)
    pairs = {(g, int(p)): float(rng.random() ** 2 / 2) for g in range(n) for p in (g + rng.integers(-4, 5, degree)) % n}
    return [(g, p, x) for (g, p), x in pairs.items()]


def best_total(rows):
    cost = np.ones((1 + max(r[0] for r in rows), 1 + max(r[1] for r in rows)))
    for g, p, x in rows:
        cost[g, p] = 1 - x
    return sum(1 - cost[a, b] for a, b in E.assignment(cost.tolist()))


def test_a_task_of_bidders_settles():
    """Everybody has a good, nobody wants another's by more than the raise, and a bidder without rivals keeps its price."""
    bidder, good = np.array([1, 1, 2, 2, 3, 3]), np.array([1, 9, 2, 9, 3, 7])
    value, price = np.array([0, 50, 0, 80, 0, 40]), np.array([0, 0, 0, 0, 0, 10])
    found = {g: (b, p) for g, b, p in settle(bidder, good, value, price, np.zeros(6, bool), 1)}
    assert found[9][0] == 2 and 50 <= found[9][1] <= 81 and found[1][0] == 1 and found[7] == (3, 41)
    # bids may end before all have a good: the rest bid again in another round
    assert len(settle(bidder, good, value, price, np.zeros(6, bool), 1, bids=1)) == 1
    # who holds a good stays silent
    assert settle(bidder[:2], good[:2], value[:2], price[:2], np.array([False, True]), 1) == []


@pytest.mark.parametrize("block", [10_000, 100])
def test_auction_finds_the_largest_total(spark, block):
    """Two meshes of random overlaps, in a task each and split over several: a matching, its total that of the dense solver."""
    meshes = {"m": random_overlaps(18, 3, 7), "n": random_overlaps(10, 4, 8)}
    table = spark.createDataFrame([(m, 0, *r) for m, rows in meshes.items() for r in rows], "mesh_id string, component int, gt int, pred int, iou double")
    got = auction(table, block).join(table, ["mesh_id", "gt", "pred"]).collect()
    for m, rows in meshes.items():
        own = [r for r in got if r["mesh_id"] == m]
        assert len({r["gt"] for r in own}) == len(own) == len({r["pred"] for r in own})
        assert sum(r["iou"] for r in own) == pytest.approx(best_total(rows), abs=1e-6)
    assert auction(table.limit(0), block).count() == 0


def test_large_components_go_by_auction(spark):
    """What is left of a component once its sure pairs are gone is solved by auction, with the dense solver's total; 1,200 labels of each side."""
    rows = random_overlaps(1200, 6, 9)
    table = spark.createDataFrame([("m", *r) for r in rows], "mesh_id string, gt int, pred int, iou double")
    got = E.optimal_matches(table, 1e-9, dense=500).collect()
    assert len({r["gt"] for r in got}) == len(got) == len({r["pred"] for r in got})
    assert sum(r["iou"] for r in got) == pytest.approx(best_total(rows), abs=1e-5)


def layered(start, links, top):
    """Layers of faces: the lowest layer counts, then the highest score."""
    now = dict(start)
    for _ in range(top):
        new = {}
        for a, b in links:
            if a in now and b not in now:
                new[b] = max(new.get(b, 0.0), 0.95 * now[a])
        now |= new
    return now


def test_gamma_crosses_regions_in_a_few_jobs(spark):
    rng = random.Random(4)
    n, steps = 150, 60
    pairs = [(i, (i + 1) % n) for i in range(n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(9)]
    links = [*pairs, *((b, a) for a, b in pairs)]
    start = {0: 0.9, 3: 0.2, 75: 0.5}
    scores = spark.createDataFrame([(m, i, start.get(i, 0.0) if m == "a" else 0.0) for m in "ab" for i in range(n)] + [("a", n, None)], "mesh_id string, face_id long, p double")
    near = spark.createDataFrame([("a", b, 0, a) for a, b in links], "mesh_id string, face_id long, slot int, nbr long")
    want = {top: [layered(start, links, top - 1).get(i, 0.0) for i in range(n)] + [None] for top in (4, steps)}
    for size in (1000, 20):
        for top in (4, steps):
            got = by_mesh(I.propagate_gamma(scores, near, 0.95, top, size), "face_id", "p")["a"]
            assert [got[i] for i in range(n + 1)] == want[top]
    began = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    I.propagate_gamma(scores, near, 0.95, steps).collect()
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup()) - began) < 10  # not a job a layer


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_face_tables_are_not_broadcast(spark, tables):
    v, f = tables
    assert broadcasts(G.pca_aligned(v)) == 0
    points = G.face_points(f, v)
    assert broadcasts(points) == 0
    assert broadcasts(G.face_sharpness(T.face_adjacency(f), G.face_normals(points))) == 0


def test_boundary_statistics_of_any_triangles(spark):
    """Sides of one to many faces, against plain loops; no table of vertices or faces is broadcast."""
    rng = random.Random(8)
    tris = [tuple(rng.sample(range(24), 3)) for _ in range(160)]
    at = {i: tuple(rng.random() for _ in range(3)) for i in range(24)}
    label = {i: rng.randrange(5) for i in range(24)}
    v = spark.createDataFrame([(1, i, *p) for i, p in at.items()], "mesh_id long, vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(1, i, *t) for i, t in enumerate(tris)], "mesh_id long, face_id long, v0 long, v1 long, v2 long")
    labels = spark.createDataFrame([(1, i, x) for i, x in label.items()], "mesh_id long, vertex_id long, label int")
    edges, normals = T.vertex_edges(f), G.face_normals(G.face_points(f, v))
    members = S.scar_vertices(labels, S.identify(labels))
    boundary = S.adjacency(edges, members)
    stats = S.boundary_statistics(f, normals, labels, boundary)
    got = {(r["scar_a"], r["scar_b"]): (r["sharpness"], r["roughness"], r["boundary_size"]) for r in stats.collect()}
    normal = {r["face_id"]: np.array([r["nx"], r["ny"], r["nz"]]) for r in normals.collect()}

    def most(t):
        a, b, c = (label[i] for i in t)
        return a if a and a in (b, c) else b if b and b == c else a or b or c

    touching = {}
    for r in boundary.collect():
        touching.setdefault((r["scar_a"], r["scar_b"]), set()).add(r["vertex_id"])
    assert got.keys() == touching.keys() and len(got) == 6
    for pair, ends in touching.items():
        sides = {}
        for i, t in enumerate(tris):
            if ends & set(t):
                for e in (t[:2], t[1:], (t[2], t[0])):
                    sides.setdefault(frozenset(e), []).append(i)
        angles = [math.acos(max(-1, min(1, float(normal[a] @ normal[b])))) for a, b in (s for s in sides.values() if len(s) == 2) if most(tris[a]) != most(tris[b]) and most(tris[a]) and most(tris[b])]
        assert got[pair] == pytest.approx((np.mean(angles), np.std(angles), len(angles)) if angles else (0, 0, 0))
    assert broadcasts(stats) == 0 and broadcasts(boundary) == 0
    assert broadcasts(S.erode_by_majority(labels, edges)) == 0


def test_requests_share_the_edges_of_a_region(spark):
    asked = [(f"r{i}", "m", 0 if i < 50 else 1) for i in range(53)]
    work = spark.createDataFrame(asked, "request string, mesh_id string, region long")
    graph = spark.createDataFrame([("m", region, k, k + 1, region, 1.0) for region in (0, 1, 2) for k in range(4)], "mesh_id string, region long, src long, to long, to_region long, cost double")
    seen = lambda key, rows, edges: pd.DataFrame({"region": [key[1]], "asked": [len(rows)], "edges": [len(edges)]})
    got = [tuple(r) for r in P._by_region(work, graph, seen, "region long, asked int, edges int", 20).collect()]
    assert len(got) <= 4 and all(edges == 4 for _, _, edges in got)
    assert sum(n for region, n, _ in got if region == 0) == 50 and (1, 3, 4) in got


def test_a_search_ends_at_its_target():
    line = {k: [(k - 1, 0, 1.0), (k + 1, 0, 1.0)] for k in range(10_000)}
    cost, before, _, beyond = P._within([(5000, 0.0)], line, math.inf, 0, 5003)
    assert cost[5003] == 3 and before[5003] == 5002 and len(cost) < 12 and not beyond


@pytest.fixture(scope="module")
def graph(spark, tables):
    v, f = tables
    return S.scar_graph(v, f, table(spark, "label int", labels_of))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boundary_averages_read_the_statistics_as_a_table(graph):
    _, scars, _, edges = graph
    averages = R.boundary_averages(edges, O.preseed_by_size(edges, scars))
    assert "Generate" not in plan(averages) and len(averages.collect()) == len(MESHES)  # no faces taken apart again


def test_saved_orders_read_the_statistics_as_a_table(graph):
    _, scars, _, edges = graph
    comparisons = O.preseed_by_size(edges, scars)
    restored = O.restorable(O.serialise(scars, edges, comparisons), scars)
    assert "posexplode" not in plan(restored)  # no faces taken apart again
    assert sorted(map(tuple, restored.collect())) == sorted(map(tuple, comparisons.collect()))
