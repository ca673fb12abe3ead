"""Segmentation: merge costs, components, erosion and boundary normalisation."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import MAX_ROUNDS, SMALL, connected_components, tabled
from debitage.operators.geometry import remap_by_frequency
from debitage.operators.topology import M, corners, edge_list, spread, vertex_edges


def edge_costs(edges: DataFrame, scores: DataFrame, how: str = "max") -> DataFrame:
    """edges (edge_list) with ``cost``: max, mean or min of the two faces' scores; any other name is min."""
    a = scores.select(M, "face_id", F.col("p").alias("pa"))
    b = scores.select(M, F.col("face_id").alias("nbr"), F.col("p").alias("pb"))
    cost = {"max": F.greatest("pa", "pb"), "mean": (F.col("pa") + F.col("pb")) / 2}.get(how, F.least("pa", "pb"))
    return edges.join(a, [M, "face_id"]).join(b, [M, "nbr"]).select(M, "edge_idx", "face_id", "nbr", cost.alias("cost"))


def _by_lowest(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """mesh_id, face_id, root: components of the pairs (face_id, nbr), as their lowest face."""
    found = connected_components(pairs, "face_id", "nbr", [M]).withColumnRenamed("node", "face_id")
    return faces.select(M, "face_id").join(found, [M, "face_id"], "left").select(M, "face_id", F.coalesce("component", "face_id").alias("root"))


def threshold_components(faces: DataFrame, costs: DataFrame, max_merge_cost: float = 0.45) -> DataFrame:
    """mesh_id, face_id, root: faces joined by edges of cost <= max_merge_cost."""
    return _by_lowest(faces, costs.where(F.col("cost") <= max_merge_cost))


def _fold(merge: Callable[[int, int], bool], edges: pd.DataFrame, sizes: dict[int, int]) -> dict[int, int]:
    """Union the edges in order wherever merge(size a, size b) allows; lowest id as root."""
    root = {v: v for v in sizes}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in zip(edges["a"], edges["b"], strict=True):
        x, y = find(a), find(b)
        if x != y and merge(sizes[x], sizes[y]):
            low, high = min(x, y), max(x, y)
            root[high] = low
            sizes[low] += sizes[high]
    return {v: find(v) for v in root}


def _merge_in_rounds(edges: DataFrame, merge: Callable, max_rounds: int = MAX_ROUNDS * 100) -> DataFrame:
    """mesh_id, node, new_root: what _fold gives for all edges (mesh_id, a, b, na, nb, cost, edge_idx), by rounds of joins.

    An edge that is the first one at both of its clusters acts next, whatever happens
    elsewhere, so a round takes all of those together.  Clusters only grow, so an edge
    once refused stays refused and goes; of parallel edges the first alone can act.
    """
    order = F.struct("cost", "edge_idx")

    def live(e: DataFrame) -> DataFrame:
        same = e.where("a <> b").where(merge(F.col("na"), F.col("nb"))).groupBy(M, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        sizes = F.when(F.col("a") < F.col("b"), F.struct(F.col("na").alias("x"), F.col("nb").alias("y"))).otherwise(F.struct(F.col("nb").alias("x"), F.col("na").alias("y")))
        first = same.agg(F.min(F.struct("cost", "edge_idx", sizes.alias("n"))).alias("e"))
        return tabled(first.select(M, F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("e.n.x").alias("na"), F.col("e.n.y").alias("nb"), "e.cost", "e.edge_idx"))

    now, merges = live(edges), []
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        ends = now.select(M, F.explode(F.array("a", "b")).alias("c"), order.alias("e")).groupBy(M, "c").agg(F.min("e").alias("e"))
        both = ends.groupBy(M, F.col("e.edge_idx").alias("edge_idx")).agg(F.count("*").alias("ends")).where("ends = 2").select(M, "edge_idx")
        done = tabled(now.join(both, [M, "edge_idx"], "left_semi").select(M, "a", "b", (F.col("na") + F.col("nb")).alias("n")))
        merges.append(done.select(M, "a", "b"))
        moved = done.select(M, F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("to"), "n")
        for end, size in (("a", "na"), ("b", "nb")):
            now = now.join(moved.withColumnRenamed("c", end), [M, end], "left").withColumns({end: F.coalesce("to", end), size: F.coalesce("n", size)}).drop("to", "n")
        now = live(now)
    else:
        raise RuntimeError("merges of more rounds than allowed")
    pairs = functools.reduce(DataFrame.unionByName, merges) if merges else edges.select(M, "a", "b").limit(0)
    return connected_components(pairs, "a", "b", [M]).withColumnRenamed("component", "new_root")


def _merged(edges: DataFrame, merge: Callable, small: int) -> DataFrame:
    """mesh_id, node, new_root of edges (mesh_id, part, a, b, na, nb, cost, edge_idx): parts of at most ``small`` edges in a task each."""
    kind = dict(edges.dtypes)[M]

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["cost", "edge_idx"])
        sizes = dict(zip(g["a"], g["na"], strict=True)) | dict(zip(g["b"], g["nb"], strict=True))
        found = _fold(merge, g, sizes)
        return pd.DataFrame({M: g[M].iloc[0], "node": list(found), "new_root": list(found.values())})

    in_tasks = lambda e: e.groupBy(M, "part").applyInPandas(fold, f"{M} {kind}, node long, new_root long")
    large = edges.groupBy(M, "part").agg(F.count("*").alias("n")).where(F.col("n") > small).select(M, "part")
    if large.isEmpty():
        return in_tasks(edges)
    large = tabled(large)
    by_rounds = _merge_in_rounds(edges.join(large, [M, "part"], "left_semi"), merge)
    return in_tasks(edges.join(large, [M, "part"], "left_anti")).unionByName(by_rounds)


def capped_components(faces: DataFrame, costs: DataFrame, max_merge_cost: float = 0.45, max_segment_size: int | None = None, small: int = SMALL) -> DataFrame:
    """threshold_components, but in ascending (cost, edge_idx) and never past max_segment_size faces.

    No merge crosses a component of the uncapped merge: those of at most ``small`` edges
    are folded in a task each, larger ones go by rounds of joins.
    """
    free = threshold_components(faces, costs, max_merge_cost)
    if not max_segment_size:
        return free
    own = costs.where(F.col("cost") <= max_merge_cost).join(free, [M, "face_id"])
    one = F.lit(1).cast("long")
    own = own.select(M, F.col("root").alias("part"), F.col("face_id").alias("a"), F.col("nbr").alias("b"), one.alias("na"), one.alias("nb"), "cost", "edge_idx")
    found = _merged(own, lambda x, y: x + y <= max_segment_size, small).withColumnRenamed("node", "face_id")
    return faces.select(M, "face_id").join(found, [M, "face_id"], "left").select(M, "face_id", F.coalesce("new_root", "face_id").alias("root"))


def cleaned_up(segments: DataFrame, costs: DataFrame, min_segment_size: int = 50, small: int = SMALL) -> DataFrame:
    """segments (face_id, root) after merging, over all edges ascending, wherever either side has under min_segment_size faces.

    Sizes only grow, so of each segment pair the first edge alone can act, and only if one
    of the two is small from the start: the mesh is contracted to those pairs.  Components
    of at most ``small`` pairs are folded in a task each, larger ones go by rounds of joins.
    """
    if min_segment_size <= 1:
        return segments
    a = segments.select(M, "face_id", F.col("root").alias("ra"))
    b = segments.select(M, F.col("face_id").alias("nbr"), F.col("root").alias("rb"))
    first = (
        costs.join(a, [M, "face_id"])
        .join(b, [M, "nbr"])
        .where("ra <> rb")
        .groupBy(M, F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        .agg(F.min(F.struct("cost", "edge_idx")).alias("e"))
        .select(M, "a", "b", "e.cost", "e.edge_idx")
    )
    sizes = segments.groupBy(M, "root").agg(F.count("*").alias("n"))
    sized = first.join(sizes.select(M, F.col("root").alias("a"), F.col("n").alias("na")), [M, "a"]).join(sizes.select(M, F.col("root").alias("b"), F.col("n").alias("nb")), [M, "b"])
    live = sized.where(F.least("na", "nb") < min_segment_size)
    parts = connected_components(live, "a", "b", [M]).select(M, F.col("node").alias("a"), F.col("component").alias("part"))
    found = _merged(live.join(parts, [M, "a"]), lambda x, y: (x < min_segment_size) | (y < min_segment_size), small).withColumnRenamed("node", "root")
    return segments.join(found, [M, "root"], "left").select(M, "face_id", F.coalesce("new_root", "root").alias("root"))


def segment_faces(faces: DataFrame, face_adj: DataFrame, scores: DataFrame, max_merge_cost: float = 0.45, min_segment_size: int = 50, max_segment_size: int | None = None, how: str = "max") -> DataFrame:
    """mesh_id, face_id, label: the whole face segmentation, ids by frequency."""
    costs = edge_costs(edge_list(face_adj), scores, how)
    merged = cleaned_up(capped_components(faces, costs, max_merge_cost, max_segment_size), costs, min_segment_size)
    return remap_by_frequency(merged.withColumnRenamed("root", "label"))


def faces_to_vertex_edges(vertices: DataFrame, faces: DataFrame, labels: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, label: 1 where incident faces disagree or there is none."""
    own = corners(faces).join(labels, [M, "face_id"]).groupBy(M, "vertex_id").agg((F.min("label") != F.max("label")).cast("int").alias("label"))
    return vertices.select(M, "vertex_id").join(own, [M, "vertex_id"], "left").fillna(1, ["label"])


def faces_to_vertex_segments(vertices: DataFrame, faces: DataFrame, labels: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, label: the one non-zero segment of the incident faces, else 0."""
    own = corners(faces).join(labels.where("label <> 0"), [M, "face_id"]).groupBy(M, "vertex_id").agg(F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(0).alias("label"))
    return vertices.select(M, "vertex_id").join(own, [M, "vertex_id"], "left").fillna(0, ["label"])


def _roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, root over the edges among nodes."""
    inside = edges.join(nodes.select(M, F.col("vertex_id").alias("src")), [M, "src"], "left_semi").join(nodes.select(M, F.col("vertex_id").alias("dst")), [M, "dst"], "left_semi")
    found = connected_components(inside, "src", "dst", [M]).withColumnRenamed("node", "vertex_id")
    return nodes.select(M, "vertex_id").join(found, [M, "vertex_id"], "left").select(M, "vertex_id", F.coalesce("component", "vertex_id").alias("root"))


def flood_fill(vertices: DataFrame, edges: DataFrame, edge_vertices: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, label: components of non-edge vertices, 1 .. n by lowest vertex; edge vertices 0."""
    inner = vertices.select(M, "vertex_id").join(edge_vertices.select(M, "vertex_id"), [M, "vertex_id"], "left_anti")
    roots = _roots(inner, edges)
    # numbered over one row a component, not over the vertices
    ids = roots.where("root = vertex_id").select(M, "root", F.row_number().over(Window.partitionBy(M).orderBy("root")).alias("label"))
    return vertices.select(M, "vertex_id").join(roots.join(ids, [M, "root"]).select(M, "vertex_id", "label"), [M, "vertex_id"], "left").fillna(0, ["label"])


def small_to_edge(labels: DataFrame, edges: DataFrame, min_size: int) -> DataFrame:
    """labels with 0 where the component of non-zero vertices (whatever their labels) is smaller than min_size."""
    roots = _roots(labels.where("label <> 0"), edges)
    small = roots.join(roots.groupBy(M, "root").agg(F.count("*").alias("n")).where(F.col("n") < min_size), [M, "root"]).select(M, "vertex_id", F.lit(0).alias("zero"))
    return labels.join(small, [M, "vertex_id"], "left").select(M, "vertex_id", F.coalesce("zero", "label").alias("label"))


def _layers(labels: DataFrame, edges: DataFrame, pick: Callable, max_rounds: int = MAX_ROUNDS * 100) -> DataFrame:
    """Label unlabelled vertices layer by layer; pick aggregates the labelled neighbours of earlier layers.

    A vertex of layer k has no neighbour of a layer before k - 1 (it would have been
    labelled sooner), so a round joins the last layer alone and stores the new one.
    """
    open_ = labels.where("label = 0").select(M, F.col("vertex_id").alias("src"))
    hops = tabled(edges.join(spread(open_), [M, "src"], "left_semi"))
    last, layers = labels.where("label > 0").select(M, "vertex_id", "label"), []
    for _ in range(max_rounds):
        votes = hops.join(spread(last.withColumnRenamed("vertex_id", "dst")), [M, "dst"])
        for before in layers[-2:]:
            votes = votes.join(spread(before.select(M, F.col("vertex_id").alias("src"))), [M, "src"], "left_anti")
        last = tabled(pick(votes).select(M, F.col("src").alias("vertex_id"), "label"))
        if last.isEmpty():
            break
        layers.append(last)
    else:
        raise RuntimeError("the mesh has more layers than rounds")
    if not layers:
        return labels
    new = functools.reduce(DataFrame.unionByName, layers).withColumnRenamed("label", "new")
    return tabled(labels.join(spread(new), [M, "vertex_id"], "left").select(M, "vertex_id", F.coalesce("new", "label").alias("label")))


def erode_to_min(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each unlabelled vertex takes the smallest label among its labelled neighbours, layer by layer; unreachable ones stay 0."""
    return _layers(labels, edges, lambda v: v.groupBy(M, "src").agg(F.min("label").alias("label")))


def thin_edges(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """mesh_id, vertex_id: the lower-labelled end of every triangle side whose ends differ."""
    sides = faces.select(M, F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))).alias("s"))
    sides = sides.select(M, F.least("s.a", "s.b").alias("a"), F.greatest("s.a", "s.b").alias("b")).distinct()
    la = labels.select(M, F.col("vertex_id").alias("a"), F.col("label").alias("la"))
    lb = labels.select(M, F.col("vertex_id").alias("b"), F.col("label").alias("lb"))
    return sides.join(la, [M, "a"]).join(lb, [M, "b"]).where("la <> lb").select(M, F.when(F.col("la") < F.col("lb"), F.col("a")).otherwise(F.col("b")).alias("vertex_id")).distinct()


def normalise_edges(faces: DataFrame, labels: DataFrame, min_size: int = 50, max_iterations: int = 3) -> tuple[DataFrame, DataFrame]:
    """(labels, progress): boundaries one vertex wide; progress has converged and iterations of each mesh.

    Each round zeroes small components, erodes all boundaries away and draws thin ones;
    a mesh whose labels didn't change is done and keeps them.
    """
    edges = tabled(vertex_edges(faces))
    now = tabled(labels)
    progress = tabled(labels.select(M).distinct().withColumns({"converged": F.lit(False), "iterations": F.lit(0)}))
    for _ in range(max_iterations):
        live = progress.where("not converged").select(M)
        if live.isEmpty():
            break
        own = now.join(live, M, "left_semi")
        grown = erode_to_min(small_to_edge(own, edges, min_size) if min_size > 1 else own, edges)
        thin = thin_edges(faces, grown).withColumn("thin", F.lit(0))
        new = tabled(grown.join(thin, [M, "vertex_id"], "left").select(M, "vertex_id", F.coalesce("thin", "label").alias("new")))
        changed = now.join(new, [M, "vertex_id"]).groupBy(M).agg(F.max((F.col("label") != F.col("new")).cast("int")).alias("changed"))
        progress = tabled(
            progress.join(changed, M, "left").select(M, F.coalesce(F.col("changed") == 0, "converged").alias("converged"), (F.col("iterations") + F.col("changed").isNotNull().cast("int")).alias("iterations"))
        )
        now = tabled(now.join(new, [M, "vertex_id"], "left").select(M, "vertex_id", F.coalesce("new", "label").alias("label")))
    return now, progress


def postprocess(vertices: DataFrame, faces: DataFrame, face_adj: DataFrame, scores: DataFrame, max_merge_cost: float = 0.45, min_segment_size: int = 50, max_iterations: int = 3) -> DataFrame:
    """mesh_id, vertex_id, label from face scores: segments without cleanup, to vertices, normalised boundaries."""
    segments = segment_faces(faces, face_adj, scores, max_merge_cost, 1)
    return normalise_edges(faces, faces_to_vertex_segments(vertices, faces, segments), min_segment_size, max_iterations)[0]


def lineage(new: DataFrame, old: DataFrame) -> DataFrame:
    """mesh_id, label, previous, shared: for each new segment the old one with most shared vertices (lowest id on ties)."""
    both = new.where("label > 0").join(old.where("label > 0").select(M, "vertex_id", F.col("label").alias("previous")), [M, "vertex_id"])
    shared = both.groupBy(M, "label", "previous").agg(F.count("*").alias("shared"))
    best = shared.groupBy(M, "label").agg(F.max(F.struct("shared", (-F.col("previous")).alias("minus"))).alias("b"))
    return best.select(M, "label", (-F.col("b.minus")).alias("previous"), F.col("b.shared").alias("shared"))


def largest_segment(labels: DataFrame) -> DataFrame:
    """mesh_id, label, n of the segment with most vertices, the lowest id on ties."""
    sizes = labels.where("label > 0").groupBy(M, "label").agg(F.count("*").alias("n"))
    best = sizes.groupBy(M).agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("b"))
    return best.select(M, (-F.col("b.minus")).alias("label"), F.col("b.n").alias("n"))


def face_label_import(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """mesh_id, vertex_id of vertices whose faces carry more than one label."""
    return corners(faces).join(labels, [M, "face_id"]).groupBy(M, "vertex_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(M, "vertex_id")


def label_id_import(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """mesh_id, vertex_id of all corners of triangles whose vertices don't share one label."""
    own = corners(faces).join(labels, [M, "vertex_id"])
    mixed = own.groupBy(M, "face_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return corners(faces).join(mixed, [M, "face_id"], "left_semi").select(M, "vertex_id").distinct()


