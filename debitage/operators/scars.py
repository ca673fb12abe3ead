"""Regions (scars) and their graph: erosion, adjacency, boundary statistics, metrics, shells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import tabled
from debitage.operators.geometry import crosses, face_normals, face_points
from debitage.operators.segment import _layers
from debitage.operators.topology import M, corners, face_sides, per_mesh, spread, vertex_edges


def erode_by_majority(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each unlabelled vertex takes its labelled neighbours' most frequent label, layer by layer; ties to the label met first."""

    def pick(votes: DataFrame) -> DataFrame:
        counted = votes.groupBy(M, "src", "label").agg(F.count("*").alias("n"), F.min("first_rank").alias("rank"))
        return counted.groupBy(M, "src").agg(F.max_by("label", F.struct("n", (-F.col("rank")).alias("r"))).alias("label"))

    return _layers(labels, edges, pick)


def identify(labels: DataFrame) -> DataFrame:
    """mesh_id, label, scar_id, vertex_count, representative_vertex: ids 0 .. by size, lowest vertex on ties."""
    groups = labels.where("label > 0").groupBy(M, "label").agg(F.count("*").alias("vertex_count"), F.min("vertex_id").alias("representative_vertex"))
    rank = F.row_number().over(Window.partitionBy(M).orderBy(F.desc("vertex_count"), "representative_vertex")) - 1
    return groups.withColumn("scar_id", rank)


def scar_vertices(labels: DataFrame, scars: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, scar_id."""
    return labels.join(per_mesh(scars.select(M, "label", "scar_id")), [M, "label"]).select(M, "vertex_id", "scar_id")


def adjacency(edges: DataFrame, members: DataFrame) -> DataFrame:
    """mesh_id, scar_a, scar_b, vertex_id: the vertices on either side of each touching pair of scars."""
    a = members.select(M, F.col("vertex_id").alias("src"), F.col("scar_id").alias("sa"))
    b = members.select(M, F.col("vertex_id").alias("dst"), F.col("scar_id").alias("sb"))
    touch = edges.join(spread(a), [M, "src"]).join(spread(b), [M, "dst"]).where("sa <> sb")
    return touch.select(M, F.least("sa", "sb").alias("scar_a"), F.greatest("sa", "sb").alias("scar_b"), F.col("src").alias("vertex_id")).distinct()


def majority_with_zero(a: Column, b: Column, c: Column) -> Column:
    """The first label that two corners share, else the first corner's; 0 takes part."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(a)


def majority_non_zero(a: Column, b: Column, c: Column) -> Column:
    """The most frequent non-zero label, the first met on ties; 0 if there is none."""
    return F.when((a != 0) & ((a == b) | (a == c)), a).when((b != 0) & (b == c), b).otherwise(F.coalesce(F.nullif(a, F.lit(0)), F.nullif(b, F.lit(0)), F.nullif(c, F.lit(0)), F.lit(0)))


def face_labels(faces: DataFrame, labels: DataFrame, rule=majority_with_zero) -> DataFrame:
    """mesh_id, face_id, label by a majority rule over the corners' labels."""
    own = corners(faces).join(spread(labels.select(M, "vertex_id", "label")), [M, "vertex_id"], "left").groupBy(M, "face_id")
    at = own.agg(*(F.coalesce(F.max(F.when(F.col("corner") == k, F.col("label"))), F.lit(0)).alias(f"l{k}") for k in range(3)))
    return at.select(M, "face_id", rule(F.col("l0"), F.col("l1"), F.col("l2")).alias("label"))


def boundary_statistics(faces: DataFrame, normals: DataFrame, labels: DataFrame, boundary: DataFrame) -> DataFrame:
    """mesh_id, scar_a, scar_b, sharpness, roughness, boundary_size of each pair of adjacency().

    Candidates of a pair are the faces at its boundary vertices; among them, mesh edges
    of exactly two candidates with different non-zero labels give the mean and the
    population deviation of the angle.  The faces' labels need not be the pair's own.
    """
    both = F.shiftleft(F.col("scar_a").cast("long"), 32).bitwiseOR(F.col("scar_b").cast("long"))
    at = boundary.groupBy(M, "vertex_id").agg(F.collect_set(both).alias("pairs"))
    candidates = corners(faces).join(spread(at), [M, "vertex_id"]).groupBy(M, "face_id").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    known = normals.join(spread(face_labels(faces, labels, majority_non_zero)), [M, "face_id"]).join(spread(candidates), [M, "face_id"])
    one = F.struct("face_id", "slot", "label", "nx", "ny", "nz", "pairs")
    # an edge whose faces all have one label can't cross, whatever the candidates
    edges = face_sides(known, "label", "nx", "ny", "nz", "pairs").groupBy(M, "lo", "hi").agg(F.collect_list(one).alias("sides"), F.min("label").alias("least"), F.max("label").alias("most"))
    met = edges.where("least <> most").withColumn("pair", F.explode(F.array_distinct(F.flatten("sides.pairs"))))
    met = met.withColumn("own", F.filter("sides", lambda x: F.array_contains(x["pairs"], F.col("pair")))).where("size(own) = 2")
    kinds = dict(boundary.dtypes)
    scar = lambda c, name: c.cast(kinds[name]).alias(name)
    met = met.select(M, scar(F.shiftright("pair", 32), "scar_a"), scar(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)), "scar_b"), F.array_min("own").alias("a"), F.array_max("own").alias("b"))
    dot = F.col("a.nx") * F.col("b.nx") + F.col("a.ny") * F.col("b.ny") + F.col("a.nz") * F.col("b.nz")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    crossing = met.where("a.label <> b.label and a.label <> 0 and b.label <> 0").withColumn("angle", angle)
    stats = crossing.groupBy(M, "scar_a", "scar_b").agg(F.avg("angle").alias("sharpness"), F.stddev_pop("angle").alias("roughness"), F.count("*").alias("boundary_size"))
    pairs = boundary.select(M, "scar_a", "scar_b").distinct()
    return pairs.join(per_mesh(stats), [M, "scar_a", "scar_b"], "left").fillna(0, ["sharpness", "roughness", "boundary_size"])


def scar_graph(vertices: DataFrame, faces: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(working labels, scars, boundary vertices, scar edges) of vertex segments (0: edge)."""
    edges = vertex_edges(faces)
    working = erode_by_majority(segments, edges)
    scars = tabled(identify(working))
    boundary = tabled(adjacency(edges, scar_vertices(working, scars)))
    stats = tabled(boundary_statistics(faces, face_normals(face_points(faces, vertices)), working, boundary))
    return working, scars, boundary, stats


def border_vertices(edges: DataFrame, working: DataFrame) -> DataFrame:
    """mesh_id, label, vertex_id: scar vertices with a neighbour of another working label (0 counts)."""
    a = working.where("label > 0").select(M, F.col("vertex_id").alias("src"), "label")
    b = working.select(M, F.col("vertex_id").alias("dst"), F.col("label").alias("other"))
    return edges.join(a, [M, "src"]).join(b, [M, "dst"]).where("label <> other").select(M, "label", F.col("src").alias("vertex_id")).distinct()


def surface_points(vertices: DataFrame, normals: DataFrame, members: DataFrame, lift: float = 0.15) -> DataFrame:
    """mesh_id, scar_id, vertex_id, x, y, z: the scar's vertex nearest to its centroid, lifted along its normal."""
    own = members.join(vertices.select(M, "vertex_id", "x", "y", "z"), [M, "vertex_id"])
    middle = own.groupBy(M, "scar_id").agg(*(F.avg(a).alias(f"m{a}") for a in "xyz"))
    d2 = sum((F.col(a) - F.col(f"m{a}")) ** 2 for a in "xyz")
    best = own.join(middle, [M, "scar_id"]).groupBy(M, "scar_id").agg(F.min(F.struct(F.round(d2, 9).alias("d2"), "vertex_id", "x", "y", "z")).alias("b"))
    at = best.select(M, "scar_id", "b.vertex_id", "b.x", "b.y", "b.z").join(normals, [M, "vertex_id"])
    return at.select(M, "scar_id", "vertex_id", *((F.col(a) + lift * F.col(f"n{a}")).alias(a) for a in "xyz"))


def segment_metrics(vertices: DataFrame, faces: DataFrame, labels: DataFrame) -> DataFrame:
    """mesh_id, label, vertex_count, surface_area, max_dimension, centroid of each segment (label > 0)."""
    own = labels.where("label > 0").join(vertices.select(M, "vertex_id", "x", "y", "z"), [M, "vertex_id"])
    size = F.sqrt(sum((F.max(a) - F.min(a)) ** 2 for a in "xyz"))
    stats = own.groupBy(M, "label").agg(F.count("*").alias("vertex_count"), size.alias("max_dimension"), *(F.avg(a).alias(f"centroid_{a}") for a in "xyz"))
    return stats.join(label_areas(vertices, faces, labels), [M, "label"], "left").fillna(0.0, ["surface_area"])


def label_areas(vertices: DataFrame, faces: DataFrame, labels: DataFrame) -> DataFrame:
    """mesh_id, label, surface_area: triangle areas by the faces' majority label (0 takes part and is left out)."""
    areas = crosses(face_points(faces, vertices)).join(face_labels(faces, labels), [M, "face_id"])
    return areas.where("label > 0").groupBy(M, "label").agg(F.sum("area").alias("surface_area"))


def scar_metrics(vertices: DataFrame, faces: DataFrame, working: DataFrame, max_angles: DataFrame, order: DataFrame) -> DataFrame:
    """segment_metrics of scars with mean_curvature (mean of the vertices' largest angles) and temporal_order (1: oldest)."""
    scars = identify(working)
    curve = working.where("label > 0").join(max_angles, [M, "vertex_id"]).groupBy(M, "label").agg(F.avg("angle").alias("mean_curvature"))
    base = segment_metrics(vertices, faces, working).join(curve, [M, "label"], "left")
    return base.join(scars.select(M, "label", "scar_id"), [M, "label"]).join(order.select(M, "scar_id", "temporal_order"), [M, "scar_id"], "left").drop("label")


def vertex_labels_to_faces(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """mesh_id, face_id, label: boundaries eroded away by majority, then the majority of each face."""
    return face_labels(faces, erode_by_majority(labels, vertex_edges(faces)))


def watertight_shell(vertices: DataFrame, faces: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a closed shell of each scar: a top, a bottom lowered along the normals, and side walls.

    New ids are by first appearance in the scar's faces; the depth is the mean of the
    faces' mean side lengths; zero normals take the mean normal of the scar.  Walls run
    along the top's rim in its own direction.
    """
    K = [M, "scar_id"]
    own = corners(faces).join(members, [M, "vertex_id"]).groupBy(*K, "face_id").agg(F.count("*").alias("n")).where("n = 3").drop("n")
    top = own.join(faces, [M, "face_id"])
    first = top.select(*K, "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vertex_id")).groupBy(*K, "vertex_id").agg(F.min(F.struct("face_id", "k")).alias("f"))
    ids = first.select(*K, "vertex_id", (F.row_number().over(Window.partitionBy(*K).orderBy("f")) - 1).cast("long").alias("id"))
    n = ids.groupBy(*K).agg(F.count("*").alias("n"))
    points = face_points(faces, vertices)
    side = lambda i, j: F.sqrt(sum((F.col(f"{a}{i}") - F.col(f"{a}{j}")) ** 2 for a in "xyz"))
    depth = own.join(points, [M, "face_id"]).groupBy(*K).agg(F.avg((side(0, 1) + side(1, 2) + side(2, 0)) / 3).alias("delta"))
    rows = crosses(points).join(own, [M, "face_id"])
    sums = rows.select(*K, "cx", "cy", "cz", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).groupBy(*K, "vertex_id").agg(*(F.sum(f"c{a}").alias(f"s{a}") for a in "xyz"))
    length = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2)
    unit = sums.select(*K, "vertex_id", *(F.when(length > 0, F.col(f"s{a}") / length).alias(f"n{a}") for a in "xyz"))
    mean = unit.groupBy(*K).agg(*(F.sum(f"n{a}").alias(f"t{a}") for a in "xyz"))
    total = F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2 + F.col("tz") ** 2)
    mean = mean.select(*K, *(F.when(total > 0, F.col(f"t{a}") / total).otherwise(F.lit(1.0 if a == "z" else 0.0)).alias(f"t{a}") for a in "xyz"))
    placed = ids.join(vertices.select(M, "vertex_id", "x", "y", "z"), [M, "vertex_id"]).join(unit, [*K, "vertex_id"]).join(mean, K).join(depth, K).join(n, K)
    normal = {a: F.coalesce(F.col(f"n{a}"), F.col(f"t{a}")) for a in "xyz"}
    layers = F.explode(F.array(F.struct(F.lit(0).alias("low")), F.struct(F.lit(1).alias("low")))).alias("l")
    shell = placed.select(*K, "id", "n", "delta", *(F.col(a) for a in "xyz"), *(c.alias(f"u{a}") for a, c in normal.items()), layers)
    out_v = shell.select(*K, (F.col("id") + F.col("l.low") * F.col("n")).alias("vertex_id"), *((F.col(a) - F.col("l.low") * F.col("delta") * F.col(f"u{a}")).alias(a) for a in "xyz"))
    new = top
    for k in range(3):
        new = new.join(ids.select(*K, F.col("vertex_id").alias(f"v{k}"), F.col("id").alias(f"i{k}")), [*K, f"v{k}"])
    new = new.join(n, K).select(*K, "face_id", "i0", "i1", "i2", "n")
    upper = new.select(*K, F.lit(0).alias("part"), "i0", "i1", "i2")
    lower = new.select(*K, F.lit(1).alias("part"), (F.col("i0") + F.col("n")).alias("i0"), (F.col("i2") + F.col("n")).alias("i1"), (F.col("i1") + F.col("n")).alias("i2"))
    half = new.select(*K, "n", F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))))).alias("h")).select(*K, "n", "h.a", "h.b")
    rim = half.join(half.select(*K, F.col("b").alias("a"), F.col("a").alias("b")), [*K, "a", "b"], "left_anti")
    wall = rim.select(*K, F.explode(F.array(F.struct(F.col("a").alias("i0"), F.col("b").alias("i1"), (F.col("b") + F.col("n")).alias("i2")), F.struct(F.col("a").alias("i0"), (F.col("b") + F.col("n")).alias("i1"), (F.col("a") + F.col("n")).alias("i2")))).alias("w"))
    sides = wall.select(*K, F.lit(2).alias("part"), "w.i0", "w.i1", "w.i2")
    return out_v, upper.unionByName(lower).unionByName(sides)


