"""Adjacency, selection and nearest-vertex joins; every table is keyed by mesh_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debitage.operators.morton import nearest

M = "mesh_id"


def spread(table: DataFrame) -> DataFrame:
    """A table with rows for each vertex or face, for a join: dealt and sorted, never copied to the driver, however small its files look."""
    return table.hint("merge")


def per_mesh(table: DataFrame) -> DataFrame:
    """A table of a row a mesh or segment, for a join with a longer one: tasks look their meshes up, and neither side is copied to the driver."""
    return table.hint("shuffle_hash")


def corners(faces: DataFrame) -> DataFrame:
    """mesh_id, face_id, corner (0..2), vertex_id."""
    return faces.select(M, "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vertex_id"))


def vertex_edges(faces: DataFrame) -> DataFrame:
    """Both directions of every distinct vertex pair of a triangle, with the rank at which a scan of faces first meets it."""
    pairs = [("v0", "v1"), ("v0", "v2"), ("v1", "v0"), ("v1", "v2"), ("v2", "v0"), ("v2", "v1")]
    met = F.posexplode(F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in pairs))).alias("k", "e")
    rows = faces.select(M, "face_id", met).where("e.src <> e.dst")
    return rows.groupBy(M, F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.min(F.col("face_id") * 6 + F.col("k")).alias("first_rank"))


def face_sides(faces: DataFrame, *kept: str) -> DataFrame:
    """mesh_id, face_id, slot, lo, hi and the columns kept: slot i is the side opposite to corner i."""
    sides = [("v1", "v2"), ("v2", "v0"), ("v0", "v1")]
    side = F.array(*(F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")) for a, b in sides))
    return faces.select(M, "face_id", F.posexplode(side).alias("slot", "e"), *kept).select(M, "face_id", "slot", "e.lo", "e.hi", *kept)


def face_adjacency(faces: DataFrame) -> DataFrame:
    """mesh_id, face_id, slot, nbr: sides that exactly two face corners share, from both."""
    shared = face_sides(faces).groupBy(M, "lo", "hi").agg(
        F.count("*").alias("n"), F.min(F.struct("face_id", "slot")).alias("a"), F.max(F.struct("face_id", "slot")).alias("b")
    )
    both = F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("other")), F.struct(F.col("b").alias("me"), F.col("a").alias("other"))))
    return shared.where("n = 2").select(M, both.alias("p")).select(M, "p.me.face_id", "p.me.slot", F.col("p.other.face_id").alias("nbr"))


def edge_list(face_adj: DataFrame) -> DataFrame:
    """Each adjacency once, from the lower face; two shared sides stay two rows."""
    return face_adj.where("face_id < nbr").select(M, "face_id", "nbr", (F.col("face_id") * 3 + F.col("slot")).alias("edge_idx"))


def are_connected(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (src, dst) that are adjacent."""
    return pairs.join(edges, [M, "src", "dst"], "left_semi")


def isolated_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices that no face uses."""
    return vertices.join(corners(faces).select(M, "vertex_id").distinct(), [M, "vertex_id"], "left_anti")


def invert_winding(faces: DataFrame) -> DataFrame:
    """v0 and v1 swapped."""
    return faces.withColumns({"v0": F.col("v1"), "v1": F.col("v0")})


def _cell(axis: str, size: Column | float) -> Column:
    return F.floor(F.col(axis) / size)


def _near(probes: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """Probe-point pairs of one mesh in the same or a neighbouring grid cell of size reach.

    probes: mesh_id, probe, px, py, pz; points: mesh_id, vertex_id, x, y, z.  A cell's
    edge is the reach, so every pair within it meets once, whatever the mesh's size.
    """
    step = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    around = probes.select("*", *(F.floor(F.col(p) / reach).alias(c) for p, c in (("px", "cx"), ("py", "cy"), ("pz", "cz"))))
    for c in ("cx", "cy", "cz"):
        around = around.withColumn("_d", F.explode(step)).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    cells = points.select(M, "vertex_id", "x", "y", "z", _cell("x", reach).alias("cx"), _cell("y", reach).alias("cy"), _cell("z", reach).alias("cz"))
    return around.join(cells, [M, "cx", "cy", "cz"]).drop("cx", "cy", "cz")


def squared_distance() -> Column:
    return (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 + (F.col("z") - F.col("pz")) ** 2


def within_radius(probes: DataFrame, vertices: DataFrame, normals: DataFrame, radius: float) -> DataFrame:
    """probe, vertex_id: vertices within radius whose normal faces the probe's direction (normal . direction < 0)."""
    near = _near(probes, vertices, radius).where(F.sqrt(squared_distance()) <= radius).join(normals, [M, "vertex_id"])
    return near.where("nx * dx + ny * dy + nz * dz < 0").select(M, "probe", "vertex_id")


def nearest_annotated(probes: DataFrame, annotated: DataFrame, max_distance: float) -> DataFrame:
    """probe, vertex_id, d2: the closest annotated vertex nearer than max_distance, not the probe itself; ties to the lowest id."""
    return nearest(probes, annotated, max_distance)


def snapped(probes: DataFrame, annotated: DataFrame, snap: float) -> DataFrame:
    """probe, target: the probe if annotated or snap <= 0, else its nearest annotated vertex, else itself."""
    if snap <= 0:
        return probes.select(M, "probe", F.col("probe").alias("target"))
    own = annotated.select(M, F.col("vertex_id").alias("probe"), F.col("vertex_id").alias("own"))
    found = nearest_annotated(probes, annotated, snap).select(M, "probe", F.col("vertex_id").alias("near"))
    return probes.join(own, [M, "probe"], "left").join(found, [M, "probe"], "left").select(M, "probe", F.coalesce("own", "near", "probe").alias("target"))
