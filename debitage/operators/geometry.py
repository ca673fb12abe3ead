"""Normals, angles, moments, bounds and per-vertex or per-face aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debitage.operators.topology import M, corners, face_sides, per_mesh, spread

TINY = 1e-10


def face_points(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the coordinates x0 .. z2 of their corners: one join and one grouping."""
    placed = corners(faces).join(spread(vertices.select(M, "vertex_id", "x", "y", "z")), [M, "vertex_id"])
    picks = [F.max(F.when(F.col("corner") == k, F.col(a))).alias(f"{a}{k}") for k in range(3) for a in "xyz"]
    ids = [F.max(F.when(F.col("corner") == k, F.col("vertex_id"))).alias(f"v{k}") for k in range(3)]
    return placed.groupBy(M, "face_id").agg(*ids, *picks)


def _cross() -> tuple[Column, Column, Column]:
    a = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
    b = [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def crosses(points: DataFrame) -> DataFrame:
    """mesh_id, face_id, v0..v2, cx, cy, cz, area: cross products of face_points()."""
    cx, cy, cz = _cross()
    rows = points.select(M, "face_id", "v0", "v1", "v2", cx.alias("cx"), cy.alias("cy"), cz.alias("cz"))
    return rows.withColumn("area", F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2 + F.col("cz") ** 2) / 2)


def face_normals(points: DataFrame, soft: bool = False) -> DataFrame:
    """Unit normals nx, ny, nz; tiny faces have the zero vector, or with ``soft`` the vector over its length plus 1e-12."""
    rows = crosses(points).withColumn("len", 2 * F.col("area"))
    over = F.col("len") + 1e-12 if soft else F.when(F.col("len") > TINY, F.col("len"))
    return rows.select(M, "face_id", "v0", "v1", "v2", *(F.coalesce(F.col(f"c{a}") / over, F.lit(0.0)).alias(f"n{a}") for a in "xyz"))


def _angle(dot: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def edge_angles(normals: DataFrame) -> DataFrame:
    """mesh_id, lo, hi, angle: of two faces the angle of their normals, of one pi, of more 0."""
    sides = face_sides(normals).join(spread(normals.select(M, "face_id", "nx", "ny", "nz")), [M, "face_id"])
    one = F.struct("face_id", "slot", "nx", "ny", "nz")
    both = sides.groupBy(M, "lo", "hi").agg(F.count("*").alias("n"), F.min(one).alias("a"), F.max(one).alias("b"))
    dot = F.col("a.nx") * F.col("b.nx") + F.col("a.ny") * F.col("b.ny") + F.col("a.nz") * F.col("b.nz")
    return both.select(M, "lo", "hi", F.when(F.col("n") == 1, F.lit(math.pi)).when(F.col("n") == 2, _angle(dot)).otherwise(0.0).alias("angle"))


def vertex_max_angles(vertices: DataFrame, angles: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, angle: the largest angle of a vertex's edges, 0 without any."""
    ends = angles.select(M, F.explode(F.array("lo", "hi")).alias("vertex_id"), "angle").groupBy(M, "vertex_id").agg(F.max("angle").alias("angle"))
    return vertices.select(M, "vertex_id").join(spread(ends), [M, "vertex_id"], "left").fillna(0.0, ["angle"])


def sharp_vertices(max_angles: DataFrame, threshold: float) -> DataFrame:
    return max_angles.where(F.col("angle") >= threshold)


def face_sharpness(face_adj: DataFrame, normals: DataFrame) -> DataFrame:
    """mesh_id, face_id, sharpness: exp(-largest angle to a neighbour), 1 without neighbours; soft normals."""
    own = normals.select(M, "face_id", "nx", "ny", "nz")
    other = normals.select(M, F.col("face_id").alias("nbr"), F.col("nx").alias("ox"), F.col("ny").alias("oy"), F.col("nz").alias("oz"))
    angle = _angle(F.col("nx") * F.col("ox") + F.col("ny") * F.col("oy") + F.col("nz") * F.col("oz"))
    worst = face_adj.join(spread(own), [M, "face_id"]).join(spread(other), [M, "nbr"]).groupBy(M, "face_id").agg(F.max(angle).alias("a"))
    return normals.select(M, "face_id").join(spread(worst), [M, "face_id"], "left").select(M, "face_id", F.exp(-F.coalesce("a", F.lit(0.0))).alias("sharpness"))


def vertex_normals(points: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, nx, ny, nz: normalised sums of the incident faces' cross products."""
    rows = crosses(points)
    sums = corners(rows).join(spread(rows.select(M, "face_id", "cx", "cy", "cz")), [M, "face_id"]).groupBy(M, "vertex_id").agg(*(F.sum(f"c{a}").alias(f"s{a}") for a in "xyz"))
    n = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2)
    return sums.select(M, "vertex_id", *((F.col(f"s{a}") / F.when(n > 0, n).otherwise(1.0)).alias(f"n{a}") for a in "xyz"))


def moments(meshes: DataFrame, points: DataFrame) -> DataFrame:
    """Volume, first and second moments and products of inertia from signed tetrahedra; a mesh without faces has zeros."""
    p = {f"{a}{k}": F.col(f"{a}{k}") for a in "xyz" for k in range(3)}
    det = (
        p["x0"] * (p["y1"] * p["z2"] - p["z1"] * p["y2"])
        + p["y0"] * (p["z1"] * p["x2"] - p["x1"] * p["z2"])
        + p["z0"] * (p["x1"] * p["y2"] - p["y1"] * p["x2"])
    )
    s = {a: p[f"{a}0"] + p[f"{a}1"] + p[f"{a}2"] for a in "xyz"}
    sq = {a: p[f"{a}0"] ** 2 + p[f"{a}1"] ** 2 + p[f"{a}2"] ** 2 for a in "xyz"}
    mixed = {a + b: sum(p[f"{a}{k}"] * p[f"{b}{k}"] for k in range(3)) for a, b in ("xy", "zy", "zx")}
    cols = {"volume": det / 6} | {f"m{a}": det * s[a] / 24 for a in "xyz"}
    cols |= {f"m{a}{b}": det * (s[a] * s[b] + mixed[a + b]) / 120 for a, b in ("xy", "zy", "zx")}
    cols |= {f"m{a}2": det * (sq[a] + s[a] ** 2) / 120 for a in "xyz"}
    sums = points.groupBy(M).agg(*(F.sum(c).alias(n) for n, c in cols.items()))
    return meshes.join(sums, M, "left").fillna(0.0, list(cols))


def bounds(meshes: DataFrame, vertices: DataFrame) -> DataFrame:
    """Centre, size and diagonal of each mesh; a diagonal under 1e-10 counts as 1; no vertices: zeros and 1."""
    ends = vertices.groupBy(M).agg(*(f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    rows = meshes.join(ends, M, "left").fillna(0.0)
    d = F.sqrt(sum((F.col(f"hi{a}") - F.col(f"lo{a}")) ** 2 for a in "xyz"))
    return rows.select(
        M,
        *(((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(f"centre_{a}") for a in "xyz"),
        *((F.col(f"hi{a}") - F.col(f"lo{a}")).alias(f"size_{a}") for a in "xyz"),
        F.when(d < TINY, 1.0).otherwise(d).alias("diagonal"),
    )


def centred(vertices: DataFrame) -> DataFrame:
    """vertices with each mesh's mean position taken off."""
    means = vertices.groupBy(M).agg(*(F.avg(a).alias(f"mean_{a}") for a in "xyz"))
    return vertices.join(per_mesh(means), M).withColumns({a: F.col(a) - F.col(f"mean_{a}") for a in "xyz"}).drop("mean_x", "mean_y", "mean_z")


def rotated(vertices: DataFrame, views: DataFrame) -> DataFrame:
    """Each vertex under each view's matrix r0 .. r8 (row by row); views is a table of some dozens of rows."""
    names = [sum(F.col(f"r{3 * k + j}") * F.col(c) for j, c in enumerate("xyz")).alias(a) for k, a in enumerate("xyz")]
    return vertices.join(F.broadcast(views)).select(M, "vertex_id", "view_id", *names)


def counts(meshes: DataFrame, vertices: DataFrame, faces: DataFrame, edge_vertices: DataFrame, arrows: DataFrame) -> DataFrame:
    """Numbers of vertices, faces, edge vertices and arrows of each mesh."""
    out = meshes
    for name, df in (("n_vertices", vertices), ("n_faces", faces), ("n_edge_vertices", edge_vertices), ("n_arrows", arrows)):
        out = out.join(df.groupBy(M).agg(F.count("*").alias(name)), M, "left").fillna(0, [name])
    return out


def face_to_vertex_mean(vertices: DataFrame, faces: DataFrame, scores: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, value: mean score of the incident faces, 0 without any."""
    own = corners(faces).join(scores, [M, "face_id"]).groupBy(M, "vertex_id").agg(F.avg("p").alias("value"))
    return vertices.select(M, "vertex_id").join(own, [M, "vertex_id"], "left").fillna(0.0, ["value"])


def remap_by_frequency(labels: DataFrame, key: str = "face_id", label: str = "label") -> DataFrame:
    """labels with ids 1 .. n by count, largest first; equal counts by old label."""
    sizes = labels.groupBy(M, label).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(M).orderBy(F.desc("_n"), label))
    return labels.join(sizes.withColumn("_new", rank), [M, label]).select(M, key, F.col("_new").cast("int").alias(label))


def face_brightness(normals: DataFrame) -> DataFrame:
    """mesh_id, face_id, brightness: normal . light, scaled to 0 .. 1 over the mesh."""
    n = math.sqrt(0.2**2 + 0.2**2 + 1)
    lit = normals.select(M, "face_id", ((0.2 * F.col("nx") + 0.2 * F.col("ny") + F.col("nz")) / n).alias("b"))
    ends = lit.groupBy(M).agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return lit.join(ends, M).select(M, "face_id", ((F.col("b") - F.col("lo")) / span).alias("brightness"))


def frame_radius(vertices: DataFrame) -> DataFrame:
    """mesh_id, radius: the largest distance from the mean position."""
    return centred(vertices).groupBy(M).agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("radius"))


def _axes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import numpy as np

    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            scatter = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
            values, vectors = np.linalg.eigh(scatter)
            order = np.argsort(-values, kind="stable")
            rows.append((r.mesh_id, *vectors[:, order].T.ravel()))
        yield pd.DataFrame(rows, columns=[M, *(f"e{k}" for k in range(9))])


def pca_aligned(vertices: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, x, y, z along the principal axes, largest first.

    Each axis points so that the vertex with the largest projection is positive (the
    lowest id on a tie).  Sums and flips are Spark's; one row a mesh goes to numpy.
    """
    c = centred(vertices).select(M, "vertex_id", "x", "y", "z")
    kind = dict(vertices.dtypes)[M]
    sums = c.groupBy(M).agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))
    axes = sums.mapInPandas(_axes, f"{M} {kind}, " + ", ".join(f"e{k} double" for k in range(9)))
    flat = c.join(per_mesh(axes), M).select(M, "vertex_id", *((sum(F.col(f"e{3 * k + j}") * F.col(a) for j, a in enumerate("xyz"))).alias(b) for k, b in enumerate("xyz")))
    signs = flat.groupBy(M).agg(*(F.max_by(F.signum(a), F.struct(F.abs(F.col(a)), -F.col("vertex_id"))).alias(f"s{a}") for a in "xyz"))
    return flat.join(per_mesh(signs), M).select(M, "vertex_id", *((F.col(a) * F.when(F.col(f"s{a}") < 0, -1.0).otherwise(1.0)).alias(a) for a in "xyz"))
