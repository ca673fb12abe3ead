"""Score aggregation: views to faces, graph smoothing, view rotations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debitage.iterate import tabled
from debitage.operators.topology import M, spread

GAMMA = 0.95
MAX_STEPS = 500


def view_scores(pixels: DataFrame, facing: DataFrame) -> DataFrame:
    """mesh_id, face_id, view_id, value, weight from pixels (view_id, face_id or null for background, logit).

    Logits are scaled to 0 .. 1 over the whole view, background included; a face's value
    is its pixels' mean; facing (mesh_id, view_id, face_id, nz) weighs views by 1, 2 or 3.
    """
    ends = pixels.groupBy(M, "view_id").agg(F.min("logit").alias("lo"), F.max("logit").alias("hi"))
    means = pixels.where("face_id is not null").groupBy(M, "view_id", "face_id").agg(F.avg("logit").alias("m"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    rows = means.join(ends, [M, "view_id"]).join(spread(facing), [M, "view_id", "face_id"], "left")
    weight = F.when(F.col("nz") >= 0.8, 3).when(F.col("nz") >= 0.5, 2).otherwise(1)
    return rows.select(M, "face_id", "view_id", ((F.col("m") - F.col("lo")) / span).alias("value"), weight.alias("weight"))


def weighted_mean(faces: DataFrame, views: DataFrame) -> DataFrame:
    """mesh_id, face_id, p: weighted mean over the views, 0 for unseen faces."""
    sums = views.groupBy(M, "face_id").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("p"))
    return faces.select(M, "face_id").join(spread(sums), [M, "face_id"], "left").fillna(0.0, ["p"])


#: Faces of a region of propagation: runs of face ids, a task each.
REGION = 100_000


def _grown(faces: np.ndarray, p: np.ndarray, links: np.ndarray, offers: np.ndarray, offered: np.ndarray, gamma: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(faces in order, the layer of each or -1, its score) of a region: layer by layer from its positive faces and the offers.

    links: rows (from, to); offers: rows (face, layer), their scores in ``offered``.  Scores
    are compared by their bits, in which doubles that aren't negative stand in order, NaN last.
    """
    ids = np.unique(faces)
    layer, bits = np.full(len(ids), -1), np.full(len(ids), -1)
    place = lambda x: np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    known = (p > 0) | np.isnan(p)
    np.maximum.at(bits, place(faces[known]), p[known].view(np.int64))
    layer[place(faces[known])] = 0
    links = links[np.isin(links, ids).all(axis=1)]
    links = place(links[np.argsort(links[:, 0], kind="stable")])
    ends = np.searchsorted(links[:, 0], np.arange(len(ids) + 1))
    mine = np.isin(offers[:, 0], ids)
    at, depth, worth = place(offers[mine, 0]), offers[mine, 1], offered[mine].view(np.int64)
    front, now = np.flatnonzero(layer == 0), 0
    while now < top:
        n = ends[front + 1] - ends[front]
        to = links[np.repeat(ends[front + 1] - np.cumsum(n), n) + np.arange(n.sum()), 1]
        by = np.repeat((bits[front].view(np.float64) * gamma).view(np.int64), n)
        now += 1
        if not len(front):  # nothing until the next offer
            waiting = depth[(depth >= now) & (layer[at] < 0)]
            if not len(waiting):
                break
            now = int(waiting.min())
        to, by = np.concatenate([to, at[depth == now]]), np.concatenate([by, worth[depth == now]])
        new = layer[to] < 0
        np.maximum.at(bits, to[new], by[new])
        front = np.unique(to[new])
        layer[front] = now
    return ids, layer, bits.view(np.float64)


def propagate_gamma(scores: DataFrame, face_adj: DataFrame, gamma: float = GAMMA, max_steps: int = MAX_STEPS, size: int = REGION) -> DataFrame:
    """mesh_id, face_id, p: positive faces keep their score, each further layer takes gamma times its best labelled neighbour.

    A mesh is cut into regions of ``size`` face ids, and a task takes a region through all
    layers.  Where links cross regions, the layers and scores that a region offers to its
    neighbours' faces go by rounds, until none is better: a face takes the lowest layer,
    then the highest score.
    """
    kinds = dict(scores.dtypes)
    of = lambda c: F.coalesce(F.floor(F.col(c) / size).cast("long"), F.lit(0))
    none = lambda kind: F.lit(None).cast(kind)
    own = scores.select(M, of("face_id").alias("region"), F.col("face_id").cast("long").alias("a"), none("long").alias("b"), F.col("p").cast("double").alias("p"))
    links = face_adj.dropna(subset=[M, "face_id", "nbr"]).select(M, of("nbr").alias("region"), F.col("nbr").cast("long").alias("a"), F.col("face_id").cast("long").alias("b"), F.lit(0.0).alias("p"))
    base = tabled(own.withColumn("kind", F.lit(0)).unionByName(links.withColumn("kind", F.lit(1))))
    top = max_steps - 1

    def run(rows: pa.Table, leaving: bool) -> pa.Table:
        kind, a = rows["kind"].to_numpy(), rows["a"].fill_null(-1).to_numpy()
        b, p = rows["b"].fill_null(-1).to_numpy(), rows["p"].fill_null(0.0).to_numpy()
        set_ = rows["a"].is_valid().to_numpy() & rows["p"].is_valid().to_numpy()
        face, link, offer = (kind == 0) & set_, kind == 1, kind == 2
        whole = lambda mask: np.column_stack([a[mask], b[mask]]).astype(np.int64)
        ids, layer, found = _grown(a[face].astype(np.int64), p[face], whole(link), whole(offer), p[offer], gamma, top)
        if leaving:
            src, dst = whole(link).T
            out = (dst // size != src // size) & np.isin(src, ids)
            at, dst = np.searchsorted(ids, src[out]), dst[out]
            out = (layer[at] >= 0) & (layer[at] < top)
            at, dst = at[out], dst[out]
            first = np.lexsort([-(found[at] * gamma).view(np.int64), layer[at], dst])
            first = first[np.unique(dst[first], return_index=True)[1]]
            at, dst = at[first], dst[first]
            mesh = pa.repeat(rows[M][0], len(dst)) if len(dst) else pa.array([], rows[M].type)
            return pa.table({M: mesh, "region": dst // size, "a": dst, "b": layer[at] + 1, "p": found[at] * gamma})
        mine = rows.filter(pa.array(kind == 0))
        at = np.minimum(np.searchsorted(ids, a[kind == 0]), max(0, len(ids) - 1))
        if len(ids):
            fresh = set_[kind == 0] & (layer[at] > 0)
            mine = mine.set_column(mine.schema.get_field_index("p"), "p", pc.if_else(pa.array(fresh), pa.array(found[at]), mine["p"]))
        return mine.select([M, "a", "p"]).rename_columns([M, "face_id", "p"])

    by_region = lambda df, leaving, schema: df.groupBy(M, "region").applyInArrow(lambda t: run(t, leaving), schema)
    known = None
    if not base.where("kind = 1").where(of("a") != of("b")).isEmpty():
        offer = f"{M} {kinds[M]}, region long, a long, b long, p double"
        best = lambda df: df.groupBy(M, "region", "a").agg(F.max(F.struct((-F.col("b")).alias("b"), "p")).alias("o")).select(M, "region", "a", (-F.col("o.b")).alias("b"), "o.p")
        known = tabled(base.select(M, "region", "a", "b", "p").limit(0))
        active = base.select(M, "region").distinct()
        while True:
            now = base.join(active, [M, "region"], "left_semi").unionByName(known.join(active, [M, "region"], "left_semi").withColumn("kind", F.lit(2)))
            offers = best(by_region(now, True, offer)).withColumnRenamed("b", "nb").withColumnRenamed("p", "np")
            better = F.col("b").isNull() | (F.col("nb") < F.col("b")) | ((F.col("nb") == F.col("b")) & (F.col("np") > F.col("p")))
            fresh = tabled(offers.join(known, [M, "region", "a"], "left").where(better).select(M, "region", "a", F.col("nb").alias("b"), F.col("np").alias("p")))
            if fresh.isEmpty():
                break
            known = tabled(best(known.unionByName(fresh)))
            active = tabled(fresh.select(M, "region").distinct())
        base = base.unionByName(known.withColumn("kind", F.lit(2)))
    return by_region(base, False, f"{M} {kinds[M]}, face_id long, p double").withColumn("face_id", F.col("face_id").cast(kinds["face_id"]))


def _matrix(ax: float, ay: float, az: float) -> list[list[float]]:
    cx, sx, cy, sy, cz, sz = (f(a) for a in (ax, ay, az) for f in (math.cos, math.sin))
    x = [[1, 0, 0], [0, cx, -sx], [0, sx, cx]]
    y = [[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]
    z = [[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]
    mul = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return mul(z, mul(y, x))


def canonical_views(steps: tuple[int, int, int] = (6, 6, 6), close: float = 1.0, upright: float = 0.05) -> list[tuple[int, list[float]]]:
    """(view_id, matrix): full turns about each axis in so many steps, without candidates that see the mesh as a kept one does.

    Two rotations see the same side if they are within ``close`` degrees, or if the axis of
    the turn from the kept one to the other, in the kept one's frame, is the viewing axis
    within ``upright`` in each component.
    """
    kept: list[list[list[float]]] = []
    for axis, n in enumerate(steps):
        for k in range(n):
            angles = [0.0, 0.0, 0.0]
            angles[axis] = 2 * math.pi * k / n
            r = _matrix(*angles)
            if not any(_same_side(q, r, close, upright) for q in kept):
                kept.append(r)
    return [(i, [v for row in r for v in row]) for i, r in enumerate(kept)]


def _same_side(q: list[list[float]], r: list[list[float]], close: float, upright: float) -> bool:
    turn = [sum(q[m][i] * r[m][i] for m in range(3)) for i in range(3)]  # the diagonal of the turn from q to r
    cosine = max(-1.0, min(1.0, (sum(turn) - 1) / 2))
    if math.degrees(math.acos(cosine)) < close:
        return True
    x, y, z = (math.sqrt(max(0.0, (d - cosine) / (1 - cosine))) for d in turn)  # the size of the axis' components
    return x < upright and y < upright and abs(z - 1) < upright


def views_table(spark: SparkSession, steps: tuple[int, int, int] = (6, 6, 6)) -> DataFrame:
    """view_id, r0 .. r8: a literal table of a few rows."""
    return spark.createDataFrame([(i, *r) for i, r in canonical_views(steps)], "view_id int, " + ", ".join(f"r{k} double" for k in range(9)))
