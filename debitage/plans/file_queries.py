"""Sinks and scans of mesh files, as round trips of the demo meshes through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from debitage.iterate import shared_folder
from debitage.operators import annotations as A
from debitage.operators import scars as S
from debitage.operators import topology as T
from debitage.plans import demo
from debitage.plans.demo import sql
from debitage.plans.registry import query, rounded
from debitage.sources import binary_ply as B
from debitage.sources import mesh_files as P


def shared(spark, name):
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _vf(spark, sf):
    v = demo.vertices(spark, sf)
    return v, demo.faces(v)


def _labelled(spark, sf):
    """The demo meshes as labelled PLY files, read again."""
    v, f = _vf(spark, sf)
    rows = v.select("mesh_id", "vertex_id", "x", "y", "z", F.expr(demo.GT).alias("label"))
    arrows = v.where("bal > 9000").select("mesh_id", F.row_number().over(_byid()).alias("pos"), F.col("vertex_id").alias("start_index"), F.lit(0).cast("long").alias("end_index"))
    notes = demo.meshes(v).select("mesh_id", F.lit("comment metadata author someone").alias("line"))
    at = shared(spark, "ply")
    P.write_text_files(P.ply_lines(rows, f, arrows, notes), at)
    return P.scan_ply(spark, at)


def _byid():
    from pyspark.sql import Window

    return Window.partitionBy("mesh_id").orderBy("vertex_id")


@query("s1_s7_labelled_ply_round_trip", sql("select v.mesh_id, v.vertex_id, round(x, 6) as x, round(y, 6) as y, round(z, 6) + 0 as z, label from v join gt using (mesh_id, vertex_id)"))
def s1(spark, sf):
    return rounded(_labelled(spark, sf)["vertices"].drop("label_id").withColumn("mesh_id", F.col("mesh_id").cast("long")))


@query("s1_s8_ply_faces_round_trip", sql("select mesh_id, (row_number() over (partition by mesh_id order by face_id) - 1) as face_id, v0, v1, v2 from f"))
def s8(spark, sf):
    return _labelled(spark, sf)["faces"].withColumn("mesh_id", F.col("mesh_id").cast("long"))


@query("s1_ply_metadata", sql("select mesh_id, 'author' as key, 'someone' as value, false as is_json from m"))
def s1_meta(spark, sf):
    return _labelled(spark, sf)["metadata"].withColumn("mesh_id", F.col("mesh_id").cast("long"))


@query("s3_obj_round_trip", sql("select mesh_id, (row_number() over (partition by mesh_id order by face_id) - 1) as face_id, v0, v1, v2 from f"))
def s3(spark, sf):
    v, f = _vf(spark, sf)
    at = shared(spark, "obj")
    P.write_text_files(P.obj_lines(v, f), at)
    return P.scan_obj(spark, at)["faces"].withColumn("mesh_id", F.col("mesh_id").cast("long"))


@query(
    "s3_large_obj_scan",
    "select mesh_id, (w * w)::bigint as n_vertices, (2 * (w - 1) * (w - 1))::bigint as n_faces, 0::bigint as n_errors from (select o_orderkey % 16 as mesh_id, floor(sqrt(count(*))) as w from orders group by 1)",
)
def s3_large(spark, sf):
    """The large meshes written as OBJ files and scanned again."""
    v = demo.large_vertices(spark, sf)
    at = shared(spark, "obj")
    P.write_text_files(P.obj_lines(v, demo.faces(v)), at)
    got = P.scan_obj(spark, at)
    n = lambda part, name: got[part].groupBy("mesh_id").agg(F.count("*").alias(name))
    rows = n("vertices", "n_vertices").join(n("faces", "n_faces"), "mesh_id").join(n("errors", "n_errors"), "mesh_id", "left").fillna(0)
    return rows.withColumn("mesh_id", F.col("mesh_id").cast("long"))


def _binary(spark, vertices, faces, big=False, **more):
    """Meshes written as binary PLY files and read again, the smallest file in about a dozen ranges."""
    at = shared(spark, "binary")
    least = B.write_binary_ply(vertices, faces, at, big=big, **more).agg(F.min("bytes")).first()[0] or 0
    return B.binary_tables(spark, at, min(B.RANGE, max(64, least // 12)))


@query("s2_binary_ply_vertices", sql("select v.mesh_id, v.vertex_id, x, y, z, label from v join gt using (mesh_id, vertex_id)"))
def s2_vertices(spark, sf):
    """Labelled vertices of big-endian files."""
    v, f = _vf(spark, sf)
    got = _binary(spark, v.select("mesh_id", "vertex_id", *"xyz", F.expr(demo.GT).alias("label")), f, big=True)
    return got["vertices"].drop("label_id").withColumn("mesh_id", F.col("mesh_id").cast("long"))


@query("s2_binary_ply_arrows", sql("select mesh_id, (row_number() over (partition by mesh_id order by vertex_id) - 1)::int as pos, vertex_id as start_index, 0::bigint as end_index from v where bal > 9000"))
def s2_arrows(spark, sf):
    """Arrows, which stand behind the lists of the faces."""
    v, f = _vf(spark, sf)
    arrows = v.where("bal > 9000").select("mesh_id", F.row_number().over(_byid()).alias("pos"), F.col("vertex_id").alias("start_index"), F.lit(0).cast("long").alias("end_index"))
    return _binary(spark, v.select("mesh_id", "vertex_id", *"xyz"), f, arrows=arrows)["arrows"].withColumn("mesh_id", F.col("mesh_id").cast("long"))


@query(
    "s2_binary_ply_mixed_faces",
    """with n as (select o_orderkey % 16 as mesh_id, row_number() over (partition by o_orderkey % 16 order by o_orderkey) - 1 as a, floor(sqrt(count(*) over (partition by o_orderkey % 16)))::bigint as w from orders),
    c as (select * from n where a < w * w and a % w < w - 1 and a // w < w - 1),
    t as (select mesh_id, 2 * a as k, a as v0, a + 1 as v1, a + w as v2 from c union all select mesh_id, 2 * a + 1, a + 1, a + w + 1, a + w from c)
    select mesh_id, row_number() over (partition by mesh_id order by k) - 1 as face_id, v0, v1, v2 from t""",
)
def s2_mixed(spark, sf):
    """The large meshes with a third of their cells as quads: no range knows where its first face begins."""
    v = demo.large_vertices(spark, sf)
    quad = (F.col("x") + F.col("y")) % 3 == 0
    a, w = F.col("vertex_id"), F.col("w")
    cells = v.where((F.col("x") < w - 1) & (F.col("y") < w - 1) & quad).select("mesh_id", (2 * a).alias("face_id"), F.array(a, a + 1, a + w + 1, a + w).alias("corners"))
    faces = demo.faces(v.where(~quad)).select("mesh_id", "face_id", F.array("v0", "v1", "v2").alias("corners")).unionByName(cells)
    got = _binary(spark, v.select("mesh_id", "vertex_id", *"xyz"), faces)
    return got["faces"].withColumn("mesh_id", F.col("mesh_id").cast("long"))


@query("s6_bulk_corpus_split", sql("select m.mesh_id, (select count(*) from v where v.mesh_id = m.mesh_id) as n_vertices, (select count(*) from f where f.mesh_id = m.mesh_id) as n_faces, (select count(*) from gt where gt.mesh_id = m.mesh_id and label <> 0) as n_annotated from m"))
def s6(spark, sf):
    geometry, _, annotation = P.split_corpus(_labelled(spark, sf))
    n = annotation.groupBy("mesh_id").agg(F.count("*").alias("n_annotated"))
    return geometry.join(n, "mesh_id", "left").fillna(0).withColumn("mesh_id", F.col("mesh_id").cast("long"))


@query("s11_watertight_ply_lines", None)
def s11(spark, sf):
    v, f = _vf(spark, sf)
    w = S.erode_by_majority(demo.pred_labels(v), T.vertex_edges(f))
    sv, sfaces = S.watertight_shell(v, f, S.scar_vertices(w, S.identify(w)))
    name = F.concat_ws("-", F.col("mesh_id"), F.col("scar_id"))
    order = F.xxhash64("part", "i0", "i1", "i2")
    return P.ply_lines(sv.select(name.alias("mesh_id"), "vertex_id", *(F.round(a, 6).alias(a) for a in "xyz")), sfaces.select(name.alias("mesh_id"), order.alias("face_id"), F.col("i0").alias("v0"), F.col("i1").alias("v1"), F.col("i2").alias("v2")))


@query("s12_parquet_tables", sql("select mesh_id, vertex_id, x, y, z from v"))
def s12(spark, sf):
    v = demo.vertices(spark, sf)
    at = shared(spark, "tables")
    v.select("mesh_id", "vertex_id", "x", "y", "z").write.partitionBy("mesh_id").parquet(at)
    return spark.read.parquet(at).withColumn("mesh_id", F.col("mesh_id").cast("long"))


@query("s9_s10_csv_sinks", sql("select mesh_id, count(*) as n, round(sum(z), 4) as total from v group by mesh_id"))
def s9_csv(spark, sf):
    v = demo.vertices(spark, sf)
    at = shared(spark, "csv")
    v.groupBy("mesh_id").agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("total")).write.option("header", True).option("escape", '"').csv(at)
    return spark.read.option("header", True).schema("mesh_id long, n long, total double").csv(at)


# each event is a mesh: its properties are the mesh's metadata, its type and value the annotation's

@query(
    "s10_metadata_csv",
    "select event_id as mesh_id, 'k,annotation.tool.name,annotation.tool.note,annotation.value,exportedAt,sourceFile' as header, json_extract_string(props, '$.k') || ',' || event_type || ',\"a, \"\"b\"\"\",' || (event_id % 100) || ',2024-01-01T00:00:00.000Z,m' || event_id || '.ply' as \"row\" from events where props is not null",
)
def s10_csv(spark, sf):
    e = demo.table(spark, sf, "events").where("props is not null").withColumnRenamed("event_id", "mesh_id")
    notes = F.to_json(F.struct(F.struct(F.col("event_type").alias("name"), F.lit('a, "b"').alias("note")).alias("tool"), (F.col("mesh_id") % 100).alias("value")))
    files = e.select("mesh_id", F.concat(F.lit("m"), "mesh_id", F.lit(".ply")).alias("source_file"))
    rows = A.metadata_csv(e.select("mesh_id", F.col("props").alias("json")), e.select("mesh_id", notes.alias("json")), files, F.lit("2024-01-01T00:00:00.000Z"))
    at = shared(spark, "metadata")
    rows.write.mode("overwrite").json(at)
    return spark.read.schema("mesh_id long, header string, row string").json(at)


BROKEN = ["ply", "format ascii 1.0", "element vertex 3", "property float x", "property float y", "property float z", "property int labelid", "element face 3", "property list uchar int vertex_indices", "end_header"]


@query(
    "s1_s6_broken_files",
    "select c_nationkey::bigint as mesh_id, 3::bigint as n_vertices, 3::bigint as n_labelled, 2::bigint as n_faces, (1 + count(*) filter (where c_acctbal < 0))::bigint as n_errors from customer group by 1",
)
def s6_broken(spark, sf):
    """A quad, a pentagon and a short face for each nation, and as many short vertex lines as it has debtors."""
    c = demo.table(spark, sf, "customer")
    n = c.groupBy(F.col("c_nationkey").cast("string").alias("mesh_id")).agg(F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("n"))
    good = [*BROKEN, "0 0 0 7", "1 0 0 7", "0 1 0 8", "4 0 1 2 0", "5 0 1 2 0 1", "3 0 1"]
    head = n.select("mesh_id", F.posexplode(F.array(*map(F.lit, good))).alias("id", "line"), F.lit(0).alias("section"))
    # short lines of a second kind of file, one more for each debtor
    short = n.where("n > 0").select("mesh_id", F.explode(F.sequence(F.lit(1), "n")).alias("id"), F.lit("v 1").alias("line"), F.lit(0).alias("section"))
    at, obj = shared(spark, "broken"), shared(spark, "short")
    P.write_text_files(head, at)
    P.write_text_files(short, obj)
    got, more = P.scan_ply(spark, at), P.scan_obj(spark, obj)
    v = got["vertices"].groupBy("mesh_id").agg(F.count("x").alias("n_vertices"), F.count("label_id").alias("n_labelled"))
    f = got["faces"].groupBy("mesh_id").agg(F.count("*").alias("n_faces"))
    errors = got["errors"].unionByName(more["errors"]).groupBy("mesh_id").agg(F.count("*").alias("n_errors"))
    return v.join(f, "mesh_id").join(errors, "mesh_id").withColumn("mesh_id", F.col("mesh_id").cast("long"))
