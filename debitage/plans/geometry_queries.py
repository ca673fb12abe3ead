"""Topology and geometry over the demo meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from debitage.operators import geometry as G
from debitage.operators import topology as T
from debitage.operators.scars import majority_non_zero, majority_with_zero
from debitage.operators.segment import face_label_import, label_id_import
from debitage.plans import demo
from debitage.plans.demo import sql
from debitage.plans.registry import query, rounded


def _vf(spark, sf):
    v = demo.vertices(spark, sf)
    return v, demo.faces(v)


@query("f1_centre_positions", sql("select mesh_id, vertex_id, round(x - avg(x) over w, 6) + 0 as x, round(y - avg(y) over w, 6) + 0 as y, round(z - avg(z) over w, 6) + 0 as z from v window w as (partition by mesh_id)"))
def f1(spark, sf):
    return rounded(G.centred(demo.vertices(spark, sf)).select("mesh_id", "vertex_id", "x", "y", "z"))


@query("f2_invert_winding", sql("select mesh_id, face_id, v1 as v0, v0 as v1, v2 from f"))
def f2(spark, sf):
    return T.invert_winding(_vf(spark, sf)[1])


@query("f3_rotate_views", None)
def f3(spark, sf):
    from debitage.operators.scores import views_table

    return rounded(G.rotated(demo.vertices(spark, sf), views_table(spark)))


@query("f4_sharp_vertices", sql("select mesh_id, vertex_id, round(angle, 6) + 0 as angle from va where angle >= 1.5"))
def f4(spark, sf):
    v, f = _vf(spark, sf)
    angles = G.vertex_max_angles(v, G.edge_angles(G.face_normals(G.face_points(f, v))))
    return rounded(G.sharp_vertices(angles, 1.5))


@query(
    "f5_within_radius",
    sql("select p.mesh_id, p.vertex_id as probe, v.vertex_id from v p join v on v.mesh_id = p.mesh_id join vn on vn.mesh_id = v.mesh_id and vn.vertex_id = v.vertex_id where p.bal < 0 and sqrt((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y)+(v.z-p.z)*(v.z-p.z)) <= 2.5 and -nz < 0"),
)
def f5(spark, sf):
    v, f = _vf(spark, sf)
    probes = v.where("bal < 0").select("mesh_id", F.col("vertex_id").alias("probe"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.0).alias("dz"))
    return T.within_radius(probes, v, G.vertex_normals(G.face_points(f, v)), 2.5)


@query("f6_isolated_vertices", sql("select mesh_id, vertex_id from v where not exists (select 1 from f where face_id % 3 = 0 and f.mesh_id = v.mesh_id and v.vertex_id in (v0, v1, v2))"))
def f6(spark, sf):
    v, f = _vf(spark, sf)
    return T.isolated_vertices(v.select("mesh_id", "vertex_id"), f.where("face_id % 3 = 0"))


@query("j1_vertex_adjacency", sql("select * from ve"))
def j1(spark, sf):
    return T.vertex_edges(_vf(spark, sf)[1])


@query("j2_face_adjacency", sql("select mesh_id, face_id, slot, nbr from fa"))
def j2(spark, sf):
    return T.face_adjacency(_vf(spark, sf)[1])


@query("j3_edge_list", sql("select mesh_id, face_id, nbr, edge_idx from el"))
def j3(spark, sf):
    return T.edge_list(T.face_adjacency(_vf(spark, sf)[1]))


@query("j4_are_connected", sql("select a.mesh_id, a.vertex_id as src, b.vertex_id as dst from ev a join ev b on a.mesh_id = b.mesh_id and a.vertex_id < b.vertex_id and b.vertex_id - a.vertex_id < 40 where exists (select 1 from ve where ve.mesh_id = a.mesh_id and src = a.vertex_id and dst = b.vertex_id)"))
def j4(spark, sf):
    v, f = _vf(spark, sf)
    e = demo.edge_vertices(v)
    pairs = e.select("mesh_id", F.col("vertex_id").alias("src"), F.explode(F.sequence(F.col("vertex_id") + 1, F.col("vertex_id") + 39)).alias("dst"))
    pairs = pairs.join(e.withColumnRenamed("vertex_id", "dst"), ["mesh_id", "dst"], "left_semi").select("mesh_id", "src", "dst")
    return T.are_connected(pairs, T.vertex_edges(f))


NEAR = """select p.mesh_id, p.vertex_id as probe, a.vertex_id, (a.x-p.x)*(a.x-p.x)+(a.y-p.y)*(a.y-p.y)+(a.z-p.z)*(a.z-p.z) as d2,
  row_number() over (partition by p.mesh_id, p.vertex_id order by (a.x-p.x)*(a.x-p.x)+(a.y-p.y)*(a.y-p.y)+(a.z-p.z)*(a.z-p.z), a.vertex_id) as rn
  from v p join v a on a.mesh_id = p.mesh_id and a.bal < 0 and a.vertex_id <> p.vertex_id
  where sqrt((a.x-p.x)*(a.x-p.x)+(a.y-p.y)*(a.y-p.y)+(a.z-p.z)*(a.z-p.z)) < 4"""


def _probes(v):
    return v.select("mesh_id", F.col("vertex_id").alias("probe"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))


@query("j5_nearest_annotated", sql(f"select mesh_id, probe, vertex_id, round(d2, 6) + 0 as d2 from ({NEAR}) where rn = 1"))
def j5(spark, sf):
    v = demo.vertices(spark, sf)
    return rounded(T.nearest_annotated(_probes(v), v.where("bal < 0"), 4.0))


@query("j6_snap", sql(f"select v.mesh_id, v.vertex_id as probe, case when v.bal < 0 then v.vertex_id else coalesce(n.vertex_id, v.vertex_id) end as target from v left join (select * from ({NEAR}) where rn = 1) n on n.mesh_id = v.mesh_id and n.probe = v.vertex_id"))
def j6(spark, sf):
    v = demo.vertices(spark, sf)
    return T.snapped(_probes(v), v.where("bal < 0"), 4.0)


@query("a1_face_normals", sql("select mesh_id, face_id, round(nm.nx, 6) + 0 as nx, round(nm.ny, 6) + 0 as ny, round(nm.nz, 6) + 0 as nz, round(ns.nx, 6) + 0 as soft_x, round(ns.ny, 6) + 0 as soft_y, round(ns.nz, 6) + 0 as soft_z from nm join ns using (mesh_id, face_id)"))
def a1(spark, sf):
    v, f = _vf(spark, sf)
    p = G.face_points(f, v)
    hard, soft = G.face_normals(p), G.face_normals(p, soft=True)
    return rounded(hard.select("mesh_id", "face_id", "nx", "ny", "nz").join(soft.select("mesh_id", "face_id", F.col("nx").alias("soft_x"), F.col("ny").alias("soft_y"), F.col("nz").alias("soft_z")), ["mesh_id", "face_id"]))


@query("a2_edge_dihedral_angles", sql("select mesh_id, lo, hi, round(angle, 6) + 0 as angle from ea"))
def a2(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(G.edge_angles(G.face_normals(G.face_points(f, v))))


@query("a3_vertex_max_angles", sql("select mesh_id, vertex_id, round(angle, 6) + 0 as angle from va"))
def a3(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(G.vertex_max_angles(v, G.edge_angles(G.face_normals(G.face_points(f, v)))))


@query("a4_face_sharpness", sql("select f.mesh_id, f.face_id, round(exp(-coalesce(max(acos(greatest(-1, least(1, a.nx*b.nx+a.ny*b.ny+a.nz*b.nz)))), 0)), 6) as sharpness from f left join fa using (mesh_id, face_id) left join ns a on a.mesh_id = f.mesh_id and a.face_id = f.face_id left join ns b on b.mesh_id = f.mesh_id and b.face_id = nbr group by all"))
def a4(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(G.face_sharpness(T.face_adjacency(f), G.face_normals(G.face_points(f, v), soft=True)))


@query("a5_vertex_normals", sql("select mesh_id, vertex_id, round(nx, 6) + 0 as nx, round(ny, 6) + 0 as ny, round(nz, 6) + 0 as nz from vn"))
def a5(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(G.vertex_normals(G.face_points(f, v)))


MOMENTS = """select m.mesh_id, round(coalesce(sum(d/6),0),4)+0 as volume, round(coalesce(sum(d*sx/24),0),4)+0 as mx, round(coalesce(sum(d*sy/24),0),4)+0 as my, round(coalesce(sum(d*sz/24),0),4)+0 as mz,
 round(coalesce(sum(d*(sx*sy+x0*y0+x1*y1+x2*y2)/120),0),4)+0 as mxy, round(coalesce(sum(d*(sz*sy+z0*y0+z1*y1+z2*y2)/120),0),4)+0 as mzy, round(coalesce(sum(d*(sz*sx+z0*x0+z1*x1+z2*x2)/120),0),4)+0 as mzx,
 round(coalesce(sum(d*(sx*sx+x0*x0+x1*x1+x2*x2)/120),0),4)+0 as mx2, round(coalesce(sum(d*(sy*sy+y0*y0+y1*y1+y2*y2)/120),0),4)+0 as my2, round(coalesce(sum(d*(sz*sz+z0*z0+z1*z1+z2*z2)/120),0),4)+0 as mz2
 from m left join (select *, x0*(y1*z2-z1*y2)+y0*(z1*x2-x1*z2)+z0*(x1*y2-y1*x2) as d, x0+x1+x2 as sx, y0+y1+y2 as sy, z0+z1+z2 as sz from fp) p using (mesh_id) group by m.mesh_id"""


@query("a6_volume_moments", sql(MOMENTS))
def a6(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(G.moments(demo.meshes(v), G.face_points(f, v)), 4)


@query("a7_bounding_info", sql("select mesh_id, (min(x)+max(x))/2 as centre_x, (min(y)+max(y))/2 as centre_y, round((min(z)+max(z))/2,6) as centre_z, max(x)-min(x) as size_x, max(y)-min(y) as size_y, round(max(z)-min(z),6) as size_z, round(case when sqrt((max(x)-min(x))**2+(max(y)-min(y))**2+(max(z)-min(z))**2) < 1e-10 then 1 else sqrt((max(x)-min(x))**2+(max(y)-min(y))**2+(max(z)-min(z))**2) end, 6) as diagonal from v group by mesh_id"))
def a7(spark, sf):
    v = demo.vertices(spark, sf)
    return rounded(G.bounds(demo.meshes(v), v))


@query("a8_mesh_counts", sql("select m.mesh_id, (select count(*) from v where v.mesh_id = m.mesh_id) as n_vertices, (select count(*) from f where f.mesh_id = m.mesh_id) as n_faces, (select count(*) from ev where ev.mesh_id = m.mesh_id) as n_edge_vertices, (select count(*) from v where v.mesh_id = m.mesh_id and bal > 9000) as n_arrows from m"))
def a8(spark, sf):
    v, f = _vf(spark, sf)
    return G.counts(demo.meshes(v), v, f, demo.edge_vertices(v), v.where("bal > 9000"))


@query("a9_face_to_vertex_mean", sql("select v.mesh_id, v.vertex_id, round(coalesce(avg(p), 0), 9) as value from v left join corner using (mesh_id, vertex_id) left join fs using (mesh_id, face_id) group by all"))
def a9(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(G.face_to_vertex_mean(v, f, demo.face_scores(v, f)), 9)


@query("a10_frequency_remap", sql("select mesh_id, vertex_id, r::int as label from gt join (select mesh_id, label, row_number() over (partition by mesh_id order by count(*) desc, label) as r from gt group by mesh_id, label) using (mesh_id, label)"))
def a10(spark, sf):
    return G.remap_by_frequency(demo.gt_labels(demo.vertices(spark, sf)), "vertex_id")


LABELS3 = "select mesh_id, face_id, max(case when k=0 then label end) as a, max(case when k=1 then label end) as b, max(case when k=2 then label end) as c from corner join gt using (mesh_id, vertex_id) group by all"


@query("a12_majority_with_zero", sql(f"select mesh_id, face_id, case when a=b or a=c then a when b=c then b else a end as label from ({LABELS3})"))
def a12(spark, sf):
    from debitage.operators.scars import face_labels

    v, f = _vf(spark, sf)
    return face_labels(f, demo.gt_labels(v), majority_with_zero)


@query("a13_majority_non_zero", sql(f"select mesh_id, face_id, case when a<>0 and (a=b or a=c) then a when b<>0 and b=c then b when a<>0 then a when b<>0 then b else c end as label from ({LABELS3})"))
def a13(spark, sf):
    from debitage.operators.scars import face_labels

    v, f = _vf(spark, sf)
    return face_labels(f, demo.gt_labels(v), majority_non_zero)


@query("a14_area_by_label", sql(f"select mesh_id, label, round(sum(area), 6) as surface_area from ar join (select mesh_id, face_id, case when a=b or a=c then a when b=c then b else a end as label from ({LABELS3})) using (mesh_id, face_id) where label > 0 group by all"))
def a14(spark, sf):
    from debitage.operators.scars import label_areas

    v, f = _vf(spark, sf)
    return rounded(label_areas(v, f, demo.gt_labels(v)))


@query("a19_pca_alignment", None)
def a19(spark, sf):
    return rounded(G.pca_aligned(demo.vertices(spark, sf)))


@query("a19_pca_spread", sql("select mesh_id, round(sum((x-mx)**2+(y-my)**2+(z-mz)**2), 4) as spread from v join (select mesh_id, avg(x) mx, avg(y) my, avg(z) mz from v group by mesh_id) using (mesh_id) group by mesh_id"))
def a19_spread(spark, sf):
    p = G.pca_aligned(demo.vertices(spark, sf))
    return rounded(p.groupBy("mesh_id").agg(F.sum(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("spread")), 4)


@query("i4_face_brightness", sql("select mesh_id, face_id, round((b - min(b) over w) / case when max(b) over w > min(b) over w then max(b) over w - min(b) over w else 1 end, 6) + 0 as brightness from (select mesh_id, face_id, (0.2*nx+0.2*ny+nz)/sqrt(1.08) as b from nm) window w as (partition by mesh_id)"))
def i4(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(G.face_brightness(G.face_normals(G.face_points(f, v))))


@query("i5_frame_radius", sql("select mesh_id, round(max(sqrt((x-mx)**2+(y-my)**2+(z-mz)**2)), 6) as radius from v join (select mesh_id, avg(x) mx, avg(y) my, avg(z) mz from v group by mesh_id) using (mesh_id) group by mesh_id"))
def i5(spark, sf):
    return rounded(G.frame_radius(demo.vertices(spark, sf)))


@query("s4_face_label_import", sql("select mesh_id, vertex_id from corner join (select mesh_id, face_id, (face_id // 8) % 3 as label from f) using (mesh_id, face_id) group by all having count(distinct label) > 1"))
def s4(spark, sf):
    _, f = _vf(spark, sf)
    return face_label_import(f, f.select("mesh_id", "face_id", F.expr("(face_id div 8) % 3").alias("label")))


@query("s5_label_id_import", sql("select distinct mesh_id, vertex_id from corner where (mesh_id, face_id) in (select (mesh_id, face_id) from corner join gt using (mesh_id, vertex_id) group by mesh_id, face_id having count(distinct label) > 1)"))
def s5(spark, sf):
    v, f = _vf(spark, sf)
    return label_id_import(f, demo.gt_labels(v))


@query("x_large_mesh_angles", None)
def large_angles(spark, sf):
    v = demo.large_vertices(spark, sf)
    f = demo.faces(v)
    return rounded(G.vertex_max_angles(v, G.edge_angles(G.face_normals(G.face_points(f, v)))))
