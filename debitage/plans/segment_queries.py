"""Segmentation and region graphs over the demo meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from debitage.functions import metrics as R
from debitage.operators import annotations as A
from debitage.operators import geometry as G
from debitage.operators import ordering as O
from debitage.operators import paths as P
from debitage.operators import scars as S
from debitage.operators import segment as K
from debitage.operators import topology as T
from debitage.plans import demo
from debitage.plans.demo import FLOOD, sql
from debitage.plans.registry import query, rounded


def _vf(spark, sf):
    v = demo.vertices(spark, sf)
    return v, demo.faces(v)


def _costs(v, f, how="max"):
    return K.edge_costs(T.edge_list(T.face_adjacency(f)), demo.face_scores(v, f), how)


@query("g1_merge_costs", sql("select el.mesh_id, edge_idx, round(greatest(a.p, b.p), 9) as high, round((a.p + b.p) / 2, 9) as mean, round(least(a.p, b.p), 9) as low from el join fs a on a.mesh_id = el.mesh_id and a.face_id = el.face_id join fs b on b.mesh_id = el.mesh_id and b.face_id = nbr"))
def g1(spark, sf):
    v, f = _vf(spark, sf)
    k = ["mesh_id", "edge_idx"]
    cols = [_costs(v, f, how).select(*k, F.col("cost").alias(name)) for how, name in (("max", "high"), ("mean", "mean"), ("min", "low"))]
    return rounded(cols[0].join(cols[1], k).join(cols[2], k), 9)


CUT = """ce as (select mesh_id, face_id as src, nbr as dst from co where cost <= 0.55 union all select mesh_id, nbr, face_id from co where cost <= 0.55),
rf(mesh_id, face_id, root) as (select mesh_id, face_id, face_id from f union select r.mesh_id, ce.dst, r.root from rf r join ce on ce.mesh_id = r.mesh_id and ce.src = r.face_id and ce.dst > r.root),
tc as (select mesh_id, face_id, min(root) as root from rf group by all)"""


@query("g2_threshold_components", sql("select mesh_id, face_id, root from tc", CUT, recursive=True))
def g2(spark, sf):
    v, f = _vf(spark, sf)
    return K.threshold_components(f, _costs(v, f), 0.55)


@query("g2_segments_by_frequency", sql("select mesh_id, face_id, r::int as label from tc join (select mesh_id, root, row_number() over (partition by mesh_id order by count(*) desc, root) as r from tc group by mesh_id, root) using (mesh_id, root)", CUT, recursive=True))
def g2_labels(spark, sf):
    v, f = _vf(spark, sf)
    return G.remap_by_frequency(K.threshold_components(f, _costs(v, f), 0.55).withColumnRenamed("root", "label"))


@query("g3_capped_merge", None)
def g3(spark, sf):
    v, f = _vf(spark, sf)
    return K.capped_components(f, _costs(v, f), 0.6, 12)


@query("g4_small_segment_cleanup", None)
def g4(spark, sf):
    v, f = _vf(spark, sf)
    c = _costs(v, f)
    return K.cleaned_up(K.threshold_components(f, c, 0.45), c, 6)


FACE_SEGMENTS = "(select mesh_id, face_id, (face_id // 10) % 4 as label from f)"


def _face_segments(f):
    return f.select("mesh_id", "face_id", F.expr("cast((face_id div 10) % 4 as int)").alias("label"))


@query("g5_faces_to_vertex_edges", sql(f"select v.mesh_id, v.vertex_id, (case when min(label) is null or min(label) <> max(label) then 1 else 0 end)::int as label from v left join (select c.mesh_id, vertex_id, label from corner c join {FACE_SEGMENTS} using (mesh_id, face_id)) using (mesh_id, vertex_id) group by all"))
def g5(spark, sf):
    v, f = _vf(spark, sf)
    return K.faces_to_vertex_edges(v, f, _face_segments(f))


@query("g6_faces_to_vertex_segments", sql(f"select v.mesh_id, v.vertex_id, (case when min(label) = max(label) then min(label) else 0 end)::int as label from v left join (select c.mesh_id, vertex_id, label from corner c join {FACE_SEGMENTS} using (mesh_id, face_id) where label <> 0) using (mesh_id, vertex_id) group by all"))
def g6(spark, sf):
    v, f = _vf(spark, sf)
    return K.faces_to_vertex_segments(v, f, _face_segments(f))


def flood(spark, sf):
    v, f = _vf(spark, sf)
    return K.flood_fill(v, T.vertex_edges(f), demo.edge_vertices(v))


@query("g7_flood_fill", sql("select mesh_id, vertex_id, label::int as label from seg", FLOOD, recursive=True))
def g7(spark, sf):
    return flood(spark, sf)


NZ = """ne as (select ve.mesh_id, src, dst from ve join gt a on a.mesh_id = ve.mesh_id and a.vertex_id = src and a.label <> 0 join pred b on b.mesh_id = ve.mesh_id and b.vertex_id = dst and b.label <> 0 join pred c on c.mesh_id = ve.mesh_id and c.vertex_id = src and c.label <> 0),
rz(mesh_id, vertex_id, root) as (select mesh_id, vertex_id, vertex_id from pred where label <> 0 union select r.mesh_id, ne.dst, r.root from rz r join ne on ne.mesh_id = r.mesh_id and ne.src = r.vertex_id and ne.dst > r.root),
zc as (select mesh_id, vertex_id, min(root) as root from rz group by all), zn as (select mesh_id, root, count(*) as n from zc group by all)"""


@query("g8_small_components_to_edge", sql("select p.mesh_id, p.vertex_id, (case when n < 6 then 0 else p.label end)::int as label from pred p left join zc using (mesh_id, vertex_id) left join zn using (mesh_id, root)", NZ, recursive=True))
def g8(spark, sf):
    v, f = _vf(spark, sf)
    return K.small_to_edge(demo.pred_labels(v), T.vertex_edges(f), 6)


def _layers_sql(pick: str) -> str:
    """Layered growth from pred by plain nested steps: enough layers for the small meshes."""
    steps = ["l0 as (select mesh_id, vertex_id, label from pred)"]
    for k in range(1, 9):
        steps.append(
            f"l{k} as (select c.mesh_id, c.vertex_id, case when c.label > 0 then c.label else coalesce(g.label, 0) end as label from l{k - 1} c left join ({pick.format(k=k - 1)}) g using (mesh_id, vertex_id))"
        )
    return ", ".join(steps)


ERODE_MIN = "select ve.mesh_id, src as vertex_id, min(label) as label from ve join l{k} n on n.mesh_id = ve.mesh_id and n.vertex_id = dst where label > 0 group by ve.mesh_id, src"
ERODE_MAJ = "select mesh_id, vertex_id, label from (select *, row_number() over (partition by mesh_id, vertex_id order by n desc, fr) as rn from (select ve.mesh_id, src as vertex_id, label, count(*) as n, min(first_rank) as fr from ve join l{k} n on n.mesh_id = ve.mesh_id and n.vertex_id = dst where label > 0 group by ve.mesh_id, src, label)) where rn = 1"


@query("g9_erode_to_min", sql("select mesh_id, vertex_id, label::int as label from l8", _layers_sql(ERODE_MIN)))
def g9(spark, sf):
    v, f = _vf(spark, sf)
    return K.erode_to_min(demo.pred_labels(v), T.vertex_edges(f))


@query("g10_thin_boundary", sql("select distinct s.mesh_id, case when a.label < b.label then lo else hi end as vertex_id from side s join gt a on a.mesh_id = s.mesh_id and a.vertex_id = lo join gt b on b.mesh_id = s.mesh_id and b.vertex_id = hi where a.label <> b.label"))
def g10(spark, sf):
    v, f = _vf(spark, sf)
    return K.thin_edges(f, demo.gt_labels(v))


@query("g11_normalise_edges", None)
def g11(spark, sf):
    v, f = _vf(spark, sf)
    labels, progress = K.normalise_edges(f, demo.pred_labels(v), 4)
    return labels.join(progress, "mesh_id")


MAJ = _layers_sql(ERODE_MAJ)


def _working(v, f):
    return S.erode_by_majority(demo.pred_labels(v), T.vertex_edges(f))


@query("g12_erode_by_majority", sql("select mesh_id, vertex_id, label::int as label from l8", MAJ))
def g12(spark, sf):
    return _working(*_vf(spark, sf))


SCARS = "sc as (select mesh_id, label, count(*) as vertex_count, min(vertex_id) as representative_vertex, (row_number() over (partition by mesh_id order by count(*) desc, min(vertex_id)) - 1)::int as scar_id from l8 where label > 0 group by mesh_id, label), mem as (select l8.mesh_id, vertex_id, scar_id from l8 join sc using (mesh_id, label))"
ADJ = "bd as (select distinct ve.mesh_id, least(a.scar_id, b.scar_id) as scar_a, greatest(a.scar_id, b.scar_id) as scar_b, src as vertex_id from ve join mem a on a.mesh_id = ve.mesh_id and a.vertex_id = src join mem b on b.mesh_id = ve.mesh_id and b.vertex_id = dst where a.scar_id <> b.scar_id)"
ROUGH = """fl as (select mesh_id, face_id, case when a<>0 and (a=b or a=c) then a when b<>0 and b=c then b when a<>0 then a when b<>0 then b else c end as label from
 (select mesh_id, face_id, max(case when k=0 then label end) as a, max(case when k=1 then label end) as b, max(case when k=2 then label end) as c from corner join l8 using (mesh_id, vertex_id) group by all)),
cand as (select distinct bd.mesh_id, scar_a, scar_b, face_id from bd join corner using (mesh_id, vertex_id)),
met as (select cand.mesh_id, scar_a, scar_b, lo, hi, arg_min(label, face_id) as la, arg_max(label, face_id) as lb, acos(greatest(-1, least(1, arg_min(nx, face_id)*arg_max(nx, face_id)+arg_min(ny, face_id)*arg_max(ny, face_id)+arg_min(nz, face_id)*arg_max(nz, face_id)))) as angle
 from cand join side using (mesh_id, face_id) join nm using (mesh_id, face_id) join fl using (mesh_id, face_id) group by all having count(*) = 2),
sg as (select p.mesh_id, p.scar_a, p.scar_b, coalesce(avg(angle), 0) as sharpness, coalesce(stddev_pop(angle), 0) as roughness, count(angle) as boundary_size from (select distinct mesh_id, scar_a, scar_b from bd) p left join (select * from met where la <> lb and la <> 0 and lb <> 0) t using (mesh_id, scar_a, scar_b) group by all)"""


@query("g13_identify_scars", sql("select mesh_id, label::int as label, vertex_count, representative_vertex, scar_id from sc", MAJ, SCARS))
def g13(spark, sf):
    return S.identify(_working(*_vf(spark, sf)))


@query("g14_scar_adjacency", sql("select * from bd", MAJ, SCARS, ADJ))
def g14(spark, sf):
    v, f = _vf(spark, sf)
    w = _working(v, f)
    return S.adjacency(T.vertex_edges(f), S.scar_vertices(w, S.identify(w)))


@query("g15_boundary_roughness", sql("select mesh_id, scar_a, scar_b, round(sharpness, 5) + 0 as sharpness, round(roughness, 5) + 0 as roughness, boundary_size from sg", MAJ, SCARS, ADJ, ROUGH))
def g15(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(S.scar_graph(v, f, demo.pred_labels(v))[3], 5)


@query("g16_scar_graph", sql("select m.mesh_id, (select count(*) from sc where sc.mesh_id = m.mesh_id) as n_scars, (select count(*) from sg where sg.mesh_id = m.mesh_id) as n_edges, (select count(*) from bd where bd.mesh_id = m.mesh_id) as n_boundary from m", MAJ, SCARS, ADJ, ROUGH))
def g16(spark, sf):
    v, f = _vf(spark, sf)
    _, scars, boundary, edges = S.scar_graph(v, f, demo.pred_labels(v))
    out = demo.meshes(v)
    for df, name in ((scars, "n_scars"), (edges, "n_edges"), (boundary, "n_boundary")):
        out = out.join(df.groupBy("mesh_id").agg(F.count("*").alias(name)), "mesh_id", "left").fillna(0, [name])
    return out


@query("g17_border_vertices", sql("select distinct ve.mesh_id, a.label::int as label, src as vertex_id from ve join gt a on a.mesh_id = ve.mesh_id and a.vertex_id = src join gt b on b.mesh_id = ve.mesh_id and b.vertex_id = dst where a.label > 0 and a.label <> b.label"))
def g17(spark, sf):
    v, f = _vf(spark, sf)
    return S.border_vertices(T.vertex_edges(f), demo.gt_labels(v))


@query(
    "g18_surface_points",
    sql("""select mesh_id, scar_id, vertex_id, round(x + 0.15 * nx, 6) + 0 as x, round(y + 0.15 * ny, 6) + 0 as y, round(z + 0.15 * nz, 6) + 0 as z from
 (select v.mesh_id, scar_id, v.vertex_id, x, y, z, row_number() over (partition by v.mesh_id, scar_id order by round((x-ax)**2+(y-ay)**2+(z-az)**2, 9), v.vertex_id) as rn from mem join v using (mesh_id, vertex_id)
  join (select mesh_id, scar_id, avg(x) ax, avg(y) ay, avg(z) az from mem join v using (mesh_id, vertex_id) group by all) using (mesh_id, scar_id)) join vn using (mesh_id, vertex_id) where rn = 1""", MAJ, SCARS),
)
def g18(spark, sf):
    v, f = _vf(spark, sf)
    w = _working(v, f)
    return rounded(S.surface_points(v, G.vertex_normals(G.face_points(f, v)), S.scar_vertices(w, S.identify(w))))


def _ring_costs(v, f):
    return P.edge_lengths(T.vertex_edges(f), v)


def _requests(v):
    ends = v.groupBy("mesh_id").agg(F.max("vertex_id").alias("dst"))
    return ends.select(F.col("mesh_id").cast("string").alias("request"), "mesh_id", F.lit(0).cast("long").alias("src"), "dst")


PATH = """w as (select ve.mesh_id, src, dst, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as c from ve join v a on a.mesh_id = ve.mesh_id and a.vertex_id = src join v b on b.mesh_id = ve.mesh_id and b.vertex_id = dst),
d0 as (select mesh_id, vertex_id, case when vertex_id = 0 then 0.0::double else 1e18 end as d from v)"""


def _relaxed(rounds: int = 60) -> str:
    return ", ".join(f"d{k} as materialized (select p.mesh_id, p.vertex_id, least(p.d, coalesce(min(q.d + c), 1e18)) as d from d{k - 1} p left join w on w.mesh_id = p.mesh_id and w.dst = p.vertex_id left join d{k - 1} q on q.mesh_id = p.mesh_id and q.vertex_id = w.src group by p.mesh_id, p.vertex_id, p.d)" for k in range(1, rounds + 1))


@query("g19_shortest_path_cost", sql("select d40.mesh_id, round(d, 5) as cost from d40 join (select mesh_id, max(vertex_id) as vertex_id from v group by all) using (mesh_id, vertex_id)", PATH, _relaxed(40)))
def g19_cost(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(P.shortest_paths(_requests(v), _ring_costs(v, f)).select("mesh_id", "cost"), 5)


@query("g19_shortest_path", None)
def g19(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(P.shortest_paths(_requests(v), _ring_costs(v, f)))


@query("g20_ridge_path", None)
def g20(spark, sf):
    v, f = _vf(spark, sf)
    angles = G.vertex_max_angles(v, G.edge_angles(G.face_normals(G.face_points(f, v))))
    return rounded(P.shortest_paths(_requests(v), P.ridge_costs(_ring_costs(v, f), angles)))


@query("g21_polyline", None)
def g21(spark, sf):
    v, f = _vf(spark, sf)
    way = v.where("vertex_id % 17 = 0").select(F.col("mesh_id").cast("string").alias("line"), "mesh_id", (F.col("vertex_id") / 17).cast("int").alias("pos"), "vertex_id")
    return P.complete_polyline(way, _ring_costs(v, f))


SHELL_SQL = """tf as (select mem.mesh_id, scar_id, face_id from corner join mem using (mesh_id, vertex_id) group by all having count(*) = 3),
tn as (select mesh_id, scar_id, count(*) as nf from tf group by all),
tv as (select tf.mesh_id, scar_id, count(distinct vertex_id) as nv from tf join corner using (mesh_id, face_id) group by all),
he as (select tf.mesh_id, scar_id, v0 as a, v1 as b from tf join f using (mesh_id, face_id) union all select tf.mesh_id, scar_id, v1, v2 from tf join f using (mesh_id, face_id) union all select tf.mesh_id, scar_id, v2, v0 from tf join f using (mesh_id, face_id)),
rim as (select mesh_id, scar_id, count(*) as nr from he h where not exists (select 1 from he g where g.mesh_id = h.mesh_id and g.scar_id = h.scar_id and g.a = h.b and g.b = h.a) group by all)"""


@query("g22_watertight_shell", sql("select mesh_id, scar_id, (2 * nv)::bigint as n_vertices, (2 * nf + 2 * nr)::bigint as n_faces from tn join tv using (mesh_id, scar_id) join rim using (mesh_id, scar_id)", MAJ, SCARS, SHELL_SQL))
def g22(spark, sf):
    v, f = _vf(spark, sf)
    w = _working(v, f)
    sv, sfc = S.watertight_shell(v, f, S.scar_vertices(w, S.identify(w)))
    k = ["mesh_id", "scar_id"]
    return sv.groupBy(k).agg(F.count("*").alias("n_vertices")).join(sfc.groupBy(k).agg(F.count("*").alias("n_faces")), k)


@query("g23_vertex_to_face_labels", sql("select mesh_id, face_id, (case when a=b or a=c then a when b=c then b else a end)::int as label from (select mesh_id, face_id, max(case when k=0 then label end) as a, max(case when k=1 then label end) as b, max(case when k=2 then label end) as c from corner join l8 using (mesh_id, vertex_id) group by all)", MAJ))
def g23(spark, sf):
    v, f = _vf(spark, sf)
    return S.vertex_labels_to_faces(f, demo.pred_labels(v))


@query("g25_postprocess", None)
def g25(spark, sf):
    v, f = _vf(spark, sf)
    return K.postprocess(v, f, T.face_adjacency(f), demo.face_scores(v, f), 0.55, 4)


@query("g26_segment_lineage", sql("select mesh_id, label, previous, shared from (select mesh_id, g.label, p.label as previous, count(*) as shared, row_number() over (partition by mesh_id, g.label order by count(*) desc, p.label) as rn from gt g join pred p using (mesh_id, vertex_id) where g.label > 0 and p.label > 0 group by mesh_id, g.label, p.label) where rn = 1"))
def g26(spark, sf):
    v = demo.vertices(spark, sf)
    return K.lineage(demo.gt_labels(v), demo.pred_labels(v))


@query("g27_largest_segment", sql("select mesh_id, label, n from (select mesh_id, label, count(*) as n, row_number() over (partition by mesh_id order by count(*) desc, label) as rn from gt where label > 0 group by mesh_id, label) where rn = 1"))
def g27(spark, sf):
    return K.largest_segment(demo.gt_labels(demo.vertices(spark, sf)))


def _metrics_sql(labels: str, places: int = 10) -> str:
    area = f"(select mesh_id, label, sum(area) as a from ar join (select mesh_id, face_id, case when a=b or a=c then a when b=c then b else a end as label from (select mesh_id, face_id, max(case when k=0 then label end) as a, max(case when k=1 then label end) as b, max(case when k=2 then label end) as c from corner join {labels} using (mesh_id, vertex_id) group by all)) using (mesh_id, face_id) where label > 0 group by all)"
    return f"""select s.mesh_id, s.label::int as label, count(*) as vertex_count, round(sqrt((max(x)-min(x))**2+(max(y)-min(y))**2+(max(z)-min(z))**2), {places}) + 0 as max_dimension, round(avg(x), {places}) + 0 as centroid_x, round(avg(y), {places}) + 0 as centroid_y, round(avg(z), {places}) + 0 as centroid_z,
 round(coalesce(max(t.a), 0), {places}) + 0 as surface_area from {labels} s join v using (mesh_id, vertex_id) left join {area} t on t.mesh_id = s.mesh_id and t.label = s.label where s.label > 0 group by s.mesh_id, s.label"""


@query("a11_segment_metrics", sql(_metrics_sql("seg"), FLOOD, recursive=True))
def a11(spark, sf):
    v, f = _vf(spark, sf)
    return rounded(S.segment_metrics(v, f, flood(spark, sf)), 10)


def regions(spark, sf):
    """The scar metrics that reports work on."""
    v, f = _vf(spark, sf)
    w = _working(v, f)
    scars = S.identify(w)
    boundary = S.adjacency(T.vertex_edges(f), S.scar_vertices(w, scars)).select("mesh_id", "scar_a", "scar_b").distinct()
    order = O.oldest_first(O.topological_order(scars, O.preseed_by_size(boundary, scars)), scars.limit(0).select("mesh_id", "scar_id", F.lit(0).alias("temporal_order")))
    return S.scar_metrics(v, f, w, G.vertex_max_angles(v, G.edge_angles(G.face_normals(G.face_points(f, v)))), order)


@query("a15_scar_metrics", sql(f"select mesh_id, scar_id, x.vertex_count, max_dimension, centroid_x, centroid_y, centroid_z, surface_area, mean_curvature from ({_metrics_sql('l8')}) x join sc using (mesh_id, label) join (select mesh_id, label, round(avg(angle), 10) + 0 as mean_curvature from l8 join va using (mesh_id, vertex_id) where label > 0 group by all) using (mesh_id, label)", MAJ, SCARS))
def a15(spark, sf):
    return rounded(regions(spark, sf).drop("temporal_order"), 10)


PLAIN = "rg as (select mesh_id, label as scar_id, count(*) as vertex_count, avg(z) as metric from gt join v using (mesh_id, vertex_id) where label > 0 group by all)"


def _plain(spark, sf):
    v = demo.vertices(spark, sf)
    rows = demo.gt_labels(v).where("label > 0").join(v.select("mesh_id", "vertex_id", "z"), ["mesh_id", "vertex_id"])
    return rows.groupBy("mesh_id", F.col("label").alias("scar_id")).agg(F.count("*").alias("vertex_count"), F.avg("z").alias("metric"))


@query("a16_summary_statistics", sql("select mesh_id, round(min(metric), 6) as low, round(max(metric), 6) as high, round(avg(metric), 6) as mean, round(median(metric), 6) as middle from rg group by mesh_id", PLAIN))
def a16(spark, sf):
    return rounded(R.summary(_plain(spark, sf), "metric"))


@query("a17_percent_of_max", sql("select mesh_id, scar_id, round(metric / max(metric) over (partition by mesh_id) * 100, 5) as percent from rg", PLAIN))
def a17(spark, sf):
    return rounded(R.percent_of_max(_plain(spark, sf), "metric"), 5)


@query("a18_boundary_averages", sql("select mesh_id, round(avg(sharpness), 5) + 0 as mean_sharpness, round(avg(roughness), 5) + 0 as mean_roughness, 0::bigint as n_expert, count(*) as n_preseed from sg group by mesh_id", MAJ, SCARS, ADJ, ROUGH))
def a18(spark, sf):
    v, f = _vf(spark, sf)
    _, scars, _, edges = S.scar_graph(v, f, demo.pred_labels(v))
    return rounded(R.boundary_averages(edges, O.preseed_by_size(edges, scars)), 5)


@query("w1_w2_ranked_regions", sql("select mesh_id, scar_id, vertex_count, (row_number() over (partition by mesh_id order by case when vertex_count % 3 = 0 then null else vertex_count end desc nulls last, scar_id))::int as rank from rg", PLAIN))
def w1(spark, sf):
    rows = _plain(spark, sf).withColumn("m", F.when(F.col("vertex_count") % 3 != 0, F.col("vertex_count")))
    return R.ranked(rows, "m").select("mesh_id", "scar_id", "vertex_count", "rank")


@query("w3_rank_fraction", sql("select mesh_id, scar_id, round(case when n = 1 then 0.5 else (r - 1) / (n - 1) end, 6) as rank_fraction from (select mesh_id, scar_id, row_number() over (partition by mesh_id order by vertex_count, scar_id) as r, count(*) over (partition by mesh_id) as n from rg)", PLAIN))
def w3(spark, sf):
    return rounded(R.ranked(_plain(spark, sf), "vertex_count", ascending=True).select("mesh_id", "scar_id", "rank_fraction"))


@query("w4_stable_cost_order", sql("select mesh_id, edge_idx, (row_number() over (partition by mesh_id order by cost, edge_idx))::int as place from co"))
def w4(spark, sf):
    from pyspark.sql import Window

    return _costs(*_vf(spark, sf)).select("mesh_id", "edge_idx", F.row_number().over(Window.partitionBy("mesh_id").orderBy("cost", "edge_idx")).alias("place"))


@query("w5_sorted_cut", sql("select mesh_id, edge_idx, round(cost, 6) as cost from co where cost <= 0.45"))
def w5(spark, sf):
    return rounded(_costs(*_vf(spark, sf)).where("cost <= 0.45").select("mesh_id", "edge_idx", "cost"))


@query("w8_available_metrics", sql("select 'vertex_count' as metric, count(*) as n from rg", PLAIN))
def w8(spark, sf):
    return R.available(_plain(spark, sf))


@query("s9_metric_report", sql("select mesh_id, (row_number() over (partition by mesh_id order by surface_area desc nulls last, scar_id))::int as rank, vertex_count, round(round(surface_area * 100, 4), 2) + 0 as surface_area_mm2, round(round(max_dimension * 10, 4), 2) + 0 as max_dimension_mm, round(degrees(mean_curvature), 2) + 0 as mean_curvature_deg from (select mesh_id, scar_id, x.vertex_count, max_dimension, surface_area, mean_curvature from (" + _metrics_sql("l8", 9) + ") x join sc using (mesh_id, label) join (select mesh_id, label, avg(angle) as mean_curvature from l8 join va using (mesh_id, vertex_id) where label > 0 group by all) using (mesh_id, label))", MAJ, SCARS))
def s9(spark, sf):
    return rounded(R.report(regions(spark, sf), "surface_area", F.lit("cm"), "mm").drop("temporal_order"), 2)


PRE = "ps as (select p.mesh_id, case when a.vertex_count <= b.vertex_count then scar_a else scar_b end as younger, case when a.vertex_count <= b.vertex_count then scar_b else scar_a end as older from (select distinct mesh_id, scar_a, scar_b from bd) p join sc a on a.mesh_id = p.mesh_id and a.scar_id = scar_a join sc b on b.mesh_id = p.mesh_id and b.scar_id = scar_b)"


def _ordering(spark, sf):
    v, f = _vf(spark, sf)
    w = _working(v, f)
    scars = S.identify(w)
    pairs = S.adjacency(T.vertex_edges(f), S.scar_vertices(w, scars)).select("mesh_id", "scar_a", "scar_b").distinct()
    return scars, pairs


@query("d7_preseed_by_size", sql("select mesh_id, younger, older, 'preseed' as source from ps", MAJ, SCARS, ADJ, PRE))
def d7(spark, sf):
    scars, pairs = _ordering(spark, sf)
    return O.preseed_by_size(pairs, scars)


@query("d1_replayed_comparisons", sql("select mesh_id, younger, older, 'preseed' as source from ps", MAJ, SCARS, ADJ, PRE))
def d1(spark, sf):
    scars, pairs = _ordering(spark, sf)
    log = O.preseed_by_size(pairs, scars).select("mesh_id", (F.col("younger") * 100 + F.col("older")).cast("int").alias("seq"), F.lit("add").alias("op"), "younger", "older", "source")
    return O.replay_comparisons(log)


@query("d2_remove_and_clear", sql("select mesh_id, younger, older, 'expert' as source from ps where (younger + older) % 2 = 0 and younger <> 0", MAJ, SCARS, ADJ, PRE))
def d2(spark, sf):
    scars, pairs = _ordering(spark, sf)
    p = O.preseed_by_size(pairs, scars)
    seq = (F.col("younger") * 100 + F.col("older")).cast("int")
    kind = F.when((F.col("younger") + F.col("older")) % 2 == 0, "expert").otherwise("preseed")
    add = p.select("mesh_id", seq.alias("seq"), F.lit("add").alias("op"), "younger", "older", kind.alias("source"))
    gone = p.where("younger = 0").select("mesh_id", (seq + 100_000).alias("seq"), F.lit("remove").alias("op"), "younger", "older", F.lit("").alias("source"))
    clear = p.select("mesh_id").distinct().select("mesh_id", F.lit(1_000_000).alias("seq"), F.lit("clear_preseed").alias("op"), F.lit(0).alias("younger"), F.lit(0).alias("older"), F.lit("").alias("source"))
    return O.replay_comparisons(add.unionByName(gone).unionByName(clear))


@query("d3_reachability", sql("select * from cl", MAJ, SCARS, ADJ, PRE, "cl(mesh_id, younger, older) as (select mesh_id, younger, older from ps union select cl.mesh_id, cl.younger, ps.older from cl join ps on ps.mesh_id = cl.mesh_id and ps.younger = cl.older)", recursive=True))
def d3(spark, sf):
    scars, pairs = _ordering(spark, sf)
    return O.reachable(O.preseed_by_size(pairs, scars))


@query("d4_topological_order", None)
def d4(spark, sf):
    scars, pairs = _ordering(spark, sf)
    return O.topological_order(scars, O.preseed_by_size(pairs, scars))


@query("d5_oldest_first", None)
def d5(spark, sf):
    scars, pairs = _ordering(spark, sf)
    own = scars.where("mesh_id % 2 = 0").select("mesh_id", "scar_id", F.col("representative_vertex").alias("temporal_order"))
    return O.oldest_first(O.topological_order(scars, O.preseed_by_size(pairs, scars)), own)


@query("d6_fully_ordered", sql("select distinct mesh_id, true as fully_ordered from sc", MAJ, SCARS))
def d6(spark, sf):
    scars, pairs = _ordering(spark, sf)
    return O.fully_ordered(scars, O.topological_order(scars, O.preseed_by_size(pairs, scars)))


@query("d8_order_to_comparisons", sql("select p.mesh_id, case when a.representative_vertex > b.representative_vertex then scar_a else scar_b end as younger, case when a.representative_vertex > b.representative_vertex then scar_b else scar_a end as older, 'expert' as source from (select distinct mesh_id, scar_a, scar_b from bd) p join sc a on a.mesh_id = p.mesh_id and a.scar_id = scar_a join sc b on b.mesh_id = p.mesh_id and b.scar_id = scar_b where a.vertex_count > 2 and b.vertex_count > 2", MAJ, SCARS, ADJ))
def d8(spark, sf):
    scars, pairs = _ordering(spark, sf)
    return O.from_global_order(pairs, scars.where("vertex_count > 2").select("mesh_id", "scar_id", F.col("representative_vertex").alias("rank")))


@query("d9_comparisons_of_scar", sql("select mesh_id, younger, older, 'preseed' as source, case when younger = 1 then 'younger' else 'older' end as side from ps where younger = 1 or older = 1", MAJ, SCARS, ADJ, PRE))
def d9(spark, sf):
    scars, pairs = _ordering(spark, sf)
    return O.comparisons_of(O.preseed_by_size(pairs, scars), 1)


@query("d10_serialise_restore", sql("select mesh_id, younger, older, 'preseed' as source from ps", MAJ, SCARS, ADJ, PRE))
def d10(spark, sf):
    v, f = _vf(spark, sf)
    _, scars, _, edges = S.scar_graph(v, f, demo.pred_labels(v))
    return O.restorable(O.serialise(scars, edges, O.preseed_by_size(edges, scars)), scars)


@query("d11_display_order", sql("select mesh_id, scar_id, (row_number() over (partition by mesh_id order by case when vertex_count > 5 then representative_vertex end asc nulls last, scar_id))::int as shown from sc", MAJ, SCARS))
def d11(spark, sf):
    scars, _ = _ordering(spark, sf)
    rows = O.display_order(scars, scars.where("vertex_count > 5").select("mesh_id", "scar_id", F.col("representative_vertex").alias("rank")))
    return rows.select("mesh_id", "scar_id", "shown")


@query("u6_label_vector", sql("select v.mesh_id, v.vertex_id, (case when bal < 0 then 1 else 0 end)::int as label from v"))
def u6(spark, sf):
    v = demo.vertices(spark, sf)
    beyond = v.groupBy("mesh_id").agg((F.max("vertex_id") + 1).alias("vertex_id"))
    return A.to_label_vector(v, demo.edge_vertices(v).unionByName(beyond))


FLAGSHIP = f"select mesh_id, label, vertex_count, surface_area, max_dimension, (row_number() over (partition by mesh_id order by vertex_count desc, label))::int as rank from ({_metrics_sql('seg')})"


@query("flagship_ranked_segments", sql(FLAGSHIP, FLOOD, recursive=True))
def flagship(spark, sf):
    v, f = _vf(spark, sf)
    rows = rounded(S.segment_metrics(v, f, flood(spark, sf)), 10)
    return R.ranked(rows, "vertex_count", key="label").select("mesh_id", "label", "vertex_count", "surface_area", "max_dimension", "rank")
