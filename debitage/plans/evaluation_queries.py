"""Evaluation and score aggregation over the demo meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from debitage.operators import evaluate as E
from debitage.operators import geometry as G
from debitage.operators import scores as I
from debitage.operators import topology as T
from debitage.operators.auction import auction
from debitage.plans import demo
from debitage.plans.demo import sql, table
from debitage.plans.registry import query, rounded

BASE = """lp as (select mesh_id, vertex_id, g.label as gt, p.label as pred from gt g join pred p using (mesh_id, vertex_id)),
ga as (select mesh_id, gt, count(*) as gt_area from lp where gt <> 0 group by all), pa as (select mesh_id, pred, count(*) as pred_area from lp where pred <> 0 group by all),
ov as (select mesh_id, gt, pred, count(*) as intersection, any_value(gt_area) as gt_area, any_value(pred_area) as pred_area, count(*) / (any_value(gt_area) + any_value(pred_area) - count(*)) as iou, count(*) / any_value(gt_area) as gt_coverage, count(*) / any_value(pred_area) as pred_coverage
  from lp join ga using (mesh_id, gt) join pa using (mesh_id, pred) group by mesh_id, gt, pred)"""
GAPS = BASE.replace("join pred p", "join predg p")
#: The matching of largest total IoU, of equal ones that of low labels together, by dynamic programming over sets of taken predictions (labels 1 to 6).
_STEPS = ", ".join(
    ["d0 as (select distinct mesh_id, 0 as taken, 0.0::double as total, []::bigint[] as picks from lp)"]
    + [
        f"d{g} as (select mesh_id, taken, max(total) as total, arg_max(picks, total) as picks from (select * from d{g - 1} union all select d.mesh_id, d.taken | (1 << o.pred), d.total + o.iou - 1e-9 * o.gt * o.pred / 36, list_append(d.picks, {g} * 100 + o.pred) from d{g - 1} d join ov o on o.mesh_id = d.mesh_id and o.gt = {g} where (d.taken >> o.pred) & 1 = 0) group by mesh_id, taken)"
        for g in range(1, 7)
    ]
)
BEST = _STEPS + """, dm as (select mesh_id, unnest(arg_max(picks, total)) as pick from d6 group by mesh_id),
mt as (select ov.* from ov join dm on dm.mesh_id = ov.mesh_id and pick = gt * 100 + pred where iou >= 0.5)"""


def _labelled(spark, sf, gaps=False):
    v = demo.vertices(spark, sf)
    return E.labelled_pairs(demo.gt_labels(v), demo.pred_labels(v, gaps))


@query("j7_e1_overlap_counts", sql("select mesh_id, gt, pred, intersection, gt_area, pred_area from ov", BASE))
def e1(spark, sf):
    return E.overlaps(_labelled(spark, sf)).select("mesh_id", "gt", "pred", "intersection", "gt_area", "pred_area")


@query("e2_iou_coverage", sql("select mesh_id, gt, pred, round(iou, 6) as iou, round(gt_coverage, 6) as gt_coverage, round(pred_coverage, 6) as pred_coverage from ov", BASE))
def e2(spark, sf):
    return rounded(E.overlaps(_labelled(spark, sf)).select("mesh_id", "gt", "pred", "iou", "gt_coverage", "pred_coverage"))


@query("e3_optimal_matching", sql("select mesh_id, gt, pred, round(iou, 6) as iou from mt", BASE, BEST))
def e3(spark, sf):
    return rounded(E.optimal_matches(E.overlaps(_labelled(spark, sf))).select("mesh_id", "gt", "pred", "iou"))


@query("e3_sure_matches", sql("select mesh_id, gt, pred, round(iou, 6) as iou from ov where iou > 0.6667", BASE))
def e3_sure(spark, sf):
    # a pair over two thirds belongs to every optimum: it beats any two pairs that it excludes
    return rounded(E.optimal_matches(E.overlaps(_labelled(spark, sf)), 0.6667).select("mesh_id", "gt", "pred", "iou"))


BIDS = _STEPS + """, dm as (select mesh_id, unnest(arg_max(picks, total)) as pick from d6 group by mesh_id)"""


@query("e3_auction_total", sql("select mesh_id, count(*) as pairs, round(sum(iou), 6) as total from ov join dm using (mesh_id) where pick = gt * 100 + pred group by all", BASE, BIDS))
def e3_auction(spark, sf):
    ov = E.overlaps(_labelled(spark, sf))
    won = auction(ov.withColumn("component", F.lit(0)), E.BLOCK).join(ov, ["mesh_id", "gt", "pred"])
    return rounded(won.groupBy("mesh_id").agg(F.count("*").alias("pairs"), F.sum("iou").alias("total")))


PANOPTIC = """select m.mesh_id, n_gt, n_pred, tp, n_pred - tp as fp, n_gt - tp as fn, round(case when n_pred = 0 then 1 else tp / n_pred end, 6) as precision, round(case when n_gt = 0 then 1 else tp / n_gt end, 6) as recall,
 round(case when n_gt + n_pred = 0 then 1 when tp + (n_pred-tp)/2 + (n_gt-tp)/2 > 0 then s / (tp + (n_pred-tp)/2 + (n_gt-tp)/2) else 0 end, 6) as pq, round(case when n_gt + n_pred = 0 then 1 when tp + (n_pred-tp)/2 + (n_gt-tp)/2 > 0 then tp / (tp + (n_pred-tp)/2 + (n_gt-tp)/2) else 0 end, 6) as rq
 from (select mesh_id, (select count(*) from ga where ga.mesh_id = m.mesh_id) as n_gt, (select count(*) from pa where pa.mesh_id = m.mesh_id) as n_pred, (select count(*) from mt where mt.mesh_id = m.mesh_id) as tp, coalesce((select sum(iou) from mt where mt.mesh_id = m.mesh_id), 0) as s from m) m"""


def _panoptic(spark, sf):
    v = demo.vertices(spark, sf)
    lp = _labelled(spark, sf)
    return E.panoptic(demo.meshes(v), lp, E.optimal_matches(E.overlaps(lp)))


@query("e4_e5_panoptic_metrics", sql(PANOPTIC, BASE, BEST))
def e4(spark, sf):
    return rounded(_panoptic(spark, sf).select("mesh_id", "n_gt", "n_pred", "tp", "fp", "fn", "precision", "recall", "pq", "rq"))


def _split_sql(side: str) -> str:
    return f"select mesh_id, {side}, count(*) as fragments, round(sum({side}_coverage), 6) as total_coverage, sum(intersection)::bigint as affected from ov where {side}_coverage >= 0.1 group by all having count(*) > 1"


@query("e6_over_segmentation", sql(_split_sql("gt"), BASE))
def e6(spark, sf):
    return rounded(E.split_errors(E.overlaps(_labelled(spark, sf)), "gt", E.OVER).select("mesh_id", "gt", "fragments", "total_coverage", "affected"))


@query("e7_under_segmentation", sql(_split_sql("pred"), BASE))
def e7(spark, sf):
    return rounded(E.split_errors(E.overlaps(_labelled(spark, sf)), "pred", E.UNDER).select("mesh_id", "pred", "fragments", "total_coverage", "affected"))


def _missing_sql(side: str, area: str) -> str:
    return f"select mesh_id, {side}, area, round(best, 6) as best_coverage, case when best < 0.05 then 'complete' else 'partial' end as severity from (select a.mesh_id, a.{side}, any_value(a.{side}_area) as area, coalesce(max({side}_coverage), 0) as best from {area} a left join ov on ov.mesh_id = a.mesh_id and ov.{side} = a.{side} group by a.mesh_id, a.{side}) where best < 0.1"


@query("e8_e16_missing_gt", sql(_missing_sql("gt", "ga"), GAPS))
def e8(spark, sf):
    lp = _labelled(spark, sf, gaps=True)
    return rounded(E.missing(lp, E.overlaps(lp), "gt", E.OVER))


@query("e9_e16_missing_pred", sql(_missing_sql("pred", "pa"), BASE.replace("from gt g join pred p using (mesh_id, vertex_id)", "from predg g join gt p using (mesh_id, vertex_id)")))
def e9(spark, sf):
    v = demo.vertices(spark, sf)
    lp = E.labelled_pairs(demo.pred_labels(v, gaps=True), demo.gt_labels(v))
    return rounded(E.missing(lp, E.overlaps(lp), "pred", E.UNDER))


@query("e10_boundary_errors", sql("select mesh_id, gt, pred, round(iou, 6) as iou, intersection, gt_area - intersection as gt_only, pred_area - intersection as pred_only, gt_area, pred_area from mt", BASE, BEST))
def e10(spark, sf):
    return rounded(E.boundary_errors(E.optimal_matches(E.overlaps(_labelled(spark, sf)))))


CLASSES = """mg as (select a.mesh_id, a.gt from ga a left join ov on ov.mesh_id = a.mesh_id and ov.gt = a.gt group by all having coalesce(max(gt_coverage), 0) < 0.1),
mp as (select a.mesh_id, a.pred from pa a left join ov on ov.mesh_id = a.mesh_id and ov.pred = a.pred group by all having coalesce(max(pred_coverage), 0) < 0.1),
og as (select mesh_id, gt from ov where gt_coverage >= 0.1 group by all having count(*) > 1), up as (select mesh_id, pred from ov where pred_coverage >= 0.1 group by all having count(*) > 1),
cls as (select mesh_id, vertex_id, gt, pred, case when gt = 0 and pred = 0 then 'none' when (mesh_id, gt) in (select (mesh_id, gt) from mg) then 'missing_gt' when (mesh_id, pred) in (select (mesh_id, pred) from mp) then 'missing_pred'
 when (mesh_id, gt) in (select (mesh_id, gt) from og) then 'over_segmentation' when (mesh_id, pred) in (select (mesh_id, pred) from up) then 'under_segmentation' when (mesh_id, gt, pred) in (select (mesh_id, gt, pred) from mt) then 'matched' else 'boundary' end as error from lp)"""


def _classes(spark, sf, gaps=True):
    lp = _labelled(spark, sf, gaps)
    ov = E.overlaps(lp)
    matches = E.optimal_matches(ov)
    parts = [E.split_errors(ov, "gt", E.OVER), E.split_errors(ov, "pred", E.UNDER), E.missing(lp, ov, "gt", E.OVER), E.missing(lp, ov, "pred", E.UNDER)]
    return lp, matches, parts, E.vertex_classes(lp, matches, *parts)


@query("e12_vertex_classes", sql("select * from cls", GAPS, BEST, CLASSES))
def e12(spark, sf):
    return _classes(spark, sf)[3]


@query("e11_error_rollup", sql("select mesh_id, count(*) filter (where gt <> 0 or pred <> 0) as valid, " + ", ".join(f"count(*) filter (where error = '{n}') as {n}" for n in ("matched", "boundary", "missing_gt", "missing_pred", "over_segmentation", "under_segmentation")) + ", " + ", ".join(f"round(count(*) filter (where error = '{n}') / greatest(count(*) filter (where gt <> 0 or pred <> 0), 1), 6) as {n}_share" for n in ("matched", "boundary", "missing_gt", "missing_pred", "over_segmentation", "under_segmentation")) + " from cls group by mesh_id", GAPS, BEST, CLASSES))
def e11(spark, sf):
    return rounded(E.error_rollup(_classes(spark, sf)[3]))


@query("f9_error_selection", sql("select * from cls where error in ('matched', 'missing_gt')", GAPS, BEST, CLASSES))
def f9(spark, sf):
    return E.of_class(_classes(spark, sf)[3], "matched", "missing_gt")


@query("e15_match_details", sql("select mesh_id, vertex_id, case when error = 'matched' then 'matched' when g and not p then 'gt_only' when p and not g then 'pred_only' else 'other' end as detail from (select *, (mesh_id, gt) in (select (mesh_id, gt) from mt) as g, (mesh_id, pred) in (select (mesh_id, pred) from mt) as p from cls) where error in ('matched', 'boundary')", GAPS, BEST, CLASSES))
def e15(spark, sf):
    _, matches, _, classes = _classes(spark, sf)
    return E.match_details(classes, matches)


@query("e17_fragment_index", sql("select mesh_id, vertex_id, coalesce(i, -1)::int as fragment from lp join og using (mesh_id, gt) left join (select mesh_id, gt, pred, (row_number() over (partition by mesh_id, gt order by pred) - 1)::int as i from ov where gt_coverage >= 0.1) using (mesh_id, gt, pred)", GAPS, BEST, CLASSES))
def e17(spark, sf):
    lp, _, parts, _ = _classes(spark, sf)
    return E.fragment_index(lp, parts[0], "gt")


KINDS = {"over_gt": ("og2", "n", "affected"), "under_pred": ("up2", "n", "affected"), "missing_gt": ("mg2", "n", "area"), "missing_pred": ("mp2", "n", "area")}
ERRORS = """og2 as (select mesh_id, count(*) as n, sum(affected)::bigint as s from (select mesh_id, gt, sum(intersection) as affected from ov where gt_coverage >= 0.1 group by all having count(*) > 1) group by mesh_id),
up2 as (select mesh_id, count(*) as n, sum(affected)::bigint as s from (select mesh_id, pred, sum(intersection) as affected from ov where pred_coverage >= 0.1 group by all having count(*) > 1) group by mesh_id),
mg2 as (select mesh_id, count(*) as n, sum(gt_area)::bigint as s from mg join ga using (mesh_id, gt) group by mesh_id), mp2 as (select mesh_id, count(*) as n, sum(pred_area)::bigint as s from mp join pa using (mesh_id, pred) group by mesh_id),
er as (select mesh_id, valid, """ + ", ".join(f"coalesce({t}.n, 0) as n_{k}, coalesce({t}.s, 0) as {k}_vertices, case when valid > 0 then coalesce({t}.s, 0) / valid else 0 end as {k}_frac" for k, (t, *_) in KINDS.items()) + " from (select mesh_id, count(*) filter (where gt <> 0 or pred <> 0) as valid from lp group by mesh_id) " + " ".join(f"left join {t} using (mesh_id)" for t, *_ in KINDS.values()) + ")"
F1 = "case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end"
FULL = "pm as (select *, case when tp > 0 then s / tp end as sq from (select *, (select count(*) from mt where mt.mesh_id = p.mesh_id) as hits, coalesce((select sum(iou) from mt where mt.mesh_id = p.mesh_id), 0) as s from (" + PANOPTIC.replace(", 6)", ", 15)") + ") p))"


def _evaluated(spark, sf):
    lp, matches, parts, _ = _classes(spark, sf)
    return E.panoptic(demo.meshes(demo.vertices(spark, sf)), lp, matches), E.error_counts(lp, *parts)


def _fixed(value: str, d: int) -> str:
    """Ties go away from zero."""
    return f"format('{{:.{d}f}}', round({value}, {d}))"


REPORT = " || ".join(
    f"'{part}'" if k % 2 == 0 else part
    for k, part in enumerate(
        (
            "=== Instance Segmentation Summary ===\nGT instances: ", "n_gt", ", Pred instances: ", "n_pred", "\nTP: ", "tp", ", FP: ", "fp", ", FN: ", "fn",
            "\nPrecision: ", _fixed("precision", 3), ", Recall: ", _fixed("recall", 3), ", F1: ", _fixed(F1, 3),
            "\nPQ: ", _fixed("pq", 3), ", RQ: ", _fixed("rq", 3), ", SQ: ", f"coalesce({_fixed('sq', 3)}, 'N/A')",
            "\n\n=== Error Breakdown ===\nOver-segmentation: ", "n_over_gt", " GT instances split (", _fixed("over_gt_frac * 100", 1),
            "% vertices)\nUnder-segmentation: ", "n_under_pred", " pred instances merge multiple GT (", _fixed("under_pred_frac * 100", 1),
            "% vertices)\nMissing GT (false negatives): ", "n_missing_gt", " instances (", _fixed("missing_gt_frac * 100", 1),
            "% vertices)\nHallucinated pred (false positives): ", "n_missing_pred", " instances (", _fixed("missing_pred_frac * 100", 1), "% vertices)",
        )
    )
)


@query("e13_summary_report", sql(f"select mesh_id, {REPORT} as report from pm join er using (mesh_id)", GAPS, BEST, CLASSES, ERRORS, FULL))
def e13(spark, sf):
    return E.summary_report(*_evaluated(spark, sf))


FIELDS = {"$.general.nGtInstances": "n_gt", "$.general.nPredInstances": "n_pred", "$.detection.TP": "tp", "$.detection.FP": "fp", "$.detection.FN": "fn", "$.errors.nOversegGt": "n_over_gt", "$.errors.nUndersegPred": "n_under_pred", "$.errors.nMissingGt": "n_missing_gt", "$.errors.nMissingPred": "n_missing_pred"}
SHARES = {"$.detection.precision": "precision", "$.detection.recall": "recall", "$.panoptic.PQ": "pq", "$.panoptic.RQ": "rq", "$.panoptic.SQ": "sq", "$.errors.oversegFrac": "over_gt_frac", "$.errors.undersegFrac": "under_pred_frac", "$.errors.missingGtFrac": "missing_gt_frac", "$.errors.missingPredFrac": "missing_pred_frac", "$.thresholds.iouThresh": "0.5::double"}


@query("e14_metric_records", sql("select mesh_id, " + ", ".join(f"{c}::bigint as {p.rsplit('.', 1)[1]}" for p, c in FIELDS.items()) + ", " + ", ".join(f"round({c}, 6) as {p.rsplit('.', 1)[1]}" for p, c in SHARES.items()) + ", 'truth' as described from pm join er using (mesh_id)", GAPS, BEST, CLASSES, ERRORS, FULL))
def e14(spark, sf):
    metrics, errors = _evaluated(spark, sf)
    described = metrics.select("mesh_id", F.lit("truth").alias("gt_description"), F.lit("model").alias("pred_description"))
    r = E.metric_record(metrics, errors, described, F.lit(1704067200000))
    at = lambda p, kind: F.get_json_object("record", p).cast(kind)
    whole = [at(p, "long").alias(p.rsplit(".", 1)[1]) for p in FIELDS]
    parts = [at(p, "double").alias(p.rsplit(".", 1)[1]) for p in SHARES]
    return rounded(r.select("mesh_id", *whole, *parts, F.get_json_object("record", "$.general.gtDescription").alias("described")))


@query("e18_evaluate_annotations", None)
def e18(spark, sf):
    from debitage.operators.segment import flood_fill

    v = demo.vertices(spark, sf)
    edges = T.vertex_edges(demo.faces(v))
    gt = flood_fill(v, edges, demo.edge_vertices(v))
    pred = flood_fill(v, edges, v.where("bal < 400").select("mesh_id", "vertex_id"))
    lp = E.labelled_pairs(gt, pred)
    return rounded(E.panoptic(demo.meshes(v), lp, E.optimal_matches(E.overlaps(lp))).select("mesh_id", "n_gt", "n_pred", "tp", "fp", "fn", "precision", "recall", "f1", "pq", "rq"))


# pixels: lineitem as (mesh, view, face, logit); low quantities are background

PIX = """px as (select l_suppkey % 20 as mesh_id, l_linenumber as view_id, case when l_quantity < 5 then null else l_partkey % 50 end as face_id, l_discount as logit from lineitem),
fc as (select distinct mesh_id, view_id, face_id, case when (face_id + view_id) % 3 = 0 then 0.9 when (face_id + view_id) % 3 = 1 then 0.6 else 0.1 end as nz from px where face_id is not null),
vw as (select mesh_id, face_id, view_id, (m - lo) / case when hi > lo then hi - lo else 1 end as value, case when nz >= 0.8 then 3 when nz >= 0.5 then 2 else 1 end as weight from
 (select mesh_id, view_id, face_id, avg(logit) as m from px where face_id is not null group by all) join (select mesh_id, view_id, min(logit) as lo, max(logit) as hi from px group by all) using (mesh_id, view_id) join fc using (mesh_id, view_id, face_id))"""


def _pixels(spark, sf):
    li = table(spark, sf, "lineitem")
    px = li.select((F.col("l_suppkey") % 20).alias("mesh_id"), F.col("l_linenumber").alias("view_id"), F.when(F.col("l_quantity") >= 5, F.col("l_partkey") % 50).alias("face_id"), F.col("l_discount").alias("logit"))
    k = (F.col("face_id") + F.col("view_id")) % 3
    facing = px.where("face_id is not null").select("mesh_id", "view_id", "face_id", F.when(k == 0, 0.9).when(k == 1, 0.6).otherwise(0.1).alias("nz")).distinct()
    return px, facing


@query("i1_view_scores", f"with {PIX} select mesh_id, face_id, view_id, round(value, 6) as value, weight from vw")
def i1(spark, sf):
    return rounded(I.view_scores(*_pixels(spark, sf)))


@query("i2_weighted_mean", f"with {PIX} select mesh_id, face_id, round(coalesce(p, 0), 6) as p from (select distinct mesh_id from px) cross join (select unnest(range(55)) as face_id) left join (select mesh_id, face_id, sum(value*weight)/sum(weight) as p from vw group by all) using (mesh_id, face_id)")
def i2(spark, sf):
    px, facing = _pixels(spark, sf)
    faces = px.select("mesh_id").distinct().select("mesh_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(54).cast("long"))).alias("face_id"))
    return rounded(I.weighted_mean(faces, I.view_scores(px, facing)))


GAMMA = ", ".join(
    ["p0 as (select mesh_id, face_id, case when p > 0.8 then p else 0 end as p from fs)"]
    + [f"p{k} as (select c.mesh_id, c.face_id, case when c.p > 0 then c.p else coalesce(g, 0) end as p from p{k - 1} c left join (select fa.mesh_id, fa.face_id, max(n.p) * 0.95 as g from fa join p{k - 1} n on n.mesh_id = fa.mesh_id and n.face_id = nbr where n.p > 0 group by all) using (mesh_id, face_id))" for k in range(1, 13)]
)


@query("g24_gamma_propagation", sql("select mesh_id, face_id, round(p, 6) as p from p12", GAMMA))
def g24(spark, sf):
    v = demo.vertices(spark, sf)
    f = demo.faces(v)
    s = demo.face_scores(v, f).select("mesh_id", "face_id", F.when(F.col("p") > 0.8, F.col("p")).otherwise(0.0).alias("p"))
    return rounded(I.propagate_gamma(s, T.face_adjacency(f), max_steps=13))


@query("i6_score_pipeline", None)
def i6(spark, sf):
    v = demo.vertices(spark, sf)
    f = demo.faces(v)
    px, facing = _pixels(spark, sf)
    adj = T.face_adjacency(f)
    seen = I.weighted_mean(f, I.view_scores(px, facing))
    sharp = G.face_sharpness(adj, G.face_normals(G.face_points(f, G.pca_aligned(v)), soft=True))
    p = I.propagate_gamma(seen, adj)
    return rounded(p.join(T.spread(sharp), ["mesh_id", "face_id"]))


@query("i3_canonical_views", None)
def i3(spark, sf):
    views = I.views_table(spark)
    n = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("mesh_id")).distinct()
    return rounded(n.join(F.broadcast(views)))
