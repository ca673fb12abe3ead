"""Instance-segmentation evaluation: ground truth against prediction, sparse pairs throughout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debitage.functions.scalars import fixed
from debitage.iterate import MAX_ROUNDS, connected_components, tabled
from debitage.operators.auction import auction
from debitage.operators.topology import M

IOU = 0.5
OVER = 0.1
UNDER = 0.1


def labelled_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, gt, pred from two labellings of the same vertices."""
    return gt.select(M, "vertex_id", F.col("label").alias("gt")).join(pred.select(M, "vertex_id", F.col("label").alias("pred")), [M, "vertex_id"])


def areas(labelled: DataFrame, side: str) -> DataFrame:
    """mesh_id, <side>, area: vertices of each non-zero label."""
    return labelled.where(F.col(side) != 0).groupBy(M, side).agg(F.count("*").alias("area"))


def overlaps(labelled: DataFrame) -> DataFrame:
    """mesh_id, gt, pred, intersection, gt_area, pred_area, iou, gt_coverage, pred_coverage of every overlapping pair."""
    pairs = labelled.where("gt <> 0 and pred <> 0").groupBy(M, "gt", "pred").agg(F.count("*").alias("intersection"))
    a = areas(labelled, "gt").withColumnRenamed("area", "gt_area")
    b = areas(labelled, "pred").withColumnRenamed("area", "pred_area")
    i = F.col("intersection")
    return pairs.join(a, [M, "gt"]).join(b, [M, "pred"]).select(
        M,
        "gt",
        "pred",
        "intersection",
        "gt_area",
        "pred_area",
        (i / (F.col("gt_area") + F.col("pred_area") - i)).alias("iou"),
        (i / F.col("gt_area")).alias("gt_coverage"),
        (i / F.col("pred_area")).alias("pred_coverage"),
    )


def assignment(cost: list[list[float]]) -> list[tuple[int, int]]:
    """The (row, column) pairs of least total cost that use up the shorter side: shortest augmenting paths."""

    c = np.asarray(cost, float)
    flip = c.shape[0] > c.shape[1]
    c = c.T if flip else c
    rows, cols = c.shape
    u, v, owner = np.zeros(rows), np.zeros(cols), np.full(cols, -1)
    for r in range(rows):
        reach, via, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        row, last = r, -1
        while True:
            better = ~done & (c[row] - u[row] - v + (reach[last] if last >= 0 else 0) < reach)
            reach = np.where(better, c[row] - u[row] - v + (reach[last] if last >= 0 else 0), reach)
            via[better] = last
            last = int(np.where(done, np.inf, reach).argmin())
            done[last] = True
            if owner[last] < 0:
                break
            row = owner[last]
        low = reach[last]
        u[r] += low
        for k in np.flatnonzero(done):
            if k != last:
                u[owner[k]] += low - reach[k]
                v[k] -= low - reach[k]
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else r
            last = before
    found = [(int(owner[k]), k) for k in range(cols) if owner[k] >= 0]
    return sorted((b, a) if flip else (a, b) for a, b in found)


#: Overlapping pairs of a component that one task solves as it is; larger ones lose the pairs that are sure, and bid for the rest.
DENSE = 20_000
#: Offers that bidders of a task settle among themselves: no matrix, so far more than DENSE.
BLOCK = 1_000_000
#: Equally good matchings are told apart by so little: low labels together first.
TIE = 1e-9


def sure_matches(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs that every optimal matching holds, pairs that are left) of overlaps (mesh_id, gt, pred, iou).

    A pair that beats the best other pair of its one label and that of its other together
    can't be missing: whatever the two were matched to instead is worth less.  Pairs of
    matched labels go, and the rest is looked at again until nothing more is sure.
    """
    left, sure = tabled(pairs.select(M, "gt", "pred", "iou")), None
    for _ in range(MAX_ROUNDS):
        seen = left
        for side, other in (("gt", "pred"), ("pred", "gt")):
            best = left.groupBy(M, side).agg(F.max(F.struct("iou", other)).alias("best"))
            seen = seen.join(best, [M, side])
            second = seen.where(F.col(other) != F.col(f"best.{other}")).groupBy(M, side).agg(F.max("iou").alias("second"))
            rival = F.when(F.col(other) == F.col(f"best.{other}"), F.coalesce("second", F.lit(0.0))).otherwise(F.col("best.iou"))
            seen = seen.join(second, [M, side], "left").withColumn(f"{side}_rival", rival).drop("best", "second")
        now = tabled(seen.where(F.col("iou") > F.col("gt_rival") + F.col("pred_rival") + 2 * TIE).select(M, "gt", "pred"))
        if now.isEmpty():
            break
        sure = now if sure is None else sure.unionByName(now)
        left = tabled(left.join(now.select(M, "gt"), [M, "gt"], "left_anti").join(now.select(M, "pred"), [M, "pred"], "left_anti"))
    return (left.select(M, "gt", "pred").limit(0) if sure is None else sure), left


def optimal_matches(pairs: DataFrame, iou: float = IOU, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """pairs (overlaps) of the matching with the largest sum of IoU, those of at least ``iou``.

    Labels that don't overlap, even through others, can't affect each other, so each
    connected component of the overlap graph is solved on its own.  Those of over ``dense``
    pairs first lose their sure matches, which leaves most of them in small pieces; pieces
    that still are larger go by auction, in tasks of about ``block`` offers.  Of equally
    good matchings the one with low labels together is taken, by auction any.
    """
    if iou <= 0:
        raise ValueError("pairs without overlap would count as matches")
    kinds = dict(pairs.dtypes)

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        table = p.pivot_table(index="gt", columns="pred", values="iou", fill_value=0.0)
        cost = 1 - table.values + TIE * np.outer(np.arange(1, len(table) + 1), np.arange(1, len(table.columns) + 1)) / table.size
        rows = [(p[M].iloc[0], table.index[a], table.columns[b]) for a, b in assignment(cost.tolist()) if table.values[a, b] > 0]
        return pd.DataFrame(rows, columns=[M, "gt", "pred"])

    def in_parts(own: DataFrame) -> DataFrame:
        edges = own.select(M, (F.col("gt").cast("long") * 2).alias("src"), (F.col("pred").cast("long") * 2 + 1).alias("dst"))
        parts = connected_components(edges, keys=[M]).where("node % 2 = 0").select(M, (F.col("node") / 2).cast("long").alias("gt"), "component")
        return own.select(M, F.col("gt").cast("long").alias("gt"), F.col("pred").cast("long").alias("pred"), "iou").join(parts, [M, "gt"])

    own = tabled(in_parts(pairs))
    def over(own: DataFrame) -> DataFrame:
        return tabled(own.groupBy(M, "component").agg(F.count("*").alias("n")).where(F.col("n") > dense).select(M, "component"))

    large, found = over(own), None
    if not large.isEmpty():
        found, left = sure_matches(own.join(large, [M, "component"], "left_semi"))
        own = own.join(large, [M, "component"], "left_anti")
        left = tabled(in_parts(left))
        large = over(left)
        if not large.isEmpty():
            found = found.unionByName(auction(left.join(large, [M, "component"], "left_semi"), block))
        own = own.unionByName(left.join(large, [M, "component"], "left_anti"))
    solved = own.groupBy(M, "component").applyInPandas(solve, f"{M} {kinds[M]}, gt long, pred long")
    found = solved if found is None else solved.unionByName(found)
    found = found.select(M, F.col("gt").cast(kinds["gt"]).alias("gt"), F.col("pred").cast(kinds["pred"]).alias("pred"))
    return pairs.join(found, [M, "gt", "pred"]).where(F.col("iou") >= iou)


def panoptic(meshes: DataFrame, labelled: DataFrame, matches: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, mean_iou, pq, sq, rq of every mesh; NaN where there is no match to average; all ones without labels."""
    n_gt = areas(labelled, "gt").groupBy(M).agg(F.count("*").alias("n_gt"))
    n_pred = areas(labelled, "pred").groupBy(M).agg(F.count("*").alias("n_pred"))
    hit = matches.groupBy(M).agg(F.count("*").alias("tp"), F.sum("iou").alias("s"))
    rows = meshes.join(n_gt, M, "left").join(n_pred, M, "left").join(hit, M, "left").fillna(0)
    tp, g, p = F.col("tp"), F.col("n_gt"), F.col("n_pred")
    nan = F.lit(float("nan"))
    empty = (g == 0) & (p == 0)
    rows = rows.withColumns({"precision": F.when(p == 0, 1.0).otherwise(tp / p), "recall": F.when(g == 0, 1.0).otherwise(tp / g), "weight": tp + (p - tp) / 2 + (g - tp) / 2})
    both = F.col("precision") + F.col("recall")
    return rows.select(
        M,
        "n_gt",
        "n_pred",
        "tp",
        (p - tp).alias("fp"),
        (g - tp).alias("fn"),
        "precision",
        "recall",
        F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"),
        F.when(tp > 0, F.col("s") / tp).otherwise(nan).alias("mean_iou"),
        F.when(empty, 1.0).when(F.col("weight") > 0, F.col("s") / F.col("weight")).otherwise(0.0).alias("pq"),
        F.when(tp > 0, F.col("s") / tp).otherwise(nan).alias("sq"),
        F.when(empty, 1.0).when(F.col("weight") > 0, tp / F.col("weight")).otherwise(0.0).alias("rq"),
    )


def split_errors(pairs: DataFrame, side: str, threshold: float) -> DataFrame:
    """Labels of one side that more than one label of the other covers to at least threshold.

    side "gt": over-segmentation; side "pred": under-segmentation.  parts lists the other
    labels in order with their share; affected sums the intersections.
    """
    other = "pred" if side == "gt" else "gt"
    share = F.col(f"{side}_coverage")
    found = pairs.where(share >= threshold).groupBy(M, side).agg(
        F.array_sort(F.collect_list(F.struct(F.col(other).alias("label"), share.alias("share"), "intersection"))).alias("parts"),
        F.sum(share).alias("total_coverage"),
        F.count("*").alias("fragments"),
        F.sum("intersection").alias("affected"),
    )
    return found.where("fragments > 1")


def missing(labelled: DataFrame, pairs: DataFrame, side: str, threshold: float) -> DataFrame:
    """mesh_id, <side>, area, best_coverage, severity of labels that nothing covers to threshold."""
    best = pairs.groupBy(M, side).agg(F.max(f"{side}_coverage").alias("best_coverage"))
    rows = areas(labelled, side).join(best, [M, side], "left").fillna(0.0, ["best_coverage"]).where(F.col("best_coverage") < threshold)
    return rows.withColumn("severity", F.when(F.col("best_coverage") < 0.05, "complete").otherwise("partial"))


def boundary_errors(matches: DataFrame) -> DataFrame:
    """Matches with the vertices on one side only."""
    return matches.select(M, "gt", "pred", "iou", "intersection", (F.col("gt_area") - F.col("intersection")).alias("gt_only"), (F.col("pred_area") - F.col("intersection")).alias("pred_only"), "gt_area", "pred_area")


def vertex_classes(labelled: DataFrame, matches: DataFrame, over: DataFrame, under: DataFrame, missing_gt: DataFrame, missing_pred: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, gt, pred, error: the first class that holds.

    The class depends on the two labels alone, so the distinct pairs are classified and
    the vertices looked up once.
    """

    def flag(df: DataFrame, side: str, name: str) -> DataFrame:
        return df.select(M, side).distinct().withColumn(name, F.lit(True))

    rows = labelled.select(M, "gt", "pred").distinct()
    for df, side, name in ((missing_gt, "gt", "_mg"), (missing_pred, "pred", "_mp"), (over, "gt", "_o"), (under, "pred", "_u")):
        rows = rows.join(flag(df, side, name), [M, side], "left")
    # a match's two labels are each other's only ones, so a matched pair is all that matters of them
    rows = rows.join(matches.select(M, "gt", "pred").withColumn("_pair", F.lit(True)), [M, "gt", "pred"], "left")
    kind = (
        F.when((F.col("gt") == 0) & (F.col("pred") == 0), "none")
        .when(F.col("_mg"), "missing_gt")
        .when(F.col("_mp"), "missing_pred")
        .when(F.col("_o"), "over_segmentation")
        .when(F.col("_u"), "under_segmentation")
        .when(F.col("_pair"), "matched")
        .otherwise("boundary")
    )
    classes = rows.select(M, "gt", "pred", kind.alias("error"))
    return labelled.join(classes, [M, "gt", "pred"]).select(M, "vertex_id", "gt", "pred", "error")


def error_rollup(classes: DataFrame) -> DataFrame:
    """Vertices and shares of valid vertices (either label non-zero) by class, one row a mesh."""
    names = ("matched", "boundary", "missing_gt", "missing_pred", "over_segmentation", "under_segmentation")
    valid = F.count(F.when((F.col("gt") != 0) | (F.col("pred") != 0), 1))
    rows = classes.groupBy(M).agg(valid.alias("valid"), *(F.count(F.when(F.col("error") == n, 1)).alias(n) for n in names))
    return rows.select("*", *((F.col(n) / F.greatest("valid", F.lit(1))).alias(f"{n}_share") for n in names))


def of_class(classes: DataFrame, *names: str) -> DataFrame:
    """Vertices of the given classes."""
    return classes.where(F.col("error").isin(*names))


def match_details(classes: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched and boundary vertices as matched, gt_only, pred_only or other."""
    g = matches.select(M, "gt", F.col("pred").alias("gt_mate"))
    p = matches.select(M, "pred", F.col("gt").alias("pred_mate"))
    rows = of_class(classes, "matched", "boundary").join(g, [M, "gt"], "left").join(p, [M, "pred"], "left")
    kind = F.when(F.col("error") == "matched", "matched").when(F.col("gt_mate").isNotNull() & F.col("pred_mate").isNull(), "gt_only").when(F.col("gt_mate").isNull() & F.col("pred_mate").isNotNull(), "pred_only").otherwise("other")
    return rows.select(M, "vertex_id", kind.alias("detail"))


def fragment_index(labelled: DataFrame, errors: DataFrame, side: str) -> DataFrame:
    """mesh_id, vertex_id, fragment: place of the vertex's other label in its side's list of parts, -1 if not in it."""
    other = "pred" if side == "gt" else "gt"
    parts = errors.select(M, side, F.posexplode("parts").alias("fragment", "p")).select(M, side, F.col("p.label").alias(other), "fragment")
    own = labelled.join(errors.select(M, side), [M, side], "left_semi")
    return own.join(parts, [M, side, other], "left").select(M, "vertex_id", F.coalesce("fragment", F.lit(-1)).alias("fragment"))


def error_counts(labelled: DataFrame, over: DataFrame, under: DataFrame, missing_gt: DataFrame, missing_pred: DataFrame) -> DataFrame:
    """mesh_id and, for each kind of error, its labels, their vertices and the share of valid vertices (either label non-zero)."""
    rows = labelled.groupBy(M).agg(F.count(F.when((F.col("gt") != 0) | (F.col("pred") != 0), 1)).alias("valid"))
    parts = {"over_gt": (over, "affected"), "under_pred": (under, "affected"), "missing_gt": (missing_gt, "area"), "missing_pred": (missing_pred, "area")}
    for name, (df, of) in parts.items():
        rows = rows.join(df.groupBy(M).agg(F.count("*").alias(f"n_{name}"), F.sum(of).alias(f"{name}_vertices")), M, "left")
    rows = rows.fillna(0, [c for c in rows.columns if c != M])
    return rows.select("*", *(F.when(F.col("valid") > 0, F.col(f"{n}_vertices") / F.col("valid")).otherwise(0.0).alias(f"{n}_frac") for n in parts))


def summary_report(metrics: DataFrame, errors: DataFrame) -> DataFrame:
    """mesh_id, report: eleven lines of text from panoptic() and error_counts(); N/A for a mean over nothing."""
    three = lambda c: fixed(F.col(c), 3)
    share = lambda n: F.concat(F.lit("("), fixed(F.col(f"{n}_frac") * 100, 1), F.lit("% vertices)"))
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    n = F.col
    rows = metrics.join(errors, M, "left").fillna(0, [c for c in errors.columns if c != M])
    # The wording of the report
    return rows.select(
        M,
        F.concat_ws(
            "\n",
            F.lit("=== Instance Segmentation Summary ==="),
            line("GT instances: ", n("n_gt"), ", Pred instances: ", n("n_pred")),
            line("TP: ", n("tp"), ", FP: ", n("fp"), ", FN: ", n("fn")),
            line("Precision: ", three("precision"), ", Recall: ", three("recall"), ", F1: ", three("f1")),
            line("PQ: ", three("pq"), ", RQ: ", three("rq"), ", SQ: ", F.when(F.isnan("sq"), "N/A").otherwise(three("sq"))),
            F.lit(""),
            F.lit("=== Error Breakdown ==="),
            line("Over-segmentation: ", n("n_over_gt"), " GT instances split ", share("over_gt")),
            line("Under-segmentation: ", n("n_under_pred"), " pred instances merge multiple GT ", share("under_pred")),
            line("Missing GT (false negatives): ", n("n_missing_gt"), " instances ", share("missing_gt")),
            line("Hallucinated pred (false positives): ", n("n_missing_pred"), " instances ", share("missing_pred")),
        ).alias("report"),
    )


def metric_record(metrics: DataFrame, errors: DataFrame, described: DataFrame, at: Column, iou: float = IOU, over: float = OVER, under: float = UNDER) -> DataFrame:
    """mesh_id, record: panoptic() and error_counts() as nested JSON, NaN null.

    described: mesh_id, gt_description, pred_description; at: the time of the computation in milliseconds.
    """
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = metrics.join(errors, M, "left").fillna(0, [c for c in errors.columns if c != M]).join(described, M, "left")
    # The names of the record's fields
    return rows.select(
        M,
        F.to_json(
            F.struct(
                F.struct(at.alias("computedAt"), F.col("gt_description").alias("gtDescription"), F.col("pred_description").alias("predDescription"), F.col("n_gt").alias("nGtInstances"), F.col("n_pred").alias("nPredInstances")).alias("general"),
                F.struct(*(F.col(c).alias(c.upper()) for c in ("tp", "fp", "fn")), "precision", "recall", "f1").alias("detection"),
                F.struct(F.col("pq").alias("PQ"), F.col("rq").alias("RQ"), clean("sq").alias("SQ")).alias("panoptic"),
                F.struct(
                    F.col("n_over_gt").alias("nOversegGt"),
                    F.col("over_gt_frac").alias("oversegFrac"),
                    F.col("n_under_pred").alias("nUndersegPred"),
                    F.col("under_pred_frac").alias("undersegFrac"),
                    F.col("n_missing_gt").alias("nMissingGt"),
                    F.col("missing_gt_frac").alias("missingGtFrac"),
                    F.col("n_missing_pred").alias("nMissingPred"),
                    F.col("missing_pred_frac").alias("missingPredFrac"),
                ).alias("errors"),
                F.struct(F.lit(iou).alias("iouThresh"), F.lit(over).alias("oversegThresh"), F.lit(under).alias("undersegThresh")).alias("thresholds"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("record"),
    )
