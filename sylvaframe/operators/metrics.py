"""Evaluation: overlaps, matching, detection, segmentation and semantic metrics.

Everything starts from one aggregation, the counts per (target, prediction); what follows works
on pairs of instances, never on points again (but for the per-partition metrics).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaframe.schema import INVALID, UNCERTAIN, require

RULES = ("panoptic_segmentation", "for_ai_net", "for_ai_net_coverage", "point2tree", "for_instance", "tree_learn")


def overlaps(points: DataFrame, group: str = "cloud_id", target: str = "target", prediction: str = "prediction") -> DataFrame:
    """Points per (target_id, prediction_id); null labels count as no instance."""
    t, p = (F.coalesce(F.greatest(F.col(c), F.lit(INVALID)), F.lit(INVALID)) for c in (target, prediction))
    return points.groupBy(group, t.alias("target_id"), p.alias("prediction_id")).agg(F.count(F.lit(1)).alias("n"))


def pair_table(over: DataFrame, group: str = "cloud_id") -> DataFrame:
    """tp, fp, fn and iou of each pair of instances that share points."""
    t = over.where("target_id >= 0").groupBy(group, "target_id").agg(F.sum("n").alias("n_target"))
    p = over.where("prediction_id >= 0").groupBy(group, "prediction_id").agg(F.sum("n").alias("n_prediction"))
    both = over.where("target_id >= 0 AND prediction_id >= 0").join(t, [group, "target_id"]).join(p, [group, "prediction_id"])
    fp, fn = F.col("n_prediction") - F.col("n"), F.col("n_target") - F.col("n")
    return both.select(group, "target_id", "prediction_id", F.col("n").alias("tp"), fp.alias("fp"), fn.alias("fn"), (F.col("n") / (F.col("n") + fp + fn)).alias("iou"))


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the assignment of least total cost (shortest augmenting paths)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            free = ~used[1:]
            reduced = c[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = 1 + int(np.where(free, least[1:], np.inf).argmin())
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    rows, cols = owner[1:][owner[1:] > 0] - 1, np.flatnonzero(owner[1:] > 0)
    return (cols, rows) if flip else (rows, cols)


def _components(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Number of the connected set of each pair (t, p), by the smallest pair reached."""
    label = np.arange(len(t))
    while True:
        new = label.copy()
        for side in (t, p):
            least = np.full(side.max() + 1, len(t))
            np.minimum.at(least, side, new)
            new = least[side]
        if (new == label).all():
            return label
        label = new


def _assign(pdf: pd.DataFrame, rule: str) -> pd.DataFrame:
    """Matches of one cloud's pairs by a rule that looks at all of them together.

    The assignment is solved for each connected set of pairs by itself: a set holds the
    instances that overlap each other in a chain, never all of a cloud.
    """
    pdf = pdf.sort_values(["target_id", "prediction_id"], ignore_index=True)
    rows: list[tuple[int, int]] = []
    if rule == "tree_learn":
        if not len(pdf):
            return pd.DataFrame(columns=["target_id", "prediction_id"], dtype="int64")
        place = lambda c: np.unique(pdf[c], return_inverse=True)[1]
        for _, own in pdf.groupby(_components(place("target_id"), place("prediction_id"))):
            t, p = np.unique(own["target_id"]), np.unique(own["prediction_id"])
            iou = np.zeros((len(t), len(p)))
            iou[np.searchsorted(t, own["target_id"]), np.searchsorted(p, own["prediction_id"])] = own["iou"]
            i, j = hungarian(-iou)
            ok = iou[i, j] > 0.5
            rows += zip(t[i[ok]].tolist(), p[j[ok]].tolist(), strict=True)
        return pd.DataFrame(rows, columns=["target_id", "prediction_id"], dtype="int64")
    used: set[int] = set()
    pdf = pdf.sort_values(["height", "target_id", "iou", "prediction_id"], ascending=[False, True, False, True])
    done: int | None = None
    for target, prediction, iou in zip(pdf["target_id"].tolist(), pdf["prediction_id"].tolist(), pdf["iou"].tolist(), strict=True):
        if target == done or prediction in used:
            continue
        done = target  # its best free partner; whether that is good enough doesn't free the target
        if rule == "for_instance" and iou < 0.5:
            continue
        used.add(prediction)
        rows.append((target, prediction))
    return pd.DataFrame(rows, columns=["target_id", "prediction_id"], dtype="int64")


def match_pairs(pairs: DataFrame, rule: str, heights: DataFrame | None = None, group: str = "cloud_id") -> DataFrame:
    """Matched (target_id, prediction_id) with tp, fp, fn by one of RULES.

    ``heights`` (group, target_id, height) orders the targets of the greedy rules. Those rules
    and the assignment are sequential per cloud; they see pairs of instances, not points.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    if rule == "panoptic_segmentation":
        return pairs.where(F.col("iou") > 0.5).drop("iou")
    if rule == "for_ai_net":
        # at exactly a half two targets can claim one prediction: the smaller ids hold
        best = pairs.where(F.col("iou") >= 0.5)
        best = best.withColumn("__t", F.row_number().over(W.partitionBy(group, "target_id").orderBy(F.desc("iou"), "prediction_id")))
        best = best.withColumn("__p", F.row_number().over(W.partitionBy(group, "prediction_id").orderBy(F.desc("iou"), "target_id")))
        return best.where("__t = 1 AND __p = 1").drop("iou", "__t", "__p")
    if rule == "for_ai_net_coverage":
        cols = ["prediction_id", "tp", "fp", "fn"]
        best = pairs.groupBy(group, "target_id").agg(F.max_by(F.struct(*cols), F.struct("iou", -F.col("prediction_id"))).alias("b"))
        return best.select(group, "target_id", "b.*")
    rows = pairs
    if rule == "tree_learn":
        rows = rows.withColumn("height", F.lit(0.0))
    else:
        if heights is None:
            raise ValueError(f"{rule} needs the targets' heights")
        rows = rows.join(heights.select(group, "target_id", "height"), [group, "target_id"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _assign(pdf, rule)
        out.insert(0, group, key[0])
        return out

    chosen = rows.groupBy(group).applyInPandas(run, f"{group} string, target_id bigint, prediction_id bigint")
    return chosen.join(pairs.drop("iou"), [group, "target_id", "prediction_id"])


def target_heights(points: DataFrame, group: str = "cloud_id", target: str = "target") -> DataFrame:
    return points.where(F.col(target) >= 0).groupBy(group, F.col(target).alias("target_id")).agg((F.max("z") - F.min("z")).alias("height"))


def match_instances(points: DataFrame, rule: str = "panoptic_segmentation", group: str = "cloud_id") -> DataFrame:
    """Every target with its match: target_id, prediction_id (-1: none), tp, fp, fn.

    Unmatched targets have tp = fp = 0 and fn = their number of points.
    """
    require(points, group, "target", "prediction", "z")
    over = overlaps(points, group)
    found = match_pairs(pair_table(over, group), rule, target_heights(points, group), group)
    size = over.where("target_id >= 0").groupBy(group, "target_id").agg(F.sum("n").alias("__n"))
    out = size.join(found, [group, "target_id"], "left")
    return out.select(group, "target_id", F.coalesce("prediction_id", F.lit(INVALID)).alias("prediction_id"), F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"), F.coalesce("fn", "__n").alias("fn"))


def matched_predictions(points: DataFrame, matches: DataFrame, group: str = "cloud_id", *, labelled: Column | None = None, min_precision: float | None = None, height: Column | str | None = None, min_height: float | None = None) -> DataFrame:
    """Every prediction with its target (-1: false positive, -2: can't be judged).

    An unmatched prediction is uncertain when less than ``min_precision`` of its points are
    labelled (by default: belong to a target), or when none of its points is ``min_height`` above
    the terrain (``height``: a column of the points, such as height_above_terrain gives).
    """
    p = points.where("prediction >= 0").groupBy(group, F.col("prediction").alias("prediction_id"))
    share = F.avg(F.coalesce(labelled if labelled is not None else F.col("target") >= 0, F.lit(False)).cast("int"))
    if min_height is not None and height is None:
        raise ValueError("min_height needs the points' height above the terrain")
    top = F.max(F.col(height) if isinstance(height, str) else height) if min_height is not None else F.lit(None).cast("double")
    best = matches.where("prediction_id >= 0").groupBy(group, "prediction_id").agg(F.min("target_id").alias("t"))
    out = p.agg(share.alias("share"), top.alias("top")).join(best, [group, "prediction_id"], "left")
    doubt = F.lit(False)
    if min_precision is not None:
        doubt = doubt | (F.col("share") < min_precision)
    if min_height is not None:
        doubt = doubt | (F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0)) < min_height)
    return out.select(group, "prediction_id", F.coalesce("t", F.when(doubt, UNCERTAIN).otherwise(INVALID)).cast("bigint").alias("target_id"))


def _ratios(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [
        precision.alias("Precision"),
        (1 - precision).alias("CommissionError"),
        recall.alias("Recall"),
        (1 - recall).alias("OmissionError"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("F1Score"),
    ]


def detection_metrics(target_matches: DataFrame, prediction_matches: DataFrame, group: str = "cloud_id") -> DataFrame:
    """TP, FP, FN and ratios per group; undefined ratios are null."""
    t = target_matches.select(group, F.when(F.col("prediction_id") >= 0, "TP").when(F.col("prediction_id") == INVALID, "FN").alias("k"))
    p = prediction_matches.select(group, F.when(F.col("target_id") == INVALID, "FP").alias("k"))
    n = t.unionByName(p).groupBy(group).agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("TP", "FP", "FN")])
    return n.select(group, "TP", "FP", "FN", *_ratios(F.col("TP"), F.col("FP"), F.col("FN")))


def instance_metrics(matches: DataFrame, group: str = "cloud_id") -> DataFrame:
    """TargetID, PredictionID, IoU, Precision, Recall; unmatched: 0, null, 0."""
    hit = F.col("prediction_id") >= 0
    return matches.select(
        group, F.col("target_id").alias("TargetID"), F.col("prediction_id").alias("PredictionID"),
        F.when(hit, F.try_divide("tp", F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("IoU"),
        F.when(hit, F.try_divide("tp", F.col("tp") + F.col("fp"))).alias("Precision"),
        F.when(hit, F.try_divide("tp", F.col("tp") + F.col("fn"))).otherwise(0.0).alias("Recall"),
    )


def segmentation_metrics(matches: DataFrame, group: str = "cloud_id", include_unmatched: bool = True) -> DataFrame:
    """MeanIoU, MeanPrecision (of those defined), MeanRecall per group."""
    rows = instance_metrics(matches, group)
    if not include_unmatched:
        rows = rows.where("PredictionID >= 0")
    return rows.groupBy(group).agg(*[F.avg(c).alias(f"Mean{c}") for c in ("IoU", "Precision", "Recall")])


def partition_metrics(points: DataFrame, matches: DataFrame, axis: str, n_bins: int = 10, group: str = "cloud_id") -> DataFrame:
    """Metrics of each matched target by distance from its foot ('xy') or height in it ('z').

    TargetID, PredictionID, Partition, IoU, Precision, Recall. Distances are in units of the
    target's 95 % quantile; what lies beyond is left out. Bins hold all points that belong to
    the target or to its match, so one union of two equi-joins reads every point at most twice.
    """
    if axis not in ("xy", "z"):
        raise ValueError("axis must be 'xy' or 'z'")
    if n_bins < 1:
        raise ValueError("there must be at least one partition")
    own = points.where("target >= 0").select(group, F.col("target").alias("t"), "x", "y", "z")
    low = own.groupBy(group, "t").agg(F.min("z").alias("z0"))
    own = own.join(low, [group, "t"])
    foot = own.where(F.col("z") <= F.col("z0") + 0.30).groupBy(group, "t").agg(F.avg("x").alias("x0"), F.avg("y").alias("y0"))
    dist = F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) if axis == "xy" else F.col("z") - F.col("z0")
    own = own.join(foot, [group, "t"])
    scale = own.groupBy(group, "t", "z0", "x0", "y0").agg(F.percentile(dist, 0.95).alias("scale"))
    ref = scale.join(matches.select(group, F.col("target_id").alias("t"), F.col("prediction_id").alias("p")), [group, "t"]).where("p >= 0")
    rows = points.select(group, F.coalesce("target", F.lit(-1)).alias("pt"), F.coalesce("prediction", F.lit(-1)).alias("pp"), "x", "y", "z")
    by_t = rows.where("pt >= 0").join(ref.withColumnRenamed(group, "__g"), (F.col(group) == F.col("__g")) & (F.col("pt") == F.col("t")))
    by_p = rows.where("pp >= 0").join(ref.withColumnRenamed(group, "__g"), (F.col(group) == F.col("__g")) & (F.col("pp") == F.col("p")) & (F.col("pt") != F.col("t")))
    both = by_t.unionByName(by_p)
    both = both.withColumn("bin", F.floor(F.try_divide(dist, F.col("scale")) * n_bins)).where((F.col("bin") >= 0) & (F.col("bin") < n_bins))
    is_t, is_p = F.col("pt") == F.col("t"), F.col("pp") == F.col("p")
    n = both.groupBy(group, "t", "p", "bin").agg(F.count_if(is_t & is_p).alias("tp"), F.count_if(~is_t & is_p).alias("fp"), F.count_if(is_t & ~is_p).alias("fn"))
    return n.select(
        group, F.col("t").alias("TargetID"), F.col("p").alias("PredictionID"), F.col("bin").alias("Partition"),
        F.try_divide("tp", F.col("tp") + F.col("fp") + F.col("fn")).alias("IoU"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("Precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("Recall"),
    )


def partition_means(rows: DataFrame, group: str = "cloud_id") -> DataFrame:
    return rows.groupBy(group, "Partition").agg(*[F.avg(c).alias(f"Mean{c}") for c in ("IoU", "Precision", "Recall")])


def semantic_metrics(points: DataFrame, target: str, prediction: str, classes: list[int], aggregates: dict[str, list[int]] | None = None, group: str = "cloud_id") -> DataFrame:
    """Per group and class or union of classes: name, is_aggregate, tp, fp, fn, IoU, Precision, Recall.

    One confusion matrix; a point whose two classes lie in the same union is right for it.
    """
    sets = [(str(c), False, [c]) for c in classes] + [(k, True, v) for k, v in (aggregates or {}).items()]
    matrix = points.groupBy(group, F.col(target).alias("t"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    has = lambda c, m: F.coalesce(F.array_contains(m, F.col(c)), F.lit(False))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("is_aggregate"), F.array(*[F.lit(int(x)) for x in m]).cast("array<bigint>").alias("members")) for n, a, m in sets])).alias("c")
    rows = matrix.select(group, "t", "p", "n", named).select(group, "t", "p", "n", "c.*")
    t, p = has("t", F.col("members")), has("p", F.col("members"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    n = rows.groupBy(group, "name", "is_aggregate").agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"))
    return n.select("*", F.try_divide("tp", F.col("tp") + F.col("fp") + F.col("fn")).alias("IoU"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("Precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("Recall"))


def inventory(points: DataFrame, group: str = "cloud_id", label: str = "instance_id") -> DataFrame:
    """Points, tree points, trees and complete trees (with trunk and crown) per group."""
    by_tree = points.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("cls") == 1, F.lit(False))).alias("trunk"), F.bool_or(F.coalesce(F.col("cls") == 2, F.lit(False))).alias("crown"))
    tree = F.coalesce(F.col(label) >= 0, F.lit(False))
    return by_tree.groupBy(group).agg(F.sum("n").alias("n_points"), F.sum(F.when(tree, F.col("n")).otherwise(0)).alias("n_tree_points"), F.count_if(tree).alias("n_trees"), F.count_if(tree & F.col("trunk") & F.col("crown")).alias("n_complete"))


def pooled_totals(matches: DataFrame, false_positives: DataFrame, dataset: Column, group: str = "cloud_id") -> DataFrame:
    """dataset, group (null: the whole): TP, FP, FN, F1Score, MeanIoU, PanopticQuality by ROLLUP."""
    hit = F.col("prediction_id") >= 0
    t = matches.select(dataset.alias("dataset"), group, hit.cast("int").alias("TP"), F.lit(0).alias("FP"), (~hit).cast("int").alias("FN"), F.when(hit, F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))).alias("iou"))
    p = false_positives.select(dataset.alias("dataset"), group, F.lit(0).alias("TP"), F.lit(1).alias("FP"), F.lit(0).alias("FN"), F.lit(None).cast("double").alias("iou"))
    n = t.unionByName(p).rollup("dataset", group).agg(*[F.sum(c).alias(c) for c in ("TP", "FP", "FN")], F.avg("iou").alias("MeanIoU"))
    f1 = F.try_divide(2 * F.col("TP"), 2 * F.col("TP") + F.col("FP") + F.col("FN"))
    return n.select("dataset", group, "TP", "FP", "FN", f1.alias("F1Score"), "MeanIoU", (f1 * F.col("MeanIoU")).alias("PanopticQuality"))


def ablation(rows: DataFrame, variants: list[str], *, variant: str = "variant", value: str = "PanopticQuality", by: tuple[str, ...] = ("cloud_id",)) -> DataFrame:
    """A column per variant with its value for each ``by``; the first by size where a row is repeated, null where none."""
    require(rows, variant, value, *by)
    return rows.groupBy(*by).pivot(variant, variants).agg(F.min(value))


def run_times(rows: DataFrame, groups: dict[str, list[str]], *, description: str = "description", value: str = "wall_s", by: tuple[str, ...] = ()) -> DataFrame:
    """by, step, place, value: run times summed by named groups of descriptions, in the order of ``groups``.

    Descriptions that no group names are summed as 'Other', last; null values count as 0.
    """
    require(rows, description, value, *by)
    step = F.lit("Other")
    for name, members in reversed(list(groups.items())):
        step = F.when(F.col(description).isin(*members), name).otherwise(step)
    order = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in groups]), F.col("step")), F.lit(0))
    sums = rows.withColumn("step", step).groupBy(*by, "step").agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias(value))
    return sums.select(*by, "step", F.when(order == 0, len(groups) + 1).otherwise(order).cast("int").alias("place"), value)
