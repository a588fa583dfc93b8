"""The whole evaluation of an instance segmentation as one call."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from sylvaframe.operators import metrics as M
from sylvaframe.session import cut


class Evaluation(NamedTuple):
    """Metrics and per-instance rows; the last four are None unless partitions are asked for."""

    metrics: DataFrame
    instances: DataFrame
    partition_xy: DataFrame | None
    instances_xy: DataFrame | None
    partition_z: DataFrame | None
    instances_z: DataFrame | None


def evaluate(points: DataFrame, *, detection_rule: str = "panoptic_segmentation", segmentation_rule: str = "for_ai_net_coverage", partitions: int | None = None, include_unmatched: bool = True, group: str = "cloud_id") -> Evaluation:
    """points: group, target, prediction, x, y, z. Detection* and Segmentation* metrics per group."""
    found = M.match_instances(points, detection_rule, group)
    detection = M.detection_metrics(found, M.matched_predictions(points, found, group), group)
    matches = cut(M.match_instances(points, segmentation_rule, group))
    segmentation = M.segmentation_metrics(matches, group, include_unmatched)
    named = lambda df, prefix: df.select(group, *[df[c].alias(prefix + c) for c in df.columns if c != group])
    whole = named(detection, "Detection").join(named(segmentation, "Segmentation"), group, "left")
    rows = M.instance_metrics(matches, group)
    if partitions is None:
        return Evaluation(whole, rows, None, None, None, None)
    xy, z = (M.partition_metrics(points, matches, axis, partitions, group) for axis in ("xy", "z"))
    return Evaluation(whole, rows, M.partition_means(xy, group), xy, M.partition_means(z, group), z)
