"""The evaluation report end to end: match once, then points, intervals and the headline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bootstrap import REPLICATES, bootstrap_slices
from ..operators.matching import gt_counts, match
from ..operators.metrics import evaluate_slices, mean_metrics, merge_intervals, slice_universe


def slice_metrics(suite: str, images: DataFrame, gt: DataFrame, regions: DataFrame, detections: DataFrame, classes: Sequence[int], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(suite, axis, bucket, metric, class_id, point, ci_low, ci_high, n_gt, n_images): ap50 and ap by
    class, map50 and map over classes. `images` has image_id, weather and camera and is the universe:
    detections of other images do not count, images without boxes do."""
    known = detections.join(images.select("image_id"), "image_id", "left_semi")
    matched = match(known, gt, regions).persist()
    counts = gt_counts(gt)
    aps = evaluate_slices(matched, counts, images, classes).persist()
    per_class = aps.groupBy("axis", "bucket", "class_id").agg(F.avg(F.when(F.col("iou_thr") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap"), F.max("n_gt").alias("n_gt"))
    one = per_class.select("axis", "bucket", "class_id", "n_gt", F.explode(F.create_map(F.lit("ap50"), "ap50", F.lit("ap"), "ap")).alias("metric", "point"))
    whole = mean_metrics(aps).select("axis", "bucket", F.lit(None).cast(dict(gt.dtypes)["class_id"]).alias("class_id"), "n_gt", F.explode(F.create_map(F.lit("map50"), "map50", F.lit("map"), "map")).alias("metric", "point"))
    points = one.unionByName(whole).withColumn("__c", F.coalesce("class_id", F.lit(-1)))
    intervals = bootstrap_slices(matched, counts, images, replicates, seed).withColumn("__c", F.coalesce("class_id", F.lit(-1)))
    out = merge_intervals(points, intervals, ["axis", "bucket", "metric", "__c"]).join(slice_universe(images, ["all", "small", "medium", "large"]), ["axis", "bucket"])
    return out.select(F.lit(suite).alias("suite"), "axis", "bucket", "metric", "class_id", "point", "ci_low", "ci_high", "n_gt", "n_images")
