"""Building a training or evaluation set from annotated sequences, as one plan of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.gates import assert_no_leakage
from ..operators.hygiene import dedup_targets, every_nth
from ..operators.taxonomy import fail_on_misses, route


def build_labels(frames: DataFrame, targets: DataFrame, manifest: DataFrame, routes: DataFrame, canonical: DataFrame, dataset: str, stride: int) -> tuple[DataFrame, DataFrame]:
    """(frames, boxes) of the set: every stride-th frame of each sequence of the manifest (split,
    sequence), its boxes without duplicates and with canonical ids. Sequences in two splits and labels
    without a route raise before anything is written."""
    from pyspark.sql import functions as F

    assert_no_leakage(manifest)
    chosen = every_nth(frames, stride).join(F.broadcast(manifest.select("split", "sequence")), "sequence")
    own = targets.join(chosen.select("sequence", "frame_num"), ["sequence", "frame_num"], "left_semi")
    routed = route(dedup_targets(own, ["sequence", "frame_num"]).withColumn("dataset", F.lit(dataset)), routes, canonical)
    fail_on_misses(routed)
    return chosen, routed.where("verb = 'map'").select("sequence", "frame_num", "ordinal", "class_id", "left", "top", "width", "height")
