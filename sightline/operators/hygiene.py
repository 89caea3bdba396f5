"""Annotation hygiene: duplicate boxes, label conflicts, covered area, the audit, frame sampling.

Frames are rows of `targets`: sequence, frame_num, ordinal (document order), native_class and a
left, top, width, height box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import from_ltwh, iou, to_pixels

#: Fixed value: IoU from which two boxes count as the same.
DUPLICATE_IOU = 0.9


def _ltrb(s, names=("left", "top", "width", "height")):
    return from_ltwh(*(s[n] for n in names))


def dedup_targets(targets: DataFrame, keys: list[str], threshold: float = DUPLICATE_IOU) -> DataFrame:
    """Rows kept after dropping, in document order, each box that overlaps a *kept* box of its class.

    The rule is a fold over a frame: what is dropped cannot drop others. Boxes that overlap no
    earlier box of their class are kept without more work; only frames with a candidate pair are
    gathered and folded, so the usual frame never leaves the join."""
    cols = ["left", "top", "width", "height"]
    own = [*keys, "ordinal", "native_class", *cols]
    a = targets.select(*own)
    b = targets.select(*keys, "native_class", F.col("ordinal").alias("o2"), *[F.col(c).alias(c + "2") for c in cols])
    pairs = a.join(b, [*keys, "native_class"]).where((F.col("o2") < F.col("ordinal")) & (iou(from_ltwh(*map(F.col, cols)), from_ltwh(*(F.col(c + "2") for c in cols))) >= threshold))
    rivals = pairs.groupBy(*keys, "native_class", "ordinal").agg(F.array_sort(F.collect_list("o2")).alias("rivals"))
    listed = rivals.groupBy(*keys, "native_class").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rivals"))).alias("todo"))
    # A box goes if any of its rivals stays; rivals come earlier, so one pass in order settles all.
    dropped = listed.withColumn(
        "gone",
        F.aggregate("todo", F.array().cast("array<int>"), lambda gone, t: F.when(F.exists(t["rivals"], lambda r: ~F.array_contains(gone, r)), F.array_append(gone, t["ordinal"].cast("int"))).otherwise(gone)),
    ).select(*keys, "native_class", F.explode("gone").alias("ordinal"))
    return targets.join(dropped, [*keys, "native_class", "ordinal"], "left_anti")


def cross_class_conflicts(targets: DataFrame, keys: list[str], threshold: float = DUPLICATE_IOU) -> DataFrame:
    """Pairs of boxes of different classes in one frame that overlap from the threshold on, over the
    boxes before duplicates are dropped."""
    cols = ["left", "top", "width", "height"]
    a = targets.select(*keys, "ordinal", "native_class", *cols)
    b = targets.select(*keys, F.col("ordinal").alias("other"), F.col("native_class").alias("other_class"), *[F.col(c).alias(c + "2") for c in cols])
    same = iou(from_ltwh(*map(F.col, cols)), from_ltwh(*(F.col(c + "2") for c in cols))) >= threshold
    return a.join(b, keys).where((F.col("ordinal") < F.col("other")) & (F.col("native_class") != F.col("other_class")) & same).select(*keys, "ordinal", "other")


def covered_fraction(regions: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """(keys, covered_px, fraction): area of the *union* of pixel rectangles by coordinate
    compression. Each rectangle is cut at the edges of its group's rectangles; equal cells count once."""
    px = regions.select(*keys, *[c.alias(n) for n, c in zip(("a", "b", "c", "d"), to_pixels(F.col("left"), F.col("top"), F.col("width"), F.col("height"), F.lit(width), F.lit(height)))])
    edges = px.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "c"))))).alias("xs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("b", "d"))))).alias("ys"))

    def cuts(edges, low, high):
        return F.filter(F.transform(edges, lambda e, i: F.struct(e.alias("lo"), F.get(edges, i + 1).alias("hi"))), lambda s: (s["lo"] >= low) & (s["hi"] <= high))

    cells = px.join(edges, keys).select(*keys, F.explode(cuts(F.col("xs"), F.col("a"), F.col("c"))).alias("x"), F.col("ys"), "b", "d").select(*keys, "x", F.explode(cuts(F.col("ys"), F.col("b"), F.col("d"))).alias("y")).distinct()
    size = (F.col("x.hi") - F.col("x.lo")).cast("long") * (F.col("y.hi") - F.col("y.lo"))
    return cells.groupBy(*keys).agg(F.sum(size).alias("covered_px")).withColumn("fraction", F.round(F.col("covered_px") / F.lit(width * height), 5))


def audit_sequences(frames: DataFrame, targets: DataFrame, regions: DataFrame, width: float = 960.0, height: float = 540.0) -> DataFrame:
    """One row a sequence: frames, boxes before and after, removed, conflicts, class histogram of the
    kept boxes, ignore regions and the fraction of the image they cover. `frames` (sequence,
    frame_num) gives the universe: sequences without boxes or regions stay."""
    keys = ["sequence", "frame_num"]
    kept = dedup_targets(targets, keys)
    before = targets.groupBy("sequence").agg(F.count("*").alias("boxes_before"))
    counts = kept.groupBy("sequence", "native_class").count()
    hist = counts.groupBy("sequence").agg(F.sum("count").alias("boxes_after"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("native_class", "count")))).alias("histogram"))
    conflicts = cross_class_conflicts(targets, keys).groupBy("sequence").agg(F.count("*").alias("conflicts"))
    ignored = regions.groupBy("sequence").agg(F.count("*").alias("ignore_regions")).join(covered_fraction(regions, ["sequence"], width, height).select("sequence", "fraction"), "sequence", "left")
    out = frames.groupBy("sequence").agg(F.count("*").alias("frames"))
    for part in (before, hist, conflicts, ignored):
        out = out.join(part, "sequence", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("boxes_before", "boxes_after", "conflicts", "ignore_regions")}
    return out.withColumns(zero).withColumn("fraction", F.coalesce("fraction", F.lit(0.0))).withColumn("removed", F.col("boxes_before") - F.col("boxes_after"))


def audit_totals(audit: DataFrame) -> DataFrame:
    """Sums over the sequences of an audit."""
    return audit.agg(F.count("*").alias("sequences"), *[F.sum(c).alias(c) for c in ("frames", "boxes_before", "boxes_after", "removed", "conflicts", "ignore_regions")])


def every_nth(frames: DataFrame, n: int, group: str = "sequence", number: str = "frame_num") -> DataFrame:
    """Each n-th of a group's distinct frame numbers in order, from the first: by place, not by number."""
    if n < 1:
        raise ValueError(f"stride must be at least 1, not {n}")
    place = F.row_number().over(W.partitionBy(group).orderBy(number)) - 1
    return frames.select(group, number).distinct().withColumn("__place", place).where(F.col("__place") % n == 0).drop("__place")
