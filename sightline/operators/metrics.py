"""Average precision on 101 recall points, and the slices of an evaluation.

A group's detections can be more than a task holds, so the running counts that precision needs are
taken in two levels: within score bins, and over the bins' sums. Of each group there then remain at
most 101 rows, the best precision at each recall point reached.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .matching import HIT, LEFT_OUT, RANGES, THRESHOLDS

#: Score bins of the running counts.
BINS = 256
POINTS = 101


def _reached(recall: Column) -> Column:
    """Largest i with i * 0.01 <= recall, in doubles: recall 57/100 does not reach point 57."""
    i = F.floor(recall * 100)
    step = F.lit(0.01)
    return F.least(F.when((i + 1).cast("double") * step <= recall, i + 1).when(i.cast("double") * step <= recall, i).otherwise(i - 1), F.lit(POINTS - 1))


def _envelope_means(best: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, ap) from the best precision at each recall point reached. Precision at point i is the best
    from i on; each row holds the points down to the next k below."""
    down = W.partitionBy(*group).orderBy("k")
    held = best.select(*group, "k", F.coalesce(F.lag("k").over(down), F.lit(-1)).alias("below"), F.max("precision").over(down.rowsBetween(0, W.unboundedFollowing)).alias("envelope"))
    return held.groupBy(*group).agg((F.sum(F.col("envelope") * (F.col("k") - F.col("below"))) / F.lit(float(POINTS))).alias("ap"))


def average_precision(facts: DataFrame, totals: DataFrame, group: Sequence[str], hit: str = "is_hit", weight: str | None = None) -> DataFrame:
    """(group, n_gt, ap). `facts` has group, image_id, det_ordinal, score and `hit`; `totals` has
    group and n_gt and is the universe: groups without ground truth have a null AP, groups without
    detections 0. With `weight`, a detection counts that often. Ties in score go by image_id, then
    det_ordinal."""
    group = list(group)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    # Scores outside [0, 1] share the end bins: the order stays right, the bins grow.
    span = F.least(F.greatest(F.floor((1 - F.col("score")) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = facts.select(*group, "image_id", "det_ordinal", "score", span.alias("bin"), (F.col(hit) * w).alias("tp"), w.alias("n"))
    bins = rows.groupBy(*group, "bin").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    before = W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    base = bins.select(*group, "bin", F.coalesce(F.sum("tp").over(before), F.lit(0.0)).alias("tp0"), F.coalesce(F.sum("n").over(before), F.lit(0.0)).alias("n0"))
    inner = W.partitionBy(*group, "bin").orderBy(F.desc("score"), "image_id", "det_ordinal").rowsBetween(W.unboundedPreceding, 0)
    running = rows.select(*group, "bin", F.sum("tp").over(inner).alias("tp"), F.sum("n").over(inner).alias("n"))
    counted = running.join(base, [*group, "bin"]).join(totals, group)
    tp = F.col("tp0") + F.col("tp")
    with_recall = counted.where("n_gt > 0").select(*group, _reached(tp / F.col("n_gt")).alias("k"), (tp / F.greatest(F.col("n0") + F.col("n"), F.lit(1e-12))).alias("precision"))
    best = with_recall.groupBy(*group, "k").agg(F.max("precision").alias("precision"))
    ap = _envelope_means(best, group)
    return totals.join(ap, group, "left").select(*group, "n_gt", F.when(F.col("n_gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


AXES = ("overall", "weather", "camera", "scale")


def sliced(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of an image repeated for each slice that it is in: axis and bucket. Only the range `all`
    is cut by weather and camera; ranges are the scale axis."""
    known = rows.join(images.select("image_id", "weather", "camera"), "image_id")
    whole = F.col("area_range") == "all"
    slices = F.array(
        F.when(whole, F.struct(F.lit("overall").alias("axis"), F.lit("all").alias("bucket"))),
        F.when(whole, F.struct(F.lit("weather").alias("axis"), F.col("weather").cast("string").alias("bucket"))),
        F.when(whole, F.struct(F.lit("camera").alias("axis"), F.col("camera").cast("string").alias("bucket"))),
        F.when(~whole, F.struct(F.lit("scale").alias("axis"), F.col("area_range").alias("bucket"))),
    )
    return known.withColumn("slice", F.explode(F.array_compact(slices))).select("*", "slice.axis", "slice.bucket").drop("slice", "weather", "camera")


def sliced_outcomes(matched: DataFrame, images: DataFrame, thresholds: Sequence[float] = THRESHOLDS, ranges: Sequence[str] = RANGES) -> DataFrame:
    """Match facts repeated for each slice of their image: axis, bucket, and the outcomes of the slice's
    range alone, by threshold. Detections of images that `images` lacks go."""
    n = len(thresholds)
    known = matched.join(images.select("image_id", "weather", "camera"), "image_id")

    def part(axis: str, bucket: Column, area: str) -> Column:
        return F.struct(F.lit(axis).alias("axis"), bucket.cast("string").alias("bucket"), F.slice("outcomes", ranges.index(area) * n + 1, n).alias("outcomes"))

    whole = [part("overall", F.lit("all"), "all"), part("weather", F.col("weather"), "all"), part("camera", F.col("camera"), "all")]
    slices = F.array(*whole, *[part("scale", F.lit(r), r) for r in ranges if r != "all"])
    return known.withColumn("slice", F.explode(slices)).drop("outcomes", "weather", "camera").select("*", "slice.*").drop("slice")


def _run_of_bin(group: Sequence[str], n_thresholds: int):
    """One score bin of a group as one row: by threshold its hits, what counts, and how many have counted
    by each hit."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("score", "descending"), ("image_id", "ascending"), ("det_ordinal", "ascending")]))
        codes = np.asarray(table["outcomes"].combine_chunks().flatten()).reshape(-1, n_thresholds)
        hit, counts = codes == HIT, np.cumsum(codes != LEFT_OUT, axis=0)
        keys = {g: table[g][:1] for g in [*group, "bin"]}
        return pa.table({**keys, "tp": [hit.sum(0).tolist()], "n": [counts[-1].tolist()], "at": pa.array([[counts[hit[:, t], t] for t in range(n_thresholds)]], pa.list_(pa.list_(pa.int64())))})

    return run


def _best_points(group: Sequence[str]):
    """Of each bin, now with what came before it, the best precision at each recall point reached. Only
    hits matter: between them precision falls."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tp0, n0 = (np.asarray(batch.column(c).flatten(), np.float64) for c in ("tp0", "n0"))
            thresholds = len(tp0) // max(batch.num_rows, 1)
            inner = batch.column("at").flatten()
            size = np.asarray(inner.value_lengths())
            of = np.repeat(np.arange(len(size)), size)  # which bin and threshold a hit is of
            tp = tp0[of] + np.arange(1, len(of) + 1) - np.repeat(np.cumsum(size) - size, size)
            precision = tp / np.maximum(n0[of] + np.asarray(inner.flatten()), 1e-12)
            recall = tp / np.asarray(batch.column("n_gt"), np.float64)[of // max(thresholds, 1)]
            k = np.floor(recall * 100)
            k = np.where((k + 1) * 0.01 <= recall, k + 1, np.where(k * 0.01 <= recall, k, k - 1))
            best = np.full((len(size), POINTS), -1.0)
            np.maximum.at(best, (of, np.minimum(k, POINTS - 1).astype(np.int64)), precision)
            of, k = np.nonzero(best >= 0)
            row = pa.array(of // max(thresholds, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(g).take(row) for g in group), pa.array((of % max(thresholds, 1)).astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(best[of, k])], names=[*group, "thr", "k", "precision"])

    return scan


def average_precisions(rows: DataFrame, totals: DataFrame, group: Sequence[str], thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(group, iou_thr, n_gt, ap) as average_precision gives it, for all thresholds at once: `rows` has
    group, image_id, det_ordinal, score and outcomes by threshold. The order by score is the same for each,
    so a detection is moved and sorted once, and what is left of a bin is one row."""
    group, n = list(group), len(thresholds)
    span = F.least(F.greatest(F.floor((1 - F.col("score")) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    types = dict(rows.dtypes)
    keys = ", ".join(f"{g} {types[g]}" for g in group)
    rows = rows.select(*group, "image_id", "det_ordinal", "score", "outcomes", span.alias("bin"))
    bins = rows.groupBy(*group, "bin").applyInArrow(_run_of_bin(group, n), f"{keys}, bin int, tp array<long>, n array<long>, at array<array<long>>")
    before = W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    counted = [F.array(*[F.coalesce(F.sum(F.get(c, k)).over(before), F.lit(0).cast("long")) for k in range(n)]).alias(f"{c}0") for c in ("tp", "n")]
    known = bins.select(*group, *counted, "at").join(totals.where("n_gt > 0").select(*group, "n_gt"), group)
    best = known.mapInArrow(_best_points(group), f"{keys}, thr int, k int, precision double")
    ap = _envelope_means(best.groupBy(*group, "thr", "k").agg(F.max("precision").alias("precision")), [*group, "thr"])
    every = totals.select(*group, "n_gt", F.explode(F.array(*[F.struct(F.lit(k).alias("thr"), F.lit(float(t)).alias("iou_thr")) for k, t in enumerate(thresholds)])).alias("t")).select(*group, "n_gt", "t.*")
    return every.join(ap, [*group, "thr"], "left").select(*group, "iou_thr", "n_gt", F.when(F.col("n_gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def slice_universe(images: DataFrame, ranges: Sequence[str]) -> DataFrame:
    """(axis, bucket, n_images) of every slice; images without boxes count."""
    part = images.select(F.explode(F.array(
        F.struct(F.lit("overall").alias("axis"), F.lit("all").alias("bucket")),
        F.struct(F.lit("weather").alias("axis"), F.col("weather").cast("string").alias("bucket")),
        F.struct(F.lit("camera").alias("axis"), F.col("camera").cast("string").alias("bucket")),
        *[F.struct(F.lit("scale").alias("axis"), F.lit(r).alias("bucket")) for r in ranges if r != "all"],
    )).alias("s"))
    return part.groupBy("s.axis", "s.bucket").agg(F.count("*").alias("n_images"))


def evaluate_slices(matched: DataFrame, counts: DataFrame, images: DataFrame, classes: Sequence[int], by: Sequence[str] = (), thresholds: Sequence[float] = THRESHOLDS, ranges: Sequence[str] = RANGES) -> DataFrame:
    """(by, axis, bucket, class_id, iou_thr, n_gt, ap) for every slice, class and threshold. `matched` is
    what match() gives for these thresholds and ranges, `counts` gt_counts; every slice of the images is
    there, with or without boxes, and detections of other images do not count."""
    by = list(by)
    universe = slice_universe(images, ranges)
    n_gt = sliced(counts, images).groupBy("axis", "bucket", "class_id").agg(F.sum("n_gt").alias("n_gt"))
    grid = universe.select("axis", "bucket").withColumn("class_id", F.explode(F.array(*[F.lit(int(c)).cast(dict(counts.dtypes)["class_id"]) for c in classes])))
    totals = grid.join(n_gt, ["axis", "bucket", "class_id"], "left").withColumn("n_gt", F.coalesce("n_gt", F.lit(0).cast("long")))
    if by:  # the groups of `by` are configuration
        totals = totals.join(F.broadcast(matched.select(*by).distinct()), F.lit(True))
    group = [*by, "axis", "bucket", "class_id"]
    return average_precisions(sliced_outcomes(matched, images, thresholds, ranges), totals.select(*group, "n_gt"), group, thresholds)


def first_images(images: DataFrame, limit: int) -> DataFrame:
    """The images with the smallest ids, for a short run."""
    return images.orderBy("image_id").limit(limit)


def mean_metrics(aps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, axis, bucket, n_gt, map50, map): means over thresholds, then over classes, that skip what
    is undefined."""
    by = list(by)
    keys = [*by, "axis", "bucket"]
    per_class = aps.groupBy(*keys, "class_id").agg(F.avg(F.when(F.col("iou_thr") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap"), F.max("n_gt").alias("n_gt"))
    return per_class.groupBy(*keys).agg(F.sum("n_gt").alias("n_gt"), F.avg("ap50").alias("map50"), F.avg("ap").alias("map"))


def headline(overall: DataFrame, roles: DataFrame) -> DataFrame:
    """One row: in-distribution value, mean of the gated suites weighted by n_gt, and their gap.
    `overall` has suite, point, n_gt; `roles` suite and role (in_distribution or gated)."""
    known = overall.join(F.broadcast(roles), "suite")
    gated = F.col("role") == "gated"
    total = F.sum(F.when(gated, F.col("n_gt")))
    weighted = F.sum(F.when(gated, F.col("point") * F.col("n_gt"))) / F.when(total > 0, total).otherwise(F.lit(1))
    return known.agg(F.max(F.when(F.col("role") == "in_distribution", F.col("point"))).alias("in_distribution"), weighted.alias("gated"), F.coalesce(total, F.lit(0)).cast("long").alias("gated_n_gt")).withColumn("gap", F.col("in_distribution") - F.col("gated"))


def suite_gaps(overall: DataFrame, roles: DataFrame) -> DataFrame:
    """(suite, gap) of each gated suite against the in-distribution value."""
    known = overall.join(F.broadcast(roles), "suite")
    base = known.where("role = 'in_distribution'").select(F.col("point").alias("base"))
    return known.where("role = 'gated'").join(F.broadcast(base), F.lit(True)).select("suite", (F.col("base") - F.col("point")).alias("gap"))


def corruption_auc(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain mean over all corruptions and severities, 0 included, so the clean value counts once for
    each corruption."""
    return curves.groupBy(*by).agg(F.avg("point").alias("auc"), F.count("point").alias("cells"))


def degradation_curves(points: DataFrame) -> DataFrame:
    """(corruption, severity, point): the clean value, severity 0, joins each corruption's curve.
    `points` has corruption (null where clean), severity and point."""
    clean = points.where("severity = 0").select(F.col("point").alias("clean")).limit(1)
    rest = points.where("severity > 0").select("corruption", "severity", "point")
    first = rest.select("corruption").distinct().join(F.broadcast(clean), F.lit(True)).select("corruption", F.lit(0).alias("severity"), F.col("clean").alias("point"))
    return rest.unionByName(first)


def merge_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Point values with the bounds of their intervals, by key; a value without an interval keeps nulls."""
    return points.join(intervals.select(*keys, "ci_low", "ci_high"), list(keys), "left")
