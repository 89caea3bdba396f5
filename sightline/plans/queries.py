"""Registered queries over the engine's operators, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import area, corners, ioa, iou, scale_bin, to_yolo
from ..functions.scalars import camera_of, flat_stem, sequence_of, stable_seed, yolo_line
from ..operators import bootstrap as bs
from ..operators import corruption as co
from ..operators import features as fe
from ..operators import gates as ga
from ..operators import hygiene as hy
from ..operators import matching as ma
from ..operators import metrics as me
from ..operators import taxonomy as ta
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(name: str) -> F.Column:
    return F.round(F.col(name), 6).alias(name)


V = v.views_sql()


@query(f"""WITH {V}
SELECT d.det_ordinal, round({v.iou_sql('d', 'g')}, 6) AS iou, round({v.area_sql('d')}, 6) AS size,
  round(CASE WHEN r.image_id IS NULL THEN 0 ELSE {v.overlap_sql('d', 'r')} / {v.area_sql('d')} END, 6) AS ioa
FROM det d JOIN gt g ON d.det_ordinal = g.gt_ordinal LEFT JOIN regions r ON d.image_id = r.image_id""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = v.gt_boxes(spark, sf_dir).select(F.col("gt_ordinal").alias("det_ordinal"), *[F.col(c).alias("g" + c) for c in ("x1", "y1", "x2", "y2")])
    r = v.regions(spark, sf_dir).select("image_id", *[F.col(c).alias("r" + c) for c in ("x1", "y1", "x2", "y2")])
    d = v.detections(spark, sf_dir).join(g, "det_ordinal").join(r, "image_id", "left")
    return d.select("det_ordinal", iou(corners(), corners("g")).alias("iou"), area(corners()).alias("size"), F.coalesce(ioa(corners(), corners("r")), F.lit(0.0)).alias("ioa")).select("det_ordinal", r6("iou"), r6("size"), r6("ioa"))


@query(f"""WITH {V} SELECT CASE WHEN size < 1024 THEN 'small' WHEN size < 9216 THEN 'medium' ELSE 'large' END AS scale, CAST(class_id AS INT) AS class_id, count(*) AS n
FROM (SELECT class_id, {v.area_sql('gt')} AS size FROM gt) GROUP BY ALL""")
def scale_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.gt_boxes(spark, sf_dir).groupBy(scale_bin(area(corners())).alias("scale"), "class_id").agg(F.count("*").alias("n"))


DEDUP_SQL = f"""WITH RECURSIVE {V},
near AS (SELECT a.frame_num, a.native_class, a.ordinal, list(b.ordinal) AS rivals FROM targets a JOIN targets b
  ON a.frame_num = b.frame_num AND a.native_class = b.native_class AND b.ordinal < a.ordinal AND {v.iou_sql('a', 'b')} >= 0.9 GROUP BY ALL),
todo AS (SELECT *, row_number() OVER (PARTITION BY frame_num, native_class ORDER BY ordinal) AS rk FROM near),
step AS (
  SELECT DISTINCT frame_num, native_class, 0::BIGINT AS rk, []::INT[] AS gone FROM todo
  UNION ALL
  SELECT t.frame_num, t.native_class, t.rk, CASE WHEN len(list_filter(t.rivals, lambda o: NOT list_contains(s.gone, o))) > 0 THEN list_append(s.gone, t.ordinal) ELSE s.gone END
  FROM step s JOIN todo t ON s.frame_num = t.frame_num AND s.native_class = t.native_class AND t.rk = s.rk + 1),
dropped AS (SELECT DISTINCT frame_num, native_class, unnest(gone) AS ordinal FROM step),
kept AS (SELECT t.* FROM targets t ANTI JOIN dropped d ON t.frame_num = d.frame_num AND t.native_class = d.native_class AND t.ordinal = d.ordinal)"""


@query(DEDUP_SQL + " SELECT sequence, frame_num, ordinal, native_class FROM kept")
def dedup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hy.dedup_targets(v.targets(spark, sf_dir), ["sequence", "frame_num"]).select("sequence", "frame_num", "ordinal", "native_class")


@query(f"""WITH {V} SELECT a.sequence, a.frame_num, a.ordinal, b.ordinal AS other FROM targets a JOIN targets b
ON a.frame_num = b.frame_num AND a.ordinal < b.ordinal AND a.native_class <> b.native_class WHERE {v.iou_sql('a', 'b')} >= 0.9""")
def cross_class_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hy.cross_class_conflicts(v.targets(spark, sf_dir), ["sequence", "frame_num"])


AREA_SQL = """px AS (SELECT 'MVI_' || (image_id % 20) AS sequence, greatest(least(floor(x1+0.5), 960), 0)::INT AS a, greatest(least(floor(y1+0.25), 540), 0)::INT AS b,
  greatest(least(ceil(x2+0.5), 960), 0)::INT AS c, greatest(least(ceil(y2+0.25), 540), 0)::INT AS d FROM regions),
pixels AS (SELECT DISTINCT sequence, x, unnest(range(b, d)) AS y FROM (SELECT *, unnest(range(a, c)) AS x FROM px)),
covered AS (SELECT sequence, count(*) AS covered_px FROM pixels GROUP BY sequence)"""


@query(f"WITH {V}, {AREA_SQL} SELECT sequence, covered_px, round(covered_px / (960.0::DOUBLE*540), 5) AS fraction FROM covered")
def ignore_area_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hy.covered_fraction(v.sequence_regions(spark, sf_dir), ["sequence"], 960.0, 540.0)


AUDIT_SQL = DEDUP_SQL + f""", {AREA_SQL},
conflicts AS (SELECT a.sequence, count(*) AS n FROM targets a JOIN targets b ON a.frame_num = b.frame_num AND a.ordinal < b.ordinal AND a.native_class <> b.native_class WHERE {v.iou_sql('a', 'b')} >= 0.9 GROUP BY a.sequence),
audit AS (SELECT f.sequence, f.frames, b.n AS boxes_before, k.n AS boxes_after, b.n - k.n AS removed, coalesce(c.n, 0) AS conflicts, coalesce(i.n, 0) AS ignore_regions, round(coalesce(a.covered_px, 0) / (960.0::DOUBLE*540), 5) AS fraction
FROM (SELECT 'MVI_' || (image_id % 20) AS sequence, count(*) AS frames FROM images GROUP BY ALL) f
LEFT JOIN (SELECT sequence, count(*) AS n FROM targets GROUP BY ALL) b USING (sequence) LEFT JOIN (SELECT sequence, count(*) AS n FROM kept GROUP BY ALL) k USING (sequence)
LEFT JOIN conflicts c USING (sequence) LEFT JOIN (SELECT 'MVI_' || (image_id % 20) AS sequence, count(*) AS n FROM regions GROUP BY ALL) i USING (sequence) LEFT JOIN covered a USING (sequence))"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = v.images(spark, sf_dir).selectExpr("concat('MVI_', image_id % 20) as sequence", "image_id as frame_num")
    return hy.audit_sequences(frames, v.targets(spark, sf_dir), v.sequence_regions(spark, sf_dir))


@query(AUDIT_SQL + " SELECT * FROM audit")
def sequence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).drop("histogram")


@query(AUDIT_SQL + " SELECT count(*) AS sequences, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(boxes_before) AS BIGINT) AS boxes_before, CAST(sum(boxes_after) AS BIGINT) AS boxes_after, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(conflicts) AS BIGINT) AS conflicts, CAST(sum(ignore_regions) AS BIGINT) AS ignore_regions FROM audit")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hy.audit_totals(_audit(spark, sf_dir))


@query(DEDUP_SQL + " SELECT sequence, native_class, count(*) AS boxes FROM kept GROUP BY ALL")
def kept_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).select("sequence", F.explode("histogram").alias("native_class", "boxes"))


@query("""WITH f AS (SELECT DISTINCT user_id AS sequence, event_id % 1000 AS frame_num FROM events)
SELECT sequence, frame_num FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY frame_num) - 1 AS k FROM f) WHERE k % 10 = 0""")
def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hy.every_nth(v.table(spark, sf_dir, "events").selectExpr("user_id as sequence", "event_id % 1000 as frame_num"), 10)


ROUTES = [("d", "car", "map", "car"), ("d", "bus", "map", "bus"), ("d", "van", "map", "van_truck"), ("d", "others", "ignore", None), ("d", "bike", "exclude", None)]
CANONICAL = [(0, "car"), (1, "bus"), (2, "van_truck")]


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(ROUTES, "dataset string, native string, verb string, canonical string"), spark.createDataFrame(CANONICAL, "id int, name string")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, v.NATIVE))
    rows = v.table(spark, sf_dir, "events").select("event_id", F.lit("d").alias("dataset"), F.get(names, (F.col("event_id") % 6).cast("int")).alias("native_class"))
    return ta.route(rows, *_tables(spark))


ROUTED_SQL = """routed AS (SELECT event_id, (['car','bus','van','others','bike','zeppelin'])[event_id % 6 + 1] AS native_class,
  (['map','map','map','ignore','exclude',NULL])[event_id % 6 + 1] AS verb, CAST(([0,1,2,NULL,NULL,NULL])[event_id % 6 + 1] AS INT) AS class_id FROM events)"""


@query(f"WITH {ROUTED_SQL} SELECT event_id, native_class, verb, class_id FROM routed")
def route_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("event_id", "native_class", "verb", "class_id")


@query(f"WITH {ROUTED_SQL} SELECT 'd' AS dataset, native_class, count(*) AS boxes FROM routed WHERE verb IS NULL GROUP BY ALL")
def route_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ta.route_misses(_routed(spark, sf_dir))


@query(f"""WITH {V}, raw AS (SELECT image_id, det_ordinal, det_ordinal % 5 AS k, x1 - 15 AS x1, y1 - 15 AS y1, x2 - 15 AS x2, y2 - 15 AS y2 FROM det),
c AS (SELECT image_id, det_ordinal, k, greatest(0, least(x1, x2)) AS x1, greatest(0, least(y1, y2)) AS y1, least(240, greatest(x1, x2)) AS x2, least(160, greatest(y1, y2)) AS y2 FROM raw)
SELECT image_id, det_ordinal, (['map','map','map','ignore'])[k + 1] AS verb, CAST(([0,1,2,NULL])[k + 1] AS INT) AS class_id, x1, y1, x2, y2 FROM c WHERE x2 > x1 AND y2 > y1 AND k < 4""")
def route_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, v.NATIVE))
    d = v.detections(spark, sf_dir).select("image_id", "det_ordinal", F.lit("d").alias("dataset"), F.get(names, (F.col("det_ordinal") % 5).cast("int")).alias("native_class"), *[(F.col(c) - 15).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(240).alias("width"), F.lit(160).alias("height"))
    return ta.route_boxes(d, *_tables(spark)).select("image_id", "det_ordinal", "verb", "class_id", "x1", "y1", "x2", "y2")


@query("""WITH m AS (SELECT DISTINCT CAST(p_size AS INT) AS model_id, (['car','bus','truck','person','van_truck','bicycle'])[p_size % 6 + 1] AS name FROM part)
SELECT model_id, CAST(CASE name WHEN 'car' THEN 0 WHEN 'bus' THEN 1 ELSE 2 END AS INT) AS class_id FROM m WHERE name IN ('car', 'bus', 'truck', 'van_truck')""")
def class_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["car", "bus", "truck", "person", "van_truck", "bicycle"]))
    models = v.table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("model_id"), F.get(names, (F.col("p_size") % 6).cast("int")).alias("name")).distinct()
    return ta.class_map(models, _tables(spark)[1])


@query(f"""WITH {V} SELECT gt_ordinal, printf('%d %.6f %.6f %.6f %.6f', class_id, least(1, greatest(0, (x1 + (x2-x1)/2)/960.0::DOUBLE)), least(1, greatest(0, (y1 + (y2-y1)/2)/540.0::DOUBLE)),
  least(1, greatest(0, (x2-x1)/960.0::DOUBLE)), least(1, greatest(0, (y2-y1)/540.0::DOUBLE))) AS line FROM gt""")
def yolo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = v.gt_boxes(spark, sf_dir)
    box = to_yolo(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 960.0, 540.0)
    return g.select("gt_ordinal", yolo_line("class_id", *box).alias("line"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'frame' || event_id ELSE 'MVI_' || (event_id % 60) END AS sequence, 'cam' || (event_id % 7) AS camera, 'cam' || (event_id % 7) || '__shot__' || event_id AS stem FROM events""")
def frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events").select("event_id")
    stem = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("frame"), "event_id")).otherwise(F.concat(F.lit("MVI_"), F.col("event_id") % 60, F.lit("_img"), F.lpad(F.col("event_id").cast("string"), 5, "0")))
    path = F.concat(F.lit("cam"), F.col("event_id") % 7, F.lit("/shot/"), "event_id", F.lit(".png"))
    return e.select("event_id", sequence_of(stem).alias("sequence"), camera_of(path).alias("camera"), flat_stem(path).alias("stem"))


@query("SELECT event_id, CAST(CAST('0x' || substr(sha256(event_id || '|gaussian_noise|' || (event_id % 6)), 1, 16) AS UBIGINT) AS DECIMAL(20,0)) AS seed FROM events")
def stable_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events")
    return e.select("event_id", stable_seed(F.col("event_id").cast("string"), F.lit("gaussian_noise"), F.col("event_id") % 6).alias("seed"))


# Matching, average precision and slices.

TEN = ma.THRESHOLDS


def _matched(spark: SparkSession, sf_dir: str, thresholds=TEN, ranges=ma.RANGES, severities=(0,)) -> DataFrame:
    return ma.match(v.detections(spark, sf_dir, severities=severities), v.gt_boxes(spark, sf_dir), v.regions(spark, sf_dir), by=["severity"], thresholds=thresholds, ranges=ranges)


@query(v.match_sql((0.5,), ("all",)) + " SELECT image_id, class_id, det_ordinal, outcome FROM matched")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, (0.5,), ("all",)).select("image_id", "class_id", "det_ordinal", F.get("outcomes", 0).cast("int").alias("outcome"))


@query(v.match_sql((0.5, 0.75), ("medium", "small")) + " SELECT image_id, class_id, det_ordinal, rng AS area_range, thr AS iou_thr, CAST(outcome = 1 AS INT) AS is_hit FROM matched WHERE outcome <> 2")
def greedy_match_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds, ranges = (0.5, 0.75), ("medium", "small")
    return ma.match_facts(_matched(spark, sf_dir, thresholds, ranges), ["severity"], thresholds, ranges).select("image_id", "class_id", "det_ordinal", "area_range", "iou_thr", "is_hit")


COUNTS_SQL = "counts AS (SELECT image_id, class_id, rng, count(*) AS n_gt FROM gt, (SELECT DISTINCT rng, lo, hi FROM grid) WHERE " + v.area_sql("gt") + " >= lo AND " + v.area_sql("gt") + " < hi GROUP BY ALL)"
SLICE_SQL = """ {name} AS (SELECT x.*, s.axis, s.bucket FROM {table} x JOIN images i ON x.image_id = i.image_id, LATERAL (
  SELECT 'overall' AS axis, 'all' AS bucket WHERE x.rng = 'all' UNION ALL SELECT 'weather', i.weather WHERE x.rng = 'all' UNION ALL SELECT 'camera', i.camera WHERE x.rng = 'all'
  UNION ALL SELECT 'scale', x.rng WHERE x.rng <> 'all') s)"""
APS_SQL = v.match_sql(TEN, ma.RANGES) + f""", {COUNTS_SQL},
hits AS (SELECT *, CAST(outcome = 1 AS INT) AS hit FROM matched WHERE outcome <> 2),
{SLICE_SQL.format(name='sfacts', table='hits')}, {SLICE_SQL.format(name='scounts', table='counts')},
universe AS (SELECT DISTINCT axis, bucket FROM (SELECT 'overall' AS axis, 'all' AS bucket UNION SELECT 'weather', weather FROM images UNION SELECT 'camera', camera FROM images UNION SELECT 'scale', unnest(['small','medium','large']))),
totals AS (SELECT u.axis, u.bucket, c.class_id, t.thr, CAST(coalesce(sum(s.n_gt), 0) AS BIGINT) AS n_gt FROM universe u CROSS JOIN (SELECT CAST(unnest([0,1,2]) AS INT) AS class_id) c CROSS JOIN (SELECT DISTINCT thr FROM grid) t
  LEFT JOIN scounts s ON s.axis = u.axis AND s.bucket = u.bucket AND s.class_id = c.class_id GROUP BY ALL),
{v.ap_sql('axis, bucket, class_id, thr', 'sfacts', 'totals')}"""


def _aps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.evaluate_slices(_matched(spark, sf_dir), ma.gt_counts(v.gt_boxes(spark, sf_dir)), v.images(spark, sf_dir), [0, 1, 2])


@query(APS_SQL + " SELECT axis, bucket, class_id, thr AS iou_thr, n_gt, round(ap, 6) AS ap FROM aps")
def ap_per_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aps(spark, sf_dir).select("axis", "bucket", "class_id", "iou_thr", "n_gt", r6("ap"))


MEANS_SQL = APS_SQL + """, per_class AS (SELECT axis, bucket, class_id, avg(ap) FILTER (thr = 0.5) AS ap50, avg(ap) AS ap, max(n_gt) AS n_gt FROM aps GROUP BY ALL)
SELECT axis, bucket, CAST(sum(n_gt) AS BIGINT) AS n_gt, round(avg(ap50), 6) AS map50, round(avg(ap), 6) AS map FROM per_class GROUP BY ALL"""


@query(MEANS_SQL)
def map_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.mean_metrics(_aps(spark, sf_dir)).select("axis", "bucket", "n_gt", r6("map50"), r6("map"))


SEVERITIES = (0, 1, 2, 3, 4, 5)
CURVE_SQL = v.match_sql((0.5,), ("all",), SEVERITIES) + f""", hits AS (SELECT *, CAST(outcome = 1 AS INT) AS hit FROM matched WHERE outcome <> 2),
totals AS (SELECT severity, class_id, n_gt FROM (SELECT class_id, count(*) AS n_gt FROM gt GROUP BY ALL), (SELECT CAST(unnest({list(SEVERITIES)}) AS INT) AS severity)),
{v.ap_sql('severity, class_id', 'hits', 'totals')}, points AS (SELECT severity, avg(ap) AS point FROM aps GROUP BY ALL),
curve AS (SELECT 'shift' AS corruption, severity, point FROM points)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = _matched(spark, sf_dir, (0.5,), ("all",), SEVERITIES).join(v.images(spark, sf_dir), "image_id", "left_semi")
    n = v.gt_boxes(spark, sf_dir).groupBy("class_id").agg(F.count("*").alias("n_gt"))
    totals = n.withColumn("severity", F.explode(F.array(*map(F.lit, SEVERITIES))))
    aps = me.average_precisions(matched, totals, ["severity", "class_id"], (0.5,))
    points = aps.groupBy("severity").agg(F.avg("ap").alias("point")).withColumn("corruption", F.lit("shift"))
    return me.degradation_curves(points)


@query(CURVE_SQL + " SELECT corruption, severity, round(point, 6) AS point FROM curve")
def degradation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("corruption", "severity", r6("point"))


@query(CURVE_SQL + " SELECT corruption, round(avg(point), 6) AS auc, count(point) AS cells FROM curve GROUP BY corruption")
def corruption_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.corruption_auc(_curve(spark, sf_dir), ["corruption"]).select("corruption", r6("auc"), "cells")


BOOT_SQL = v.match_sql((0.5,), ("all",)) + f""", draws AS (SELECT r AS replicate, image_id, (r*7 + image_id*(r+1)) % 3 AS times FROM images, (SELECT unnest(range(0, 20)) AS r)),
hits AS (SELECT m.*, d.replicate, d.times, CAST(outcome = 1 AS INT) AS hit FROM matched m JOIN draws d ON m.image_id = d.image_id WHERE outcome <> 2 AND times > 0),
totals AS (SELECT d.replicate, g.class_id, CAST(sum(g.n*d.times) AS BIGINT) AS n_gt FROM (SELECT image_id, class_id, count(*) AS n FROM gt GROUP BY ALL) g JOIN draws d ON g.image_id = d.image_id GROUP BY ALL),
{v.ap_sql('replicate, class_id', 'hits', 'totals', weight='times')}"""


def _replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = ma.match_facts(_matched(spark, sf_dir, (0.5,), ("all",)), ["severity"], (0.5,), ("all",))
    counts = ma.gt_counts(v.gt_boxes(spark, sf_dir), ("all",))
    draws = v.images(spark, sf_dir).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<long>")).alias("replicate")).withColumn("times", (F.col("replicate") * 7 + F.col("image_id") * (F.col("replicate") + 1)) % 3)
    return bs.weighted_replicates(facts, counts, draws, ["class_id"])


@query(BOOT_SQL + " SELECT replicate, class_id, n_gt, round(ap, 6) AS ap FROM aps")
def bootstrap_weighted_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replicates(spark, sf_dir).select("replicate", "class_id", "n_gt", r6("ap"))


@query(BOOT_SQL + " SELECT class_id, round(quantile_cont(ap, 0.025), 6) AS ci_low, round(quantile_cont(ap, 0.975), 6) AS ci_high FROM aps GROUP BY class_id")
def percentile_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bs.percentile_interval(_replicates(spark, sf_dir), ["class_id"], "ap").select("class_id", r6("ci_low"), r6("ci_high"))


@query()
def seeded_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NumPy's generator has no SQL form; tests hold it against a plain loop. Every slice, threshold
    and replicate, as in the evaluation report."""
    return bs.bootstrap_slices(_matched(spark, sf_dir), ma.gt_counts(v.gt_boxes(spark, sf_dir)), v.images(spark, sf_dir))


# Reports and decisions, over metrics derived from the customers of each region.

METRICS = """SELECT r_name AS suite, s.axis, s.bucket, CAST(s.cls AS INT) AS class_id, s.metric, count(*) AS n_gt, avg(c_acctbal) / 10000 AS point
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN
(SELECT * FROM (VALUES ('overall', 'all', NULL, 'map', 0, 1), ('weather', 'w0', NULL, 'map', 0, 2), ('weather', 'w1', NULL, 'map', 1, 2), ('class', '0', 0, 'ap', 0, 3), ('class', '1', 1, 'ap', 1, 3), ('class', '2', 2, 'ap', 2, 3)) AS t(axis, bucket, cls, metric, k, m)) s
ON c_custkey % s.m = s.k GROUP BY r_name, s.axis, s.bucket, s.cls, s.metric"""
ROLE = "CASE suite WHEN 'EUROPE' THEN 'in_distribution' WHEN 'ASIA' THEN 'gated' WHEN 'AFRICA' THEN 'gated' ELSE 'other' END"


def _metrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    for t in ("customer", "nation", "region"):
        v.table(spark, sf_dir, t).createOrReplaceTempView(t)
    old = spark.sql(METRICS)
    shift = ((F.col("n_gt") % 7) - 3) / 100
    new = old.withColumn("point", F.col("point") + shift)
    ci = lambda d: d.withColumns({"ci_low": F.col("point") - 0.01, "ci_high": F.col("point") + 0.01})
    roles = v.table(spark, sf_dir, "region").select(F.col("r_name").alias("suite")).withColumn("role", F.expr(ROLE))
    return ci(old), ci(new), roles


NEW_SQL = f"""old AS ({METRICS}), new AS (SELECT * REPLACE (point + ((n_gt % 7) - 3) / 100.0::DOUBLE AS point), point + ((n_gt % 7) - 3) / 100.0::DOUBLE + 0.01 AS high FROM old),
pair AS (SELECT {ROLE.replace('suite', 'o.suite')} AS role, o.suite, o.axis, o.metric, o.point AS op, n.point AS np, n.high, o.n_gt, n.high < o.point AS worse FROM old o JOIN new n ON o.suite = n.suite AND o.axis = n.axis AND o.bucket = n.bucket AND o.metric = n.metric)"""


@query(f"""WITH {NEW_SQL}, o AS (SELECT * FROM pair WHERE axis = 'overall')
SELECT round(max(op) FILTER (role = 'in_distribution'), 6) AS in_distribution, round(sum(op*n_gt) FILTER (role = 'gated') / sum(n_gt) FILTER (role = 'gated'), 6) AS gated, CAST(sum(n_gt) FILTER (role = 'gated') AS BIGINT) AS gated_n_gt,
round(max(op) FILTER (role = 'in_distribution') - sum(op*n_gt) FILTER (role = 'gated') / sum(n_gt) FILTER (role = 'gated'), 6) AS gap FROM o""")
def headline_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _, roles = _metrics(spark, sf_dir)
    return me.headline(old.where("axis = 'overall'"), roles).select(r6("in_distribution"), r6("gated"), "gated_n_gt", r6("gap"))


@query(f"""WITH {NEW_SQL}, o AS (SELECT * FROM pair WHERE axis = 'overall') SELECT suite, round((SELECT op FROM o WHERE role = 'in_distribution') - op, 6) AS gap FROM o WHERE role = 'gated'""")
def suite_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _, roles = _metrics(spark, sf_dir)
    return me.suite_gaps(old.where("axis = 'overall'"), roles).select("suite", r6("gap"))


CLAUSES_SQL = f"""WITH {NEW_SQL}, curves AS (SELECT 'champion' AS model, avg(c_acctbal) / 10000 AS p FROM customer UNION ALL SELECT 'challenger', avg(s_acctbal) / 10000 FROM supplier),
g AS (SELECT sum(op*n_gt)/sum(n_gt) AS o, sum(np*n_gt)/sum(n_gt) AS n, greatest(0, max(op-np)) AS drop_, bool_and(worse) AS allw FROM pair WHERE axis = 'overall' AND role = 'gated'),
i AS (SELECT * FROM pair WHERE axis = 'overall' AND role = 'in_distribution'),
s AS (SELECT count(*) FILTER (n_gt >= 500) AS b, count(*) FILTER (n_gt < 500) AS w FROM pair WHERE axis IN ('class', 'weather') AND role = 'in_distribution' AND worse),
a AS (SELECT max(p) FILTER (model = 'champion') AS o, max(p) FILTER (model = 'challenger') AS n FROM curves),
clauses AS (SELECT 'C1' AS clause, NOT worse AND np >= op AS passed, printf('%.4f -> %.4f', op, np) AS detail FROM i
UNION ALL SELECT 'C2', drop_ <= 0.05 AND n >= o AND NOT allw, printf('%.4f -> %.4f, worst drop %.4f', o, n, drop_) FROM g
UNION ALL SELECT 'C3', b = 0, printf('%d blocks, %d warnings', b, w) FROM s
UNION ALL SELECT 'C4', n >= o - 0.02, printf('%.4f -> %.4f', o, n) FROM a
UNION ALL SELECT 'C5', TRUE, 'serving latency is not measured')"""


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, roles = _metrics(spark, sf_dir)
    part = lambda t, c, m: v.table(spark, sf_dir, t).agg((F.avg(c) / 10000).alias("point")).select(F.lit(m).alias("model"), F.lit("x").alias("corruption"), F.lit(0).alias("severity"), "point")
    return ga.contract(old, new, part("customer", "c_acctbal", "champion").unionByName(part("supplier", "s_acctbal", "challenger")), roles)


@query(CLAUSES_SQL + " SELECT * FROM clauses")
def contract_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clauses(spark, sf_dir)


@query(CLAUSES_SQL + " SELECT bool_and(passed) AS promoted, coalesce(string_agg(clause, ',' ORDER BY clause) FILTER (NOT passed), '') AS failed FROM clauses")
def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.decision(_clauses(spark, sf_dir))


ASSIGN_SQL = "assigned AS (SELECT DISTINCT 'MVI_' || (c_custkey % 50) AS sequence, (['train','train','val','test','prod_holdout'])[(c_custkey // 11) % 5 + 1] AS split FROM customer)"
POOL_SQL = "pool AS (SELECT DISTINCT 'MVI_' || (s_suppkey % 60) AS sequence FROM supplier)"


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = F.array(*map(F.lit, ["train", "train", "val", "test", "prod_holdout"]))
    c = v.table(spark, sf_dir, "customer").select(F.concat(F.lit("MVI_"), F.col("c_custkey") % 50).alias("sequence"), F.get(names, (F.expr("c_custkey div 11") % 5).cast("int")).alias("split")).distinct()
    return c, v.table(spark, sf_dir, "supplier").select(F.concat(F.lit("MVI_"), F.col("s_suppkey") % 60).alias("sequence")).distinct()


@query(f"WITH {ASSIGN_SQL} SELECT sequence, string_agg(split, ',' ORDER BY split) AS splits FROM assigned GROUP BY sequence HAVING count(*) > 1")
def leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.leaked_sequences(_assigned(spark, sf_dir)[0])


@query(f"WITH {ASSIGN_SQL}, {POOL_SQL} SELECT sequence FROM pool WHERE sequence NOT IN (SELECT sequence FROM assigned WHERE split = 'train')")
def trainable_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p = _assigned(spark, sf_dir)
    return ga.outside_train(p, a)


@query(f"WITH {ASSIGN_SQL}, {POOL_SQL} SELECT sequence FROM pool WHERE sequence IN (SELECT sequence FROM assigned WHERE split IN ('test', 'prod_holdout'))")
def pool_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p = _assigned(spark, sf_dir)
    return ga.forbidden_in_pool(p, a)


EPOCHS_SQL = "epochs AS (SELECT o_custkey % 100 AS run_id, CAST(row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) - 1 AS BIGINT) AS epoch, o_totalprice / 1000 AS train_loss, (o_orderkey*37 % 101 + 20) / 20.0::DOUBLE AS val_loss, (o_orderkey*53 % 97) / 97.0::DOUBLE AS map FROM orders)"


@query(f"""WITH {EPOCHS_SQL}, a AS (SELECT run_id, count(*) AS n, arg_min(train_loss, epoch) AS t0, arg_max(train_loss, epoch) AS t1, arg_max(val_loss, epoch) AS v1, min(val_loss) AS vm FROM epochs GROUP BY run_id),
m AS (SELECT run_id, arg_min(train_loss, epoch) AS tm FROM epochs JOIN a USING (run_id) WHERE val_loss = vm GROUP BY run_id),
b AS (SELECT run_id, max(map) AS best FROM epochs GROUP BY run_id), be AS (SELECT run_id, min(epoch) AS best_epoch FROM epochs JOIN b USING (run_id) WHERE map = best GROUP BY run_id),
d AS (SELECT *, n >= 2 AND t1 >= t0 AS diverged FROM a JOIN m USING (run_id) JOIN b USING (run_id) JOIN be USING (run_id)),
o AS (SELECT *, NOT diverged AND n >= 2 AND v1 > vm*1.2::DOUBLE AND t1 < tm AS overfit, NOT diverged AND (best < 0.381::DOUBLE OR CASE WHEN n >= 2 AND t0 <> 0 THEN (t0-t1)/abs(t0) ELSE 0 END < 0.05::DOUBLE) AS underfit FROM d)
SELECT run_id, diverged, overfit, underfit, diverged OR overfit OR underfit AS suspect, best_epoch FROM o""")
def loss_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    o = v.table(spark, sf_dir, "orders").withColumn("run_id", F.col("o_custkey") % 100)
    e = o.select("run_id", (F.row_number().over(W.partitionBy("run_id").orderBy("o_orderkey")) - 1).cast("long").alias("epoch"), (F.col("o_totalprice") / 1000).alias("train_loss"), F.expr("(o_orderkey*37 % 101 + 20) / 20D").alias("val_loss"), F.expr("(o_orderkey*53 % 97) / 97D").alias("map"))
    return ga.diagnose(e)


@query("SELECT round(sum(value)/3600, 6) AS spent_h, round(100000 - sum(value)/3600, 6) AS remaining_h, 2.5::DOUBLE AS needed_h, 100000 - sum(value)/3600 >= 2.5 AS allowed FROM events")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.table(spark, sf_dir, "events").select(F.col("value").alias("seconds"))
    return ga.budget(s, 100_000, 10, 10).select(r6("spent_h"), r6("remaining_h"), "needed_h", "allowed")


@query("SELECT l_suppkey, min(trial) AS trial, max(metric) AS metric FROM (SELECT l_suppkey, l_orderkey*8 + l_linenumber AS trial, l_quantity AS metric, max(l_quantity) OVER (PARTITION BY l_suppkey) AS top FROM lineitem) WHERE metric = top GROUP BY l_suppkey")
def best_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_orderkey*8 + l_linenumber as trial", "l_quantity as metric")
    return ga.best_trial(t, ["l_suppkey"])


@query("""WITH z AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS u, list_avg(CAST(embedding AS DOUBLE[])) AS m FROM embeddings),
c AS (SELECT vec_id, label, list_transform(u, lambda x: x - m) AS w FROM z),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.w, b.w) AS corr FROM c a JOIN c b ON a.label <= 2 AND b.label > 2)
SELECT a, b, round(corr, 6) AS corr, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY corr DESC, b) AS place FROM p) WHERE place <= 3""")
def nearest_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels up to 2 stand for the dark scenes, the others for the bright ones."""
    raw = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    f = raw.drop("label")
    return fe.nearest(f, raw.where("label <= 2").select("id"), raw.where("label > 2").select("id")).select("a", "b", r6("corr"), "place")


@query("""WITH RECURSIVE z AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS u, list_avg(CAST(embedding AS DOUBLE[])) AS m FROM embeddings),
c AS (SELECT vec_id, list_transform(u, lambda x: x - m) AS w FROM z),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM c a JOIN c b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.w, b.w) > 0.8),
r AS (SELECT vec_id AS id, vec_id AS cluster FROM embeddings UNION SELECT l.b, r.cluster FROM r JOIN l ON l.a = r.id)
SELECT id, min(cluster) AS cluster FROM r GROUP BY id""")
def camera_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return fe.clusters(f)


@query()
def noise_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of small images under every numeric corruption; a generator's draws have no SQL form."""
    raw = v.images(spark, sf_dir).select(F.col("image_id").cast("string").alias("image_id"))

    @F.pandas_udf("binary")
    def picture(ids: pd.Series) -> pd.Series:
        return pd.Series([((np.arange(8 * 8 * 3) * 7 + int(i)) % 256).astype(np.uint8).tobytes() for i in ids])

    pics = raw.select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), picture("image_id").alias("data"))
    kinds = [(k, s) for k in ("brightness_up", "brightness_down", "gaussian_noise", "gaussian_blur") for s in (0, 1, 5)]
    return co.corrupt_images(pics, kinds).select("image_id", "corruption", "severity", F.sha2("data", 256).alias("sha256"))


@query("SELECT 'MVI_' || (user_id % 50) AS sequence, count(DISTINCT event_id) AS frame_count, 'zip/' || 'MVI_' || (user_id % 50) AS archive_dir, 'abc' AS source_md5 FROM events GROUP BY ALL")
def frame_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import frame_manifest as build

    f = v.table(spark, sf_dir, "events").select(F.concat(F.lit("MVI_"), F.col("user_id") % 50).alias("sequence"), F.col("event_id").alias("frame_num"))
    dirs = f.select("sequence").distinct().withColumn("archive_dir", F.concat(F.lit("zip/"), "sequence"))
    return build(f, dirs, "abc")


@query(f"""WITH {V}, d AS (SELECT image_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, least(1, greatest(0, (x1 + (x2-x1)/2)/960.0::DOUBLE)), least(1, greatest(0, (y1 + (y2-y1)/2)/540.0::DOUBLE)),
  least(1, greatest(0, (x2-x1)/960.0::DOUBLE)), least(1, greatest(0, (y2-y1)/540.0::DOUBLE))), chr(10) ORDER BY gt_ordinal) AS body FROM gt GROUP BY image_id)
SELECT i.image_id, coalesce(body, '') || chr(10) AS label_text FROM images i LEFT JOIN d ON i.image_id = d.image_id""")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import label_texts

    boxes = v.gt_boxes(spark, sf_dir).selectExpr("image_id", "class_id", "gt_ordinal as ordinal", "x1 as left", "y1 as top", "x2-x1 as width", "y2-y1 as height")
    return label_texts(v.images(spark, sf_dir), boxes)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean average precision of every slice."""
    return map_by_slice(spark, sf_dir)
