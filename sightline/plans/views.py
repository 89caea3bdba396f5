"""Boxes derived from the events table by integer arithmetic, alike in Spark and in DuckDB.

Each event is a ground-truth box and, shifted, a detection; there are fifty events an image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NATIVE = ["car", "bus", "van", "others", "bike", "zeppelin"]
#: model: multipliers and ranges of the shift
SHIFTS = {"champion": (13, 23, 17, 19), "challenger": (7, 17, 11, 13)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, image_id, q, value."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    n = max(events.count() // 50, 1)
    return events.selectExpr("event_id", f"event_id % {n} as image_id", f"event_id div {n} as q", "value")


def _xywh(e: DataFrame) -> DataFrame:
    return e.selectExpr("*", "(event_id*37 + q*29) % 200 as x", "(event_id*53 + q*17) % 120 as y", "20 + (q*7 + event_id) % 100 as w", "20 + (q*11 + event_id) % 100 as h")


def gt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _xywh(base(spark, sf_dir))
    return e.selectExpr("image_id", "event_id as gt_ordinal", "cast(q % 3 as int) as class_id", "cast(x as double) as x1", "cast(y as double) as y1", "cast(x+w as double) as x2", "cast(y+h as double) as y2")


def detections(spark: SparkSession, sf_dir: str, model: str = "champion", severities: tuple[int, ...] = (0,)) -> DataFrame:
    a, b, c, d = SHIFTS[model]
    e = _xywh(base(spark, sf_dir)).withColumn("severity", F.explode(F.array(*map(F.lit, severities))))
    e = e.selectExpr("*", f"x + (event_id*{a}) % {b} - {b // 2} + 3*severity as dx", f"y + (event_id*{c}) % {d} - {d // 2} as dy")
    return e.selectExpr("severity", "image_id", "event_id as det_ordinal", "cast(q % 3 as int) as class_id", "floor(value/20D)/25D as score", "cast(dx as double) as x1", "cast(dy as double) as y1", "cast(dx+w as double) as x2", "cast(dy+h as double) as y2")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("image_id").distinct().selectExpr("image_id", "concat('w', image_id % 4) as weather", "concat('c', image_id % 7) as camera")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir).where("image_id % 3 = 0")
    return i.selectExpr("image_id", "cast((image_id*31) % 180 as double) as x1", "cast((image_id*23) % 100 as double) as y1", "cast((image_id*31) % 180 + 60 as double) as x2", "cast((image_id*23) % 100 + 50 as double) as y2")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated frames with close and conflicting boxes: each box, and its detection as a second
    target, of another class for every fourth."""
    gt = gt_boxes(spark, sf_dir).selectExpr("image_id", "cast(gt_ordinal*2 as int) as ordinal", "class_id", "x1", "y1", "x2", "y2")
    det = detections(spark, sf_dir).selectExpr("image_id", "cast(det_ordinal*2+1 as int) as ordinal", "cast(if(det_ordinal % 4 = 0, (class_id+1) % 3, class_id) as int) as class_id", "x1", "y1", "x2", "y2")
    names = F.array(*map(F.lit, NATIVE))
    return gt.unionByName(det).select(F.concat(F.lit("MVI_"), F.col("image_id") % 20).alias("sequence"), F.col("image_id").alias("frame_num"), "ordinal", F.get(names, "class_id").alias("native_class"), F.col("x1").alias("left"), F.col("y1").alias("top"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))


def sequence_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).selectExpr("concat('MVI_', image_id % 20) as sequence", "image_id as ordinal", "x1 + 0.5 as left", "y1 + 0.25 as top", "x2 - x1 as width", "y2 - y1 as height")


# The same in DuckDB.

VIEWS_SQL = """
n AS (SELECT greatest(count(*) // 50, 1) AS n FROM events),
base AS (SELECT event_id, event_id % n AS image_id, event_id // n AS q, value FROM events, n),
e AS (SELECT *, (event_id*37 + q*29) % 200 AS x, (event_id*53 + q*17) % 120 AS y, 20 + (q*7 + event_id) % 100 AS w, 20 + (q*11 + event_id) % 100 AS h FROM base),
gt AS (SELECT image_id, event_id AS gt_ordinal, CAST(q % 3 AS INT) AS class_id, x::DOUBLE AS x1, y::DOUBLE AS y1, (x+w)::DOUBLE AS x2, (y+h)::DOUBLE AS y2 FROM e),
det AS (
  SELECT CAST(severity AS INT) AS severity, image_id, event_id AS det_ordinal, CAST(q % 3 AS INT) AS class_id, floor(value/20.0::DOUBLE)/25.0::DOUBLE AS score,
    dx::DOUBLE AS x1, dy::DOUBLE AS y1, (dx+w)::DOUBLE AS x2, (dy+h)::DOUBLE AS y2
  FROM (SELECT *, x + (event_id*13) % 23 - 11 + 3*severity AS dx, y + (event_id*17) % 19 - 9 AS dy FROM e, (SELECT unnest({severities}) AS severity))),
images AS (SELECT DISTINCT image_id, 'w' || (image_id % 4) AS weather, 'c' || (image_id % 7) AS camera FROM base),
regions AS (
  SELECT image_id, ((image_id*31) % 180)::DOUBLE AS x1, ((image_id*23) % 100)::DOUBLE AS y1, ((image_id*31) % 180 + 60)::DOUBLE AS x2, ((image_id*23) % 100 + 50)::DOUBLE AS y2
  FROM images WHERE image_id % 3 = 0),
targets AS (
  SELECT 'MVI_' || (image_id % 20) AS sequence, image_id AS frame_num, ordinal, (['car','bus','van'])[class_id + 1] AS native_class, x1, y1, x2, y2
  FROM (SELECT image_id, CAST(gt_ordinal*2 AS INT) AS ordinal, class_id, x1, y1, x2, y2 FROM gt
        UNION ALL SELECT image_id, CAST(det_ordinal*2+1 AS INT), CASE WHEN det_ordinal % 4 = 0 THEN (class_id+1) % 3 ELSE class_id END, x1, y1, x2, y2 FROM det WHERE severity = 0))
"""


def overlap_sql(a: str, b: str) -> str:
    return f"(greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0.0::DOUBLE)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0.0::DOUBLE))"


def area_sql(a: str) -> str:
    return f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1))"


def iou_sql(a: str, b: str) -> str:
    return f"({overlap_sql(a, b)}/({area_sql(a)}+{area_sql(b)}-{overlap_sql(a, b)}))"


def views_sql(severities: tuple[int, ...] = (0,)) -> str:
    return VIEWS_SQL.format(severities=list(severities))


RANGE_SQL = {"all": (-1, 1e300), "small": (0, 1024), "medium": (1024, 9216), "large": (9216, 1e300)}


def match_sql(thresholds: tuple[float, ...], ranges: tuple[str, ...], severities: tuple[int, ...] = (0,)) -> str:
    """CTEs that end in `matched`: the greedy fold as recursion over detections by rank."""
    grid = ", ".join(f"({t}::DOUBLE, '{r}', {RANGE_SQL[r][0]}::DOUBLE, {RANGE_SQL[r][1]}::DOUBLE)" for t in thresholds for r in ranges)
    key = "severity, image_id, class_id, thr, rng"
    same = " AND ".join(f"s.{k} = t.{k}" for k in key.split(", "))
    return f"""WITH RECURSIVE {views_sql(severities)},
grid AS (SELECT * FROM (VALUES {grid}) AS g(thr, rng, lo, hi)),
pairs AS (SELECT d.severity, d.image_id, d.class_id, d.det_ordinal, g.gt_ordinal, {iou_sql('d', 'g')} AS iou, {area_sql('g')} AS size
  FROM det d JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id WHERE {iou_sql('d', 'g')} >= {min(thresholds)}::DOUBLE),
cand AS (SELECT severity, image_id, class_id, det_ordinal, thr, rng,
    list(gt_ordinal ORDER BY iou DESC, gt_ordinal) FILTER (WHERE size >= lo AND size < hi) AS reals,
    list(gt_ordinal ORDER BY iou DESC, gt_ordinal) FILTER (WHERE NOT (size >= lo AND size < hi)) AS others
  FROM pairs, grid WHERE iou >= thr GROUP BY ALL),
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY d.severity, d.image_id, d.class_id ORDER BY score DESC, det_ordinal) AS rk,
    coalesce({overlap_sql('d', 'r')} / {area_sql('d')} >= 0.5, FALSE) AND r.image_id IS NOT NULL AS excused
  FROM det d LEFT JOIN regions r ON d.image_id = r.image_id),
todo AS (SELECT k.severity, k.image_id, k.class_id, g.thr, g.rng, k.det_ordinal, k.score, k.rk, k.excused, coalesce(c.reals, []) AS reals, coalesce(c.others, []) AS others
  FROM ranked k CROSS JOIN grid g LEFT JOIN cand c ON c.severity = k.severity AND c.image_id = k.image_id AND c.class_id = k.class_id AND c.det_ordinal = k.det_ordinal AND c.thr = g.thr AND c.rng = g.rng),
step AS (
  SELECT DISTINCT {key}, 0::BIGINT AS rk, []::BIGINT[] AS used, NULL::BIGINT AS det_ordinal, NULL::DOUBLE AS score, NULL::INT AS outcome FROM todo
  UNION ALL
  SELECT {key}, rk, CASE WHEN g IS NOT NULL THEN list_append(used, g) WHEN o IS NOT NULL THEN list_append(used, o) ELSE used END, det_ordinal, score,
    CASE WHEN g IS NOT NULL THEN 1 WHEN o IS NOT NULL OR excused THEN 2 ELSE 0 END
  FROM (SELECT {', '.join('t.' + k for k in key.split(', '))}, t.rk, t.det_ordinal, t.score, t.excused, s.used,
      list_filter(t.reals, lambda v: NOT list_contains(s.used, v))[1] AS g, list_filter(t.others, lambda v: NOT list_contains(s.used, v))[1] AS o
    FROM step s JOIN todo t ON {same} AND t.rk = s.rk + 1)),
matched AS (SELECT {key}, det_ordinal, score, outcome FROM step WHERE rk > 0)"""


def ap_sql(group: str, facts: str, totals: str, name: str = "aps", weight: str = "1.0::DOUBLE") -> str:
    """CTEs that end in `name`: (group, n_gt, ap) from facts (group, image_id, det_ordinal, score,
    hit) and totals (group, n_gt)."""
    on = " AND ".join(f"x.{g.strip()} = t.{g.strip()}" for g in group.split(","))
    back = " AND ".join(f"t.{g.strip()} = x.{g.strip()}" for g in group.split(","))
    return f"""
{name}_run AS (SELECT {group}, sum(hit*{weight}) OVER w AS tp, sum({weight}) OVER w AS n FROM {facts}
  WINDOW w AS (PARTITION BY {group} ORDER BY score DESC, image_id, det_ordinal ROWS UNBOUNDED PRECEDING)),
{name}_pts AS (SELECT {', '.join('x.' + g.strip() for g in group.split(','))}, tp / t.n_gt AS recall, tp / greatest(x.n, 1e-12) AS prec FROM {name}_run x JOIN {totals} t ON {on} WHERE t.n_gt > 0),
{name}_best AS (SELECT {group}, i, max(prec) AS prec FROM {name}_pts, (SELECT unnest(range(0, 101)) AS i) WHERE recall >= i::DOUBLE * 0.01::DOUBLE GROUP BY ALL),
{name}_sum AS (SELECT {group}, sum(prec) / 101.0::DOUBLE AS ap FROM {name}_best GROUP BY ALL),
{name} AS (SELECT {', '.join('t.' + g.strip() for g in group.split(','))}, t.n_gt, CASE WHEN t.n_gt > 0 THEN coalesce(x.ap, 0) END AS ap FROM {totals} t LEFT JOIN {name}_sum x ON {back})"""
