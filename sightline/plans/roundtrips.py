"""Registered queries over readers, writers and guards: files are written from the tables and read back.

The files lie in the folder that the cluster names in spark.checkpoint.dir; on a local master without one,
in a folder of this process that is removed at its end.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import corners, out_of_bounds
from ..operators import gates as ga
from ..operators import metrics as me
from ..operators import splits as sp
from ..operators import taxonomy as ta
from ..sources import annotations as an
from ..sources import sinks as si
from ..sources.shared import folder
from . import views as v
from .queries import METRICS, NEW_SQL, POOL_SQL, V, _metrics, query, r6

def _documents(spark: SparkSession, rows: DataFrame, by: str, name: str) -> str:
    """One file for each row of (by, value)."""
    path = folder(spark, name)
    rows.select(by, "value").repartition(by).write.partitionBy(by).option("maxRecordsPerFile", 1).text(path)
    return path


def _xml_box(c: str) -> F.Column:
    return F.concat(*[F.concat(F.lit(f' {n}="'), F.col(f"{c}.{n}").cast("string"), F.lit('"')) for n in ("left", "top", "width", "height")])


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated frames as XML, a document a sequence, read back."""
    place = ["left", "top", "width", "height"]
    t = v.targets(spark, sf_dir).select("sequence", "frame_num", "ordinal", F.struct("native_class", *place).alias("t"))
    one = t.select("sequence", "frame_num", "ordinal", F.concat(F.lit("<target><box"), _xml_box("t"), F.lit('/><attribute vehicle_type="'), "t.native_class", F.lit('"/></target>')).alias("x"))

    def joined(order: str) -> F.Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "x"))), lambda s: s["x"]), "")

    frames = one.groupBy("sequence", "frame_num").agg(joined("ordinal").alias("x")).withColumn("x", F.concat(F.lit('<frame num="'), F.col("frame_num").cast("string"), F.lit('"><target_list>'), "x", F.lit("</target_list></frame>")))
    bodies = frames.groupBy("sequence").agg(joined("frame_num").alias("body"))
    r = v.sequence_regions(spark, sf_dir).select("sequence", "ordinal", F.struct(*place).alias("r")).select("sequence", "ordinal", F.concat(F.lit("<box"), _xml_box("r"), F.lit("/>")).alias("x"))
    ignored = r.groupBy("sequence").agg(joined("ordinal").alias("ignored"))
    doc = F.concat(F.lit('<sequence name="'), "sequence", F.lit('"><sequence_attribute sence_weather="sunny"/>'), F.coalesce(F.concat(F.lit("<ignored_region>"), "ignored", F.lit("</ignored_region>")), F.lit("")), "body", F.lit("</sequence>"))
    return an.read_sequences(spark, _documents(spark, bodies.join(ignored, "sequence", "left").select("sequence", doc.alias("value")), "sequence", "sequences"))


@query(f"WITH {V} SELECT sequence, frame_num, CAST(row_number() OVER (PARTITION BY sequence, frame_num ORDER BY ordinal) - 1 AS INT) AS ordinal, native_class, x1 AS left_, y1 AS top_, x2 - x1 AS width, y2 - y1 AS height FROM targets")
def sequence_file_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.sequence_targets(_sequences(spark, sf_dir)).select("sequence", F.col("frame_num").cast("long").alias("frame_num"), "ordinal", "native_class", F.col("left").alias("left_"), F.col("top").alias("top_"), "width", "height")


@query(f"WITH {V} SELECT 'MVI_' || (image_id % 20) AS sequence, CAST(row_number() OVER (PARTITION BY image_id % 20 ORDER BY image_id) - 1 AS INT) AS ordinal, x1 + 0.5 AS left_, y1 + 0.25 AS top_, x2 - x1 AS width, y2 - y1 AS height FROM regions")
def sequence_file_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.sequence_regions(_sequences(spark, sf_dir)).select("sequence", "ordinal", F.col("left").alias("left_"), F.col("top").alias("top_"), "width", "height")


@query(f"""WITH {V}, f AS (SELECT DISTINCT sequence, frame_num FROM targets),
p AS (SELECT sequence, frame_num // 40 AS tens, row_number() OVER (PARTITION BY sequence ORDER BY frame_num) - 1 AS pos FROM f)
SELECT sequence, CAST(tens AS BIGINT) AS frame_num, CAST(max(pos) AS INT) AS frame_pos FROM p GROUP BY sequence, tens""")
def sequence_file_last_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = an.sequence_frames(_sequences(spark, sf_dir)).withColumn("frame_num", F.expr("cast(frame_num div 40 as long)"))
    return an.last_frames(frames).select("sequence", "frame_num", "frame_pos")


@query(f"WITH {V} SELECT lpad(CAST(image_id AS VARCHAR), 8, '0') AS image_id, (['car','bus','van'])[class_id + 1] AS native_class, x1, y1, x2, y2 FROM gt")
def csv_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, v.NATIVE))
    path = folder(spark, "csv")
    v.gt_boxes(spark, sf_dir).select(F.lpad(F.col("image_id").cast("string"), 8, "0").alias("image_id"), F.get(names, "class_id").alias("native_class"), "x1", "y1", "x2", "y2").write.csv(path)
    return an.read_csv_boxes(spark, path)


@query(f"WITH {V} SELECT 'f' || g.image_id || '.jpg' AS file_name, CAST(class_id AS VARCHAR) AS native_class, x1, y1, x2, y2 FROM gt g")
def coco_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each eighth of the images; its image table is joined to its annotations."""
    part = F.col("image_id") % 8
    i = v.images(spark, sf_dir).groupBy(part.alias("part")).agg(F.collect_list(F.struct(F.col("image_id").alias("id"), F.lit(960).alias("width"), F.lit(540).alias("height"), F.concat(F.lit("f"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"))).alias("images"))
    a = v.gt_boxes(spark, sf_dir).groupBy(part.alias("part")).agg(F.collect_list(F.struct("image_id", F.col("class_id").alias("category_id"), F.expr("array(x1, y1, x2 - x1, y2 - y1)").alias("bbox"))).alias("annotations"))
    path = _documents(spark, i.join(a, "part").select("part", F.to_json(F.struct("images", "annotations")).alias("value")), "part", "coco")
    images, boxes = an.read_coco(spark, path)
    return boxes.join(images.select("image_id", "file_name"), "image_id").select("file_name", "native_class", "x1", "y1", "x2", "y2")


@query(f"WITH {V} SELECT 'i' || image_id AS image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY gt_ordinal) - 1 AS INT) AS gt_ordinal, class_id, x1, y1, x2, y2 FROM gt")
def manifest_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("i"), F.col("image_id").cast("string")).alias("image_id")
    box = ["x1", "y1", "x2", "y2"]
    whole = si.compact_manifest(v.images(spark, sf_dir).select(name, "camera", "weather"), v.gt_boxes(spark, sf_dir).select(name, "gt_ordinal", "class_id", *box), v.regions(spark, sf_dir).select(name, *box))
    docs = whole.groupBy("camera").agg(F.collect_list(F.struct(F.col("image_id").alias("id"), "camera", "weather", "boxes", "ignore")).alias("images"))
    path = _documents(spark, docs.select("camera", F.to_json(F.struct(F.create_map(F.lit("dataset"), F.lit("events")).alias("meta"), "images")).alias("value")), "camera", "manifest")
    return an.read_manifest(spark, path)[1]


@query(f"WITH {V} SELECT 'MVI_' || (image_id % 20) AS sequence, x1 + 0.5 AS x1, y1 + 0.25 AS y1, x2 + 0.5 AS x2, y2 + 0.25 AS y2 FROM regions")
def ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = v.sequence_regions(spark, sf_dir)
    docs = si.ignore_documents(v.targets(spark, sf_dir), regions)
    return an.read_ignore_json(spark, _documents(spark, docs.select("sequence", F.col("document").alias("value")), "sequence", "ignore")).select("sequence", "x1", "y1", "x2", "y2")


@query("SELECT CAST(event_id AS INT) AS epoch, round(value + 1.5 + user_id, 6) AS train_loss, round(value * 2, 6) AS val_loss, round((event_id % 97) / 97.0::DOUBLE, 6) AS map FROM events")
def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "log")
    e = v.table(spark, sf_dir, "events")
    e.selectExpr("event_id as epoch", "value as `train/a_loss`", "1.5 as ` train/b_loss`", "user_id as `train/c_loss`", "value * 2 as `val/a_loss`", "(event_id % 97) / 97D as `metrics/mAP50-95(B) `", "7 as `lr/pg0`").write.csv(path, header=True)
    return an.read_results(spark, path).select("epoch", r6("train_loss"), r6("val_loss"), r6("map"))


@query(f"WITH m AS ({METRICS}) SELECT suite, axis, bucket, round(point, 6) AS point, round(point - 0.01, 6) AS ci_low, round(point + 0.01, 6) AS ci_high, n_gt FROM m")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _, roles = _metrics(spark, sf_dir)
    cell = F.struct("point", "ci_low", "ci_high", "n_gt")
    axes = old.groupBy("suite", "axis").agg(F.map_from_entries(F.collect_list(F.struct("bucket", cell.alias("m")))).alias("buckets"))
    suites = axes.groupBy("suite").agg(F.map_from_entries(F.collect_list(F.struct("axis", "buckets"))).alias("slices")).join(roles, "suite")
    docs = suites.select("suite", F.to_json(F.struct(F.map_from_arrays(F.array("suite"), F.array(F.struct("role", "slices"))).alias("suites"))).alias("value"))
    return an.read_report(spark, _documents(spark, docs.withColumnRenamed("suite", "part"), "part", "report")).select("suite", "axis", "bucket", r6("point"), r6("ci_low"), r6("ci_high"), "n_gt")


@query("SELECT 'n' || (n_nationkey % 3) AS dataset, n_name AS native, 'str' AS native_type, (['map','ignore','exclude'])[n_nationkey % 3 + 1] AS verb, CASE WHEN n_nationkey % 3 = 0 THEN 'c' || (n_regionkey) END AS canonical FROM nation")
def taxonomy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import yaml

    rows = v.table(spark, sf_dir, "nation").collect()  # configuration: 25 rows
    sets: dict = {}
    for r in rows:
        verb = ("map", "ignore", "exclude")[r["n_nationkey"] % 3]
        own = sets.setdefault(f"n{r['n_nationkey'] % 3}", {})
        if verb == "map":
            own.setdefault(verb, {})[r["n_name"]] = f"c{r['n_regionkey']}"
        else:
            own.setdefault(verb, []).append(r["n_name"])
    path = folder(spark, "taxonomy") + ".yaml"
    si.write_small(spark, path, yaml.safe_dump({"canonical": [{"id": k, "name": f"c{k}"} for k in range(5)], "datasets": sets}))
    routes, _ = an.taxonomy_tables(spark, an.read_config(spark, path))
    return routes


@query("SELECT 'MVI_' || r_regionkey AS sequence, count(n_nationkey) FILTER (n_nationkey % 5 <> 0) AS images FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zip with a member for each nation: pictures, but for every fifth."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for r in v.table(spark, sf_dir, "nation").collect():  # 25 rows
            z.writestr(f"set/MVI_{r['n_regionkey']}/{r['n_nationkey']}.{'txt' if r['n_nationkey'] % 5 == 0 else 'jpg'}", r["n_name"])
    path = folder(spark, "archive") + ".zip"
    si.write_bytes(spark, path, raw.getvalue())
    sequences = v.table(spark, sf_dir, "region").select(F.concat(F.lit("MVI_"), F.col("r_regionkey").cast("string")).alias("sequence"))
    return an.member_counts(an.archive_members(spark, path), sequences)


@query("SELECT 'set/MVI_' || n_regionkey || '/' || n_nationkey || '.jpg' AS member FROM nation WHERE n_nationkey % 5 = 0")
def archive_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = v.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("set/MVI_"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"), F.lit(".jpg")).alias("member"))
    return an.missing_members(n.select("member"), n.where("n_nationkey % 5 <> 0").select("member"))


@query("SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey")
def frozen_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, frozen, refused to a second writer, and read."""
    path = folder(spark, "dataset")
    data = si.DatasetDir(spark, path, "w")
    data.write("orders", v.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders")))
    data.freeze("the query reads it")
    try:
        si.DatasetDir(spark, path, "w")
    except si.ReadOnlyDatasetError:
        return si.DatasetDir(spark, path).read("orders")
    raise AssertionError("a frozen dataset was opened for writing")


@query("SELECT r_name AS name, sha256(r_name) AS sha256, CASE WHEN r_regionkey % 2 = 0 THEN 'verified' ELSE 'pinned' END AS state FROM region")
def checksum_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = folder(spark, "sums")
    for r in v.table(spark, sf_dir, "region").collect():  # 5 rows
        si.write_small(spark, f"{top}/{r['r_name'].replace(' ', '_')}", r["r_name"])
    found = si.checksums(spark, top).select(F.replace(F.regexp_extract("path", "([^/]+)$", 1), F.lit("_"), F.lit(" ")).alias("name"), "sha256")
    locks = found.join(v.table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(F.col("r_name").alias("name")), "name", "left_semi")
    return si.verify_or_pin(found, locks)


@query("SELECT arg_max(version, moment) AS version FROM (SELECT CAST(o_orderkey AS VARCHAR) AS version, strftime(o_orderdate, '%Y-%m-%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS moment FROM orders UNION ALL SELECT 'new', '2999-01-01')")
def champion_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("version"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("at"))
    return si.champion(si.alias_events(si.alias_events(events, "never", False, "3999-01-01"), "new", True, "2999-01-01"))


@query(f"WITH {NEW_SQL} SELECT o.suite, o.axis, o.bucket, o.metric, round(o.point, 6) AS point, CASE WHEN o.axis <> 'class' THEN round(o.point - 0.01, 6) END AS ci_low, CASE WHEN o.axis <> 'class' THEN round(o.point + 0.01, 6) END AS ci_high FROM old o")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _, _ = _metrics(spark, sf_dir)
    keys = ["suite", "axis", "bucket", "metric"]
    return me.merge_intervals(old.select(*keys, "point"), old.where("axis <> 'class'").select(*keys, "ci_low", "ci_high"), keys).select(*keys, r6("point"), r6("ci_low"), r6("ci_high"))


@query(f"""WITH {NEW_SQL} SELECT suite, axis, bucket, metric, n_gt, round(op, 6) AS old, round(np, 6) AS new, CASE WHEN n_gt >= 500 THEN 'block' ELSE 'warning' END AS kind
FROM (SELECT o.suite, o.axis, o.bucket, o.metric, o.point AS op, n.point AS np, o.n_gt, n.high FROM old o JOIN new n ON o.suite = n.suite AND o.axis = n.axis AND o.bucket = n.bucket AND o.metric = n.metric)
WHERE axis IN ('class', 'weather') AND high < op""")
def slice_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, roles = _metrics(spark, sf_dir)
    roles = roles.withColumn("role", F.lit("in_distribution"))  # all suites, so that some slices are worse
    return ga.slice_regressions(old, new, roles).select("suite", "axis", "bucket", "metric", "n_gt", r6("old"), r6("new"), "kind")


GROUPS_SQL = """members AS (SELECT n_name AS grp, 'w' || (n_regionkey % 3) AS weather, 'MVI_' || c_custkey AS sequence, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
chosen AS (SELECT n_name AS grp, (['train','val','test','prod_holdout'])[n_nationkey % 4 + 1] AS split FROM nation WHERE n_nationkey % 6 <> 0 UNION ALL SELECT n_name, 'test' FROM nation WHERE n_nationkey % 9 = 1 UNION ALL SELECT 'nowhere', 'val')"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = v.table(spark, sf_dir, "nation")
    members = v.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    groups = members.groupBy(F.col("n_name").alias("group")).agg(F.collect_set(F.concat(F.lit("w"), (F.col("n_regionkey") % 3).cast("string"))).alias("weathers"), F.collect_list(F.concat(F.lit("MVI_"), F.col("c_custkey").cast("string"))).alias("sequences"))
    names = F.array(*map(F.lit, sp.SPLITS[:1] + ("val", "test", "prod_holdout")))
    first = nation.where("n_nationkey % 6 <> 0").select(F.get(names, (F.col("n_nationkey") % 4).cast("int")).alias("split"), F.col("n_name").alias("group"))
    more = nation.where("n_nationkey % 9 = 1").select(F.lit("test"), "n_name")
    return first.union(more).union(spark.createDataFrame([("val", "nowhere")], "split string, group string")), groups


@query(f"WITH {GROUPS_SQL} SELECT split, count(DISTINCT m.grp) AS groups, count(DISTINCT sequence) AS sequences FROM chosen c JOIN members m ON c.grp = m.grp GROUP BY split")
def split_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, groups = _split(spark, sf_dir)
    return sp.manifest_counts(sp.manifests(assigned, groups))


@query(f"""WITH {GROUPS_SQL}, known AS (SELECT DISTINCT grp, weather FROM members), minima AS (SELECT * FROM (VALUES ('val', 'w0', 1), ('val', 'w1', 500), ('test', 'w9', 1)) AS t(split, weather, need))
SELECT 'assigned twice' AS fault, grp AS name FROM chosen GROUP BY grp HAVING count(*) > 1
UNION ALL SELECT 'not assigned', grp FROM (SELECT DISTINCT grp FROM known) WHERE grp NOT IN (SELECT grp FROM chosen)
UNION ALL SELECT 'unknown group', grp FROM chosen WHERE grp NOT IN (SELECT grp FROM known)
UNION ALL SELECT 'too few groups', split || '/' || weather FROM minima x WHERE (SELECT count(*) FROM chosen c JOIN known k ON c.grp = k.grp WHERE c.split = x.split AND k.weather = x.weather) < need""")
def split_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, groups = _split(spark, sf_dir)
    minima = spark.createDataFrame([("val", "w0", 1), ("val", "w1", 500), ("test", "w9", 1)], "split string, weather string, need int")
    return sp.split_faults(assigned, groups, minima)


@query("""WITH routes AS (SELECT p_brand AS dataset, p_type AS native, (['map','ignore','exclude'])[p_size % 3 + 1] AS verb, CASE WHEN p_size % 3 = 0 THEN 'c' || (p_size % 9) END AS canonical FROM part),
canon AS (SELECT 'c' || (s_suppkey % 5) AS name FROM supplier WHERE s_suppkey <= 7)
SELECT 'canonical name repeats' AS fault, name FROM canon GROUP BY name HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'target is not canonical', canonical FROM routes WHERE verb = 'map' AND canonical NOT IN (SELECT name FROM canon)
UNION ALL SELECT 'routed twice', dataset || '/' || native FROM routes GROUP BY dataset, native HAVING count(*) > 1""")
def taxonomy_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    verbs = F.array(*map(F.lit, ("map", "ignore", "exclude")))
    third = (F.col("p_size") % 3).cast("int")
    routes = v.table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("native"), F.get(verbs, third).alias("verb"), F.when(third == 0, F.concat(F.lit("c"), (F.col("p_size") % 9).cast("string"))).alias("canonical"))
    canon = v.table(spark, sf_dir, "supplier").where("s_suppkey <= 7").select(F.concat(F.lit("c"), (F.col("s_suppkey") % 5).cast("string")).alias("name"))
    return ta.taxonomy_faults(routes, canon)


@query(f"WITH {V} SELECT det_ordinal, x1 < -0.5 * 200 OR y1 < -0.5 * 120 OR x2 > 1.5 * 200 OR y2 > 1.5 * 120 AS gross FROM det")
def gross_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.detections(spark, sf_dir).select("det_ordinal", out_of_bounds(corners(), F.lit(200.0), F.lit(120.0)).alias("gross"))


@query(f"WITH {V} SELECT det_ordinal, CAST(class_id + 1 AS INT) AS class_id FROM det WHERE class_id <> 2")
def scored_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([(0, 1), (1, 2)], "model_id int, class_id int")
    return ta.relabel(v.detections(spark, sf_dir).withColumnRenamed("class_id", "model_id"), mapping).select("det_ordinal", "class_id")


@query(f"""WITH {V}, s AS (SELECT 'overall' AS axis, 'all' AS bucket FROM images UNION ALL SELECT 'weather', weather FROM images UNION ALL SELECT 'camera', camera FROM images UNION ALL SELECT 'scale', unnest(['small', 'medium', 'large']) FROM images)
SELECT axis, bucket, count(*) AS n_images FROM s GROUP BY axis, bucket""")
def slice_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.slice_universe(v.images(spark, sf_dir), ["all", "small", "medium", "large"])


@query(f"WITH {V} SELECT image_id, weather FROM images ORDER BY image_id LIMIT 100")
def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: a run over the first image ids alone."""
    return me.first_images(v.images(spark, sf_dir), 100).select("image_id", "weather")


@query(f"WITH {POOL_SQL} SELECT DISTINCT 'MVI_' || (user_id % 90) AS sequence FROM events WHERE 'MVI_' || (user_id % 90) NOT IN (SELECT sequence FROM pool)")
def unlisted_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference as the leakage guard takes it: sequences that no pool lists."""
    pool = v.table(spark, sf_dir, "supplier").select(F.concat(F.lit("MVI_"), F.col("s_suppkey") % 60).alias("sequence")).withColumn("split", F.lit("train"))
    return ga.outside_train(v.table(spark, sf_dir, "events").select(F.concat(F.lit("MVI_"), F.col("user_id") % 90).alias("sequence")), pool)
