"""Readers of annotation formats, as tables with explicit schemas. All take paths that Spark reads."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import from_ltwh, from_yolo

_BOX = "STRUCT<_left: DOUBLE, _top: DOUBLE, _width: DOUBLE, _height: DOUBLE>"
#: Fixed format of sequence files; the source spells its weather attribute this way.
SEQUENCE_SCHEMA = f"""
_name STRING,
sequence_attribute STRUCT<_camera_state: STRING, _sence_weather: STRING>,
ignored_region STRUCT<box: ARRAY<{_BOX}>>,
frame ARRAY<STRUCT<_num: INT, target_list: STRUCT<target: ARRAY<STRUCT<_id: INT, box: {_BOX}, attribute: STRUCT<_vehicle_type: STRING>>>>>>
"""
#: Fixed size of the frames that the label files are normalised by.
FRAME_WIDTH, FRAME_HEIGHT = 960.0, 540.0


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """One row a sequence file, nested as in the file."""
    return spark.read.format("xml").option("rowTag", "sequence").schema(SEQUENCE_SCHEMA).load(path)


def sequence_frames(sequences: DataFrame) -> DataFrame:
    """(sequence, weather, frame_pos, frame_num) of every frame, with or without boxes."""
    return sequences.select(F.col("_name").alias("sequence"), F.col("sequence_attribute._sence_weather").alias("weather"), F.posexplode("frame").alias("frame_pos", "f")).select("sequence", "weather", "frame_pos", F.col("f._num").alias("frame_num"))


def last_frames(frames: DataFrame) -> DataFrame:
    """One row a frame number: the last, where a number repeats."""
    place = F.row_number().over(W.partitionBy("sequence", "frame_num").orderBy(F.desc("frame_pos")))
    return frames.withColumn("__place", place).where("__place = 1").drop("__place")


def sequence_targets(sequences: DataFrame) -> DataFrame:
    """(sequence, frame_pos, frame_num, ordinal, native_class, left, top, width, height), in document
    order. Targets without a box or attribute are passed over; a missing type is `?`."""
    frames = sequences.select(F.col("_name").alias("sequence"), F.posexplode("frame").alias("frame_pos", "f"))
    boxes = frames.select("sequence", "frame_pos", F.col("f._num").alias("frame_num"), F.posexplode("f.target_list.target").alias("ordinal", "t"))
    fine = boxes.where("t.box is not null and t.attribute is not null")
    return fine.select("sequence", "frame_pos", "frame_num", "ordinal", F.coalesce("t.attribute._vehicle_type", F.lit("?")).alias("native_class"), *[F.col(f"t.box._{c}").alias(c) for c in ("left", "top", "width", "height")])


def sequence_regions(sequences: DataFrame) -> DataFrame:
    """(sequence, ordinal, left, top, width, height) of ignore regions; none where the element is
    missing."""
    rows = sequences.select(F.col("_name").alias("sequence"), F.posexplode(F.coalesce("ignored_region.box", F.array().cast(f"array<{_BOX.replace(': ', ':').lower()}>"))).alias("ordinal", "b"))
    return rows.select("sequence", "ordinal", *[F.col(f"b._{c}").alias(c) for c in ("left", "top", "width", "height")])


def read_csv_boxes(spark: SparkSession, path: str) -> DataFrame:
    """image_id, native_class and corners of a CSV without a header; ids keep leading zeros; empty
    lines go."""
    schema = "image_id STRING, native_class STRING, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    return spark.read.csv(path, schema=schema, header=False, ignoreLeadingWhiteSpace=True).where("image_id is not null")


COCO_SCHEMA = "images ARRAY<STRUCT<id: INT, width: INT, height: INT, file_name: STRING>>, annotations ARRAY<STRUCT<image_id: INT, category_id: INT, bbox: ARRAY<DOUBLE>>>"


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, boxes): boxes have corners; images without annotations stay in images."""
    doc = spark.read.schema(COCO_SCHEMA).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select("i.*").withColumnRenamed("id", "image_id")
    b = [F.get("a.bbox", k) for k in range(4)]
    boxes = doc.select(F.explode("annotations").alias("a")).select(F.col("a.image_id").alias("image_id"), F.col("a.category_id").cast("string").alias("native_class"), *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), from_ltwh(*b))])
    return images, boxes


def read_yolo(spark: SparkSession, path: str, width: float = FRAME_WIDTH, height: float = FRAME_HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(images, boxes) of label files, named by their stem. Files without boxes are images too: the
    listing and the lines are read apart."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("image_id"))
    lines = spark.read.text(path).select(stem.alias("image_id"), F.trim("value").alias("line")).where("line <> ''")
    v = F.split("line", r"\s+")
    box = from_yolo(*[F.get(v, k).cast("double") for k in range(1, 5)], width, height)
    return files, lines.select("image_id", F.get(v, 0).cast("int").alias("class_id"), *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), box)])


def read_ignore_json(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, corners) of exported ignore regions; files without boxes give none."""
    schema = "sequence STRING, ignore_regions ARRAY<STRUCT<left: DOUBLE, top: DOUBLE, width: DOUBLE, height: DOUBLE>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("sequence", F.explode("ignore_regions").alias("b"))
    return rows.select("sequence", *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), from_ltwh(*[F.col(f"b.{c}") for c in ("left", "top", "width", "height")]))])


def label_suite(spark: SparkSession, labels: str, ignores: str, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, gt boxes, ignore boxes) of a suite of label files and exported ignore regions. `groups`
    has group, weathers and sequences; a sequence's camera is its group, and a group with more than one
    weather raises, as its images' weather would be open."""
    from ..functions.scalars import sequence_of

    files, boxes = read_yolo(spark, labels)
    stop = F.raise_error(F.concat(F.lit("more than one weather in "), F.col("group"))).cast("string")
    weather = F.when(F.size("weathers") == 1, F.get("weathers", 0)).otherwise(stop)
    known = groups.select(F.explode("sequences").alias("sequence"), F.col("group").alias("camera"), weather.alias("weather"))
    images = files.withColumn("sequence", sequence_of(F.col("image_id"))).join(F.broadcast(known), "sequence", "left")
    place = F.row_number().over(W.partitionBy("image_id").orderBy("class_id", "x1", "y1", "x2", "y2")) - 1
    regions = images.select("image_id", "sequence").join(read_ignore_json(spark, ignores), "sequence").drop("sequence")
    return images.select("image_id", "weather", "camera"), boxes.withColumn("gt_ordinal", place), regions


MANIFEST_SCHEMA = "meta MAP<STRING, STRING>, images ARRAY<STRUCT<id: STRING, file: STRING, width: INT, height: INT, camera: STRING, weather: STRING, boxes: ARRAY<ARRAY<DOUBLE>>, ignore: ARRAY<ARRAY<DOUBLE>>>>"


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, gt boxes, ignore boxes) of a compact manifest; a box is x1, y1, x2, y2 and a class."""
    doc = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True).select(F.explode("images").alias("i"))
    images = doc.select(F.col("i.id").alias("image_id"), "i.file", "i.width", "i.height", "i.camera", "i.weather")

    def corners_of(b: str) -> list:
        return [F.get(b, k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]

    gt = doc.select(F.col("i.id").alias("image_id"), F.posexplode("i.boxes").alias("gt_ordinal", "b")).select("image_id", "gt_ordinal", F.get("b", 4).cast("int").alias("class_id"), *corners_of("b"))
    ignore = doc.select(F.col("i.id").alias("image_id"), F.explode("i.ignore").alias("b")).select("image_id", *corners_of("b"))
    return images, gt, ignore


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, train_loss, val_loss, map) of a training log: losses are sums of the columns that begin
    with train/ or val/ and end with _loss; the metric's column holds mAP50-95. Names may be padded."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.strip(): c for c in raw.columns}
    number = lambda c: F.col(f"`{c}`").cast("double")

    def total(prefix: str):
        own = [number(c) for n, c in names.items() if n.startswith(prefix) and n.endswith("_loss")]
        return sum(own[1:], own[0]) if own else F.lit(0.0)

    metric = next((c for n, c in names.items() if "mAP50-95" in n), None)
    epoch = number(names["epoch"]).cast("int") if "epoch" in names else (F.monotonically_increasing_id()).cast("int")
    return raw.select(epoch.alias("epoch"), total("train/").alias("train_loss"), total("val/").alias("val_loss"), (number(metric) if metric else F.lit(None).cast("double")).alias("map"))


#: A class's or bucket's metrics, keyed by name in report files.
REPORT_SCHEMA = "suites MAP<STRING, STRUCT<role: STRING, slices: MAP<STRING, MAP<STRING, STRUCT<point: DOUBLE, ci_low: DOUBLE, ci_high: DOUBLE, n_gt: LONG>>>>>"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(suite, role, axis, bucket, point, ci_low, ci_high, n_gt) of a nested report; NaN is null."""
    doc = spark.read.schema(REPORT_SCHEMA).option("allowNonNumericNumbers", True).json(path, multiLine=True)
    rows = doc.select(F.explode("suites").alias("suite", "s")).select("suite", "s.role", F.explode("s.slices").alias("axis", "b")).select("suite", "role", "axis", F.explode("b").alias("bucket", "m"))
    return rows.select("suite", "role", "axis", "bucket", *[F.when(~F.isnan(F.col(f"m.{c}")), F.col(f"m.{c}")).alias(c) for c in ("point", "ci_low", "ci_high")], "m.n_gt")


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML file, read where Spark can read it."""
    import yaml

    return yaml.safe_load("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def taxonomy_tables(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(routes, canonical) of a taxonomy: keys become strings, their type stays in native_type."""
    rows = []
    for dataset, verbs in config["datasets"].items():
        for native, name in (verbs.get("map") or {}).items():
            rows.append((dataset, str(native), type(native).__name__, "map", name))
        for verb in ("ignore", "exclude"):
            rows += [(dataset, str(n), type(n).__name__, verb, None) for n in verbs.get(verb) or []]
    canonical = [(int(c["id"]), c["name"]) for c in config["canonical"]]
    return spark.createDataFrame(rows, "dataset string, native string, native_type string, verb string, canonical string"), spark.createDataFrame(canonical, "id int, name string")


def dataset_digest(pointer: dict) -> str:
    """The md5 that a data pointer file pins."""
    return pointer["outs"][0]["md5"]


def archive_members(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """(archive, member, size, data) of zip and tar files; data only with `contents`. An archive is
    read by one task; several archives run side by side."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                if zipfile.is_zipfile(io.BytesIO(raw)):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                yield pd.DataFrame({"archive": [name], "member": [i.filename], "size": [i.file_size], "data": [z.read(i) if contents else None]})
                else:
                    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                        for m in t:
                            if m.isfile():
                                yield pd.DataFrame({"archive": [name], "member": [m.name], "size": [m.size], "data": [t.extractfile(m).read() if contents else None]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "archive string, member string, size long, data binary")


def member_counts(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """(sequence, images): .jpg members below each sequence's folder, 0 for those without any."""
    found = members.where(F.lower("member").endswith(".jpg")).select(F.regexp_extract("member", r"(?:^|/)(MVI_[^/]*)/", 1).alias("sequence")).groupBy("sequence").agg(F.count("*").alias("images"))
    return sequences.select("sequence").distinct().join(found, "sequence", "left").select("sequence", F.coalesce("images", F.lit(0).cast("long")).alias("images"))


def missing_members(frames: DataFrame, members: DataFrame) -> DataFrame:
    """Annotated files (column member) that the archive lacks."""
    return frames.join(members.select("member"), "member", "left_anti")
