"""Writers and their guards: frozen datasets, label files, manifests, checksums, renderings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import to_yolo
from ..functions.scalars import yolo_line

#: Fixed name of the file that freezes a dataset.
SENTINEL = ".readonly"


class ReadOnlyDatasetError(PermissionError):
    """A frozen dataset, or a handle opened for reading, was to be written."""


class ChecksumMismatch(ValueError):
    """A file is not the one that was pinned."""


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small file's text wherever Spark's file systems reach, or None."""
    fs, where = _file(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file that the driver holds, wherever Spark's file systems reach."""
    fs, where = _file(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


class DatasetDir:
    """A dataset's folder, opened with mode r or w."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "r"):
        if mode not in ("r", "w"):
            raise ValueError(f"mode is r or w, not {mode!r}")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        if mode == "w" and (reason := read_small(spark, f"{self.path}/{SENTINEL}")) is not None:
            raise ReadOnlyDatasetError(f"{self.path} is frozen: {reason.strip()}")

    def _writable(self) -> None:
        if self.mode != "w":
            raise ReadOnlyDatasetError(f"{self.path} was opened for reading")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, name: str, table: DataFrame, partition_by: Sequence[str] = ()) -> None:
        self._writable()
        table.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{name}")

    def write_text(self, name: str, text: str) -> None:
        self._writable()
        write_small(self.spark, f"{self.path}/{name}", text)

    def freeze(self, reason: str) -> None:
        """From now on the folder cannot be opened for writing."""
        self._writable()
        write_small(self.spark, f"{self.path}/{SENTINEL}", reason + "\n")


def label_texts(frames: DataFrame, boxes: DataFrame, image_w: float = 960.0, image_h: float = 540.0) -> DataFrame:
    """(image_id, label_text): a line for each box in order, each ended; a frame without boxes has one
    line break. `frames` gives the universe; `boxes` has class_id, ordinal, left, top, width, height."""
    norm = to_yolo(*map(F.col, ("left", "top", "width", "height")), image_w, image_h)
    lines = boxes.select("image_id", "ordinal", yolo_line("class_id", *norm).alias("line"))
    text = lines.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda s: s["line"]), "\n").alias("body"))
    return frames.select("image_id").distinct().join(text, "image_id", "left").select("image_id", F.concat(F.coalesce("body", F.lit("")), F.lit("\n")).alias("label_text"))


def write_label_files(texts: DataFrame, folder: str) -> int:
    """A .txt file for each image below a folder that every executor has; returns how many."""

    def save(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for image, text in zip(pdf["image_id"], pdf["label_text"]):
                with open(f"{folder}/{image}.txt.part", "w") as f:
                    f.write(text)
                os.replace(f"{folder}/{image}.txt.part", f"{folder}/{image}.txt")
            yield pd.DataFrame({"n": [len(pdf)]})

    return texts.mapInPandas(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Fixed values of the exported format.
IGNORE_VERSION, IGNORE_CONVENTION = 1, "xywh_px_topleft_origin_rb_exclusive_float"


def ignore_documents(sequences: DataFrame, regions: DataFrame, image_width: int = 960, image_height: int = 540) -> DataFrame:
    """(sequence, document): self-describing JSON of a sequence's ignore regions, for every sequence."""
    box = F.struct("left", "top", "width", "height")
    listed = regions.groupBy("sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", box.alias("b")))), lambda s: s["b"]).alias("boxes"))
    empty = F.array().cast("array<struct<left:double,top:double,width:double,height:double>>")
    doc = F.struct(F.lit(IGNORE_VERSION).alias("schema_version"), "sequence", F.lit(IGNORE_CONVENTION).alias("coordinate_convention"), F.lit(image_width).alias("image_width"), F.lit(image_height).alias("image_height"), F.coalesce("boxes", empty).alias("ignore_regions"))
    return sequences.select("sequence").distinct().join(listed, "sequence", "left").select("sequence", F.to_json(doc).alias("document"))


def compact_manifest(images: DataFrame, gt: DataFrame, ignore: DataFrame) -> DataFrame:
    """One row an image with its boxes (corners, class) and ignore boxes, rounded to two decimals."""
    r = [F.round(c, 2) for c in ("x1", "y1", "x2", "y2")]
    boxes = gt.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gt_ordinal", F.array(*r, F.col("class_id").cast("double")).alias("b")))), lambda s: s["b"]).alias("boxes"))
    regions = ignore.groupBy("image_id").agg(F.array_sort(F.collect_list(F.array(*r))).alias("ignore"))
    empty = F.array().cast("array<array<double>>")
    return images.join(boxes, "image_id", "left").join(regions, "image_id", "left").withColumns({"boxes": F.coalesce("boxes", empty), "ignore": F.coalesce("ignore", empty)})


def manifest_document(manifest: DataFrame, meta: Mapping) -> str:
    """JSON of a compact manifest, for sets of a few thousand images; `meta` names dataset, role,
    source, split, sample and classes."""
    images = [{**{k: v for k, v in r.asDict().items() if k not in ("image_id", "boxes", "ignore")}, "id": r["image_id"], "boxes": r["boxes"], "ignore": r["ignore"]} for r in manifest.orderBy("image_id").toLocalIterator()]
    return json.dumps({"meta": dict(meta), "images": images}, indent=2) + "\n"


def data_document(names: Sequence[str], split_paths: Mapping[str, str]) -> str:
    """YAML that tells a trainer a dataset's classes and folders."""
    import yaml

    return yaml.safe_dump({"path": ".", "names": dict(enumerate(names)), **split_paths}, sort_keys=False)


def frame_document(manifest: DataFrame, raw_source: str) -> str:
    """YAML of a frame manifest: a sequence's frames and folder, and the pinned source."""
    import yaml

    rows = manifest.orderBy("sequence").collect()
    return yaml.safe_dump({"raw_source": raw_source, "sequences": {r["sequence"]: {"frame_count": r["frame_count"], "archive_dir": r["archive_dir"]} for r in rows}}, sort_keys=False)


def frame_manifest(frames: DataFrame, archive_dirs: DataFrame, source_md5: str) -> DataFrame:
    """(sequence, frame_count, archive_dir, source_md5)."""
    counts = frames.groupBy("sequence").agg(F.countDistinct("frame_num").alias("frame_count"))
    return counts.join(archive_dirs, "sequence", "left").withColumn("source_md5", F.lit(source_md5))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, hashed where they lie; files over what one row can hold are not for
    this reader."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def file_sha256(path: str, chunk: int = 1 << 20) -> str:
    """Of one file of any size, by chunks."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def verify_or_pin(found: DataFrame, locks: DataFrame) -> DataFrame:
    """(name, sha256, state) with state verified or pinned; raises where a pinned file differs.
    `found` and `locks` have name and sha256."""
    both = found.join(locks.withColumnRenamed("sha256", "pinned"), "name", "left")
    wrong = [r["name"] for r in both.where("pinned <> sha256").select("name").limit(20).collect()]
    if wrong:
        raise ChecksumMismatch("not the pinned files: " + ", ".join(sorted(wrong)))
    return both.select("name", "sha256", F.when(F.col("pinned").isNull(), "pinned").otherwise("verified").alias("state"))


def alias_events(current: DataFrame, version: str, promoted: bool, at: str) -> DataFrame:
    """Events of the champion alias with a new one, if the version was promoted."""
    if not promoted:
        return current
    return current.unionByName(current.sparkSession.createDataFrame([(version, at)], current.schema))


def champion(events: DataFrame) -> DataFrame:
    return events.agg(F.max_by("version", "at").alias("version"))


# Renderings of small, final tables.


def markdown_table(rows: Sequence[Mapping], columns: Sequence[str], title: Callable[[str], str] = str) -> str:
    show = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(map(title, columns)) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows)])


def render_audit(audit: DataFrame, totals: DataFrame) -> tuple[str, str]:
    """(JSON, Markdown) of an audit; one row a sequence, some dozens to hundreds."""
    rows = [r.asDict() for r in audit.orderBy("sequence").collect()]
    total = totals.first().asDict()
    columns = ["sequence", "frames", "boxes_before", "boxes_after", "removed", "conflicts", "ignore_regions", "fraction"]
    text = f"# Annotation audit\n\n{total['sequences']} sequences, {total['frames']} frames, {total['boxes_before']} -> {total['boxes_after']} boxes ({total['removed']} removed, {total['conflicts']} label conflicts)\n\n" + markdown_table(rows, columns)
    return json.dumps({"aggregate": total, "sequences": rows}, indent=2), text


def render_report(metrics: DataFrame, headline: DataFrame, provenance: Mapping[str, str]) -> tuple[str, str]:
    """(JSON, Markdown) of slice metrics; undefined values become NaN in the JSON alone."""
    rows = [r.asDict() for r in metrics.orderBy("suite", "axis", "bucket").collect()]
    head = headline.first().asDict()
    nan = lambda d: {k: float("nan") if v is None and k not in ("class_id",) else v for k, v in d.items()}
    suites: dict = {}
    for r in rows:
        suites.setdefault(r["suite"], {}).setdefault(r["axis"], {})[r["bucket"]] = nan({k: v for k, v in r.items() if k not in ("suite", "axis", "bucket")})
    body = "\n\n".join(f"## {s}\n\n" + markdown_table([r for r in rows if r["suite"] == s], [c for c in metrics.columns if c != "suite"]) for s in suites)
    return json.dumps({"provenance": dict(provenance), "headline": nan(head), "suites": suites}, indent=2), f"# Evaluation\n\n{markdown_table([head], list(head))}\n\n{body}\n"


def render_decision(clauses: DataFrame, outcome: DataFrame) -> tuple[str, str]:
    """(JSON, Markdown) of a decision; `outcome` may carry warnings, one text a slice."""
    rows = [r.asDict() for r in clauses.orderBy("clause").collect()]
    final = outcome.first().asDict()
    word = "PROMOTE" if final["promoted"] else "REJECT"
    warnings = list(final.get("warnings") or [])
    text = f"# {word}\n\n" + markdown_table(rows, ["clause", "passed", "detail"]) + "".join(f"\n- warning: {w}" for w in warnings)
    return json.dumps({"promoted": final["promoted"], "clauses": rows, "warnings": warnings}, indent=2), text
