"""One taxonomy for all native labels. `routes` has dataset, native (string), verb (map, ignore or
exclude) and canonical (a name, for map); `canonical` has id and name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clip, corners, out_of_bounds

PRECEDENCE = {"map": 0, "ignore": 1, "exclude": 2}


class UnknownNativeClass(KeyError):
    """A native label that no route covers."""


class TaxonomyError(ValueError):
    """The taxonomy contradicts itself."""


def taxonomy_faults(routes: DataFrame, canonical: DataFrame) -> DataFrame:
    """(fault, name): repeated canonical names, map targets that are no canonical name, and native labels
    listed twice, within a verb or across."""
    twice = canonical.groupBy("name").count().where("count > 1").select(F.lit("canonical name repeats").alias("fault"), "name")
    strange = routes.where("verb = 'map'").join(canonical, routes["canonical"] == canonical["name"], "left_anti").select(F.lit("target is not canonical"), "canonical").distinct()
    double = routes.groupBy("dataset", "native").count().where("count > 1").select(F.lit("routed twice"), F.concat_ws("/", "dataset", "native"))
    return twice.union(strange).union(double)


def validate_taxonomy(routes: DataFrame, canonical: DataFrame) -> None:
    """Raises if there are faults. Only offending names come to the driver."""
    found = taxonomy_faults(routes, canonical).limit(20).collect()
    if found:
        raise TaxonomyError("; ".join(sorted(f"{r['fault']}: {r['name']}" for r in found)))


def route(boxes: DataFrame, routes: DataFrame, canonical: DataFrame) -> DataFrame:
    """Boxes with verb and class_id (null unless mapped); labels without a route keep a null verb.
    The taxonomy is configuration: a row for each native label, so it goes to every task."""
    first = routes.withColumn("__order", F.coalesce(*[F.when(F.col("verb") == v, F.lit(o)) for v, o in PRECEDENCE.items()]))
    best = first.groupBy("dataset", "native").agg(F.min_by(F.struct("verb", "canonical"), "__order").alias("r")).select("dataset", "native", "r.verb", "r.canonical")
    ids = canonical.select(F.col("id").cast("int").alias("class_id"), F.col("name").alias("canonical"))
    known = best.join(ids, "canonical", "left").withColumnRenamed("native", "native_class")
    return boxes.join(F.broadcast(known), ["dataset", "native_class"], "left")


def route_misses(routed: DataFrame) -> DataFrame:
    """Native labels without a route, and how many boxes have them."""
    return routed.where("verb is null").groupBy("dataset", "native_class").agg(F.count("*").alias("boxes"))


def require_routed(routed: DataFrame) -> DataFrame:
    """The same rows; an action that reads them fails on the first label without a route."""
    told = F.raise_error(F.concat(F.lit("unknown native class: "), F.coalesce("native_class", F.lit("null")))).cast("string")
    return routed.withColumn("verb", F.coalesce("verb", told))


def fail_on_misses(routed: DataFrame) -> None:
    missing = route_misses(routed).limit(20).collect()
    if missing:
        raise UnknownNativeClass(", ".join(sorted(f"{r['dataset']}:{r['native_class']}" for r in missing)))


def route_boxes(rows: DataFrame, routes: DataFrame, canonical: DataFrame) -> DataFrame:
    """Corner boxes of other datasets, with image width and height, as class boxes and ignore regions
    (verb map or ignore). Misread numbers raise first, whatever the label; boxes are then clipped;
    those without an extent go before their label is looked at; excluded labels go last."""
    bad = F.raise_error(F.concat(F.lit("box out of bounds: "), F.col("image_id"))).cast("double")
    box = corners()
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    checked = rows.withColumn("x1", F.when(out_of_bounds(box, w, h), bad).otherwise(F.col("x1")))
    clipped = checked.withColumns(dict(zip(("x1", "y1", "x2", "y2"), clip(box, w, h), strict=True)))
    solid = clipped.where("x2 > x1 and y2 > y1")
    return require_routed(route(solid, routes, canonical)).where("verb <> 'exclude'")


#: COCO's names for the classes a detector may be scored on, by canonical name.
COCO_NAMES = {"car": "car", "bus": "bus", "van_truck": "truck"}


def class_map(model_classes: DataFrame, canonical: DataFrame) -> DataFrame:
    """(model_id, class_id): a model class named as a canonical class, else by its COCO name, else
    dropped. `model_classes` has model_id and name."""
    own = canonical.select(F.col("name"), F.col("id").alias("by_name"))
    table = F.create_map(*[F.lit(x) for canon, coco in COCO_NAMES.items() for x in (canon, coco)])
    coco = canonical.select(F.try_element_at(table, F.col("name")).alias("name"), F.col("id").alias("by_coco")).where("name is not null")
    return model_classes.join(own, "name", "left").join(coco, "name", "left").select("model_id", F.coalesce("by_name", "by_coco").cast("int").alias("class_id")).where("class_id is not null")


def relabel(detections: DataFrame, mapping: DataFrame) -> DataFrame:
    """Detections of scored classes under canonical ids; `mapping` is a class_map."""
    return detections.join(F.broadcast(mapping), "model_id").drop("model_id")
