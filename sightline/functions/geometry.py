"""Box arithmetic as Column expressions. Boxes are columns of doubles; everything stays in codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]

#: Areas (px^2) at which the scale bins begin, half-open.
SCALE_EDGES = (("small", 0.0, 1024.0), ("medium", 1024.0, 9216.0), ("large", 9216.0, None))


def corners(prefix: str = "", names: Sequence[str] = ("x1", "y1", "x2", "y2")) -> list[Column]:
    return [F.col(prefix + n) for n in names]


def from_ltwh(left: Column, top: Column, width: Column, height: Column) -> list[Column]:
    """Corner form of a left, top, width, height box."""
    return [left, top, left + width, top + height]


def area(box: Box) -> Column:
    x1, y1, x2, y2 = box
    return (x2 - x1) * (y2 - y1)


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection; null if any corner is null (greatest and least skip nulls)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    known = a[0].isNotNull() & b[0].isNotNull()
    return F.when(known, F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where the union is not positive."""
    inter = overlap(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).when(inter.isNotNull(), F.lit(0.0))


def ioa(a: Box, b: Box) -> Column:
    """Intersection over the area of a; an area of 0 or less counts as 1."""
    own = area(a)
    return overlap(a, b) / F.when(own > 0, own).otherwise(F.lit(1.0))


def scale_bin(size: Column) -> Column:
    """Name of the scale bin of an area; a negative area raises."""
    out = F.when(size < 0, F.raise_error(F.lit("negative area")).cast("string"))
    for name, _, high in SCALE_EDGES:
        out = out.otherwise(F.lit(name)) if high is None else out.when(size < high, F.lit(name))
    return out


def in_range(size: Column, bin_name: str) -> Column:
    """Whether an area lies in a scale bin; every area lies in `all`."""
    if bin_name == "all":
        return F.lit(True)
    low, high = next((lo, hi) for n, lo, hi in SCALE_EDGES if n == bin_name)
    return (size >= low) & (F.lit(True) if high is None else size < high)


def clip(box: Box, width: Column, height: Column) -> list[Column]:
    """Corners in order, clipped to the image."""
    x1, y1, x2, y2 = box
    zero = F.lit(0.0)
    return [
        F.greatest(zero, F.least(x1, x2)), F.greatest(zero, F.least(y1, y2)),
        F.least(width, F.greatest(x1, x2)), F.least(height, F.greatest(y1, y2)),
    ]


def out_of_bounds(box: Box, width: Column, height: Column) -> Column:
    """Whether a box lies so far outside that its numbers were misread: half an image beyond an edge."""
    x1, y1, x2, y2 = box
    return (x2 > 1.5 * width) | (y2 > 1.5 * height) | (x1 < -0.5 * width) | (y1 < -0.5 * height)


def to_pixels(left: Column, top: Column, width: Column, height: Column, image_w: Column, image_h: Column) -> list[Column]:
    """Half-open pixel rectangle of a box: floored, ceiled, clipped to the image."""
    def bound(v: Column, most: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0)), most).cast("int")

    return [
        bound(F.floor(left), image_w), bound(F.floor(top), image_h),
        bound(F.ceil(left + width), image_w), bound(F.ceil(top + height), image_h),
    ]


def clip01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def to_yolo(left: Column, top: Column, width: Column, height: Column, image_w: float, image_h: float) -> list[Column]:
    """Normalised centre and size, each clamped to [0, 1] on its own."""
    return [clip01((left + width / 2) / image_w), clip01((top + height / 2) / image_h), clip01(width / image_w), clip01(height / image_h)]


def from_yolo(cx: Column, cy: Column, w: Column, h: Column, image_w: float, image_h: float) -> list[Column]:
    return [(cx - w / 2) * image_w, (cy - h / 2) * image_h, (cx + w / 2) * image_w, (cy + h / 2) * image_h]
