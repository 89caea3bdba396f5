"""Other scalar expressions."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def sequence_of(stem: Column) -> Column:
    """Sequence of a frame's file stem: what stands before the last `_img`, or the whole stem."""
    found = F.regexp_extract(stem, r"^(.*)_img", 1)
    return F.when(stem.contains("_img"), found).otherwise(stem)


def camera_of(path: Column) -> Column:
    """First component of an image path."""
    return F.element_at(F.split(path, "/"), 1)


def flat_stem(path: Column) -> Column:
    """A path as one file stem: `/` becomes `__`, the extension goes."""
    return F.regexp_replace(F.replace(path, F.lit("/"), F.lit("__")), r"\.[^._]*$", "")


def stable_seed(image_id: Column, corruption: Column, severity: Column) -> Column:
    """The first eight bytes of sha256("id|corruption|severity") as an unsigned number."""
    text = F.concat_ws("|", image_id, corruption, severity.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def undefined(v: Column) -> Column:
    """NaN as null: averages skip it and comparisons with it are not true."""
    return F.when(~F.isnan(v), v)


def interval_text(point: Column, low: Column, high: Column) -> Column:
    """`p [low, high]` with three decimals; a dash where undefined."""
    return F.when(point.isNull(), F.lit("—")).otherwise(F.format_string("%.3f [%.3f, %.3f]", point, low, high))


@F.pandas_udf(StringType())
def yolo_line(class_id: pd.Series, cx: pd.Series, cy: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """A label line, byte for byte: six decimals of the exact binary value, which the JVM's formatter
    does not give."""
    return pd.Series([f"{c} {a:.6f} {b:.6f} {d:.6f} {e:.6f}" for c, a, b, d, e in zip(class_id, cx, cy, w, h)])


@F.pandas_udf(DoubleType())
def round_exact(v: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounds the exact binary value, half to even."""
    return pd.Series([None if x is None or x != x else float(round(Decimal(x), int(d))) for x, d in zip(v, digits)], dtype="float64")
