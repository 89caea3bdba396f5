"""Image corruptions on raw pixels, in Arrow batches. An image is a row with image_id, height, width,
channels and data (bytes, row by row, unsigned 8 bit).

Blur is a separable Gaussian in NumPy and close to, not bit for bit, what an image library gives;
JPEG needs a codec: it raises where no library is installed.
"""

from __future__ import annotations

import hashlib
import importlib
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = 5
#: Fixed values by severity.
SIGMA_BLUR = (0.5, 1.0, 2.0, 3.0, 4.0)
SIGMA_NOISE = (5.0, 10.0, 20.0, 40.0, 60.0)
JPEG_QUALITY = (80, 60, 40, 25, 15)
BRIGHTNESS = (20.0, 40.0, 60.0, 80.0, 100.0)


def seed_of(image_id: str, kind: str, severity: int) -> int:
    """As functions.scalars.stable_seed, in Python."""
    return int(hashlib.sha256(f"{image_id}|{kind}|{severity}".encode()).hexdigest()[:16], 16)


def shifted(image: np.ndarray, delta) -> np.ndarray:
    """Adds in single precision, clips, rounds half to even."""
    return np.rint(np.clip(image.astype(np.float32) + delta, 0, 255)).astype(np.uint8)


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    half = max(1, round(3 * sigma))
    line = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    line /= line.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(half, half) if a == axis else (0, 0) for a in range(out.ndim)], mode="reflect" if out.shape[axis] > half else "edge")
        n = out.shape[axis]
        out = sum(w * np.take(padded, range(k, k + n), axis=axis) for k, w in enumerate(line))
    return np.rint(np.clip(out, 0, 255)).astype(np.uint8)


def jpeg(image: np.ndarray, quality: int) -> np.ndarray:
    try:
        pil = importlib.import_module("PIL.Image")
    except ModuleNotFoundError as e:
        raise NotImplementedError("JPEG needs an image library") from e
    buffer = io.BytesIO()
    pil.fromarray(image).save(buffer, "JPEG", quality=quality)
    return np.asarray(pil.open(buffer))


def corrupt(image: np.ndarray, kind: str, severity: int, image_id: str = "") -> np.ndarray:
    """One image; severity 0 is a copy."""
    if not 0 <= severity <= SEVERITIES:
        raise ValueError(f"severity is from 0 to {SEVERITIES}, not {severity}")
    if severity == 0:
        return image.copy()
    k = severity - 1
    match kind:
        case "brightness_up":
            return shifted(image, BRIGHTNESS[k])
        case "brightness_down":
            return shifted(image, -BRIGHTNESS[k])
        case "gaussian_noise":
            return shifted(image, np.random.default_rng(seed_of(image_id, kind, severity)).normal(0.0, SIGMA_NOISE[k], image.shape))
        case "gaussian_blur":
            return blurred(image, SIGMA_BLUR[k])
        case "jpeg_compression":
            return jpeg(image, JPEG_QUALITY[k])
    raise ValueError(f"unknown corruption {kind}")


def _pixels(data: bytes, h: int, w: int, c: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, c)


def corrupt_images(images: DataFrame, variants: list[tuple[str, int]]) -> DataFrame:
    """Each image under each (corruption, severity), with these two columns."""
    table = F.array(*[F.struct(F.lit(k).alias("corruption"), F.lit(s).alias("severity")) for k, s in variants])
    many = images.withColumn("v", F.explode(table)).select("*", "v.corruption", "v.severity").drop("v")

    @F.pandas_udf("binary")
    def apply(image_id: pd.Series, data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, kind: pd.Series, severity: pd.Series) -> pd.Series:
        return pd.Series([corrupt(_pixels(d, y, x, n), k, int(s), str(i)).tobytes() for i, d, y, x, n, k, s in zip(image_id, data, h, w, c, kind, severity)])

    return many.withColumn("data", apply("image_id", "data", "height", "width", "channels", "corruption", "severity"))


def black_fill(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Images with the pixels of their ignore regions (image_id, left, top, width, height) zeroed."""
    listed = regions.groupBy("image_id").agg(F.collect_list(F.struct("left", "top", F.col("width").alias("w"), F.col("height").alias("h"))).alias("regions"))

    @F.pandas_udf("binary")
    def fill(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, boxes: pd.Series) -> pd.Series:
        out = []
        for d, y, x, n, bs in zip(data, h, w, c, boxes):
            image = _pixels(d, y, x, n).copy()
            for b in bs if bs is not None else ():
                left, top = max(0, int(np.floor(b["left"]))), max(0, int(np.floor(b["top"])))
                image[top : int(np.ceil(b["top"] + b["h"])), left : int(np.ceil(b["left"] + b["w"]))] = 0
            out.append(image.tobytes())
        return pd.Series(out)

    return images.join(listed, "image_id", "left").withColumn("data", fill("data", "height", "width", "channels", "regions")).drop("regions")


def median_background(frames: DataFrame, key: str = "sequence", most: int = 41) -> DataFrame:
    """(key, height, width, channels, data): the pixel-wise median of at most `most` frames of each
    group, taken evenly; the others are not sent. `frames` has frame_num besides an image's columns."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(key).orderBy("frame_num")) - 1
    numbers = frames.select(key, "frame_num").withColumn("k", place).withColumn("n", F.count("*").over(W.partitionBy(key)))
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    chosen = frames.join(numbers.where(F.col("k") % step == 0).select(key, "frame_num"), [key, "frame_num"])

    def median(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        stack = np.stack([np.frombuffer(d, np.uint8) for d in pdf["data"]])
        return pd.DataFrame({key: [r[key]], "height": [r["height"]], "width": [r["width"]], "channels": [r["channels"]], "data": [np.median(stack, axis=0).astype(np.uint8).tobytes()]})

    types = dict(frames.dtypes)
    return chosen.groupBy(key).applyInPandas(median, ", ".join(f"{c} {types[c]}" for c in (key, "height", "width", "channels", "data")))
