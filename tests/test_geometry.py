import math

from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions import scalars as s


def one(spark, **columns):
    return list(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first())


def box(*v):
    return [F.lit(float(x)) if x is not None else F.lit(None).cast("double") for x in v]


def test_iou_and_ioa(spark):
    got = one(spark, a=g.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)), b=g.ioa(box(0, 0, 10, 10), box(0, 0, 5, 10)), c=g.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), d=g.ioa(box(1, 1, 1, 1), box(0, 0, 5, 5)), e=g.ioa(box(0, 0, 10, 10), box(None, None, None, None)))
    assert got == [1 / 3, 0.5, 0.0, 0.0, None]


def test_scale_edges(spark):
    sizes = [0, 1023.9, 1024, 9215.9, 9216, 1e9]
    assert one(spark, **{f"c{i}": g.scale_bin(F.lit(float(v))) for i, v in enumerate(sizes)}) == ["small", "small", "medium", "medium", "large", "large"]


def test_clip_and_bounds(spark):
    w, h = F.lit(640.0), F.lit(480.0)
    assert one(spark, **dict(zip("abcd", g.clip(box(-5, -5, 700, 500), w, h)))) == [0, 0, 640, 480]
    assert one(spark, a=g.out_of_bounds(box(0, 0, 2000, 10), w, h), b=g.out_of_bounds(box(-5, -5, 700, 500), w, h)) == [True, False]


def test_pixels_are_floored_and_ceiled(spark):
    assert one(spark, **dict(zip("abcd", g.to_pixels(*box(1.4, 1.6, 2.2, 2.2), F.lit(10), F.lit(10))))) == [1, 1, 4, 4]


def test_yolo_text_and_back(spark):
    line = lambda c, *b: s.yolo_line(F.lit(c), *g.to_yolo(*box(*b), 960.0, 540.0))
    assert one(spark, a=line(2, 0, 0, 960, 540), b=line(0, 432, 243, 96, 54)) == ["2 0.500000 0.500000 1.000000 1.000000", "0 0.500000 0.500000 0.100000 0.100000"]
    got = one(spark, **dict(zip("abcd", g.from_yolo(*box(0.5, 0.5, 0.1, 0.2), 960.0, 540.0))))
    assert all(math.isclose(x, y) for x, y in zip(got, [432, 216, 528, 324]))


def test_names_and_seeds(spark):
    import hashlib

    seed = int.from_bytes(hashlib.sha256(b"a|gaussian_noise|3").digest()[:8], "big")
    got = one(spark, a=s.sequence_of(F.lit("MVI_1_img_img00003")), b=s.sequence_of(F.lit("plain")), c=s.camera_of(F.lit("cam/x/1.png")), d=s.flat_stem(F.lit("cam/x/1.png")), e=s.stable_seed(F.lit("a"), F.lit("gaussian_noise"), F.lit(3)))
    assert got[:4] == ["MVI_1_img", "plain", "cam", "cam__x__1"] and int(got[4]) == seed


def test_exact_rounding(spark):
    assert one(spark, a=s.round_exact(F.lit(2.675), F.lit(2)), b=s.interval_text(F.lit(0.5), F.lit(0.25), F.lit(0.75))) == [2.67, "0.500 [0.250, 0.750]"]
