import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sightline.plans.dataset_build import build_labels
from sightline.streaming import monitor as mo

SF = "/root/testdata/sf0.001"


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def detections(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"c{k % 2}", start + dt.timedelta(seconds=k), k, k % 3, (k % 10) / 10) for k in range(120)]
    return spark.createDataFrame(rows, "camera string, ts timestamp, frame_num long, class_id int, score double")


def test_batch_windows(spark):
    d = detections(spark)
    frames = mo.sample_frames(d).orderBy("camera", "start").collect()
    assert [f.frame_num for f in frames if f.camera == "c0"] == list(range(0, 120, 10))
    w = mo.confidence_windows(d, "1 minute", "1 minute")
    assert w.agg(F.sum("n")).first()[0] == 120
    uniform = spark.createDataFrame([(b, 0.1) for b in range(10)], "bin int, share double")
    assert all(abs(r.distance - 0.5) < 1e-9 for r in mo.drift(w, uniform).collect())  # even or odd scores alone
    assert mo.class_mix(d).agg(F.sum("n")).first()[0] == 120 and mo.mined(d).where("score < 0.3 or score >= 0.6").count() == 0
    n = d.groupBy("camera", "frame_num", "ts").agg(F.count("*").alias("n"))
    assert mo.shadow_agreement(n, n).where("agree").count() == 120


def test_streams_give_what_batches_give(spark, tmp_path):
    d = detections(spark)
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = mo.class_mix(stream, late="1 hour").writeStream.outputMode("complete").format("memory").queryName("mix").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("mix").collect()}
    assert got == {tuple(r) for r in mo.class_mix(d).collect()}


def test_dataset_build(spark):
    frames = spark.createDataFrame([("s", k) for k in range(1, 7)] + [("t", 1)], "sequence string, frame_num int")
    box = lambda s, f, o, c, x: (s, f, o, c, x, 0.0, 10.0, 10.0)
    targets = spark.createDataFrame([box("s", 1, 0, "car", 0.0), box("s", 1, 1, "car", 0.2), box("s", 2, 0, "car", 0.0), box("s", 3, 0, "others", 0.0), box("t", 1, 0, "zebra", 0.0)], "sequence string, frame_num int, ordinal int, native_class string, left double, top double, width double, height double")
    routes = spark.createDataFrame([("d", "car", "map", "car"), ("d", "others", "map", "van_truck")], "dataset string, native string, verb string, canonical string")
    canon = spark.createDataFrame([(0, "car"), (2, "van_truck")], "id int, name string")
    manifest = spark.createDataFrame([("train", "s")], "split string, sequence string")
    chosen, boxes = build_labels(frames, targets, manifest, routes, canon, "d", 2)
    assert sorted(r.frame_num for r in chosen.collect()) == [1, 3, 5]
    assert sorted((r.frame_num, r.class_id) for r in boxes.collect()) == [(1, 0), (3, 2)]


def test_flicker_keeps_the_last_frame_as_state(spark, tmp_path):
    rows = [("c", k, n) for k, n in enumerate([3, 3, 5, 1])] + [("d", 0, 2), ("d", 1, 2)]
    spark.createDataFrame(rows, "camera string, frame_num long, n long").coalesce(1).write.parquet(str(tmp_path / "n"))
    stream = spark.readStream.schema("camera string, frame_num long, n long").parquet(str(tmp_path / "n"))
    q = mo.flicker(stream).writeStream.outputMode("append").format("memory").queryName("flicker").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("flicker").collect()} == {("c", 1, 0), ("c", 2, 2), ("c", 3, 4), ("d", 1, 0)}
