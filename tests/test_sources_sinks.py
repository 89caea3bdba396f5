import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import corruption as co
from sightline.operators import features as fe
from sightline.sources import annotations as an
from sightline.sources import sinks as si


def test_csv_keeps_ids_and_skips_empty_lines(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("0070,tram,11,2.5,33,41\n\n0070,bike,5,60,71.25,8\n0031,dog,1,0,2,9\n")
    rows = an.read_csv_boxes(spark, str(tmp_path / "gt.csv")).collect()
    assert [r.image_id for r in rows] == ["0070", "0070", "0031"] and rows[1].x2 == 71.25


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 41, "width": 640, "height": 360, "file_name": "day/k.png"}, {"id": 57, "width": 320, "height": 200, "file_name": "q.png"}], "annotations": [{"image_id": 41, "category_id": 17, "bbox": [12.5, 7, 81, 64]}]}
    (tmp_path / "coco.json").write_text(json.dumps(doc, indent=1))
    images, boxes = an.read_coco(spark, str(tmp_path / "coco.json"))
    b = boxes.first()
    assert images.count() == 2 and (b.native_class, b.x1, b.y1, b.x2, b.y2) == ("17", 12.5, 7, 93.5, 71)


def test_yolo_files_without_boxes_are_images(spark, tmp_path):
    (tmp_path / "a_img00001.txt").write_text("1 0.25 0.75 0.05 0.4\n\n")
    (tmp_path / "a_img00002.txt").write_text("\n")
    images, boxes = an.read_yolo(spark, str(tmp_path))
    assert sorted(r.image_id for r in images.collect()) == ["a_img00001", "a_img00002"]
    b = boxes.first()
    assert boxes.count() == 1 and np.allclose([b.x1, b.y1, b.x2, b.y2], [216, 297, 264, 513]) and b.image_id == "a_img00001"


def test_manifest_round_trip(spark, tmp_path):
    doc = {"meta": {"name": "m"}, "images": [{"id": "i", "file": "f", "width": 9, "height": 8, "camera": "c", "weather": "w", "boxes": [[1, 2, 3, 4, 2]], "ignore": [[0, 0, 1, 1]]}, {"id": "j", "boxes": [], "ignore": []}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    images, gt, ignore = an.read_manifest(spark, str(tmp_path / "m.json"))
    assert images.count() == 2 and gt.first().class_id == 2 and ignore.first().x2 == 1.0
    again = {r.image_id: r for r in si.compact_manifest(images, gt, ignore).collect()}
    assert again["i"].boxes == [[1.0, 2.0, 3.0, 4.0, 2.0]] and again["j"].boxes == []


def test_results_log(spark, tmp_path):
    head = "epoch, train/box_loss, train/cls_loss, train/dfl_loss, metrics/mAP50-95(B), val/box_loss, val/cls_loss, val/dfl_loss"
    (tmp_path / "r.csv").write_text(head + "\n1,2.25,0.5,4,0.61,3,1.75,0.5\n2,1.25,0.25,3,0.66,2.5,1,0.25\n")
    rows = an.read_results(spark, str(tmp_path / "r.csv")).orderBy("epoch").collect()
    assert np.allclose([(r.train_loss, r.val_loss, r.map) for r in rows], [(6.75, 5.25, 0.61), (4.5, 3.75, 0.66)])


def test_reports_and_configs(spark, tmp_path):
    doc = '{"suites": {"mio": {"role": "gated", "slices": {"weather": {"night": {"point": NaN, "ci_low": 0.1, "ci_high": 0.2, "n_gt": 4}}}}}}'
    (tmp_path / "report.json").write_text(doc)
    r = an.read_report(spark, str(tmp_path / "report.json")).first()
    assert (r.suite, r.role, r.axis, r.bucket, r.point, r.ci_low, r.n_gt) == ("mio", "gated", "weather", "night", None, 0.1, 4)
    (tmp_path / "t.yaml").write_text("canonical: [{id: 0, name: car}]\ndatasets:\n  rain:\n    map: {3: car}\n    ignore: [4]\n    exclude: []\n")
    routes, canon = an.taxonomy_tables(spark, an.read_config(spark, str(tmp_path / "t.yaml")))
    assert sorted((r.native, r.native_type, r.verb) for r in routes.collect()) == [("3", "int", "map"), ("4", "int", "ignore")] and canon.first().name == "car"
    assert an.dataset_digest({"outs": [{"md5": "abc"}]}) == "abc"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("x/MVI_1/img1.jpg", "x/MVI_1/img2.JPG", "x/MVI_2/readme.txt"):
            z.writestr(name, "data")
    members = an.archive_members(spark, str(tmp_path / "a.zip"), contents=True)
    assert {bytes(r.data) for r in members.collect()} == {b"data"}
    wanted = spark.createDataFrame([("MVI_1",), ("MVI_2",)], "sequence string")
    assert {r.sequence: r.images for r in an.member_counts(members, wanted).collect()} == {"MVI_1": 2, "MVI_2": 0}
    frames = spark.createDataFrame([("x/MVI_1/img1.jpg",), ("x/MVI_1/img9.jpg",)], "member string")
    assert [r.member for r in an.missing_members(frames, members).collect()] == ["x/MVI_1/img9.jpg"]


def test_frozen_folders(spark, tmp_path):
    path = str(tmp_path / "set")
    w = si.DatasetDir(spark, path, "w")
    w.write("t", spark.range(3))
    w.freeze("done for the report")
    with pytest.raises(si.ReadOnlyDatasetError, match="done for the report"):
        si.DatasetDir(spark, path, "w")
    r = si.DatasetDir(spark, path)
    assert r.read("t").count() == 3
    with pytest.raises(si.ReadOnlyDatasetError):
        r.write("t", spark.range(1))
    with pytest.raises(ValueError):
        si.DatasetDir(spark, path, "a")


def test_label_files(spark, tmp_path):
    frames = spark.createDataFrame([("a",), ("b",)], "image_id string")
    boxes = spark.createDataFrame([("a", 1, 0, 96.0, 135.0, 192.0, 270.0), ("a", 2, 1, 0.0, 513.0, 48.0, 27.0)], "image_id string, class_id int, ordinal int, left double, top double, width double, height double")
    texts = si.label_texts(frames, boxes)
    assert {r.image_id: r.label_text for r in texts.collect()} == {"a": "1 0.200000 0.500000 0.200000 0.500000\n2 0.025000 0.975000 0.050000 0.050000\n", "b": "\n"}
    assert si.write_label_files(texts, str(tmp_path / "labels")) == 2 and (tmp_path / "labels/b.txt").read_text() == "\n"


def test_checksums(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    found = si.checksums(spark, str(tmp_path / "f.bin")).withColumn("name", F.lit("f")).select("name", "sha256")
    assert found.first().sha256 == si.file_sha256(str(tmp_path / "f.bin"))
    locks = spark.createDataFrame([], "name string, sha256 string")
    assert si.verify_or_pin(found, locks).first().state == "pinned" and si.verify_or_pin(found, found).first().state == "verified"
    with pytest.raises(si.ChecksumMismatch):
        si.verify_or_pin(found, found.withColumn("sha256", F.lit("0")))


def test_ignore_documents_and_renderings(spark):
    seqs = spark.createDataFrame([("s",), ("t",)], "sequence string")
    regions = spark.createDataFrame([("s", 0, 1.0, 2.0, 3.0, 4.0)], "sequence string, ordinal int, left double, top double, width double, height double")
    docs = {r.sequence: json.loads(r.document) for r in si.ignore_documents(seqs, regions).collect()}
    assert docs["s"]["ignore_regions"] == [{"left": 1.0, "top": 2.0, "width": 3.0, "height": 4.0}] and docs["t"]["ignore_regions"] == [] and docs["t"]["image_width"] == 960
    clauses = spark.createDataFrame([("C1", True, "x"), ("C2", False, "y")], "clause string, passed boolean, detail string")
    from sightline.operators.gates import decision

    js, md = si.render_decision(clauses, decision(clauses))
    assert json.loads(js)["promoted"] is False and md.startswith("# REJECT")
    metrics = spark.createDataFrame([("s", "overall", "all", "map", None, None)], "suite string, axis string, bucket string, metric string, class_id int, point double")
    js, md = si.render_report(metrics, spark.createDataFrame([(0.5,)], "gap double"), {"seed": "0"})
    assert "NaN" in js and "—" in md


def picture(seed=1, shape=(12, 9, 3)):
    return np.random.default_rng(seed).integers(0, 256, shape).astype(np.uint8)


def test_corruptions():
    x = picture()
    assert (co.corrupt(x, "gaussian_noise", 0) == x).all() and co.corrupt(x, "gaussian_noise", 0) is not x
    assert (co.corrupt(x, "brightness_up", 1) == np.minimum(x.astype(int) + 20, 255)).all()
    assert (co.corrupt(x, "brightness_down", 5) == np.maximum(x.astype(int) - 100, 0)).all()
    a, b = co.corrupt(x, "gaussian_noise", 3, "i"), co.corrupt(x, "gaussian_noise", 3, "j")
    assert (a == co.corrupt(x, "gaussian_noise", 3, "i")).all() and (a != b).any()
    flat = np.full((9, 9, 3), 77, np.uint8)
    assert (co.corrupt(flat, "gaussian_blur", 4) == 77).all() and co.corrupt(x, "gaussian_blur", 3).std() < x.std()
    for wrong in (-1, 6):
        with pytest.raises(ValueError):
            co.corrupt(x, "brightness_up", wrong)


def test_image_tables(spark):
    rows = [("i", 12, 9, 3, bytearray(picture().tobytes())), ("j", 12, 9, 3, bytearray(picture(2).tobytes()))]
    images = spark.createDataFrame(rows, "image_id string, height int, width int, channels int, data binary")
    regions = spark.createDataFrame([("i", 2.3, 4.1, 3.5, 1.7)], "image_id string, left double, top double, width double, height double")
    filled = {r.image_id: np.frombuffer(bytes(r.data), np.uint8).reshape(12, 9, 3) for r in co.black_fill(images, regions).collect()}
    want = picture()
    want[4:6, 2:6] = 0  # 4.1 to 5.8 down, 2.3 to 5.8 across, in whole pixels
    assert (filled["i"] == want).all() and (filled["j"] == picture(2)).all()
    out = co.corrupt_images(images, [("gaussian_noise", 2), ("brightness_up", 0)]).collect()
    assert len(out) == 4 and all(bytes(r.data) == picture(1 if r.image_id == "i" else 2).tobytes() for r in out if r.severity == 0)
    frames = images.selectExpr("'s' as sequence", "if(image_id = 'i', 1, 2) as frame_num", "height", "width", "channels", "data")
    median = co.median_background(frames).first()
    assert bytes(median.data) == np.median(np.stack([picture(), picture(2)]), axis=0).astype(np.uint8).tobytes()


def test_clusters_and_nearest(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 20))
    rows = [(k, (base[k % 3] + rng.normal(size=20) * 0.1).tolist()) for k in range(9)] + [(9, [1.0] * 20)]
    f = spark.createDataFrame(rows, "id long, vec array<double>")
    assert {r.id: r.cluster for r in fe.clusters(f).collect()} == {k: k % 3 if k < 9 else 9 for k in range(10)}
    near = fe.nearest(f, f.select("id").where("id = 0"), f.select("id").where("id > 0"), 2).collect()
    assert {r.b for r in near} == {3, 6}


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_features_in_blocks_are_as_plain_loops(spark, block):
    rng = np.random.default_rng(12)
    vecs = {int(i): v for i, v in enumerate(rng.normal(size=(30, 6)))}
    vecs |= {30: vecs[2], 31: vecs[2], 32: np.full(6, 2.5)}  # copies tie, a constant is like nothing
    rows = [(i, v.tolist()) for i, v in vecs.items()] + [(33, None), (34, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (35, [float("nan")] * 6)]
    f = spark.createDataFrame(rows, "id long, vec array<double>")

    def corr(i, j):
        x, y = (vecs[k] - vecs[k].mean() for k in (i, j))
        return round(float((x * y).mean() / (x.std() * y.std())) if x.std() > 1e-9 and y.std() > 1e-9 else 0.0, 9)

    expect = {(i, j): corr(i, j) for i in vecs for j in vecs if i < j}
    assert {(r.a, r.b): round(r["corr"], 9) for r in fe.correlations(f, block=block).collect()} == pytest.approx(expect, abs=1e-8)
    top = {(i, j) for i in range(8) for j in sorted(set(vecs) - {i}, key=lambda j: (-corr(min(i, j), max(i, j)), j))[:3]}
    got = fe.nearest(f, f.where("id < 8").select("id"), f.select("id"), 3, block).collect()
    assert {(r.a, r.b) for r in got} == top and {r.place for r in got} == {1, 2, 3}
    label = {i: i for i in [*vecs, 33, 34, 35]}
    for _ in vecs:
        for (i, j), c in expect.items():
            if c > 0.7:
                label[i] = label[j] = min(label[i], label[j])
    assert {r.id: r.cluster for r in fe.clusters(f, 0.7, block).collect()} == label


def test_features_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert fe.clusters(none).collect() == fe.correlations(none).collect() == fe.nearest(none, none.select("id"), none.select("id")).collect() == []


def test_label_suite_and_ignore_round_trip(spark, tmp_path):
    from sightline.operators.splits import group_table

    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/MVI_1_img00001.txt").write_text("0 0.5 0.5 0.1 0.2\n2 0.1 0.1 0.1 0.1\n")
    (tmp_path / "labels/MVI_1_img00002.txt").write_text("\n")
    seqs = spark.createDataFrame([("MVI_1",)], "sequence string")
    regions = spark.createDataFrame([("MVI_1", 0, 1.0, 2.0, 3.0, 4.0)], "sequence string, ordinal int, left double, top double, width double, height double")
    (tmp_path / "i.json").write_text(si.ignore_documents(seqs, regions).first().document)
    groups = group_table(spark, {"cam": {"weathers": ["night"], "sequences": ["MVI_1"]}})
    images, gt, ignore = an.label_suite(spark, str(tmp_path / "labels"), str(tmp_path / "i.json"), groups)
    assert {(r.camera, r.weather) for r in images.collect()} == {("cam", "night")} and images.count() == 2
    assert gt.count() == 2 and [(r.x1, r.y2) for r in ignore.where("image_id = 'MVI_1_img00002'").collect()] == [(1.0, 6.0)]
    mixed = group_table(spark, {"cam": {"weathers": ["night", "sunny"], "sequences": ["MVI_1"]}})
    with pytest.raises(Exception, match="more than one weather"):
        an.label_suite(spark, str(tmp_path / "labels"), str(tmp_path / "i.json"), mixed)[0].collect()


def test_documents(spark):
    import yaml

    assert yaml.safe_load(si.data_document(["car", "bus"], {"train": "images/train"})) == {"path": ".", "names": {0: "car", 1: "bus"}, "train": "images/train"}
    m = spark.createDataFrame([("s", 3, "d")], "sequence string, frame_count long, archive_dir string")
    assert yaml.safe_load(si.frame_document(m, "src"))["sequences"]["s"] == {"frame_count": 3, "archive_dir": "d"}
    images = spark.createDataFrame([("i", 4, [[1.0]], [])], "image_id string, width int, boxes array<array<double>>, ignore array<array<double>>")
    doc = json.loads(si.manifest_document(images, {"dataset": "d"}))
    assert doc["images"] == [{"width": 4, "id": "i", "boxes": [[1.0]], "ignore": []}]


def test_provenance_and_fetching(tmp_path):
    from sightline.functions import provenance as pr
    from sightline.sources import fetch as fe2

    assert pr.masked(["run", "password", "x", "--token", "y", "z"]) == "run password ******** --token ******** z"
    assert pr.merged({"overrides": {"lr0": 1, "a": 2}}, {"lr0": 3}) == {"lr0": 3, "a": 2} and pr.git("no-such-command") == "unknown"
    assert pr.provenance("w/yolov8n.pt", 0, 10, "cpu", ["car"])["note"] and not pr.provenance("coco/yolov8n.pt", 0, 10, "cpu", [])["note"]
    space = {"lr": {"dist": "loguniform", "low": 1e-4, "high": 1e-2}, "m": {"dist": "uniform", "low": 0, "high": 1}, "o": {"dist": "choice", "values": ["a", "b"]}}
    point = pr.drawn(space, 1)
    assert point == pr.drawn(space, 1) and 1e-4 <= point["lr"] <= 1e-2 and point["o"] in "ab"
    with pytest.raises(ValueError):
        pr.drawn({"x": {"dist": "normal"}}, 1)
    content = {"v": b"one"}

    def write(archive, folder):
        folder.mkdir(parents=True, exist_ok=True)
        (folder / archive["filename"]).write_bytes(content["v"])
        return folder / archive["filename"]

    fe2.FETCHERS["memory"] = write
    archives = [{"id": "a", "filename": "a.bin", "source": "memory"}]
    locks: dict[str, str] = {}
    assert fe2.obtain(archives, tmp_path / "d", locks) == {"a": "fetched"} and fe2.obtain(archives, tmp_path / "d", locks) == {"a": "skipped"}
    content["v"] = b"two"
    (tmp_path / "d/a.bin").unlink()
    with pytest.raises(si.ChecksumMismatch):
        fe2.obtain(archives, tmp_path / "d", locks)
    with pytest.warns(UserWarning):
        fe2.obtain_all([{"name": "s", "role": "stretch", "archives": [{"id": "b", "filename": "b", "source": "none"}]}], tmp_path, locks)
    with pytest.raises(ValueError):
        fe2.fetch({"source": "none"}, tmp_path)
