import math
import random

import numpy as np
import pytest

from sightline.operators import bootstrap as bs
from sightline.operators import matching as ma
from sightline.operators import metrics as me
from sightline.plans.evaluation import slice_metrics

BOX = "x1 double, y1 double, x2 double, y2 double"


def dets(spark, rows):
    return spark.createDataFrame(rows, f"image_id string, class_id int, det_ordinal int, score double, {BOX}")


def gts(spark, rows):
    return spark.createDataFrame(rows, f"image_id string, class_id int, gt_ordinal int, {BOX}")


def areas(spark, rows=()):
    return spark.createDataFrame(list(rows), f"image_id string, {BOX}")


SMALL, LARGE, REGION = (0.0, 0.0, 10.0, 10.0), (100.0, 100.0, 300.0, 300.0), (500.0, 500.0, 600.0, 600.0)


def test_precedence():
    got = ma.match_image(np.array([LARGE, REGION, SMALL]), np.array([SMALL, LARGE]), np.array([REGION]), (0.5,), ("small",))
    assert got.ravel().tolist() == [ma.LEFT_OUT, ma.LEFT_OUT, ma.HIT]


def test_ties_go_to_the_first_box():
    got = ma.match_image(np.array([SMALL, SMALL, SMALL]), np.array([SMALL, SMALL]), np.zeros((0, 4)), (0.5, 0.95), ("all",))
    assert got.tolist() == [[1, 1], [1, 1], [0, 0]]


def ap_of(spark, hits, n_gt):
    facts = spark.createDataFrame([("g", "i", k, s, h) for k, (s, h) in enumerate(hits)], "g string, image_id string, det_ordinal int, score double, is_hit int")
    totals = spark.createDataFrame([("g", n_gt)], "g string, n_gt long")
    return me.average_precision(facts, totals, ["g"]).first().ap


def brute_ap(hits, n_gt):
    order = sorted(range(len(hits)), key=lambda k: (-hits[k][0], k))
    tp, points = 0, []
    for n, k in enumerate(order, 1):
        tp += hits[k][1]
        points.append((tp / n_gt, tp / n))
    return sum(max([p for r, p in points if r >= i * 0.01], default=0.0) for i in range(101)) / 101


def test_average_precision(spark):
    assert ap_of(spark, [(0.9, 0), (0.8, 1)], 1) == 0.5
    assert ap_of(spark, [(0.9, 1), (0.8, 1)], 2) == 1.0
    assert ap_of(spark, [(0.9, 1)], 0) is None and ap_of(spark, [], 3) == 0.0
    rng = random.Random(6)
    for n in (1, 7, 57, 100, 400):
        hits = [(rng.choice([rng.random(), 0.5, 1.3]), int(rng.random() < 0.6)) for _ in range(n)]
        n_gt = sum(h for _, h in hits) + rng.randint(0, 20) or 1
        assert math.isclose(ap_of(spark, hits, n_gt), brute_ap(hits, n_gt), abs_tol=1e-12)


def evaluation(spark, d, g, r=(), images=("a",), classes=(0,), replicates=50):
    universe = spark.createDataFrame([(i, "sunny", "cam_x") for i in images], "image_id string, weather string, camera string")
    rows = slice_metrics("s", universe, gts(spark, g), areas(spark, r), dets(spark, d), classes, replicates).collect()
    return {(x.axis, x.bucket, x.metric, x.class_id): x for x in rows}


def test_ignore_region_excuses_a_false_positive(spark):
    d = [("a", 0, 0, 0.9, 20.0, 20.0, 30.0, 30.0), ("a", 0, 1, 0.8, *SMALL)]
    g = [("a", 0, 0, *SMALL)]
    assert evaluation(spark, d, g)["overall", "all", "map50", None].point == 0.5
    assert evaluation(spark, d, g, [("a", 20.0, 20.0, 30.0, 30.0)])["overall", "all", "map50", None].point == 1.0
    # A region of another image excuses nothing.
    assert evaluation(spark, d, g, [("b", 20.0, 20.0, 30.0, 30.0)], ("a", "b"))["overall", "all", "map50", None].point == 0.5


def test_scale_slices_and_intervals(spark):
    d = [("a", 0, 0, 0.95, *LARGE), ("a", 0, 1, 0.9, *REGION), ("a", 0, 2, 0.85, *SMALL), ("z", 0, 3, 0.99, *SMALL)]
    g = [("a", 0, 0, *SMALL), ("a", 0, 1, *LARGE)]
    got = evaluation(spark, d, g, [("a", *REGION)], ("a", "empty"))
    assert got["scale", "small", "map50", None].point == 1.0 and got["scale", "small", "map50", None].n_gt == 1
    assert got["scale", "large", "map50", None].point == 1.0 and got["scale", "medium", "map50", None].point is None
    row = got["overall", "all", "map50", None]
    assert (row.point, row.ci_low, row.ci_high, row.n_images, row.n_gt) == (1.0, 1.0, 1.0, 2, 2)


def mixed():
    d = [(i, 0, k, 0.9, *(SMALL if i != "d" else LARGE)) for k, i in enumerate("abcd")]
    return d, [(i, 0, k, *SMALL) for k, i in enumerate("abcd")]


def test_bootstrap_has_width_and_repeats(spark):
    d, g = mixed()
    a, b = (evaluation(spark, d, g, images=tuple("abcd"))["overall", "all", "map50", None] for _ in range(2))
    assert a == b and a.ci_low < a.point < a.ci_high and a.n_gt == 4


def test_unit_weights_give_the_point(spark):
    rng = np.random.default_rng(2)
    hits, image = rng.integers(0, 2, 60), rng.integers(0, 9, 60)
    n_gt = np.full(9, 5)
    plain = brute_ap([(-k, int(h)) for k, h in enumerate(hits)], 45)
    assert abs(bs.precision_at_points(np.ones((1, 9), int), image, hits > 0, n_gt)[0] - plain) < 1e-12
    draws = np.stack(list(bs.times_drawn(9, 3, 0, 20)))
    assert all((a == b).all() for a, b in zip(bs.times_drawn(9, 3, 12, 20), draws[12:], strict=True))
    assert (draws.sum(1) == 9).all()
    for k, w in enumerate(draws):
        repeated = [(-j, int(h)) for j, (h, i) in enumerate(zip(hits, image)) for _ in range(w[i])]
        assert abs(bs.precision_at_points(draws, image, hits > 0, n_gt)[k] - brute_ap([(s, h) for s, h in repeated], int((w * 5).sum()))) < 1e-9


def by_detection(times, image, hits, n_gt):
    """The same as precision_at_points, with every hit of every draw looked at."""
    points = np.linspace(0, 1, 101)
    total, seen, at = times @ n_gt, np.cumsum(times[:, image], axis=1), np.flatnonzero(hits)
    weight = times[:, image[at]]
    found = np.cumsum(weight, axis=1)
    draw, hit = np.nonzero((weight > 0) & (total > 0)[:, None])
    best = np.zeros((len(times), 101))
    np.maximum.at(best, (draw, np.searchsorted(points, found[draw, hit] / total[draw], "right") - 1), found[draw, hit] / seen[draw, at[hit]])
    return np.where(total > 0, np.maximum.accumulate(best[:, ::-1], axis=1).mean(axis=1), np.nan)


@pytest.mark.parametrize("kind", ["flat", "falling", "rising", "perfect", "none"])
@pytest.mark.parametrize("n_images,n", [(1, 1), (6, 0), (6, 40), (90, 700), (400, 6000)])
def test_draws_are_exact_for_any_shape_of_curve(kind, n_images, n):
    rng = np.random.default_rng(n)
    chance = {"flat": 0.5, "falling": np.linspace(1, 0.1, n), "rising": np.linspace(0, 0.9, n), "perfect": 1, "none": 0}[kind]
    image = np.sort(rng.integers(0, n_images, n)) if n == 700 else rng.integers(0, n_images, n)
    codes = np.where(rng.random((3, n)) < chance, ma.HIT, np.where(rng.random((3, n)) < 0.3, ma.LEFT_OUT, ma.MISS)).astype(np.int8)
    n_gt = np.bincount(image, minlength=n_images) + rng.integers(0, 2, n_images)
    n_gt[n_images // 2 :] *= rng.integers(0, 2)
    times = np.stack(list(bs.times_drawn(n_images, 1, 0, 20)))
    want = [by_detection(times, image[c != ma.LEFT_OUT], c[c != ma.LEFT_OUT] == ma.HIT, n_gt) for c in codes]
    assert np.array_equal(bs.ap_of_draws(times, image, codes, n_gt), np.array(want), equal_nan=True)


def test_draws_do_not_look_at_every_detection():
    import time

    rng = np.random.default_rng(7)
    image, hits = rng.integers(0, 1500, 40_000), rng.random(40_000) < np.linspace(0.9, 0.2, 40_000)
    times, n_gt = np.stack(list(bs.times_drawn(1500, 0, 0, 200))), np.bincount(image, minlength=1500)
    took = {}
    for f in (bs.precision_at_points, by_detection):
        for _ in range(3):
            began = time.process_time()
            got = f(times, image, hits, n_gt)
            took[f] = min(took.get(f, (9e9,))[0], time.process_time() - began), got
    assert np.array_equal(took[bs.precision_at_points][1], took[by_detection][1])
    assert took[bs.precision_at_points][0] < took[by_detection][0] / 2, {f.__name__: t for f, (t, _) in took.items()}


def test_intervals_when_no_detection_counts(spark):
    got = evaluation(spark, [("a", 0, 0, 0.9, 20.0, 20.0, 30.0, 30.0)], [("a", 0, 0, *SMALL)], [("a", 20.0, 20.0, 30.0, 30.0)])
    for metric, c in (("map50", None), ("map", None), ("ap50", 0), ("ap", 0)):
        row = got["overall", "all", metric, c]
        assert (row.point, row.ci_low, row.ci_high) == (0.0, 0.0, 0.0)


def test_headline(spark):
    rows = spark.createDataFrame([("in", 0.4, 100), ("mio", 0.3, 300), ("rain", 0.1, 100)], "suite string, point double, n_gt long")
    roles = spark.createDataFrame([("in", "in_distribution"), ("mio", "gated"), ("rain", "gated")], "suite string, role string")
    r = me.headline(rows, roles).first()
    assert math.isclose(r.gated, 0.25) and math.isclose(r.gap, 0.15)
    assert math.isclose({x.suite: x.gap for x in me.suite_gaps(rows, roles).collect()}["rain"], 0.3)


def test_curves_hold_the_clean_value_once_each(spark):
    p = spark.createDataFrame([(None, 0, 0.6), ("a", 1, 0.5), ("a", 2, 0.4), ("b", 1, 0.3)], "corruption string, severity int, point double")
    curves = me.degradation_curves(p)
    assert sorted((r.corruption, r.severity) for r in curves.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert math.isclose(me.corruption_auc(curves).first().auc, (0.6 * 2 + 0.5 + 0.4 + 0.3) / 5)


@pytest.mark.parametrize("seed", range(4))
def test_matcher_against_a_plain_loop(seed):
    rng = np.random.default_rng(seed)

    def boxes(n):
        a = rng.integers(0, 60, (n, 2))
        return np.hstack([a, a + rng.integers(10, 120, (n, 2))]).astype(float)

    d, g, r = boxes(25), boxes(15), boxes(2)
    got = ma.match_image(d, g, r, ma.THRESHOLDS, ma.RANGES)
    iou = ma.pair_iou(d, g)
    k = 0
    for name in ma.RANGES:
        real = ma.range_masks((g[:, 2] - g[:, 0]) * (g[:, 3] - g[:, 1]), [name])[0]
        for t in ma.THRESHOLDS:
            free = np.ones(len(g), bool)
            for i in range(len(d)):
                want = ma.MISS
                for group, code in ((real, ma.HIT), (~real, ma.LEFT_OUT)):
                    ok = np.flatnonzero(free & group & (iou[i] >= t))
                    if len(ok):
                        free[ok[np.argmax(iou[i][ok])]] = False
                        want = code
                        break
                else:
                    want = ma.LEFT_OUT if ma.covered(d[i : i + 1], r)[0] >= 0.5 else ma.MISS
                assert got[i, k] == want
            k += 1


def test_seeded_bootstrap_query_is_whole_and_as_a_plain_loop(spark, tmp_path):
    from collections import defaultdict

    from sightline.plans import views as v
    from sightline.plans.queries import QUERIES

    rng = np.random.default_rng(5)
    spark.createDataFrame([(i, float(rng.integers(0, 500))) for i in range(400)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.axis, r.bucket, r.metric, r.class_id): (r.ci_low, r.ci_high) for r in QUERIES["seeded_bootstrap_ci"](spark, str(tmp_path)).collect()}
    images = v.images(spark, str(tmp_path))
    slices = {("overall", "all"), *(("weather", f"w{i}") for i in range(4)), *(("camera", f"c{i}") for i in range(7)), *(("scale", s) for s in ma.RANGES if s != "all")}
    counts = me.sliced(ma.gt_counts(v.gt_boxes(spark, str(tmp_path))), images).collect()
    assert {k[:2] for k in got} == {(r.axis, r.bucket) for r in counts} <= slices and {"overall", "weather", "camera", "scale"} == {k[0] for k in got}

    matched = ma.match(v.detections(spark, str(tmp_path)), v.gt_boxes(spark, str(tmp_path)), v.regions(spark, str(tmp_path)))
    facts = [r for r in me.sliced(ma.match_facts(matched), images).collect() if r.bucket == "w0"]
    ids = sorted(r.image_id for r in images.collect() if r.weather == "w0")
    n_gt, dets_of = defaultdict(int), defaultdict(list)
    for r in counts:
        if r.bucket == "w0":
            n_gt[r.class_id, ids.index(r.image_id)] += r.n_gt
    for r in facts:
        dets_of[r.class_id, r.iou_thr].append((-r.score, ids.index(r.image_id), r.det_ordinal, int(r.is_hit)))
    known, values = {}, []
    for w in map(tuple, bs.times_drawn(len(ids), 0, 0, 2000)):
        if w not in known:
            aps = []
            for c in sorted({c for c, _ in n_gt}):
                total = sum(w[i] * n_gt[c, i] for i in range(len(ids)))
                own = [brute_ap([(-k, d[3]) for k, d in enumerate(d for d in sorted(dets_of[c, t]) for _ in range(w[d[1]]))], total) for t in ma.THRESHOLDS] if total else []
                aps += [np.mean(own)] if own else []
            known[w] = np.mean(aps)
        values.append(known[w])
    assert np.allclose(got["weather", "w0", "map", None], np.percentile(values, [2.5, 97.5]), atol=1e-9)
