import pytest
from pyspark.sql import functions as F

from sightline.operators import gates as ga
from sightline.operators import splits as sp
from sightline.operators import taxonomy as ta

METRIC = "suite string, axis string, bucket string, class_id int, metric string, point double, ci_low double, ci_high double, n_gt long"
ROLES = [("in", "in_distribution"), ("mio", "gated"), ("rain", "gated")]


def report(spark, overall=0.60, mio=0.22, rain=0.10, classes=(0.68, 0.64, 0.47), night=0.46, sunny=0.72, half=0.02, class_n=(9000, 100, 1400)):
    rows = [("in", "overall", "all", None, "map", overall, 10_500), ("mio", "overall", "all", None, "map", mio, 5000), ("rain", "overall", "all", None, "map", rain, 11_000)]
    rows += [("in", "class", str(k), k, "ap", p, n) for k, (p, n) in enumerate(zip(classes, class_n))]
    rows += [("in", "weather", "night", None, "map", night, 1700), ("in", "weather", "sunny", None, "map", sunny, 1000)]
    return spark.createDataFrame([(*r[:6], r[5] - half, r[5] + half, r[6]) for r in rows], METRIC)


def curves(spark, champion=(0.60, 0.55, 0.45, 0.30), challenger=(0.60, 0.55, 0.45, 0.30)):
    rows = [(m, "blur", s, p) for m, c in (("champion", champion), ("challenger", challenger)) for s, p in enumerate(c or ())]
    return spark.createDataFrame(rows, "model string, corruption string, severity int, point double")


def verdict(spark, challenger, c=None):
    roles = spark.createDataFrame(ROLES, "suite string, role string")
    rows = {r.clause: r for r in ga.contract(report(spark), challenger, c if c is not None else curves(spark), roles).collect()}
    assert sorted(rows) == ["C1", "C2", "C3", "C4", "C5"]
    return rows


BETTER = {"overall": 0.63, "mio": 0.23, "rain": 0.12, "classes": (0.70, 0.66, 0.50), "night": 0.50, "sunny": 0.73}


def test_better_is_promoted(spark):
    rows = verdict(spark, report(spark, **BETTER))
    assert all(r.passed for r in rows.values())


def test_weak_fails_c1_and_c3(spark):
    rows = verdict(spark, report(spark, **{**BETTER, "overall": 0.30, "classes": (0.30, 0.30, 0.30)}))
    assert not rows["C1"].passed and not rows["C3"].passed


def test_one_crater_fails_c2(spark):
    assert not verdict(spark, report(spark, **{**BETTER, "mio": 0.05}))["C2"].passed


def test_small_slices_only_warn_and_wide_intervals_pass(spark):
    small = verdict(spark, report(spark, **{**BETTER, "classes": (0.70, 0.40, 0.50)}))
    assert small["C3"].passed and small["C3"].detail == "0 blocks, 1 warnings"
    assert verdict(spark, report(spark, **{**BETTER, "sunny": 0.69}, half=0.05))["C3"].passed


def test_corruption_clause(spark):
    good = report(spark, **BETTER)
    assert not verdict(spark, good, curves(spark, challenger=(0.40, 0.30, 0.20, 0.10)))["C4"].passed
    skipped = verdict(spark, good, curves(spark, challenger=None))["C4"]
    assert skipped.passed and skipped.detail == "skipped"


def epochs(spark, train, val, maps):
    return spark.createDataFrame([(1, k, *v) for k, v in enumerate(zip(train, val, maps))], "run_id int, epoch int, train_loss double, val_loss double, map double")


@pytest.mark.parametrize(
    ("train", "val", "maps", "flags", "best"),
    [
        ((3.0, 2.0, 1.0), (3.0, 2.0, 1.5), (0.4, 0.6, 0.6), (False, False, False), 1),
        ((3.0, float("nan"), 1.0), (3.0, 2.0, 1.5), (0.4, 0.5, 0.6), (True, False, False), 2),
        ((2.0, 10.0, 25.0), (3.0, 2.0, 1.5), (0.4, 0.5, 0.6), (True, False, False), 2),
        ((3.0, 2.0, 1.0), (3.0, 1.0, 1.5), (0.4, 0.5, 0.6), (False, True, False), 2),
        ((3.0, 2.0, 1.0), (3.0, 2.0, 1.5), (0.1, 0.2, 0.2), (False, False, True), 1),
        ((3.0, 2.99, 2.98), (3.0, 2.0, 1.5), (0.4, 0.5, 0.6), (False, False, True), 2),
    ],
)
def test_diagnosis(spark, train, val, maps, flags, best):
    r = ga.diagnose(epochs(spark, train, val, maps)).first()
    assert (r.diverged, r.overfit, r.underfit) == flags and r.suspect == any(flags) and r.best_epoch == best


def test_budget(spark):
    s = spark.createDataFrame([(3600.0,), (3600.0,), (None,)], "seconds double")
    assert ga.check_budget(s, 8, 10, 10) == 6.0
    with pytest.raises(ga.BudgetExhausted):
        ga.check_budget(s, 8, 20, 25)


def test_best_trial_passes_over_undefined_values(spark):
    t = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, 0.5), (4, None)], "trial int, metric double")
    assert ga.best_trial(t).first().trial == 2


def test_leakage_guards(spark):
    a = spark.createDataFrame([("train", "s1"), ("val", "s2"), ("test", "s3")], "split string, sequence string")
    pool = lambda *x: spark.createDataFrame([(i,) for i in x], "sequence string")
    ga.assert_no_leakage(a)
    ga.assert_trainable(pool("s1"), a)
    ga.guard_pool(pool("s1", "s2"), a)
    with pytest.raises(ga.LeakageError, match="s2"):
        ga.assert_trainable(pool("s1", "s2"), a)
    with pytest.raises(ga.LeakageError, match="s3"):
        ga.guard_pool(pool("s3"), a)
    with pytest.raises(ga.LeakageError, match="s1"):
        ga.assert_no_leakage(a.union(spark.createDataFrame([("train", "s1")], a.schema)))


def test_taxonomy_routes_and_faults(spark):
    routes = spark.createDataFrame([("d", "car", "map", "car"), ("d", "4", "ignore", None), ("d", "dog", "exclude", None)], "dataset string, native string, verb string, canonical string")
    canon = spark.createDataFrame([(0, "car"), (1, "bus")], "id int, name string")
    ta.validate_taxonomy(routes, canon)
    boxes = spark.createDataFrame([("d", "car"), ("d", "4"), ("d", "dog"), ("d", "cat")], "dataset string, native_class string")
    got = {r.native_class: (r.verb, r.class_id) for r in ta.route(boxes, routes, canon).collect()}
    assert got == {"car": ("map", 0), "4": ("ignore", None), "dog": ("exclude", None), "cat": (None, None)}
    with pytest.raises(ta.UnknownNativeClass, match="d:cat"):
        ta.fail_on_misses(ta.route(boxes, routes, canon))
    for extra in [("d", "car", "ignore", None), ("d", "x", "map", "tram")]:
        with pytest.raises(ta.TaxonomyError):
            ta.validate_taxonomy(routes.union(spark.createDataFrame([extra], routes.schema)), canon)


def test_routing_of_other_datasets(spark):
    routes = spark.createDataFrame([("m", "car", "map", "car"), ("m", "truck", "map", "van_truck"), ("m", "motorized", "ignore", None), ("m", "person", "exclude", None)], "dataset string, native string, verb string, canonical string")
    canon = spark.createDataFrame([(0, "car"), (2, "van_truck")], "id int, name string")
    schema = "dataset string, image_id string, native_class string, x1 double, y1 double, x2 double, y2 double, width int, height int"
    row = lambda c, *b: ("m", "i", c, *map(float, b), 640, 480)
    rows = [row("car", -5, -5, 700, 500), row("truck", 1, 1, 9, 9), row("motorized", 5, 5, 15, 15), row("person", 1, 1, 2, 2), row("zebra", 3, 3, 3, 9)]
    got = ta.route_boxes(spark.createDataFrame(rows, schema), routes, canon).collect()
    assert sorted((r.verb, r.class_id, r.x2) for r in got if r.class_id is not None) == [("map", 0, 640.0), ("map", 2, 9.0)]
    assert [r.verb for r in got if r.class_id is None] == ["ignore"]
    for bad in (row("person", 0, 0, 2000, 10), row("zebra", 1, 1, 5, 5)):
        with pytest.raises(Exception, match="out of bounds|unknown native"):
            ta.route_boxes(spark.createDataFrame([bad], schema), routes, canon).collect()


def test_class_map(spark):
    models = spark.createDataFrame(list({0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}.items()), "model_id int, name string")
    canon = spark.createDataFrame([(0, "car"), (1, "bus"), (2, "van_truck")], "id int, name string")
    mapping = ta.class_map(models, canon)
    assert {r.model_id: r.class_id for r in mapping.collect()} == {2: 0, 5: 1, 7: 2}
    d = spark.createDataFrame([(2, 0.5), (0, 0.9)], "model_id int, score double")
    assert [(r.class_id, r.score) for r in ta.relabel(d, mapping).collect()] == [(0, 0.5)]


GROUPS = {f"g{k:02d}": {"weathers": [["sunny", "night", "cloudy", "rainy"][k % 4]], "sequences": [f"s{k}_{i}" for i in range(1 + k % 5)]} for k in range(20)}
CONFIG = {"seed": 7, "proportions": {"train": 0.6, "val": 0.1, "test": 0.1, "prod_holdout": 0.2}, "constraints": {"min_weather_groups": {"test": {"night": 1, "sunny": 1}, "val": {"night": 1}}}}


def test_splits_cover_and_repeat(spark):
    a = sp.assign_groups(GROUPS, CONFIG)
    assert a == sp.assign_groups(GROUPS, CONFIG) != sp.assign_groups(GROUPS, {**CONFIG, "seed": 8})
    assert sorted(g for v in a.values() for g in v) == sorted(GROUPS)
    minima = spark.createDataFrame([("test", "night", 1), ("test", "sunny", 1), ("val", "night", 1)], "split string, weather string, need int")
    groups, assigned = sp.group_table(spark, GROUPS), sp.split_table(spark, a)
    sp.validate_split(assigned, groups, minima)
    counts = {r.split: r.sequences for r in sp.manifest_counts(sp.manifests(assigned, groups)).collect()}
    assert sum(counts.values()) == sum(len(g["sequences"]) for g in GROUPS.values())
    with pytest.raises(sp.SplitError):
        sp.validate_split(assigned.where("group <> 'g00'"), groups, minima)
    with pytest.raises(sp.SplitError):
        sp.validate_split(assigned, groups, minima.selectExpr("split", "weather", "need + 50 as need"))
    with pytest.raises(sp.SplitError):
        sp.assign_groups(GROUPS, {**CONFIG, "proportions": {"val": 0.6, "test": 0.6, "prod_holdout": 0.6}})


def test_seeded_samples(spark):
    ids = [f"{k:03d}" for k in range(50)]
    a = sp.sample_ids(ids[::-1], 10, 1)
    assert a == sp.sample_ids(ids, 10, 1) == sorted(a) and len(a) == 10 and sp.sample_ids(ids, 99, 1) == ids
    assert sp.sample_rows(spark.range(100).selectExpr("id as k"), "k", 7, 1).count() == 7


# A published assignment, and the groups that it is of (weather: group: number of its sequences).
PUBLISHED_SEED = 1337
PUBLISHED_SHARES = {"train": 0.58, "prod_holdout": 0.2, "val": 0.12, "test": 0.1}
PUBLISHED_MINIMA = {"prod_holdout": {"night": 1, "rainy": 1}, "test": {"night": 1, "rainy": 1}}
PUBLISHED_GROUPS = {
    "sunny": {"cam_wideave_complex": 6, "cam_redbanner_a": 2, "cam_redbarrier": 5, "cam_41063": 1, "cam_41073": 1},
    "night": {"cam_treemed": 2, "cam_bldgroad": 3, "cam_billboard": 2, "cam_nightblue": 2, "cam_pillar_r": 2, "cam_39781": 1, "cam_39851": 1, "cam_39861": 1, "cam_40752": 1, "cam_40981": 1},
    "cloudy": {"cam_fence5": 5, "cam_greenmed": 2, "cam_hedge_a": 2, "cam_hedge_b": 3, "cam_hedge_c": 3, "cam_39931": 1, "cam_40141": 1, "cam_40181": 1},
    "cloudy rainy": {"cam_metalmed": 3},
    "rainy": {"cam_hedgewall": 6, "cam_40871": 1, "cam_63544": 1},
}
PUBLISHED_SPLITS = {
    "train": "cam_39861 cam_40981 cam_bldgroad cam_fence5 cam_hedge_a cam_hedge_b cam_hedgewall cam_metalmed cam_redbarrier cam_wideave_complex",
    "val": "cam_41073 cam_billboard cam_redbanner_a cam_treemed",
    "test": "cam_40141 cam_40752 cam_41063 cam_63544 cam_greenmed",
    "prod_holdout": "cam_39781 cam_39851 cam_39931 cam_40181 cam_40871 cam_hedge_c cam_nightblue cam_pillar_r",
}
PUBLISHED_SEQUENCES = {"train": 35, "val": 7, "test": 6, "prod_holdout": 12}


def test_the_published_assignment(spark):
    groups = {g: {"weathers": w.split(), "sequences": [f"{g}/{k}" for k in range(n)]} for w, own in PUBLISHED_GROUPS.items() for g, n in own.items()}
    got = sp.assign_groups(groups, {"seed": PUBLISHED_SEED, "proportions": PUBLISHED_SHARES, "constraints": {"min_weather_groups": PUBLISHED_MINIMA}})
    assert got == {s: names.split() for s, names in PUBLISHED_SPLITS.items()}
    counts = sp.manifest_counts(sp.manifests(sp.split_table(spark, got), sp.group_table(spark, groups))).collect()
    assert {r.split: r.sequences for r in counts} == PUBLISHED_SEQUENCES


# The points and bounds of a published promotion (clauses 1, 2 and 4).
PUBLISHED_INSIDE = {"champion": (0.6009879202905629, 0.5764562087376732, 0.6251224460604056), "challenger": (0.6301693458708414, 0.6095182779101239, 0.6510536924384659)}
PUBLISHED_GATED = {"champion": 0.1367658539207289, "challenger": 0.1514011729525393}
PUBLISHED_AUC = {"champion": 0.5325576164878434, "challenger": 0.5838160919643591}


def test_the_published_promotion(spark):
    def side(model):
        return spark.createDataFrame([("in", "overall", "all", None, "map", *PUBLISHED_INSIDE[model], 1000), ("mio", "overall", "all", None, "map", PUBLISHED_GATED[model], 0.0, 1.0, 1000)], METRIC)

    cells = spark.createDataFrame([(m, "blur", 0, p) for m, p in PUBLISHED_AUC.items()], "model string, corruption string, severity int, point double")
    roles = spark.createDataFrame(ROLES, "suite string, role string")
    regressions = ga.slice_regressions(side("champion"), side("challenger"), roles)
    clauses = ga.contract(side("champion"), side("challenger"), cells, roles)
    row = ga.decision(clauses, regressions).first()
    assert row.promoted and row.failed == "" and row.warnings == []
    details = {r.clause: r.detail for r in clauses.collect()}
    assert details["C1"] == "0.6010 -> 0.6302" and details["C2"] == "0.1368 -> 0.1514, worst drop 0.0000" and details["C4"] == "0.5326 -> 0.5838"


def test_warnings_are_carried_in_the_order_of_axes(spark):
    new = report(spark, **{**BETTER, "classes": (0.70, 0.20, 0.50), "night": 0.10})
    roles = spark.createDataFrame(ROLES, "suite string, role string")
    found = ga.slice_regressions(report(spark), new, roles)
    assert {(r.axis, r.bucket, r.kind) for r in found.collect()} == {("class", "1", "warning"), ("weather", "night", "block")}
    few = found.withColumn("kind", F.lit("warning"))
    row = ga.decision(ga.contract(report(spark), new, curves(spark), roles), few).first()
    assert not row.promoted and [w.split(":")[0] for w in row.warnings] == ["class/1", "weather/night"]
