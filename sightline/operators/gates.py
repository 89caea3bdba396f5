"""Decisions: the promotion contract, leakage guards, training diagnosis, the GPU budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract.
C1_EPSILON, C2_EPSILON, C2_DROP, C3_MIN_GT, C4_TOLERANCE = 0.0, 0.0, 0.05, 500, 0.02
#: Fixed order in which slices are looked at.
SLICE_AXES = ("class", "weather", "camera", "scale")
#: Fixed values of the diagnosis.
OVERFIT_RATIO, UNDERFIT_FLOOR, UNDERFIT_DROP = 1.2, 0.381, 0.05
#: Fixed value: minutes an epoch of a trial is taken to last.
EPOCH_MINUTES = 1.5


class LeakageError(ValueError):
    """Data of one split is found in another."""


class BudgetExhausted(RuntimeError):
    """A session does not fit what is left of the budget."""


def sig_worse(challenger_high: Column, champion_point: Column) -> Column:
    """Whether the challenger's upper bound lies below the champion's point; false where undefined."""
    return F.coalesce(challenger_high < champion_point, F.lit(False))


def _paired(champion: DataFrame, challenger: DataFrame, roles: DataFrame) -> DataFrame:
    """Slices that both sides have, with both points, the challenger's upper bound and `worse`."""
    keys = ["suite", "axis", "bucket", "metric"]
    a = champion.select(*keys, F.coalesce("class_id", F.lit(-1)).alias("cls"), F.col("point").alias("old"), F.col("n_gt").alias("old_n"))
    b = challenger.select(*keys, F.coalesce("class_id", F.lit(-1)).alias("cls"), F.col("point").alias("new"), F.col("ci_high").alias("new_high"), F.col("n_gt").alias("new_n"))
    return a.join(b, [*keys, "cls"]).join(F.broadcast(roles), "suite").withColumn("worse", sig_worse(F.col("new_high"), F.col("old")))


def slice_regressions(champion: DataFrame, challenger: DataFrame, roles: DataFrame) -> DataFrame:
    """(suite, axis, bucket, metric, n_gt, old, new, kind, place): in-distribution slices on which the
    challenger is significantly worse; kind is block, or warning for slices with little ground truth.
    `place` is the order in which a report lists them."""
    axes = F.array(*map(F.lit, SLICE_AXES))
    sliced = ((F.col("axis") == "class") & (F.col("metric") == "ap")) | ((F.col("axis") != "class") & F.array_contains(axes, F.col("axis")) & (F.col("metric") == "map"))
    bad = _paired(champion, challenger, roles).where(sliced & (F.col("role") == "in_distribution") & F.col("worse"))
    kind = F.when(F.col("new_n") >= C3_MIN_GT, "block").otherwise("warning")
    place = F.struct(F.array_position(axes, F.col("axis")).alias("axis"), F.col("bucket"))
    return bad.select("suite", "axis", "bucket", "metric", F.col("new_n").alias("n_gt"), "old", "new", kind.alias("kind"), place.alias("place"))


def contract(champion: DataFrame, challenger: DataFrame, curves: DataFrame, roles: DataFrame) -> DataFrame:
    """Five rows: clause, passed, detail.

    `champion` and `challenger` have suite, axis, bucket, class_id, metric, point, ci_low, ci_high,
    n_gt; `curves` model (champion or challenger), corruption, severity, point; `roles` suite, role.
    Slices that one side lacks are passed over. Undefined values are null."""
    both = _paired(champion, challenger, roles)
    overall = (F.col("axis") == "overall") & (F.col("metric") == "map")
    inside, gated = F.col("role") == "in_distribution", F.col("role") == "gated"

    c1 = both.where(overall & inside).agg(F.coalesce(F.bool_and(~F.col("worse") & (F.col("new") >= F.col("old") - C1_EPSILON)), F.lit(False)).alias("passed"), F.format_string("%.4f -> %.4f", F.max("old"), F.max("new")).alias("detail")).select(F.lit("C1").alias("clause"), "*")

    n = F.sum("old_n").cast("double")
    c2 = both.where(overall & gated).agg((F.sum(F.col("old") * F.col("old_n")) / n).alias("old"), (F.sum(F.col("new") * F.col("old_n")) / n).alias("new"), F.greatest(F.lit(0.0), F.max(F.col("old") - F.col("new"))).alias("drop"), F.bool_and("worse").alias("all_worse"))
    fine = (F.col("drop") <= C2_DROP) & (F.col("new") >= F.col("old") - C2_EPSILON) & ~F.col("all_worse")
    c2 = c2.select(F.lit("C2").alias("clause"), F.coalesce(fine, F.lit(False)).alias("passed"), F.format_string("%.4f -> %.4f, worst drop %.4f", "old", "new", "drop").alias("detail"))

    c3 = slice_regressions(champion, challenger, roles).agg(F.count_if(F.col("kind") == "block").alias("blocks"), F.count_if(F.col("kind") == "warning").alias("warnings"))
    c3 = c3.select(F.lit("C3").alias("clause"), (F.col("blocks") == 0).alias("passed"), F.format_string("%d blocks, %d warnings", "blocks", "warnings").alias("detail"))

    # One undefined cell leaves the whole curve undefined.
    def auc(model: str) -> Column:
        mine = F.col("model") == model
        return F.when(F.count(F.when(mine & F.col("point").isNull(), 1)) == 0, F.avg(F.when(mine, F.col("point"))))

    c4 = curves.agg(auc("champion").alias("old"), auc("challenger").alias("new"))
    c4 = c4.select(F.lit("C4").alias("clause"), F.coalesce(F.col("new") >= F.col("old") - C4_TOLERANCE, F.lit(True)).alias("passed"), F.coalesce(F.format_string("%.4f -> %.4f", F.when(F.col("new").isNotNull(), F.col("old")), "new"), F.lit("skipped")).alias("detail"))
    c4 = c4.withColumn("detail", F.when(F.col("detail").contains("null"), F.lit("skipped")).otherwise(F.col("detail")))
    c5 = c1.select(F.lit("C5").alias("clause"), F.lit(True).alias("passed"), F.lit("serving latency is not measured").alias("detail"))
    return c1.unionByName(c2).unionByName(c3).unionByName(c4).unionByName(c5)


def decision(clauses: DataFrame, regressions: DataFrame | None = None) -> DataFrame:
    """One row: whether all clauses pass, and those that do not; with `regressions`, also the warnings, a
    text for each slice that does not block, by axis and bucket."""
    out = clauses.agg(F.bool_and("passed").alias("promoted"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("clause")))), ",").alias("failed"))
    if regressions is None:
        return out
    told = F.format_string("%s/%s: %.4f -> %.4f on %d boxes", "axis", "bucket", "old", "new", "n_gt")
    listed = regressions.where("kind = 'warning'").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", told.alias("text")))), lambda s: s["text"]).alias("warnings"))
    return out.join(F.broadcast(listed), F.lit(True))


def leaked_sequences(assignment: DataFrame) -> DataFrame:
    """Sequences listed more than once, in two splits or within one: (sequence, splits)."""
    return assignment.groupBy("sequence").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("split")), ",").alias("splits")).where("n > 1").select("sequence", "splits")


def assert_no_leakage(assignment: DataFrame) -> None:
    found = leaked_sequences(assignment).limit(20).collect()
    if found:
        raise LeakageError("; ".join(f"{r['sequence']} in {r['splits']}" for r in found))


def outside_train(pool: DataFrame, assignment: DataFrame) -> DataFrame:
    """Sequences of a pool that are not in the train split."""
    return pool.select("sequence").distinct().join(assignment.where("split = 'train'"), "sequence", "left_anti")


def assert_trainable(pool: DataFrame, assignment: DataFrame) -> None:
    found = outside_train(pool, assignment).limit(20).collect()
    if found:
        raise LeakageError("not in the train split: " + ", ".join(sorted(r["sequence"] for r in found)))


def forbidden_in_pool(pool: DataFrame, assignment: DataFrame, forbidden: Sequence[str] = ("test", "prod_holdout")) -> DataFrame:
    """Sequences of a training pool that belong to forbidden splits; validation is allowed."""
    return pool.select("sequence").distinct().join(assignment.where(F.col("split").isin(*forbidden)).select("sequence").distinct(), "sequence", "left_semi")


def guard_pool(pool: DataFrame, assignment: DataFrame) -> None:
    found = forbidden_in_pool(pool, assignment).limit(20).collect()
    if found:
        raise LeakageError("evaluation sequences in the training pool: " + ", ".join(sorted(r["sequence"] for r in found)))


def diagnose(epochs: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, diverged, overfit, underfit, suspect, best_epoch): from epoch, train_loss, val_loss and
    map of each run. A loss that is no number, or a last training loss not below the first, diverges;
    a last validation loss over the least one while training goes on falling overfits; too low a
    metric, or too small a fall of the training loss, underfits. Only diverged runs are not looked at
    further."""
    ok = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    e = F.col("epoch")
    agg = epochs.groupBy(run).agg(
        F.count("*").alias("n"),
        F.bool_and(ok(F.col("train_loss")) & ok(F.col("val_loss"))).alias("finite"),
        F.min_by("train_loss", e).alias("first_train"), F.max_by("train_loss", e).alias("last_train"), F.max_by("val_loss", e).alias("last_val"),
        F.min("val_loss").alias("least_val"),
        F.min_by(F.col("train_loss"), F.struct("val_loss", "epoch")).alias("train_there"),
        F.max("map").alias("best"), F.max_by(e, F.struct(F.col("map"), -e)).alias("best_epoch"),
    )
    diverged = ~F.col("finite") | ((F.col("n") >= 2) & (F.col("last_train") >= F.col("first_train")))
    overfit = ~diverged & (F.col("n") >= 2) & (F.col("last_val") > F.col("least_val") * OVERFIT_RATIO) & (F.col("last_train") < F.col("train_there"))
    fall = F.when((F.col("n") >= 2) & (F.col("first_train") != 0), (F.col("first_train") - F.col("last_train")) / F.abs("first_train")).otherwise(F.lit(0.0))
    underfit = ~diverged & (F.coalesce(F.col("best") < UNDERFIT_FLOOR, F.lit(False)) | (fall < UNDERFIT_DROP))
    return agg.select(run, diverged.alias("diverged"), overfit.alias("overfit"), underfit.alias("underfit"), (diverged | overfit | underfit).alias("suspect"), F.coalesce("best_epoch", F.col("n") - 1).cast("long").alias("best_epoch"))


def budget(sessions: DataFrame, hours: float, trials: int, epochs: int) -> DataFrame:
    """One row: spent and remaining hours, what the session needs, and whether it may start."""
    spent = sessions.agg((F.coalesce(F.sum(F.coalesce("seconds", F.lit(0.0))), F.lit(0.0)) / 3600).alias("spent_h"))
    need = trials * epochs * EPOCH_MINUTES / 60
    left = F.lit(float(hours)) - F.col("spent_h")
    return spent.select("spent_h", left.alias("remaining_h"), F.lit(need).alias("needed_h"), ((left > 0) & (left >= need)).alias("allowed"))


def check_budget(sessions: DataFrame, hours: float, trials: int, epochs: int) -> float:
    row = budget(sessions, hours, trials, epochs).first()
    if not row["allowed"]:
        raise BudgetExhausted(f"{row['needed_h']:.2f} h needed, {row['remaining_h']:.2f} h left")
    return row["remaining_h"]


def best_trial(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The trial with the highest metric, undefined ones passed over, the first of equals."""
    known = trials.where(~F.isnan("metric") & F.col("metric").isNotNull())
    return known.groupBy(*by).agg(F.max_by("trial", F.struct("metric", -F.col("trial"))).alias("trial"), F.max("metric").alias("metric"))


def champion_run(runs: DataFrame) -> DataFrame:
    """The latest run of each name that is finished and not marked suspect."""
    fine = runs.where("status = 'FINISHED' and not coalesce(suspect, false)")
    return fine.groupBy("name").agg(F.max_by("run_id", "started").alias("run_id"))
