"""Training, scoring, ensembles and importance on data with a known signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.plans.ensemble import apply_blend, blend_grid, blend_objective, fit_blend, mix_and_search, score_matrix, search_blend
from riskloom.plans.learn import ModelBundle, average_folds, boosted_trees, cross_validate, statement_meta_feature
from riskloom.operators.folds import contiguous_folds
from riskloom.plans.selection import permutation_importance, permute_column, select_features, selected_names, with_mixing_buckets
from riskloom.session import materialize


def trees():
    return [boosted_trees(rounds=3, depth=2)]


@pytest.fixture(scope="module")
def signal(spark):
    """``good`` decides the label, ``noise`` does not; some values are missing."""
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0
    df = spark.range(600).select("id", (F.col("id") % 60).alias("g"), unit(1).alias("good"), unit(2).alias("noise"))
    df = df.withColumn("label", ((F.col("good") + 0.2 * unit(3)) > 0.7).cast("int"))
    return df.withColumn("noise", F.when(F.col("id") % 9 != 0, F.col("noise"))).coalesce(2)


@pytest.fixture(scope="module")
def bundle(signal):
    return cross_validate(signal, ["good", "noise"], "label", "id", trees, k=3)


def test_every_row_is_predicted_once_and_the_signal_is_found(signal, bundle):
    rows = bundle.oof.collect()
    assert sorted(r.id for r in rows) == list(range(600))
    assert len(bundle.models) == 3
    scores = {(r.measure, r.fold): r.value for r in bundle.scores.collect()}
    assert len(scores) == 6 and scores["oof", None] > 0.6
    folds = [scores["fold", f] for f in range(3)]
    assert scores["cv_mean", None] == pytest.approx(np.mean(folds))
    assert scores["cv_std", None] == pytest.approx(np.std(folds))


def test_saved_bundle_predicts_the_same(spark, signal, bundle, tmp_path):
    bundle.save(f"{tmp_path}/bundle")
    loaded = ModelBundle.load(spark, f"{tmp_path}/bundle")
    before = {r.id: r.prediction for r in average_folds(bundle.models, signal, ["good", "noise"]).collect()}
    scored = average_folds(loaded.models, signal, ["good", "noise"])
    assert scored.columns == [*signal.columns, "prediction"]
    after = {r.id: r.prediction for r in scored.collect()}
    assert before == pytest.approx(after)
    assert scored.where("noise IS NULL").count() == signal.where("noise IS NULL").count() > 0
    assert sorted(map(tuple, loaded.scores.collect()), key=repr) == sorted(map(tuple, bundle.scores.collect()), key=repr)


def test_statement_predictions_keep_groups_apart(signal):
    labels = signal.groupBy("g").agg((F.avg("good") > 0.5).cast("int").alias("target"))
    rows = signal.drop("label")
    made = lambda: [boosted_trees(rounds=2, depth=2, label="target")]
    statements, bundle = statement_meta_feature(rows, labels, "g", "id", "target", ["good", "noise"], made, k=3)
    assert statements.count() == 600 and statements.where("preds IS NULL").count() == 0
    folds = bundle.oof.join(rows.select("id", "g"), "id").groupBy("g").agg(F.count_distinct("fold").alias("n"))
    assert folds.where("n > 1").count() == 0


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(500) < 0.4).astype(int)
    member = lambda s: np.clip(0.4 + 0.25 * (y - 0.4) + s * rng.normal(size=500), 0.02, 0.98)
    rows = list(zip(range(500), y.tolist(), member(0.1).tolist(), member(0.15).tolist(), member(0.3).tolist(), strict=True))
    return spark.createDataFrame(rows, "id long, label int, m1 double, m2 double, m3 double").coalesce(2)


def test_fitted_blend_is_a_minimum(scores):
    fit = fit_blend(scores, ["m1", "m2", "m3"], "label", "id", k=3)
    assert fit.weights.sum() == pytest.approx(1.0)
    assert fit.weights[:2] == pytest.approx(fit.fold_weights.mean(axis=0))
    placed = contiguous_folds(scores, "id", 3)

    def loss(fold, w):
        weights = {"m1": w[0], "m2": w[1], "m3": 1 - w[0] - w[1]}
        return {r.fold: r.log_loss for r in blend_objective(placed, "label", weights, 3).collect()}[fold]

    best = fit.fold_weights[0]
    value = loss(0, best)
    for step in ([0.02, 0], [-0.02, 0], [0, 0.02], [0, -0.02]):
        assert loss(0, best + step) > value


def test_search_takes_the_best_candidate(scores):
    grid = blend_grid(scores, "label", "m1", "m2", "id", max_weight=1.0, steps=10).collect()
    assert len(grid) == 11
    top = max(r.rank_score for r in grid)
    want = min(r.weight for r in grid if r.rank_score == top)
    assert search_blend(scores, "label", "m1", "m2", "id", max_weight=1.0, steps=10) == pytest.approx(want)


def test_blends_apply_to_new_rows(scores):
    test = scores.drop("label")
    weight, oof, blended = mix_and_search(scores, test, "label", "id", "m1", "m2", "m3", mix_weight=0.25, max_weight=1.0, steps=4)
    assert weight in (0.0, 0.25, 0.5, 0.75, 1.0)
    members = {r.id: (r.m1, r.m2, r.m3) for r in test.collect()}
    got, again = ({r.id: r.prediction for r in d.collect()} for d in (blended, oof))
    want = {i: (1 - weight) * (0.75 * a + 0.25 * b) + weight * c for i, (a, b, c) in members.items()}
    assert got == pytest.approx(want) and again == pytest.approx(want)
    plain = {r.id: r.prediction for r in apply_blend(test, "id", ["m1", "m2", "m3"], [0.5, 0.3, 0.2]).collect()}
    assert plain == pytest.approx({i: 0.5 * a + 0.3 * b + 0.2 * c for i, (a, b, c) in members.items()})


def test_score_matrix_needs_every_model(spark):
    rows = [(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.3), (3, "b", 0.5), (3, "a", 0.4), (3, "other", 0.9)]
    long = spark.createDataFrame(rows, "id long, model string, p double")
    assert sorted(map(tuple, score_matrix(long, "id", "model", "p", ["a", "b"]).collect())) == [(1, 0.1, 0.2), (3, 0.4, 0.5)]


def test_permuting_keeps_the_values(signal):
    placed = with_mixing_buckets(materialize(signal), "id", 3)
    moved = permute_column(placed, "noise", "id", "s")
    before, after = [{r.id: r.noise for r in d.collect()} for d in (signal, moved)]
    assert sorted(before.values(), key=repr) == sorted(after.values(), key=repr)
    assert sum(before[i] != after[i] for i in before) > 500
    assert {r.id: r.good for r in moved.collect()} == {r.id: r.good for r in signal.collect()}


def test_shuffled_copies_share_one_exchange(signal):
    placed = with_mixing_buckets(materialize(signal), "id", 3)
    copies = permute_column(placed, "noise", "id", "a").unionByName(permute_column(placed, "good", "id", "b"))
    copies.write.format("noop").mode("overwrite").save()
    copies.collect()
    plan = copies._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1


def test_importance_finds_the_signal(signal):
    importance = permutation_importance(signal, ["good", "noise"], "label", "id", trees, repeats=2)
    weights = {r.feature: r.weight for r in importance.collect()}
    assert weights["good"] > 0.1 > abs(weights["noise"])


def test_selection(spark):
    importance = spark.createDataFrame([("a", 0.2), ("b", -0.1), ("c", 0.0), ("d", 0.3)], "feature string, weight double")
    assert selected_names(importance, ["c", "b"]) == (["d", "a", "c"], ["c"])
    assert select_features(importance, ["c"]).where("is_categorical").count() == 1
