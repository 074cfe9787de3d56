"""Rank, metrics and losses against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.metrics import (
    RankScoreEvaluator,
    confusion_counts,
    fold_summary,
    log_loss,
    rank_score,
    rank_weighted_gradients,
    rank_weighted_log_loss,
    ranked_by_score,
)
from riskloom.operators.ordering import descending, head_tail, ranked


def brute_force(rows):
    """(id, label, score) rows to (D, G), by walking the ordered rows."""

    def area(ordered):
        seen_w = seen_p = total = 0.0
        for _, y, _ in ordered:
            w = 1 if y else 20
            seen_w, seen_p = seen_w + w, seen_p + y
            total += (seen_p / all_p - seen_w / all_w) * w
        return total

    all_w = sum(1 if y else 20 for _, y, _ in rows)
    all_p = sum(y for _, y, _ in rows)
    by_score = sorted(rows, key=lambda r: (-r[2], r[0]))
    caught = running = 0
    for _, y, _ in by_score:
        running += 1 if y else 20
        caught += y if running <= math.floor(0.04 * all_w) else 0
    return caught / all_p, area(by_score) / area(sorted(rows, key=lambda r: -r[1]))


def rows_of(kind, n=400):
    rng = random.Random(kind)
    if kind == "ties":
        return [(i, int(rng.random() < 0.3), rng.randrange(4) / 4) for i in range(n)]
    if kind == "one value":
        return [(i, int(rng.random() < 0.3), 0.5) for i in range(n)]
    if kind == "perfect":
        return [(i, int(i < n // 4), 1.0 - i / n) for i in range(n)]
    if kind == "reversed":
        return [(i, int(i < n // 4), i / n) for i in range(n)]
    return [(i, int(rng.random() < 0.3), rng.gauss(0, 1)) for i in range(n)]


@pytest.mark.parametrize("kind", ["ties", "one value", "perfect", "reversed", "noise"])
def test_rank_score_equals_brute_force(spark, kind, low_floor):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, "id long, label int, score double").repartition(5)
    d, g = brute_force(rows)
    got = rank_score(df, "label", "score", "id").first()
    assert got.top_capture == pytest.approx(d, abs=1e-12)
    assert got.weighted_gini == pytest.approx(g, abs=1e-12)
    assert got.rank_score == pytest.approx((d + g) / 2, abs=1e-12)
    stretched = rank_score(df.withColumn("score", F.exp("score") * 3 - 1), "label", "score", "id").first()
    assert stretched.rank_score == pytest.approx(got.rank_score, abs=1e-12)


def test_split_points_from_few_rows_change_nothing(spark, sparse_sample):
    rows = rows_of("ties", 4000)
    df = spark.createDataFrame(rows, "id long, label int, score double")
    got = rank_score(df, "label", "score", "id").first()
    assert (got.top_capture, got.weighted_gini) == pytest.approx(brute_force(rows), abs=1e-12)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_has_no_score(spark, label):
    df = spark.createDataFrame([(i, label, i / 9) for i in range(9)], "id long, label int, score double")
    got = rank_score(df, "label", "score", "id").first()
    assert (got.top_capture, got.weighted_gini, got.rank_score) == (None, None, None)


def test_cut_is_inclusive(spark):
    # Weights: 40 positives and 3 negatives give 100, so the cut is at running weight 4.
    rows = [(i, int(i < 40), -float(i)) for i in range(43)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    assert ranked_by_score(df, "label", "score", "id").where("in_top").count() == 4


def test_scores_by_group(spark):
    parts = {g: rows_of(g, 150) for g in ("a", "b", "ties")}
    df = spark.createDataFrame([(g, *r) for g, rows in parts.items() for r in rows], "g string, id long, label int, score double")
    got = {r.g: (r.top_capture, r.weighted_gini) for r in rank_score(df, "label", "score", "id", by=["g"]).collect()}
    for g, rows in parts.items():
        assert got[g] == pytest.approx(brute_force(rows), abs=1e-12)


@pytest.mark.parametrize("kind", ["ties", "noise"])
def test_gradients_equal_brute_force(spark, kind):
    rows = rows_of(kind, 120)
    df = spark.createDataFrame(rows, "id long, label int, raw double")
    ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
    total = sum(1 if y else 20 for _, y, _ in rows)
    want, loss, running = {}, 0.0, 0
    for r, (i, y, raw) in enumerate(ordered):
        running += 1 if y else 20
        falling = 1 + math.exp(-5.0 * (1 - r / (len(rows) - 1)))
        w = falling if y and running > math.floor(0.04 * total) else 1.0
        p = 1 / (1 + math.exp(-raw))
        want[i] = (w, p * (1 + w * y - y) - w * y, p * (1 - p) * (1 + w * y - y))
        loss += -falling * y * math.log(p) - (1 - y) * math.log(1 - p)
    got = {r.id: (r.weight, r.grad, r.hess) for r in rank_weighted_gradients(df, "label", "raw", "id").collect()}
    assert got.keys() == want.keys()
    for i, values in want.items():
        assert got[i] == pytest.approx(values, abs=1e-12)
    value = rank_weighted_log_loss(df, "label", "raw", "id").first()[0]
    assert value == pytest.approx(loss / len(rows), abs=1e-12)


def test_one_row_has_gradients(spark):
    df = spark.createDataFrame([(1, 1, 0.0)], "id long, label int, raw double")
    assert rank_weighted_gradients(df, "label", "raw", "id").first().grad is not None


def test_rank_of_texts_and_missing_scores(spark, low_floor):
    rng = random.Random(1)
    rows = [(f"customer-{rng.randrange(10**6):09d}" if i % 3 else "customer-same", i) for i in range(600)]
    df = spark.createDataFrame(rows, "name string, id long")
    got = {(r.name, r.id): r["rank"] for r in ranked(df, [F.col("name"), F.col("id")]).collect()}
    assert [got[x] for x in sorted(rows)] == list(range(1, 601))
    gaps = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9)], "id long, score double")
    assert [r.id for r in ranked(gaps, [descending("score"), F.col("id")]).orderBy("rank").collect()] == [3, 1, 2]


def test_missing_group_keeps_its_rows(spark):
    rows = [(1, "a"), (2, None), (3, None), (4, ""), (5, "a")]
    df = spark.createDataFrame(rows, "id long, g string")
    got = {r.id: (r["rank"], r.n_rows) for r in ranked(df, [F.col("id")], by=["g"]).collect()}
    assert got == {1: (1, 2), 5: (2, 2), 2: (1, 2), 3: (2, 2), 4: (1, 1)}


def test_small_metrics(spark):
    df = spark.createDataFrame([(1, 0.8, 1), (0, 0.4, 0), (0, 1.0, 1)], "label int, p double, pred int")
    want = -(math.log(0.8) + math.log(0.6) + math.log(1e-15)) / 3
    assert log_loss(df, "label", "p").first()[0] == pytest.approx(want, rel=1e-2)
    counts = {r.label: (r.pred_0, r.pred_1) for r in confusion_counts(df, "label", "pred").collect()}
    assert counts == {0: (1, 1), 1: (0, 1)}
    scores = spark.createDataFrame([(0.2,), (0.4,)], "s double")
    assert fold_summary(scores, "s").first().cv_std == pytest.approx(0.1)
    parts = [(r.part, r.p) for r in head_tail(df, ["p"], 1).collect()]
    assert sorted(parts) == [("head", 0.4), ("tail", 1.0)]


def test_evaluator_prefers_larger(spark):
    df = spark.createDataFrame(rows_of("noise"), "id long, label int, score double")
    evaluator = RankScoreEvaluator(labelCol="label", predictionCol="score", idCol="id")
    assert evaluator.isLargerBetter()
    d, g = brute_force(rows_of("noise"))
    assert evaluator.evaluate(df) == pytest.approx((d + g) / 2)


def test_bounds_after_counts_like_a_filter(spark):
    from riskloom.operators.skew import bounds_after

    df = spark.range(-3, 60).withColumn("at", F.struct((F.col("id") / 2).alias("o0"), F.col("id").alias("o1")))
    bounds = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct((i * 1.0).alias("o0"), (i * 2).cast("long").alias("o1")))
    for size in (0, 1, 2, 20):
        held = df.withColumn("b", F.slice(bounds, 1, size)).withColumn("n", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("b")))
        for name in ("b", "n"):
            want = F.coalesce(F.when(F.col(name).isNotNull(), F.size(F.filter(name, lambda x: x > F.col("at")))), F.lit(0))
            assert held.where(bounds_after(name, F.col("at"), 20) != want).isEmpty()


def test_many_slices_cost_little_more_than_few(spark):
    import time

    from riskloom.operators.skew import bounds_after

    def seconds(slices):
        # Every row carries the same array; only the search differs.
        bounds = F.array(*[F.lit(i) for i in range(100)]) if slices == 100 else F.sequence(F.lit(0), F.lit(slices - 1))
        df = spark.range(0, 300_000, 1, 4).select((F.col("id") % slices).cast("int").alias("at"), bounds.alias("b"))
        best = []
        for _ in range(3):
            start = time.perf_counter()
            df.select(bounds_after("b", F.col("at"), slices).alias("s")).agg(F.sum("s")).collect()
            best.append(time.perf_counter() - start)
        return min(best)

    few, many = seconds(100), seconds(10_000)
    assert many <= 2 * few + 0.5
