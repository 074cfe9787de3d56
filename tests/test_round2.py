"""Fits that converge or raise, layouts that agree, window groups that stay small, exact dictionary codes."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from riskloom.operators import ordering
from riskloom.operators.encode import apply_dictionary, fit_dictionary, load_dictionary, save_dictionary
from riskloom.operators.ordering import descending, with_sequence
from riskloom.operators.profile import numeric_profile
from riskloom.plans.ensemble import fit_blend
from riskloom.plans.features import statement_profiles
from riskloom.plans.learn import average_folds, boosted_trees, cross_validate


def blend_rows(spark, extra=()):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    a = np.clip(0.5 + (y - 0.5) * 0.5 + rng.normal(0, 0.15, 400), 0.02, 0.98)
    b = np.clip(0.5 + (y - 0.5) * 0.1 + rng.normal(0, 0.15, 400), 0.02, 0.98)
    rows = [(i, int(y[i]), float(a[i]), float(b[i])) for i in range(400)] + list(extra)
    return spark.createDataFrame(rows, "id long, label int, a double, b double")


def clipped_loss(rows, w):
    y = np.array([r.label for r in rows])
    p = np.clip([w * r.a + (1 - w) * r.b for r in rows], 1e-15, 1 - 1e-15)
    return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))


@pytest.mark.parametrize("extra", [(), ((400, 0, 0.0, 0.0),), ((400, 1, 1.0, 1.0), (401, 0, 0.0, 0.0))])
def test_blend_reaches_a_minimum(spark, extra):
    df = blend_rows(spark, extra)
    fit = fit_blend(df, ["a", "b"], "label", "id", k=2)
    rows = sorted(df.collect(), key=lambda r: r.id)
    half = -(-len(rows) // 2)
    for f, training in enumerate((rows[half:], rows[:half])):
        w = fit.fold_weights[f][0]
        at = clipped_loss(training, w)
        assert at <= clipped_loss(training, 0.5)
        assert at <= min(clipped_loss(training, w - 1e-4), clipped_loss(training, w + 1e-4)) + 1e-12
        assert abs(w - 0.5) > 1e-3


def test_blend_raises_without_convergence(spark):
    with pytest.raises(RuntimeError, match="did not converge"):
        fit_blend(blend_rows(spark), ["a", "b"], "label", "id", k=2, max_passes=2)


def test_layouts_agree_in_types_and_values(spark):
    rows = [(1, 1, 9007199254740990, 1, 0.5, 2.0), (1, 2, 9007199254740993, None, None, 1.0), (2, 1, -5, 7, 1.5, None)]
    df = spark.createDataFrame(rows, "k long, t int, big long, small int, x double, f double")
    df = df.withColumn("f", F.col("f").cast("float")).withColumn("d", F.col("small").cast("decimal(20,2)"))
    columns = ["big", "small", "x", "f", "d"]
    made = [numeric_profile(with_sequence(df, "k", ["t"]), "k", columns, columns, layout=x) for x in ("wide", "long")]
    assert made[0].dtypes == made[1].dtypes
    assert sorted(made[0].collect()) == sorted(made[1].collect())
    one = made[1].where("k = 1").first()
    assert (one.big_last, one.big_diff1, made[1].schema["big_last"].dataType.simpleString()) == (9007199254740993, 3, "bigint")


def test_text_times_are_parsed_once(spark):
    rows = [("c", f"2024-1-{d}", x, i) for i, (d, x) in enumerate([(9, 1.0), (10, 2.0), (11, 5.0)])]
    df = spark.createDataFrame(rows, "k string, day string, x double, i long")
    r = statement_profiles(df, "k", "day", ["i"], ["x"], [], markers=["x"], with_gaps=True, float32=False).first()
    assert (r.x_last, r.x_diff1, r.SDist_last, r.LT, str(r.day)) == (5.0, 3.0, 1.0, 3.0, "2024-01-11 00:00:00")


@pytest.mark.parametrize("value", ["null", "double('inf')", "double('-inf')", "double('nan')", "0.5D"])
def test_no_window_group_is_large(spark, value):
    n, floor = 60_000, 1_500
    df = spark.range(n).selectExpr("id", f"case when id % 5 < 3 then {value} else id / {n} end as score").repartition(8)
    placed, cut = ordering._by_quantiles(df, [descending("score"), F.col("id")], floor)
    groups = placed.groupBy(ordering.BUCKET, ordering.SLICE).count() if cut else placed.groupBy(ordering.BUCKET).count()
    assert cut and groups.agg(F.max("count")).first()[0] <= 2 * max(floor, n // 8)
    ranked = ordering.ranked(df, [descending("score"), F.col("id")], min_rows=floor)
    exact = df.withColumn("want", F.row_number().over(Window.orderBy(descending("score"), "id")))
    assert ranked.join(exact.select("id", "want"), "id").where("rank != want").count() == 0


def test_dictionary_orders_large_integers_and_survives_saving(spark, tmp_path):
    values = [-9007199254740992, -9007199254740993, 10000000000000000, 9999999999999999, 7, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    dictionary = fit_dictionary(df, ["v"])
    codes = {r.value: r.code for r in dictionary.collect()}
    order = [str(v) for v in sorted(v for v in values if v is not None)] + [None]
    assert codes == {v: i for i, v in enumerate(order)}
    assert {r.value: r.code for r in fit_dictionary(df, ["v"], small=2).collect()} == codes
    save_dictionary(dictionary, str(tmp_path / "d"))
    loaded = load_dictionary(spark, str(tmp_path / "d"))
    more = df.union(spark.createDataFrame([(8,)], "v long"))
    got = [r.v for r in apply_dictionary(more, loaded, ["v"], unseen=-1).collect()]
    assert sorted(got) == [-1, 0, 1, 2, 3, 4, 5]


def test_categories_split_by_value_and_the_metric_is_a_choice(spark):
    # Codes 1, 3 and 5 are positive: no single cut of an ordered code separates them.
    rows = [(i, i % 6 if i % 11 else None, i % 2 if i % 11 else 1) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, code int, label int")

    def hits(df, label, score, id, by):
        right = F.avg(((F.col(score) >= 0.5) == (F.col(label) == 1)).cast("double"))
        return df.groupBy(*by).agg(right.alias("hits"))

    trees = lambda: [boosted_trees(rounds=2, depth=1, bins=8, row_share=0.9, leaf_rows=5)]
    options = dict(k=2, metric=hits, measure="hits")
    nominal = cross_validate(df, ["code"], "label", "id", trees, nominal={"code": 6}, **options)
    ordered = cross_validate(df, ["code"], "label", "id", trees, **options)
    value = {name: {r.measure: r.value for r in b.scores.collect()}["oof"] for name, b in (("n", nominal), ("o", ordered))}
    assert value["n"] == 1.0 and value["o"] < 0.9
    again = average_folds(nominal.models, df, ["code"], {"code": 6})
    assert again.where("(prediction >= 0.5) != (label = 1)").count() == 0
