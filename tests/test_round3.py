"""One-pass encoding, balanced grouped folds, bounded search, staged training and chunked flows on edge rows."""

from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.encode import apply_dictionary, fit_dictionary
from riskloom.operators.folds import balanced_grouped_folds, water_level
from riskloom.operators.metrics import rank_score
from riskloom.operators.profile import profile, tenure
from riskloom.operators.skew import spread_join
from riskloom.plans import ensemble
from riskloom.plans.learn import StagedPerceptron, cross_validate, early_stopping_stages

# --- profiles ----------------------------------------------------------------------------


def test_profile_of_many_types_equals_its_parts(spark):
    rows = [
        (1, 1, 1.5, 7, Decimal("12345678901234567.25"), "x", 1), (1, 2, None, None, None, None, None), (1, 3, 0.5, 9, Decimal("0.25"), "x", 2),
        (2, 1, None, None, None, None, None), (3, 1, float("inf"), -(2**62), Decimal("-1.00"), "y", 3), (None, 1, 1.0, 1, None, "z", 4),
    ]
    df = spark.createDataFrame(rows, "k int, t int, d double, n long, c decimal(20,2), s string, m int")
    whole = profile(df, "k", ["t"], ["d", "n", "c"], ["s", "m"], time="t", markers=["m", "s"])
    found = {r.k: r.asDict() for r in whole.collect()}
    assert set(found) == {1, 2, 3}
    for c in ("d", "n", "c"):  # the wide aggregate of one column as the other side
        for r in profile(df, "k", ["t"], [c], layout="wide").collect():
            assert all(found[r.k][name] == r[name] for name in r.asDict()), c
    assert found[1]["s_count"] == 2 and found[1]["s_nunique"] == 1 and found[1]["m_first"] == "1" and found[1]["m_last"] == "2"
    assert found[2]["s_count"] == 0 and found[2]["s_first"] is None and found[2]["LT"] == 0.5
    want = {r.k: (r.LT, r.t) for r in tenure(df, "k", "t", ["m", "s"]).collect()}
    assert {k: (r["LT"], r["t"]) for k, r in found.items()} == want
    assert profile(df.where("false"), "k", ["t"], ["d"], ["s"], time="t", markers=["m"]).collect() == []


def test_gaps_of_one_window_equal_those_of_slices(spark, low_floor):
    rows = [(7 if i % 2 else i, f"2024-01-{1 + i % 28:02d} 0{i % 10}:00:00", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t string, i int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    sliced = profile(df, "k", ["t", "i"], [], ["i"], gap="gap")
    plain = profile(df, "k", ["t", "i"], [], ["i"], gap="gap", min_rows=10**9)
    names = ["k", "gap_first", "gap_last", "gap_min", "gap_max", "i_count"]
    assert sorted(map(tuple, sliced.select(*names).collect())) == sorted(map(tuple, plain.select(*names).collect()))


# --- encoding ----------------------------------------------------------------------------


def test_long_decimals_are_ordered_exactly(spark):
    values = [Decimal("9" * 30 + ".5"), Decimal("9" * 30 + ".25"), Decimal("-" + "9" * 30), Decimal("0.10"), None]
    df = spark.createDataFrame([(v,) for v in values], "c decimal(38,4)")
    codes = {r.value: r.code for r in fit_dictionary(df, ["c"]).collect()}
    line = sorted((v for v in values if v is not None))
    assert [codes[f"{v:.4f}"] for v in line] == [0, 1, 2, 3] and codes[None] == 4
    ranked = {r.value: r.code for r in fit_dictionary(df, ["c"], small=2).collect()}
    assert ranked == codes


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 100, 0])
@pytest.mark.parametrize("key", [None, "id"])
def test_every_way_of_encoding_gives_the_same_codes(spark, broadcast_bytes, key):
    rows = [(i, "hot" if i % 3 else f"v{i}", None if i % 7 == 0 else float(i % 5), float("nan") if i % 11 == 0 else i / 4, "=x") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b double, c double, _row string")
    columns = ["a", "b", "c"]
    dictionary = fit_dictionary(df, columns)
    codes = defaultdict(dict)
    for r in dictionary.collect():
        codes[r.feature][r.value] = r.code
    out = apply_dictionary(df, dictionary, columns, broadcast_bytes=broadcast_bytes, key=key)
    assert out.columns == df.columns
    text = lambda v: None if v is None or v != v else str(v)
    for r, (i, a, b, c, x) in zip(out.orderBy("id").collect(), rows, strict=True):
        assert (r.id, r.a, r.b, r.c, r._row) == (i, codes["a"][a], codes["b"][text(b)], codes["c"][text(c)], x)
    fresh = spark.createDataFrame([(1, "new", None, 1.0, "")], df.schema)
    coded = apply_dictionary(fresh, dictionary.where("value is not null"), columns, unseen=-7, broadcast_bytes=broadcast_bytes, key=key)
    assert tuple(coded.first())[1:3] == (-7, -7)
    with pytest.raises(Exception, match="not in the dictionary of a"):
        apply_dictionary(fresh, dictionary, columns, broadcast_bytes=broadcast_bytes, key=key).collect()


def test_codes_of_a_dictionary_need_not_be_consecutive(spark):
    dictionary = spark.createDataFrame([("a", "x", 50), ("a", "y", 7), ("a", None, 99)], "feature string, value string, code long")
    df = spark.createDataFrame([("x",), ("y",), (None,), ("z",)], "a string")
    assert [r.a for r in apply_dictionary(df, dictionary, ["a"], unseen=-1).collect()] == [50, 7, 99, -1]


def test_spread_join_keeps_rows_without_a_partner_on_request(spark):
    rows = spark.range(100).select((F.col("id") % 4).alias("k"), "id")
    lookup = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert spread_join(rows, lookup, ["k"], ["id"]).count() == 50
    left = spread_join(rows, lookup, ["k"], ["id"], "left")
    assert left.count() == 100 and left.where("v is null").count() == 50


# --- folds --------------------------------------------------------------------------------


def test_water_level():
    assert water_level([0, 0, 1000], 110) == 55 and water_level([0, 10], 5) == 5 and water_level([3, 3], 0) == 3


@pytest.mark.parametrize("large", [0, 4, 64])
def test_balanced_folds_bound_the_spread(spark, large):
    rng = np.random.default_rng(2)
    sizes = [1000, *rng.integers(1, 12, 120).tolist()]
    rows = [(f"g{g}", g % 2, i) for g, n in enumerate(sizes) for i in range(n)] + [(None, 1, 0)]
    df = spark.createDataFrame(rows, "g string, y int, i int")
    out = balanced_grouped_folds(df, "g", "y", 3, large=large).collect()
    assert len(out) == sum(sizes)
    folds, loads = defaultdict(set), defaultdict(lambda: [0, 0, 0])
    for r in out:
        folds[r.g].add(r.fold)
        loads[r.y][r.fold] += 1
    assert all(len(f) == 1 for f in folds.values())
    if large:
        # The group of a thousand has a fold of class 0 for itself; the others share the rest within the largest group.
        light = sorted(loads[0])[:2]
        assert max(loads[0]) == 1000 and light[1] - light[0] <= 24
        assert max(loads[1]) - min(loads[1]) <= 24


# --- search, blend, staged training ----------------------------------------------------------


def _members(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    rows = [(i, int(y), float(np.round(rng.random(), 2)), float(0.3 * y + 0.7 * rng.random())) for i, y in enumerate(label)]
    return spark.createDataFrame(rows, "id int, y int, a double, b double")


def _grid_by_rank(df, steps, top):
    copies = df.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = F.col("c") * F.lit(top) / F.lit(float(steps))
    mixed = copies.withColumn("m", (F.lit(1.0) - w) * F.col("a") + w * F.col("b"))
    return {r.c: r.rank_score for r in rank_score(mixed, "y", "m", "id", by=["c"]).collect()}


@pytest.mark.parametrize("top", [1.0, 0.001])
def test_grid_and_search_equal_the_general_rank(spark, top):
    df = _members(spark)
    want = _grid_by_rank(df, 20, top)
    got = {r.candidate: r.rank_score for r in ensemble.blend_grid(df, "y", "a", "b", "id", top, 20).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)
    best = ensemble.search_best(df, "y", "a", "b", "id", top, 20)
    assert best.candidate == min(want, key=lambda c: (-round(want[c], 12), c))


def test_bounds_hold(spark):
    df = _members(spark, seed=3)
    made = ensemble._candidates(df, "y", "a", "b", "id", 1.0, 10)
    low, high = made.bounds(made.totals(list(range(11))))
    want = _grid_by_rank(df, 10, 1.0)
    assert all(low[c] - 1e-9 <= want[c] <= high[c] + 1e-9 for c in want)


def test_search_with_missing_scores_ties_and_one_class(spark, low_floor):
    nan, inf = float("nan"), float("inf")
    odd = [(i, i % 2, [None, nan, inf, -inf, 0.5, 0.5][i % 6], 0.5) for i in range(300)]
    df = spark.createDataFrame(odd, "id int, y int, a double, b double")
    want = _grid_by_rank(df, 4, 1.0)
    got = {r.candidate: r.rank_score for r in ensemble.blend_grid(df, "y", "a", "b", "id", 1.0, 4).collect()}
    assert all(abs(got[c] - want[c]) < 1e-12 for c in want)
    ties = df.withColumns({"a": F.lit(0.5), "b": F.lit(0.5)})
    assert ensemble.search_best(ties, "y", "a", "b", "id", 1.0, 4).candidate == 0
    assert ensemble.search_best(df.where("y = 1"), "y", "a", "b", "id", 1.0, 4).rank_score is None
    assert [r.rank_score for r in ensemble.blend_grid(df.where("y = 1"), "y", "a", "b", "id", 1.0, 4).collect()] == [None] * 5


def test_moments_equal_numpy(spark):
    df = _members(spark, 90).withColumns({"c": F.col("a") * F.col("b"), "fold": (F.col("id") % 3).cast("int")})
    weights = np.array([[0.2, 0.5], [0.4, 0.1], [0.0, 0.0]])
    value, grad, hess = ensemble._blend_sums(df, ["a", "b", "c"], "y", weights)
    x = np.array([(r.fold, r.y, r.a, r.b, r.c) for r in df.collect()])
    for f in range(3):
        rows = x[x[:, 0] != f]
        y, d = rows[:, 1], rows[:, 2:4] - rows[:, 4:5]
        b = np.clip(rows[:, 4] + d @ weights[f], 1e-15, 1 - 1e-15)
        inner = (b > 1e-15) & (b < 1 - 1e-15)
        first = np.where(inner, (b - y) / (b * (1 - b)), 0)
        second = np.where(inner, y / b**2 + (1 - y) / (1 - b) ** 2, 0)
        np.testing.assert_allclose(value[f], -np.mean(y * np.log(b) + (1 - y) * np.log(1 - b)))
        np.testing.assert_allclose(grad[f], (first[:, None] * d).mean(axis=0))
        np.testing.assert_allclose(hess[f], np.einsum("n,ni,nj->ij", second, d, d) / len(d))


def test_staged_training_keeps_the_best_weights(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, int(a + b > 0.2 * rng.normal()), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double")
    bundle = cross_validate(df, ["a", "b"], "label", "id", lambda: early_stopping_stages(2, (4,), stage_rounds=3, stages=6), k=2)
    for model in bundle.models:
        losses = model.stages[-1].stage_losses
        assert 1 <= len(losses) <= 6 and len(losses) - 1 - losses.index(min(losses)) <= 2
        assert losses[-1] <= losses[0] or len(losses) < 6
    assert bundle.scores.where("measure = 'oof'").first().value > 0.3
    bundle.save(str(tmp_path))
    assert StagedPerceptron([2, 4, 2]).getLabelCol() == "label"
