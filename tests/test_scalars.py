import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions.arith import ieee_divide, round_half_even
from riskloom.functions.columns import bases_with, common_names, edge_float_columns, project
from riskloom.functions.missing import fill_sentinel, normalise_missing, null_counts
from riskloom.operators.casting import downcast_by_range, downcast_fixed, downcast_floats
from riskloom.operators.derive import last_mean_rate, pair_features, ratio_features, round_features

INF, NAN = math.inf, math.nan


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (-0.125,), (1.005,), (0.375,)], "x double")
    got = [r[0] for r in df.select(round_half_even(F.col("x"), 2)).collect()]
    assert got == [0.12, 2.68, -0.12, 1.0, 0.38]


@pytest.mark.parametrize(
    "n, d, want",
    [(1.0, 0.0, INF), (-1.0, 0.0, -INF), (1.0, -0.0, -INF), (0.0, 0.0, NAN), (None, 0.0, None), (1.0, None, None),
     (None, None, None), (NAN, 0.0, NAN), (NAN, 2.0, NAN), (3.0, 2.0, 1.5)],
)
def test_division_is_ieee(spark, n, d, want):
    row = spark.createDataFrame([(n, d)], "n double, d double")
    ieee, null = row.select(
        ieee_divide(F.col("n"), F.col("d")), ieee_divide(F.col("n"), F.col("d"), on_zero="null")
    ).first()
    if want is None:
        assert ieee is None
    elif math.isnan(want):
        assert math.isnan(ieee)
    else:
        assert ieee == want
    if d == 0.0:
        assert null is None


def test_missing_values(spark):
    df = spark.createDataFrame([(1, NAN), (2, None), (3, INF), (4, -INF), (5, 2.5)], "id int, x double")
    assert [r.x for r in normalise_missing(df).orderBy("id").collect()] == [None, None, INF, -INF, 2.5]
    filled = df.select("id", fill_sentinel(F.col("x")).alias("x")).orderBy("id")
    assert [r.x for r in filled.collect()] == [-127.0, -127.0, -127.0, -127.0, 2.5]
    assert null_counts(df).first().asDict() == {"id": 0, "x": 2, "total": 2}


def test_columns_are_chosen_by_name_and_type(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0, "a", "b", 4, 0.5)],
        "P_last double, P_mean double, Q_last double, D_last string, D_first string, N_last int, P_last_round2 double",
    )
    assert bases_with(df, "mean") == ["P"]
    assert bases_with(df, "first") == []
    assert edge_float_columns(df) == ["P_last", "Q_last", "P_last_round2"]
    assert project(df, keep=["Q_last", "nope", "P_last"], drop=["P_last"], missing="skip").columns == ["Q_last"]
    with pytest.raises(ValueError, match="nope"):
        project(df, keep=["Q_last", "nope"])
    assert common_names(["c", "a", "b"], ["a", "c"]) == ["c", "a"]
    assert last_mean_rate(df).first().P_last_mean_rate == 0.5
    assert "N_last_round2" not in round_features(df).columns


def test_ratios_and_pairs_need_their_inputs(spark):
    df = spark.createDataFrame([(2.0, -0.0001, 3.0, 0.5)], "D_39_last double, P_4_last double, B_9 double, P_2 double")
    made = ratio_features(df)
    assert [c for c in made.columns if c.startswith("c_")] == ["c_PD_439"]
    assert made.first().c_PD_439 == INF
    pairs = pair_features(df, ["B_9", "B_11"], ["P_2", "P_3"]).first().asDict()
    assert (pairs["B_9-P_2"], pairs["B_9XP_2"]) == (2.5, 1.5)
    assert "B_9-P_3" not in pairs


def test_downcasts_need_strict_containment(spark):
    df = spark.createDataFrame(
        [(126, 127, -128, 2**31 - 2, 1.0, 1e300, None), (0, 0, 0, 0, 70000.0, 0.0, None)],
        "a int, b int, c int, d long, e double, f double, g double",
    )
    kinds = dict(downcast_by_range(df).dtypes)
    assert kinds == {"a": "tinyint", "b": "smallint", "c": "smallint", "d": "int", "e": "float", "f": "double", "g": "double"}
    assert dict(downcast_fixed(df, skip=["d"]).dtypes) | {} == {
        "a": "int", "b": "int", "c": "int", "d": "bigint", "e": "float", "f": "float", "g": "float",
    }
    assert dict(downcast_floats(df).dtypes)["f"] == "float"
