"""Profiles and ordered differences on edge rows, and on hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.ordered import gap_days, last_difference
from riskloom.operators.ordering import FROM_END, SEQ, with_sequence
from riskloom.operators.profile import profile, tenure
from riskloom.operators.skew import SLICE, hot_groups, with_slices

NAN = float("nan")


def day(n: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        ("one", day(0), 1, 5.0, "a", 1.0),
        ("none", day(0), 2, None, None, 1.0),
        ("none", day(1), 3, None, None, 2.0),
        ("ends", day(0), 4, None, None, 1.0),
        ("ends", day(1), 5, 2.0, "b", 2.0),
        ("ends", day(2), 6, 4.0, "a", 3.0),
        ("ends", day(3), 7, None, None, 4.0),
        ("tie", day(0), 9, 9.0, "z", 1.0),
        ("tie", day(0), 8, 8.0, "y", 2.0),
        (None, day(0), 10, 1.0, "a", 1.0),
    ]
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, i long, x double, c string, preds double")


def by_key(df, key="k"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("layout", ["wide", "long"])
def test_profile_edges(edges, layout):
    got = by_key(profile(edges, "k", ["t", "i"], ["x", "preds"], ["c"], layout=layout))
    assert set(got) == {"one", "none", "ends", "tie"}
    assert (got["one"]["x_first"], got["one"]["x_std"], got["one"]["x_diff1"]) == (5.0, None, None)
    assert [got["none"][f"x_{s}"] for s in ("first", "mean", "min", "last", "diff1")] == [None] * 5
    assert [got["none"][f"c_{s}"] for s in ("count", "first", "last", "nunique")] == [0, None, None, 0]
    ends = got["ends"]
    assert (ends["x_first"], ends["x_last"], ends["x_mean"], ends["x_diff1"]) == (2.0, 4.0, 3.0, None)
    assert (ends["c_first"], ends["c_last"], ends["c_count"], ends["c_nunique"]) == ("b", "a", 2, 2)
    assert (got["tie"]["x_first"], got["tie"]["x_last"], got["tie"]["x_diff1"]) == (8.0, 9.0, 1.0)
    assert "preds_last" in ends and "preds_diff1" not in ends


def test_last_difference_edges(edges):
    got = by_key(last_difference(edges, "k", ["t", "i"], ["x", "preds"]))
    assert {k: v["x_diff1"] for k, v in got.items()} == {"one": None, "none": None, "ends": None, "tie": 1.0}
    assert got["ends"]["preds_diff1"] == 1.0


def test_gaps(spark):
    rows = [("a", "2024-01-01", 1), ("a", "2024-01-02 12:00:00", 2), ("a", "2024-01-02 12:00:00", 3), ("b", None, 4)]
    df = spark.createDataFrame(rows, "k string, t string, i long")
    got = {r.i: r.SDist for r in gap_days(df, "k", "t", ["i"]).collect()}
    assert got == {1: 30.53, 2: 1.5, 3: 0.0, 4: 30.53}


def test_tenure(spark):
    rows = [("new", day(0), None, 1.0), ("old", day(0), 1.0, 1.0), ("two", day(0), None, None), ("two", day(5), None, None)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, a double, b double")
    got = by_key(tenure(df, "k", "t", ["a", "b"]))
    assert {k: v["LT"] for k, v in got.items()} == {"new": 0.5, "old": 1.0, "two": 2.0}
    assert got["two"]["t"] == day(5)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of all rows, half of them on one day."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        k = "hot" if i % 3 == 0 else f"k{rng.randrange(200)}"
        when = day(50) if rng.random() < 0.5 else day(rng.randrange(100) / 4)
        rows.append((k, when, i, None if rng.random() < 0.1 else rng.random(), rng.choice(["p", "q", None])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, i long, x double, c string")


def test_hot_key_is_cut_into_balanced_slices(skewed):
    hot = hot_groups(skewed, "k", min_rows=100)
    assert set(hot.rows) == {"hot"}
    sliced, cut = with_slices(skewed, "k", [F.col("t"), F.col("i")], hot, min_rows=100)
    assert cut and sliced.count() == 3000
    sizes = {r[SLICE]: r["count"] for r in sliced.where("k = 'hot'").groupBy(SLICE).count().collect()}
    assert len(sizes) >= 3 and max(sizes.values()) < 600 and sizes[0] >= 2
    assert sliced.where("k <> 'hot'").agg(F.max(SLICE)).first()[0] == 0


def test_sequence_follows_the_order_across_slices(skewed):
    rows = with_sequence(skewed, "k", ["t", "i"], min_rows=100).where("k = 'hot'").collect()
    ordered = sorted(rows, key=lambda r: (r.t, r.i))
    seqs = [r[SEQ] for r in ordered]
    assert seqs == sorted(seqs) and len(set(seqs)) == len(seqs)
    assert [r[FROM_END] for r in ordered[-2:]] == [2, 1]
    assert sum(r[FROM_END] == 1 for r in rows) == 1


@pytest.mark.parametrize("layout", ["wide", "long"])
def test_profile_does_not_depend_on_skew_handling_or_input_order(skewed, layout):
    def normal(df):
        return {r.k: tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()}

    names = ["k", "x_first", "x_mean", "x_std", "x_last", "x_diff1", "c_count", "c_first", "c_last", "c_nunique"]
    plain = normal(profile(skewed, "k", ["t", "i"], ["x"], ["c"], layout="wide").select(names))
    cut = normal(profile(skewed, "k", ["t", "i"], ["x"], ["c"], layout=layout, min_rows=100).select(names))
    moved = skewed.repartition(13, "i")
    again = normal(profile(moved, "k", ["t", "i"], ["x"], ["c"], layout=layout, min_rows=100).select(names))
    assert plain == cut == again


def test_hot_key_is_found_in_a_small_sample(skewed, sparse_sample):
    hot = hot_groups(skewed, "k")
    assert set(hot.rows) == {"hot"} and hot.total == 3000
    plain = {r.i: r.SDist for r in gap_days(skewed, "k", "t", ["i"], min_rows=10**9).collect()}
    assert {r.i: r.SDist for r in gap_days(skewed, "k", "t", ["i"], hot=hot).collect()} == plain


def test_gaps_cross_slices(skewed):
    plain = {r.i: r.SDist for r in gap_days(skewed, "k", "t", ["i"]).collect()}
    cut = {r.i: r.SDist for r in gap_days(skewed, "k", "t", ["i"], min_rows=100).collect()}
    assert plain == cut and len(cut) == 3000
