"""Work that is done once, and tasks that stay of one size as the table grows."""

import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics
from riskloom.operators.encode import apply_dictionary, fit_dictionary
from riskloom.operators.profile import profile
from riskloom.plans import ensemble, learn


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [False, True])
def test_cells_of_large_dictionaries_are_exchanged_once(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr("riskloom.operators.skew.MIN_HOT_ROWS", 40)
    rows = [(i, None if i % 5 == 0 else "x", i % 90, float(i) / 4) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a string, b int, c float")
    dictionary = fit_dictionary(df, ["a", "b", "c"], small=1)
    # Ranked once, however often it is read.
    assert "Window" not in plan(dictionary)
    made = apply_dictionary(df, dictionary, ["a", "b", "c"], broadcast_bytes=0, key="id")
    text = plan(made)
    assert len(re.findall(r"Exchange hashpartitioning\((feature|_cell)", text)) <= 2
    assert ("_deal" in text) == hot
    got = {r.id: (r.a, r.b, r.c) for r in made.collect()}
    assert got == {i: (0 if a else 1, b, i) for i, a, b, c in rows}


def test_a_fit_ranks_its_scores_once(spark, monkeypatch):
    calls = []
    for module, name in ((ensemble, "ranked_by_score"), (metrics, "ranked_by_score")):
        real = metrics.ranked_by_score
        monkeypatch.setattr(module, name, lambda *a, real=real, **k: calls.append(1) or real(*a, **k), raising=False)
    df = spark.range(400).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), ((F.col("id") * 37 % 101) / 101 + (F.col("id") % 3 == 0).cast("int")).alias("m"))
    made = ensemble.stack_until_settled(df, df.drop("label"), ["m"], "label", "id", k=2, rounds=2, depth=2)
    # A rank for each fit, and two for the scores of the settled bundle.
    assert len(calls) <= len(made.losses) + 2
    assert {r.measure for r in made.bundle.scores.collect()} == {"fold", "cv_mean", "cv_std", "oof"}
    bundle = learn.cross_validate(df, ["m"], "label", "id", lambda: [learn.boosted_trees(2, 2)], 2, scored=False)
    assert bundle.scores is None


def test_a_profile_has_tasks_by_its_cells(spark, monkeypatch):
    monkeypatch.setattr("riskloom.operators.profile.CELLS_PER_TASK", 100, raising=False)
    df = spark.range(600).select((F.col("id") % 200).alias("k"), "id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("s"))
    made = profile(df, "k", ["id"], ["x"], ["s"])
    # 1,200 cells by 100; the exchange is the one that the window needs.
    assert re.findall(r"Exchange hashpartitioning\(k#\d+L, (\d+)\)", plan(made)) == ["12"]
    assert made.count() == 200
