"""Folds, chunks, encoders and files."""

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom.operators.encode import apply_dictionary, fit_dictionary
from riskloom.operators.folds import (
    assign_chunks,
    contiguous_folds,
    grouped_stratified_folds,
    holdout_split,
    repeated_stratified_folds,
    stratified_folds,
)
from riskloom.sources import files


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))


def spread(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def test_stratified_folds(labelled):
    rows = stratified_folds(labelled, "id", "label", 5, seed=1).collect()
    assert sorted(r.id for r in rows) == list(range(103))
    for label in (0, 1):
        sizes = [n for (y, _), n in spread(rows, "label", "fold").items() if y == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = stratified_folds(labelled.repartition(7), "id", "label", 5, seed=1).collect()
    assert {r.id: r.fold for r in rows} == {r.id: r.fold for r in again}
    other = stratified_folds(labelled, "id", "label", 5, seed=2).collect()
    assert {r.id: r.fold for r in rows} != {r.id: r.fold for r in other}


def test_repeats_differ_and_cover(labelled):
    rows = repeated_stratified_folds(labelled, "id", "label", 3, repeats=2).collect()
    halves = [{r.id: r.fold for r in rows if r.repeat == n} for n in (0, 1)]
    assert len(halves[0]) == len(halves[1]) == 103 and halves[0] != halves[1]


def test_groups_stay_together(labelled):
    rows = grouped_stratified_folds(labelled.withColumn("g", F.col("id") % 10), "g", "label", 3).collect()
    assert len(rows) == 103
    assert all(len({r.fold for r in rows if r.g == g}) == 1 for g in range(10))


def test_holdout_takes_the_share_of_each_class(labelled):
    held = [r for r in holdout_split(labelled, "id", "label", 0.3).collect() if r.is_holdout]
    assert spread(held, "label") == {(0,): 23, (1,): 7}


@pytest.mark.parametrize("keys, n, sizes", [(10, 3, [4, 3, 3]), (2, 5, [1, 1]), (6, 3, [2, 2, 2])])
def test_chunks_are_contiguous_and_balanced(spark, keys, n, sizes):
    df = spark.range(keys * 2).select((F.col("id") % keys).alias("k"))
    rows = sorted((r.k, r.chunk) for r in assign_chunks(df, "k", n).collect())
    assert [c for _, c in rows] == [i for i, size in enumerate(sizes) for _ in range(size)]
    assert contiguous_folds(df.distinct(), "k", n).count() == keys


MIXED = [("b", 10.0), ("a", 9.0), (None, float("nan")), ("b", 100.0), ("c", None)]


@pytest.mark.parametrize("small", [1000, 1])
def test_dictionary_is_sorted_with_missing_last(spark, low_floor, small):
    df = spark.createDataFrame(MIXED, "s string, x double")
    got = {(r.feature, r.value): r.code for r in fit_dictionary(df, ["s", "x"], small=small).collect()}
    assert got == {
        ("s", "a"): 0, ("s", "b"): 1, ("s", "c"): 2, ("s", None): 3,
        ("x", "9.0"): 0, ("x", "10.0"): 1, ("x", "100.0"): 2, ("x", None): 3,
    }


@pytest.mark.parametrize("size", [1000, 1])
def test_dictionary_applies(spark, size):
    df = spark.createDataFrame(MIXED, "s string, x double")
    dictionary = fit_dictionary(df, ["s", "x"])
    coded = apply_dictionary(df, dictionary, ["s", "x"], broadcast_bytes=size).collect()
    assert sorted((r.s, r.x) for r in coded) == [(0, 0), (1, 1), (1, 2), (2, 3), (3, 3)]
    new = spark.createDataFrame([("zz", 9.0)], "s string, x double")
    assert apply_dictionary(new, dictionary, ["s", "x"], unseen=-1, broadcast_bytes=size).first().s == -1
    with pytest.raises(PySparkException, match="not in the dictionary of s"):
        apply_dictionary(new, dictionary, ["s", "x"], broadcast_bytes=size).collect()


def test_files_round_trip(spark, tmp_path):
    rows = [("c1", 1, 0.5), ("c2", 0, None)]
    oof = spark.createDataFrame(rows, files.OOF_SCHEMA)
    files.write_csv(oof, f"{tmp_path}/oof")
    back = files.read_csv(spark, f"{tmp_path}/oof", files.OOF_SCHEMA)
    assert sorted(map(tuple, back.collect())) == rows and back.schema == oof.schema
    chunked = oof.withColumn("chunk", F.col("target"))
    files.write_parquet(chunked, f"{tmp_path}/chunks", partition_by=["chunk"])
    assert {p.name for p in (tmp_path / "chunks").glob("chunk=*")} == {"chunk=0", "chunk=1"}
    assert files.read_parquet(spark, f"{tmp_path}/chunks").where("chunk = 1").first().customer_ID == "c1"
    some = spark.createDataFrame([(1.0,), (float("nan"),), (-1.0,)], "x double")
    files.write_parquet(some, f"{tmp_path}/some")
    assert [r.x for r in files.read_parquet(spark, f"{tmp_path}/some", F.col("x") > 0).collect()] == [1.0]
    files.write_names(spark, ["z", "a", "m"], f"{tmp_path}/names")
    assert files.read_names(spark, f"{tmp_path}/names") == ["z", "a", "m"]
