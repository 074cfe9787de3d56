"""Feature importance by permutation, and the selection built on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import batched

from pyspark.sql import DataFrame, Window, functions as F

from riskloom.functions.columns import common_names
from riskloom.operators.folds import holdout_split, shuffle_digest
from riskloom.plans.learn import MakeStages, assemble, fit_fold
from riskloom.session import materialize

# Buckets within which values change places. Fixed, so that importances do not depend on cores or settings.
BUCKETS = 64

# A bucket with more rows than this would be too much for one task; only then there are more.
ROWS_PER_BUCKET = 2_000_000

MIX = "_mix_bucket"


def with_mixing_buckets(df: DataFrame, id: str, buckets: int) -> DataFrame:
    """Partition rows by a random bucket, within which columns will be permuted."""
    placed = df.withColumn(MIX, F.pmod(F.xxhash64(F.col(id)), F.lit(buckets)))
    return placed.repartition(buckets, MIX)


def permute_column(df: DataFrame, column: str, id: str, seed: str) -> DataFrame:
    """Give every row the value of the row after it in a random order of its bucket.

    The last row of a bucket takes the first row's value, so the result is a
    permutation of the column. Rows already partitioned by bucket stay where they are.
    """
    ring = Window.partitionBy(MIX).orderBy("_digest", id)
    held = F.struct(F.col(column).alias("v"))
    following = F.coalesce(F.lead(held).over(ring), F.first(held).over(ring))
    moved = df.withColumn("_digest", shuffle_digest(seed, id)).withColumn("_moved", following)
    return moved.withColumn(column, F.col("_moved.v")).drop("_digest", "_moved")


def permutation_importance(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    id: str,
    make_stages: MakeStages,
    share: float = 0.3,
    repeats: int = 5,
    seed: int = 42,
    batch: int = 8,
) -> DataFrame:
    """``(feature, weight, std)``: drop of holdout accuracy when a feature is shuffled.

    The model is fitted on the other rows. Each batch of features is scored in one
    job over one shuffled copy per feature and repeat; the copies share a single
    exchange of the holdout, into random buckets.
    """
    rows = df.select(id, F.col(label).cast("int").alias(label), *features)
    split = materialize(holdout_split(rows, id, label, share, seed))
    model = fit_fold(assemble(split, features), make_stages, F.col("is_holdout"))
    held = split.where("is_holdout")
    holdout = with_mixing_buckets(held, id, max(BUCKETS, held.count() // ROWS_PER_BUCKET))
    right = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    base = model.transform(assemble(holdout, features)).agg(right.alias("base")).first()

    def accuracy(names: Sequence[str]) -> DataFrame:
        copies = [
            permute_column(holdout, c, id, f"{seed}/{c}/{r}").withColumns(
                {"feature": F.lit(c), "repeat": F.lit(r)}
            )
            for c in names
            for r in range(repeats)
        ]
        scored = model.transform(assemble(reduce(DataFrame.unionByName, copies), features))
        return scored.groupBy("feature", "repeat").agg(right.alias("accuracy"))

    parts = [materialize(accuracy(names)) for names in batched(features, batch)]
    drops = reduce(DataFrame.unionByName, parts).withColumn("drop", F.lit(base.base) - F.col("accuracy"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("weight"), F.stddev_pop("drop").alias("std"))


def select_features(importance: DataFrame, categorical: Sequence[str], least: float = 0.0) -> DataFrame:
    """Features of at least the given weight, each marked ``is_categorical``."""
    chosen = importance.where(F.col("weight") >= least)
    return chosen.select("feature", "weight", F.col("feature").isin(list(categorical)).alias("is_categorical"))


def selected_names(importance: DataFrame, categorical: Sequence[str], least: float = 0.0) -> tuple[list[str], list[str]]:
    """Chosen names by falling weight, and those of them that are categorical.

    The names are columns of a plan, so the list is short by nature.
    """
    rows = select_features(importance, categorical, least).orderBy(F.col("weight").desc(), "feature").collect()
    names = [r.feature for r in rows]
    return names, common_names(names, categorical)
