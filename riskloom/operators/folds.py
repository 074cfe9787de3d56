"""Row and key assignment: stratified folds, repeats, contiguous folds, holdout, chunks.

Shuffled assignments order rows by an md5 digest of seed and id: the order is
random-looking, reproducible on any engine, and uniform, so ordered buckets
come straight from the digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskloom.operators.ordering import ranked
from riskloom.operators.skew import spread_join
from riskloom.session import materialize

# Groups of every class that are placed one by one, by their sizes.
LARGE_GROUPS = 64


def shuffle_digest(seed: int | str | Column, id: str) -> Column:
    seed_text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed_text, F.lit(":"), F.col(id).cast("string")))


def _shuffled(df: DataFrame, id: str, by: Sequence[str], seed: int | Column) -> DataFrame:
    """``rank`` and ``n_rows`` of rows in digest order within ``by``."""
    placed = df.withColumn("_digest", shuffle_digest(seed, id))
    return ranked(placed, [F.col("_digest"), F.col(id)], by, digest=F.col("_digest")).drop("_digest")


def stratified_folds(df: DataFrame, id: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0..k-1); class counts differ by at most one between folds."""
    rows = _shuffled(df, id, [label], seed)
    return rows.select(*df.columns, F.pmod(F.col("rank") - 1, F.lit(k)).cast("int").alias("fold"))


def repeated_stratified_folds(
    df: DataFrame, id: str, label: str, k: int, repeats: int = 2, seed: int = 42
) -> DataFrame:
    """Stratified folds, drawn anew for each ``repeat``; one output row per row and repeat."""
    each = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = _shuffled(each, id, ["repeat", label], F.lit(seed) + F.col("repeat"))
    return rows.select(*each.columns, F.pmod(F.col("rank") - 1, F.lit(k)).cast("int").alias("fold"))


def grouped_stratified_folds(
    df: DataFrame, group: str, label: str, k: int, seed: int = 42
) -> DataFrame:
    """Folds for rows such that all rows of a group share one fold.

    Groups are stratified by their largest label and count as one each; :func:`balanced_grouped_folds` weighs them by their rows.
    """
    groups = materialize(df.groupBy(group).agg(F.max(label).alias("_label")))
    folds = stratified_folds(groups, group, "_label", k, seed).select(group, "fold")
    return spread_join(df, folds, [group], _other_columns(df, group)).select(group, *[c for c in df.columns if c != group], "fold")


def _other_columns(df: DataFrame, group: str) -> list[str]:
    """Plain columns by which the rows of one group are told apart."""
    return [c for c in df.columns if c != group and isinstance(df.schema[c].dataType, T.AtomicType)] or [group]


def water_level(loads: Sequence[float], rest: float) -> float:
    """The height to which ``rest`` fills up ``loads``: loads below it rise to it, those above stay."""
    loads = sorted(loads)
    return min((rest + sum(loads[: j + 1])) / (j + 1) for j in range(len(loads)))


def balanced_grouped_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 42, large: int = LARGE_GROUPS) -> DataFrame:
    """Folds for rows such that all rows of a group share one fold, and folds hold similar numbers of rows of every class.

    A group's class is its largest label. Of every class, the ``large`` groups with most rows go, one after the other, to the fold
    that holds fewest rows of the class so far. All others stand in digest order and fill up the folds to one level by
    their running number of rows, so a fold misses its share by less than the rows of the largest of them. Only the
    large groups, a fixed number a class, meet on the driver. Classes are few.
    """
    sizes = df.groupBy(group).agg(F.max(label).alias("_label"), F.count("*").alias("_size")).where(F.col(group).isNotNull())
    sizes = materialize(sizes.withColumn("_digest", shuffle_digest(seed, group)))
    order = Window.partitionBy("_label").orderBy(F.col("_size").desc(), "_digest", group)
    top = sizes.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= large)
    loads: dict = {}
    placed = []
    for r in top.orderBy("_label", "_place").collect():
        mine = loads.setdefault(r._label, [0] * k)
        fold = mine.index(min(mine))
        mine[fold] += r._size
        placed.append((r[group], fold))
    spark = df.sparkSession
    kind = sizes.schema[group].dataType
    first = spark.createDataFrame(placed, T.StructType([T.StructField(group, kind), T.StructField("fold", T.IntegerType())]))
    # At most ``large`` groups a class.
    others = sizes.join(F.broadcast(first), group, "left_anti")
    running = ranked(others, [F.col("_digest"), F.col(group)], ["_label"], {"rows": F.col("_size")}, digest=F.col("_digest"))
    rest = {r._label: r.total for r in others.groupBy("_label").agg(F.sum("_size").alias("total")).collect()}
    fold = F.lit(0)
    for value, total in rest.items():
        mine = loads.get(value, [0] * k)
        level = water_level(mine, total)
        room = [max(0.0, level - x) for x in mine]
        edges = [sum(room[: f + 1]) for f in range(k - 1)]
        within = sum(((F.col("cum_rows") - F.col("_size") >= F.lit(e)).cast("int") for e in edges), F.lit(0))
        fold = F.when(F.col("_label").eqNullSafe(F.lit(value)), within).otherwise(fold)
    folds = first.unionByName(running.select(group, fold.cast("int").alias("fold")))
    return spread_join(df, folds, [group], _other_columns(df, group)).select(*df.columns, "fold")


def holdout_split(df: DataFrame, id: str, label: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Add ``is_holdout``: a seeded ``share`` of each class."""
    rows = _shuffled(df, id, [label], seed)
    held = F.col("rank") <= F.floor(F.lit(share) * F.col("n_rows"))
    return rows.select(*df.columns, held.alias("is_holdout"))


def block_of_rank(rank: Column, n_rows: Column, n: int) -> Column:
    """Which of ``n`` contiguous blocks a rank (from 1) falls in; sizes differ by at most one."""
    small, extra = F.floor(n_rows / F.lit(n)), n_rows % F.lit(n)
    place = rank - 1
    in_large = extra * (small + 1)
    return (
        F.when(place < in_large, F.floor(place / (small + 1)))
        .otherwise(extra + F.floor((place - in_large) / F.greatest(small, F.lit(1))))
        .cast("int")
    )


def contiguous_folds(df: DataFrame, id: str, k: int = 5) -> DataFrame:
    """Add ``fold``: k blocks of consecutive ids."""
    rows = ranked(df, [F.col(id)])
    return rows.select(*df.columns, block_of_rank(F.col("rank"), F.col("n_rows"), k).alias("fold"))


def assign_chunks(df: DataFrame, key: str, n: int) -> DataFrame:
    """Distinct keys with their ``chunk``: n contiguous, balanced blocks in key order."""
    keys = materialize(df.where(F.col(key).isNotNull()).select(key).distinct())
    return contiguous_folds(keys, key, n).withColumnRenamed("fold", "chunk")


def rows_of_chunks(df: DataFrame, chunks: DataFrame, key: str, wanted: Sequence[int]) -> DataFrame:
    """Rows whose key lies in one of the wanted chunks."""
    return df.join(chunks.where(F.col("chunk").isin(list(wanted))).select(key), key, "left_semi")

