"""Groups too large for one task: find them, and cut them into ordered slices.

A window over a key puts all rows of that key into one task. When one key
holds a large share of the table, its rows are cut along the row order into
slices of roughly equal size, and the window runs per ``(key, _slice)``.
Slices are numbered from the end: the last rows of every key, and all rows of
an ordinary key, are slice 0. All rows stay; split points only steer balance.

Split points are values of real rows, chosen such that every slice is
non-empty and slice 0 holds at least two rows. They travel as literals, so a
row's slice is a function of the row alone and survives recomputation.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskloom.session import shuffle_partitions

SLICE = "_slice"

# A group below this many rows is small for one task however large its share.
MIN_HOT_ROWS = 200_000

SAMPLES_PER_PART = 200
SAMPLES_PER_SLICE = 64


def row_floor(min_rows: int | None) -> int:
    return MIN_HOT_ROWS if min_rows is None else min_rows


@dataclass(frozen=True)
class HotGroups:
    """Rows in the table, and rows of each group that needs slicing."""

    total: int
    rows: Mapping[Any, int] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.rows)


def sample_fraction(total: int, parts: int) -> float:
    """Share of rows that gives about ``SAMPLES_PER_PART`` rows per partition."""
    return min(1.0, SAMPLES_PER_PART * parts / max(total, 1))


def hot_groups(df: DataFrame, key: str, min_rows: int | None = None) -> HotGroups:
    """Keys holding more than one shuffle partition's worth of rows.

    A count, and only for tables that could hold such a key a count of keys in a
    sample of fixed size. At most two keys per shuffle partition come back. A
    key near the threshold may be missed or added: that shifts work between
    tasks and changes no result.
    """
    floor = row_floor(min_rows)
    keys = df.where(F.col(key).isNotNull()).select(key)
    parts = shuffle_partitions(df.sparkSession)
    total = keys.count()
    if total < floor:
        return HotGroups(total)
    fraction = sample_fraction(total, parts)
    least = 0.5 * max(floor, total / parts) * fraction
    counted = keys.sample(fraction, seed=7).groupBy(key).count().where(F.col("count") >= least)
    return HotGroups(total, {r[0]: int(r[1] / fraction) for r in counted.collect()})


def split_hot(df: DataFrame, key: str, hot: HotGroups) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and rows of hot keys."""
    is_hot = F.col(key).isin(list(hot.rows))
    return df.where(~is_hot), df.where(is_hot)


def _split_points(
    df: DataFrame, key: str, order: Sequence[Column], hot: HotGroups, min_rows: int
) -> tuple[DataFrame, int] | None:
    """``(key, _bounds)``: ascending order values at which each hot group is cut; and the most of one group."""
    spark = df.sparkSession
    target = max(min_rows, hot.total / shuffle_partitions(spark))
    slices = {k: max(2, math.ceil(n / target)) for k, n in hot.rows.items()}
    fractions = {k: min(1.0, SAMPLES_PER_SLICE * slices[k] / n) for k, n in hot.rows.items()}
    ordered = df.select(F.col(key), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_at"))
    sample = ordered.sampleBy(key, fractions, seed=7).distinct()
    kind = ordered.schema[key].dataType
    wanted = spark.createDataFrame(list(slices.items()), T.StructType([T.StructField(key, kind), T.StructField("_slices", T.LongType())]))
    # The sample's rows at the cuts: place i is one if it is floor(j n / s) for a whole j.
    group = Window.partitionBy(key)
    placed = sample.withColumns({"_i": F.row_number().over(group.orderBy("_at")) - 1, "_n": F.count("*").over(group)})
    placed = placed.join(F.broadcast(wanted), key)
    j = F.ceil(F.col("_i") * F.col("_slices") / F.col("_n"))
    is_cut = (F.floor(j * F.col("_n") / F.col("_slices")) == F.col("_i")) & j.between(1, F.col("_slices") - 1)
    cuts = placed.where(is_cut & (F.col("_i") > 0) & (F.col("_i") < F.col("_n") - 1)).select(key, "_at")
    found: dict[Any, list] = {}
    for row in cuts.orderBy(key, "_at").collect():
        found.setdefault(row[0], []).append(row[1])
    bounds = list(found.items())
    if not bounds:
        return None
    schema = T.StructType(
        [
            T.StructField(key, ordered.schema[key].dataType),
            T.StructField("_bounds", T.ArrayType(ordered.schema["_at"].dataType)),
        ]
    )
    return spark.createDataFrame(bounds, schema), max(len(b) for _, b in bounds)


def with_slices(
    df: DataFrame,
    key: str,
    order: Sequence[Column],
    hot: HotGroups | None = None,
    min_rows: int | None = None,
) -> tuple[DataFrame, bool]:
    """Add ``_slice`` if any group needs it; tell whether it was added.

    ``order`` columns ascend and identify the row position within the group.
    """
    floor = row_floor(min_rows)
    hot = hot_groups(df, key, floor) if hot is None else hot
    points = _split_points(df, key, order, hot, floor) if hot else None
    if points is None:
        return df, False
    points, most = points
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    # At most two hot groups per shuffle partition and, over all of them, a few
    # bounds per partition: the size is fixed by the settings, not by the data.
    sliced = df.join(F.broadcast(points), key, "left").withColumn("_at", at)
    return sliced.withColumn(SLICE, bounds_after("_bounds", F.col("_at"), most)).drop("_bounds", "_at"), True


def bounds_after(bounds: str, at: Column, most: int) -> Column:
    """How many of the ascending ``bounds``, ``most`` at the most, lie after ``at``; 0 without bounds. By halving, not one by one."""

    def halved(held: Column, _: Column) -> Column:
        middle = F.floor((held["low"] + held["high"]) / 2).cast("int")
        after = F.get(bounds, middle) > at
        low, high = F.when(after, held["low"]).otherwise(middle + 1), F.when(after, middle).otherwise(held["high"])
        return F.when(held["low"] < held["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(held)

    size = F.coalesce(F.size(bounds), F.lit(0))
    start = F.struct(F.lit(0).alias("low"), size.alias("high"))
    first = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most.bit_length()))), start, halved)["low"]
    return F.when(F.col(bounds).isNull(), F.lit(0)).otherwise(size - first)


# Ways a key that fills a large share of the rows is dealt out.
DEALS = 64


def spread_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with what ``lookup`` holds for their keys, where few keys may hold most rows.

    Rows of one key are dealt out by the columns ``by``. Only the different pairs of key and
    deal, at most ``DEALS`` a key, meet the lookup (``how`` inner or left); what they find then meets the rows, dealt
    the same way. No task gets all rows of a key, and nothing is broadcast. Keys are not NULL.
    """
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*by), F.lit(DEALS)))
    held = dealt.select(*keys, "_deal").distinct().join(lookup, list(keys), how)
    return dealt.join(held, [*keys, "_deal"]).drop("_deal")
