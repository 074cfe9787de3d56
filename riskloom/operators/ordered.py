"""Differences between neighbouring rows of one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskloom.operators.skew import SLICE, HotGroups, hot_groups, with_slices

FIRST_GAP_DAYS = 30.53


def last_difference(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``{c}_diff1``: value in a key's last row minus value in the row before.

    Raw rows count, so a missing value in either row gives NULL, as does a key
    with one row. Each map task keeps only its two last rows per key before the
    exchange (a grouped limit), so hot keys ship next to nothing.
    """
    last_first = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    ends = (
        df.where(F.col(key).isNotNull())
        .select(key, *columns, F.row_number().over(last_first).alias("_from_end"))
        .where(F.col("_from_end") <= 2)
    )
    return ends.groupBy(key).agg(*[difference_of_ends(c).alias(f"{c}_diff1") for c in columns])


def difference_of_ends(column: str, from_end: str = "_from_end"):
    """Aggregate: value where ``from_end`` is 1 minus value where it is 2."""
    at = [F.max(F.when(F.col(from_end) == i, F.col(column))) for i in (1, 2)]
    return at[0] - at[1]


def days_between(earlier: Column, later: Column) -> Column:
    """Days, with fraction, from one date or time to another."""
    moments = [c.cast("timestamp_ntz") for c in (earlier, later)]
    return F.timestamp_diff("MICROSECOND", *moments) / F.lit(86_400e6)


def gap_days(
    df: DataFrame,
    key: str,
    time: str,
    tie: Sequence[str] = (),
    first_gap: float = FIRST_GAP_DAYS,
    name: str = "SDist",
    hot: HotGroups | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Add the days (with fraction) since the key's previous row.

    A key's first row gets ``first_gap``. Text dates are parsed. For a hot key
    cut into slices, the first row of a slice takes its predecessor from a table
    with one row per slice.
    """
    text = isinstance(df.schema[time].dataType, T.StringType)
    moment = F.to_timestamp_ntz(F.col(time)) if text else F.col(time).cast("timestamp_ntz")
    dated = df.where(F.col(key).isNotNull()).withColumn("_moment", moment)
    order = ["_moment", *tie]
    hot = hot_groups(df, key, min_rows) if hot is None else hot
    sliced, cut = with_slices(dated, key, [F.col(c) for c in order], hot, min_rows)
    group = [key, SLICE] if cut else [key]
    previous = F.lag("_moment").over(Window.partitionBy(*group).orderBy(*order))
    with_previous = sliced.withColumn("_previous", previous)
    if cut:
        # One row per slice of a hot key: bounded by the number of split points.
        ends = (
            sliced.where(F.col(key).isin(list(hot.rows)))
            .groupBy(*group)
            .agg(F.max("_moment").alias("_carried"))
            .withColumn(SLICE, F.col(SLICE) - 1)
        )
        with_previous = with_previous.join(F.broadcast(ends), group, "left").withColumn(
            "_previous", F.coalesce("_previous", "_carried")
        )
    filled = F.coalesce(days_between(F.col("_previous"), F.col("_moment")), F.lit(float(first_gap)))
    return with_previous.select(*df.columns, filled.alias(name))
