"""Order without a single task: row sequence within a key, and global rank with running sums."""

from __future__ import annotations

import math
import os.path
import sys
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskloom.operators.skew import SLICE, HotGroups, row_floor, sample_fraction, with_slices
from riskloom.session import shuffle_partitions

SEQ = "_seq"
FROM_END = "_from_end"
BUCKET = "_bucket"

# Several buckets per partition even out what hashing them to tasks makes uneven.
BUCKETS_PER_PART = 4
BUCKETS_PER_HOT_GROUP = 200
ROWS_PER_BUCKET = 4_000_000

# Largest finite double.
END = sys.float_info.max

# Room for the row number inside one slice when slice and row number share a bigint.
SLICE_SPAN = 1 << 40


def with_sequence(
    df: DataFrame, key: str, order: Sequence[str], hot: HotGroups | None = None, min_rows: int | None = None
) -> DataFrame:
    """Number the rows of every key in ``order``.

    ``_seq`` is a bigint that ascends with the order (not contiguous across the
    slices of a hot key). ``_from_end`` is 1 for a key's last row, 2 for the one
    before it, and so on; it is NULL outside a hot key's last slice. Rows
    without a key are dropped, as in a keyed aggregate.

    The window leaves the rows hash-partitioned by ``key``, so aggregates by the
    key that follow need no further exchange.
    """
    keyed = df.where(F.col(key).isNotNull())
    sliced, cut = with_slices(keyed, key, [F.col(c) for c in order], hot, min_rows)
    group = Window.partitionBy(key, SLICE) if cut else Window.partitionBy(key)
    position = F.row_number().over(group.orderBy(*order))
    size = F.count(F.lit(1)).over(
        group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    if not cut:
        return sliced.withColumns({SEQ: position.cast("long"), FROM_END: size - position + 1})
    numbered = sliced.withColumns({"_position": position, "_size": size})
    return numbered.withColumns(
        {
            SEQ: F.col("_position") - F.col(SLICE).cast("long") * F.lit(SLICE_SPAN),
            FROM_END: F.when(F.col(SLICE) == 0, F.col("_size") - F.col("_position") + 1),
        }
    ).drop("_position", "_size", SLICE)


def _position_on_line(df: DataFrame, order: Column) -> Column:
    """Map an order column of any type to a double that never decreases with it.

    Different values may share a double; ties are resolved by the real columns.
    """
    typed = df.select(order.alias("v"))
    kind = typed.schema["v"].dataType
    if isinstance(kind, T.NumericType):
        return order.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        return F.timestamp_diff("MICROSECOND", epoch, order.cast("timestamp_ntz")).cast("double")
    # Text: skip the prefix shared by all values, read the next six bytes as a number.
    ends = typed.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    shared = len(os.path.commonprefix([ends.lo or "", ends.hi or ""]))
    rest = F.hex(F.encode(F.substring(order.cast("string"), shared + 1, 6), "UTF-8"))
    return F.conv(F.rpad(rest, 12, "0"), 16, 10).cast("double")


def bucket_count(total: int, parts: int, min_rows: int) -> int:
    """Enough buckets for the partitions, none too large for one task, none needlessly small."""
    wanted = max(BUCKETS_PER_PART * parts, math.ceil(total / ROWS_PER_BUCKET))
    useful = max(1, total // max(1, min_rows // BUCKETS_PER_HOT_GROUP))
    return min(wanted, useful)


def _by_quantiles(df: DataFrame, order: Sequence[Column], min_rows: int) -> tuple[DataFrame, bool]:
    """Cut rows into ordered buckets of similar size.

    Quantiles of the first order column come from a sample of fixed size. A value
    that fills several quantiles is a hot tie: it gets a bucket of its own, which
    is then sliced along the full order. Split points affect balance only.
    """
    # Missing, infinite and NaN values stand at the ends of the line, where many of them are a hot tie like any other.
    line = F.coalesce(_position_on_line(df, order[0]), F.lit(-END))
    placed = df.withColumn("_line", F.when(F.isnan(line), END).otherwise(F.greatest(F.lit(-END), F.least(F.lit(END), line))))
    total = df.count()
    n = bucket_count(total, shuffle_partitions(df.sparkSession), min_rows)
    sample = placed.select("_line").sample(sample_fraction(total, n), seed=7)
    shares = ", ".join(f"{i / n!r}D" for i in range(1, n)) or "0.5D"
    found = sample.agg(F.expr(f"percentile_approx(_line, array({shares}), {10 * n + 1_000})").alias("q")).first().q
    times = Counter(found or [])
    ties = {q: c * total / n for q, c in times.items() if c > 1 and c * total / n >= min_rows}
    inner = sorted({*times, *(math.nextafter(q, math.inf) for q in ties if q < END)})
    if not inner:
        return placed.withColumn(BUCKET, F.lit(0)).drop("_line"), False
    splits = [-math.inf, *inner, math.inf]
    cutter = Bucketizer(splits=splits, inputCol="_line", outputCol=BUCKET)
    bucketed = cutter.transform(placed).withColumn(BUCKET, F.col(BUCKET).cast("int")).drop("_line")
    hot = HotGroups(total, {splits.index(q): int(rows) for q, rows in ties.items()})
    return with_slices(bucketed, BUCKET, order, hot, min_rows)


def _non_null_keys(df: DataFrame, by: Sequence[str]) -> dict[str, Column]:
    """Key columns that identify the groups of ``by`` and are never NULL, for plain equi-joins."""
    keys: dict[str, Column] = {}
    for i, name in enumerate(by):
        field = df.schema[name]
        value = F.col(name)
        if not isinstance(field.dataType, T.NumericType):
            value = value.cast("string")
        blank = F.lit(0) if isinstance(field.dataType, T.NumericType) else F.lit("")
        keys[f"_key{i}"] = F.coalesce(value, blank) if field.nullable else value
        if field.nullable:
            keys[f"_key{i}_missing"] = F.col(name).isNull()
    return keys


def uniform_bucket(hex_digest: Column, n: int) -> Column:
    """Ordered bucket (0..n-1) of a uniformly distributed hex digest; needs no quantiles."""
    leading = F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")
    return F.floor(leading * F.lit(n) / F.lit(float(1 << 32))).cast("int")


def ranked(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    digest: Column | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Global row number and running sums in ``order``, separately within ``by``.

    Adds ``rank`` (from 1), ``n_rows``, and for each entry of ``sums`` the
    inclusive running sum ``cum_{name}`` and the total ``total_{name}``.

    Rows are cut into ordered buckets, numbered inside their bucket, and shifted
    by the totals of the buckets before. Only bucket totals (a few hundred rows
    per ``by`` group) ever meet in one task. The rows are exchanged once: the
    join with the totals uses the buckets as its key, like the window. Pass
    ``digest`` if ``order`` starts with a hex digest, to skip the quantile pass.
    ``by`` columns are few-valued; NULL is a group like any other.
    """
    sums = dict(sums or {})
    if digest is None:
        placed, cut = _by_quantiles(df, order, row_floor(min_rows))
    else:
        n = bucket_count(df.count(), shuffle_partitions(df.sparkSession), row_floor(min_rows))
        placed, cut = df.withColumn(BUCKET, uniform_bucket(digest, n)), False
    keys = _non_null_keys(df, by)
    placed = placed.withColumns(keys)
    group = [*keys, BUCKET, SLICE] if cut else [*keys, BUCKET]
    running = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns(
        {"_rank": F.row_number().over(Window.partitionBy(*group).orderBy(*order))}
        | {f"_run_{name}": F.sum(value).over(running) for name, value in sums.items()}
    )

    counted = placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_of_rank"), *[F.sum(value).alias(f"_of_{name}") for name, value in sums.items()]
    )
    along = [F.col(BUCKET), F.col(SLICE).desc()] if cut else [F.col(BUCKET)]
    every = Window.partitionBy(*keys)
    before = every.orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    whole = every.orderBy(*along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counted.select(
        *group,
        *[F.coalesce(F.sum(f"_of_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in ["rank", *sums]],
        *[F.sum(f"_of_{name}").over(whole).alias(f"_all_{name}") for name in ["rank", *sums]],
    )
    # Size estimates do not see rows multiplied upstream and might broadcast the rows;
    # the merge join finds them partitioned and sorted by its key already.
    shifted = local.join(offsets.hint("merge"), group)
    return shifted.select(
        *df.columns,
        (F.col("_rank") + F.col("_before_rank")).alias("rank"),
        F.col("_all_rank").alias("n_rows"),
        *[(F.col(f"_run_{name}") + F.col(f"_before_{name}")).alias(f"cum_{name}") for name in sums],
        *[F.col(f"_all_{name}").alias(f"total_{name}") for name in sums],
    )


def descending(score: str) -> Column:
    """Ascending order column for "highest score first"; missing scores come last."""
    return F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))


def head_tail(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First and last ``n`` rows of a stated order, marked ``head`` / ``tail``."""
    first = df.orderBy(*[F.col(c).asc() for c in order]).limit(n)
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return first.withColumn("part", F.lit("head")).unionByName(last.withColumn("part", F.lit("tail")))
