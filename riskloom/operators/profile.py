"""One row per key: ordered, distributional and categorical statistics of its history.

Layout. Rows are exchanged once by key in their compact form, with all columns that any
statistic needs, and numbered there; the gap to the row before is taken in the same window. Everything
after works on rows already partitioned by key: unfolding columns of all types into
``(key, column, value)`` cells, aggregating, and widening again need no second exchange and no second
scan, whatever the number of column types. Unfolding before the exchange would ship one row per cell
instead of one per statement. For a hot key the rows are partitioned by
``(key, slice)`` instead, and Spark's partial aggregates (counts, moments, extremes, first and last) reduce each slice
before the exchange that joins the slices.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskloom.operators.ordered import FIRST_GAP_DAYS, days_between, difference_of_ends, gap_days
from riskloom.operators.ordering import FROM_END, SEQ, with_sequence
from riskloom.operators.skew import HotGroups, hot_groups, split_hot
from riskloom.session import shuffle_partitions

# The names of the statistics and the tenure of a new key.
NUMERIC_STATS = ("first", "mean", "std", "min", "max", "last")
CATEGORICAL_STATS = ("count", "first", "last", "nunique")

# From this many columns on, unfolding beats one very wide aggregate.
WIDE_LIMIT = 20

NEW_CUSTOMER_TENURE = 0.5

# Cells that a task unfolds and holds groups of. Tables with more get more tasks, whatever the number of shuffle partitions.
CELLS_PER_TASK = 1_500_000


def _first_last(value: Column) -> tuple[Column, Column]:
    """Aggregates for the first and last value that is not missing."""
    at = F.when(value.isNotNull(), F.col(SEQ))
    return F.min_by(value, at), F.max_by(value, at)


def _numeric_aggregates(column: str) -> dict[str, Column]:
    value = F.col(column)
    first, last = _first_last(value)
    return {
        "first": first,
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "min": F.min(value),
        "max": F.max(value),
        "last": last,
        "diff1": difference_of_ends(column, FROM_END),
    }


def numeric_profile(
    sequenced: DataFrame,
    key: str,
    columns: Sequence[str],
    diff: Sequence[str] = (),
    stats: Sequence[str] = NUMERIC_STATS,
    layout: str = "auto",
) -> DataFrame:
    """``{column}_{stat}`` for every column, and ``{column}_diff1`` for those in ``diff``.

    ``sequenced`` comes from :func:`with_sequence`. ``layout`` is ``wide`` (one
    aggregate per output column), ``long`` (unfold, aggregate, widen) or ``auto``.
    """
    sequenced = with_plain_types(sequenced, columns)
    if layout == "auto":
        layout = "long" if len(columns) >= WIDE_LIMIT else "wide"
    if layout == "wide":
        outputs = []
        for c in columns:
            made = _numeric_aggregates(c)
            wanted = [*stats, *(["diff1"] if c in set(diff) else [])]
            outputs += [made[s].alias(f"{c}_{s}") for s in wanted]
        return sequenced.groupBy(key).agg(*outputs)

    # Columns unfold with others of their type, so that values are those of the wide layout.
    named = [*stats, *(["diff1"] if diff else [])]
    skip = {(c, "diff1") for c in columns if c not in set(diff)}
    parts = []
    for own in _by_type(sequenced, columns):
        long = numeric_profile_long(sequenced, key, own, bool(diff), stats)
        parts.append(_widen(long, key, own, named, skip))
    whole = reduce(lambda a, b: a.join(b, key), parts)
    return whole.select(key, *[f"`{c}_{s}`" for c in columns for s in named if (c, s) not in skip])


def with_plain_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Integers as bigint and floating numbers as double; decimals keep their type."""
    plain = {c: "bigint" for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)}
    plain |= {c: "double" for c in columns if isinstance(df.schema[c].dataType, T.FloatType)}
    return df.withColumns({c: F.col(c).cast(t) for c, t in plain.items()})


def _by_type(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    return list(groups.values())


def _widen(
    long: DataFrame, key: str, columns: Sequence[str], stats: Sequence[str], skip: Collection[tuple[str, str]] = ()
) -> DataFrame:
    """``(key, _column, stats…)`` rows to one row per key.

    A key has exactly one row per column, so its rows gather into an array of
    known length and each output reads one fixed position. This runs in about
    half the time of ``pivot``, which evaluates an aggregate per output group.
    """
    gathered = long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_column", *stats))).alias("_stats"))
    picks = [
        f"_stats[{i}].`{s}` AS `{c}_{s}`" for i, c in enumerate(columns) for s in stats if (c, s) not in set(skip)
    ]
    return gathered.selectExpr(f"`{key}`", *picks)


def numeric_profile_long(
    sequenced: DataFrame, key: str, columns: Sequence[str], diff: bool = True, stats: Sequence[str] = NUMERIC_STATS
) -> DataFrame:
    """The profile as ``(key, _column, stats…)`` rows; ``_column`` is the position in ``columns``.

    Missing cells are kept while unfolding, so a column without any value keeps
    its row. Prefer this form when the consumer does not need one wide row. Columns of
    several types unfold as their common type.
    """
    cells = F.array(*[F.col(c) for c in columns])
    unfolded = sequenced.select(key, SEQ, FROM_END, F.posexplode(cells).alias("_column", "_value"))
    made = _numeric_aggregates("_value")
    wanted = [*stats, *(["diff1"] if diff else [])]
    return unfolded.groupBy(key, "_column").agg(*[made[s].alias(s) for s in wanted])


def categorical_profile(
    sequenced: DataFrame, key: str, columns: Sequence[str], stats: Sequence[str] = CATEGORICAL_STATS
) -> DataFrame:
    """``{column}_{count,first,last,nunique}``, missing values skipped.

    Rows collapse to one per distinct value first. That gives the distinct count
    without collecting sets, however many values a key has.
    """
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    unfolded = sequenced.select(key, SEQ, F.posexplode(cells).alias("_column", "_value"))
    values = unfolded.groupBy(key, "_column", "_value").agg(
        F.count("_value").alias("_n"), F.min(SEQ).alias("_from"), F.max(SEQ).alias("_to")
    )
    seen = F.col("_value").isNotNull()
    made = {
        "count": F.sum("_n"),
        "first": F.min_by("_value", F.when(seen, F.col("_from"))),
        "last": F.max_by("_value", F.when(seen, F.col("_to"))),
        "nunique": F.count("_value"),
    }
    long = values.groupBy(key, "_column").agg(*[made[s].alias(s) for s in stats])
    return _widen(long, key, columns, stats)


def tenure(df: DataFrame, key: str, time: str, markers: Sequence[str]) -> DataFrame:
    """``LT`` (number of dated rows) and the last date of every key.

    A key with one dated row is "new" (0.5) if any marker column has no value.
    Needs no row order: counts and a maximum combine on the map side.
    """
    dated = df.where(F.col(key).isNotNull())
    counted = dated.groupBy(key).agg(
        F.count(time).alias("_rows"),
        F.max(time).alias(time),
        F.least(*[F.count(m) for m in markers], F.lit(1)).alias("_marked"),
    )
    return counted.select(key, _tenure_of(F.col("_rows"), F.col("_marked")).alias("LT"), time)


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"

#: Cells that only tenure reads.
TIME_CELL, MARKER_CELL = "_time", "_marker"


def _as_number(df: DataFrame, time: str) -> Column:
    """Dates and times as microseconds; numbers as they are."""
    if isinstance(df.schema[time].dataType, T.NumericType):
        return F.col(time)
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col(time).cast("timestamp_ntz"))


def _as_time(number: Column, kind: T.DataType) -> Column:
    return number.cast(kind) if isinstance(kind, T.NumericType) else F.timestamp_add("MICROSECOND", number, F.expr(EPOCH)).cast(kind)


def one_pass_profile(
    sequenced: DataFrame,
    key: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    diff: Collection[str] = (),
    time: str | None = None,
    markers: Sequence[str] = (),
) -> DataFrame:
    """All statistics of all columns from one unfolding of numbered rows (:func:`with_sequence`).

    A cell holds its value in the field of its type. Cells collapse to one per distinct text first, so no sets are collected; numeric
    cells have no text, so theirs are complete after that step. With ``time``, the columns ``LT`` and ``time`` of
    :func:`tenure` come from the same cells.
    """
    rows = with_plain_types(sequenced, numeric)
    values = {c: F.col(c) for c in numeric}
    if time is not None:
        kind = sequenced.schema[time].dataType
        rows = rows.withColumn(TIME_CELL, _as_number(sequenced, time))
        values[TIME_CELL] = F.col(TIME_CELL)
        for i, m in enumerate(markers):
            rows = rows.withColumn(f"{MARKER_CELL}{i}", F.when(F.col(m).isNotNull(), F.lit(1).cast("long")))
            values[f"{MARKER_CELL}{i}"] = F.col(f"{MARKER_CELL}{i}")
    own_type = {c: rows.schema[c].dataType.simpleString() for c in values}
    types = list(dict.fromkeys(own_type.values()))
    fields = {t: f"v{i}" for i, t in enumerate(types)}

    def cell(value: Column, kind: str) -> Column:
        held = [(value if kind == t else F.lit(None).cast(t)).alias(f) for t, f in fields.items()]
        return F.struct(*held, (value if kind == "text" else F.lit(None).cast("string")).alias("text"))

    # A column may be both numeric and categorical, so positions and not names tell cells apart.
    cells = [*values, *categorical]
    made_cells = [cell(v, own_type[c]) for c, v in values.items()] + [cell(F.col(c).cast("string"), "text") for c in categorical]
    unfolded = rows.select(key, SEQ, FROM_END, F.posexplode(F.array(*made_cells)).alias("_column", "_cell"))
    unfolded = unfolded.select(key, SEQ, FROM_END, "_column", "_cell.*")

    # Averages and deviations of integers and doubles are the same aggregate; decimals keep their own.
    plain = [f for t, f in fields.items() if not t.startswith("decimal")]
    moments = {"m": F.coalesce(*[F.col(f).cast("double") for f in plain])} if plain else {}
    moments |= {f"m_{f}": F.col(f) for t, f in fields.items() if t.startswith("decimal")}
    moment_of = {t: f"m_{f}" if t.startswith("decimal") else "m" for t, f in fields.items()}
    made: dict[str, Column] = {}
    for f in fields.values():
        first, last = _first_last(F.col(f))
        ends = [F.max(F.when(F.col(FROM_END) == i, F.col(f))) for i in (1, 2)]
        made |= {f"{f}_first": first, f"{f}_last": last, f"{f}_min": F.min(f), f"{f}_max": F.max(f), f"{f}_diff1": ends[0] - ends[1]}
    for name, value in moments.items():
        made |= {f"{name}_mean": F.avg(value), f"{name}_std": F.stddev_samp(value)}
    filled = reduce(Column.__or__, [F.col(f).isNotNull() for f in fields.values()], F.lit(False))
    made |= {"n": F.count_if(filled), "n_text": F.count("text"), "from": F.min(SEQ), "to": F.max(SEQ)}
    collapsed = unfolded.groupBy(key, "_column", "text").agg(*[v.alias(n) for n, v in made.items()])

    kept = [n for n in made if n not in ("n_text", "from", "to")]
    if categorical:
        seen = F.col("text").isNotNull()
        stats = {n: F.max(n) for n in kept} | {
            "count": F.sum("n_text"),
            "first": F.min_by("text", F.when(seen, F.col("from"))),
            "last": F.max_by("text", F.when(seen, F.col("to"))),
            "nunique": F.count("text"),
        }
        collapsed = collapsed.groupBy(key, "_column").agg(*[v.alias(n) for n, v in stats.items()])
        kept = list(stats)
    gathered = collapsed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_column", *kept))).alias("_stats"))

    def pick(position: int, field: str) -> Column:
        return F.col("_stats")[position][field]

    out = [F.col(key)]
    for i, c in enumerate(cells):
        if i < len(numeric):
            f, m = fields[own_type[c]], moment_of[own_type[c]]
            at = {s: f"{m}_{s}" if s in ("mean", "std") else f"{f}_{s}" for s in NUMERIC_STATS}
            out += [pick(i, at[s]).alias(f"{c}_{s}") for s in NUMERIC_STATS]
            out += [pick(i, f"{f}_diff1").alias(f"{c}_diff1")] if c in diff else []
        elif i >= len(values):
            out += [pick(i, s).alias(f"{c}_{s}") for s in CATEGORICAL_STATS]
    if time is not None:
        at = len(numeric)
        dated = pick(at, "n")
        marked = F.least(*[pick(at + 1 + i, "n") for i in range(len(markers))], F.lit(1))
        out.append(_tenure_of(dated, marked).alias("LT"))
        out.append(_as_time(pick(at, f"{fields[own_type[TIME_CELL]]}_max"), kind).alias(time))
    return gathered.select(*out)


def _tenure_of(rows: Column, marked: Column) -> Column:
    return F.when((rows == 1) & (marked == 0), F.lit(NEW_CUSTOMER_TENURE)).otherwise(rows.cast("double"))


def profile(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    no_diff: Sequence[str] = ("preds",),
    layout: str = "auto",
    hot: HotGroups | None = None,
    min_rows: int | None = None,
    gap: str | None = None,
    time: str | None = None,
    markers: Sequence[str] = (),
) -> DataFrame:
    """Full profile: numeric statistics, last-step differences and categorical statistics, from one exchange of the rows.

    ``gap`` names a numeric column to add before: days since the key's previous row in ``order``, whose first
    column is then a date or time. ``time`` and ``markers`` add the columns of :func:`tenure`. Rows of hot keys take their own
    branch, so that ordinary keys keep the plan with one exchange. Numeric columns alone may use one wide aggregate (``layout``).
    """
    hot = hot_groups(df, key, min_rows) if hot is None else hot
    names = [*numeric, *([gap] if gap else [])]
    diff = {c for c in names if c not in set(no_diff)}
    needed = list(dict.fromkeys([key, *order, *numeric, *categorical, *([time] if time else []), *markers]))
    cells = len(names) + len(categorical) + (1 + len(markers) if time else 0)

    def branch(rows: DataFrame, groups: HotGroups) -> DataFrame:
        rows = rows.select(*needed)
        if gap and groups:
            rows = gap_days(rows, key, order[0], order[1:], name=gap, hot=groups, min_rows=min_rows)
        if not groups and hot.total * cells > CELLS_PER_TASK:
            # The exchange that the window needs, with its number of tasks; merged ones would hold too much.
            tasks = max(shuffle_partitions(rows.sparkSession), math.ceil(hot.total * cells / CELLS_PER_TASK))
            rows = rows.where(F.col(key).isNotNull()).repartition(tasks, key)
        numbered = with_sequence(rows, key, order, groups, min_rows)
        if gap and not groups:
            # The window that numbers the rows is partitioned and sorted alike, so this costs no exchange.
            before = F.lag(order[0]).over(Window.partitionBy(key).orderBy(*order))
            numbered = numbered.withColumn(gap, F.coalesce(days_between(before, F.col(order[0])), F.lit(FIRST_GAP_DAYS)))
        if not categorical and time is None:
            return numeric_profile(numbered, key, names, [c for c in names if c in diff], layout=layout)
        return one_pass_profile(numbered, key, names, categorical, diff, time, markers)

    if not hot:
        return branch(df, hot)
    ordinary, dominant = split_hot(df, key, hot)
    return branch(ordinary, HotGroups(hot.total)).unionByName(branch(dominant, hot))
