"""Missing values: one representation (NULL) inside, one sentinel at the model boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

SENTINEL = -127.0


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column.

    Spark keeps NaN as a value (it wins ``max`` and poisons ``avg``), while the
    aggregates here must skip missing values.
    """
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in float_columns(df)})


def fill_sentinel(value: Column, sentinel: float = SENTINEL) -> Column:
    """Replace NULL, NaN and both infinities by a sentinel."""
    # NaN sorts above infinity in Spark, so one comparison covers NaN, infinities and NULL.
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(sentinel))


def sentinel_fill(df: DataFrame, columns: Sequence[str] | None = None, sentinel: float = SENTINEL) -> DataFrame:
    """Apply :func:`fill_sentinel` to the given (default: all numeric) columns."""
    names = numeric_columns(df) if columns is None else columns
    return df.withColumns({c: fill_sentinel(F.col(c).cast("double"), sentinel) for c in names})


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns."""
    c = F.col(name)
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column and in total, from one scan."""
    names = list(columns or df.columns)
    counts = [F.sum(is_missing(df, c).cast("long")).alias(c) for c in names]
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return df.agg(*counts).select(*names, total.alias("total"))
