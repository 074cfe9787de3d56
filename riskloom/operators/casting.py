"""Narrower output types. Computation stays in double; only results are narrowed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

# Largest finite values of the floating types, and bounds of the integer types.
FLOAT_LIMITS = (65504.0, 3.4028234663852886e38)
INTEGER_TYPES = (
    ("byte", -(2**7), 2**7 - 1),
    ("short", -(2**15), 2**15 - 1),
    ("int", -(2**31), 2**31 - 1),
    ("long", -(2**63), 2**63 - 1),
)


def downcast_fixed(df: DataFrame, integers: Sequence[str] = (), skip: Sequence[str] = ()) -> DataFrame:
    """double becomes float; of the bigint columns, those named (counts) become int.

    Other integers may exceed the smaller type and stay.
    """
    kinds = {f.name: type(f.dataType) for f in df.schema if f.name not in set(skip)}
    casts = {c: F.col(c).cast("float") for c, kind in kinds.items() if kind is T.DoubleType}
    casts |= {c: F.col(c).cast("int") for c in integers if kinds[c] is T.LongType}
    return df.withColumns(casts)


def downcast_floats(df: DataFrame) -> DataFrame:
    """Every floating column to float (Spark has no half precision)."""
    casts = {f.name: F.col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(casts)


def value_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """Minimum and maximum of each column, from one scan."""
    ends = [e for c in columns for e in (F.min(c).alias(f"{c}\0lo"), F.max(c).alias(f"{c}\0hi"))]
    row = df.agg(*ends).first().asDict()
    return {c: (row[f"{c}\0lo"], row[f"{c}\0hi"]) for c in columns}


def smallest_type(kind: T.DataType, low, high) -> str | None:
    """Type name whose bounds strictly contain the range; None to leave the column."""
    if low is None:
        return None
    if isinstance(kind, T.IntegralType):
        return next((name for name, lo, hi in INTEGER_TYPES if low > lo and high < hi), None)
    fits = any(low > -limit and high < limit for limit in FLOAT_LIMITS)
    return "float" if fits else "double"


def downcast_by_range(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast each numeric column to the smallest type that strictly contains its values.

    Half precision is not a Spark type, so the smallest floating type is float.
    """
    kinds = {
        f.name: f.dataType
        for f in df.schema
        if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType))
        and (columns is None or f.name in set(columns))
    }
    if not kinds:
        return df
    casts = {}
    for name, (low, high) in value_ranges(df, list(kinds)).items():
        target = smallest_type(kinds[name], low, high)
        if target is not None:
            casts[name] = F.col(name).cast(target)
    return df.withColumns(casts)
