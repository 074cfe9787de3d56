"""Column choice by name and type, from the schema alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from riskloom.functions.missing import float_columns, numeric_columns


def edge_float_columns(df: DataFrame) -> list[str]:
    """Floating columns that hold a first or last value."""
    return [c for c in float_columns(df) if "last" in c or "first" in c]


def bases_with(df: DataFrame, partner: str, anchor: str = "last") -> list[str]:
    """Base names with numeric ``{base}_{anchor}`` and ``{base}_{partner}`` columns."""
    names = numeric_columns(df)
    suffix = f"_{anchor}"
    bases = [c.removesuffix(suffix) for c in names if c.endswith(suffix) and "round" not in c]
    return [b for b in bases if f"{b}_{partner}" in names]


def project(
    df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = (), missing: str = "error"
) -> DataFrame:
    """Keep a chosen list of names, or everything but the dropped ones.

    Both are plain projections, so the parquet scan reads only what is kept. A name that the
    frame lacks is an error, unless ``missing="skip"``.
    """
    dropped, present = set(drop), set(df.columns)
    unknown = [c for c in [*(keep or []), *drop] if c not in present]
    if unknown and missing != "skip":
        raise ValueError(f"no such columns: {unknown}")
    names = df.columns if keep is None else [c for c in keep if c in present]
    return df.select(*[c for c in names if c not in dropped])


def common_names(chosen: Sequence[str], allowed: Sequence[str]) -> list[str]:
    """Chosen names that are also allowed, in chosen order."""
    permitted = set(allowed)
    return [c for c in chosen if c in permitted]
