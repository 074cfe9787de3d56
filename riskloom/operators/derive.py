"""Features computed from the columns of one profile row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.arith import ieee_divide, round_half_even
from riskloom.functions.columns import bases_with, edge_float_columns


def last_mean_diff(df: DataFrame) -> DataFrame:
    """``{b}_last_mean_diff`` for every base with a last and a mean."""
    return df.withColumns(
        {f"{b}_last_mean_diff": F.col(f"{b}_last") - F.col(f"{b}_mean") for b in bases_with(df, "mean")}
    )


def last_mean_rate(df: DataFrame, on_zero: str = "ieee") -> DataFrame:
    """``{b}_last_mean_rate`` for every base with a last and a mean."""
    return df.withColumns(
        {
            f"{b}_last_mean_rate": ieee_divide(F.col(f"{b}_last"), F.col(f"{b}_mean"), on_zero)
            for b in bases_with(df, "mean")
        }
    )


def last_first_diff(df: DataFrame) -> DataFrame:
    """``{b}_last_first_diff`` for every base with a last and a first."""
    return df.withColumns(
        {f"{b}_last_first_diff": F.col(f"{b}_last") - F.col(f"{b}_first") for b in bases_with(df, "first")}
    )


def round_features(df: DataFrame, digits: int = 2) -> DataFrame:
    """``{c}_round{digits}`` for floating first/last columns, rounded half to even."""
    return df.withColumns(
        {f"{c}_round{digits}": round_half_even(F.col(c), digits) for c in edge_float_columns(df)}
    )


def pair_features(df: DataFrame, before: Sequence[str], after: Sequence[str]) -> DataFrame:
    """``{b}-{p}`` and ``{b}X{p}`` for each pair whose columns exist."""
    present = set(df.columns)
    made: dict[str, Column] = {}
    for b in (c for c in before if c in present):
        for p in (c for c in after if c in present):
            made[f"{b}-{p}"] = F.col(b) - F.col(p)
            made[f"{b}X{p}"] = F.col(b) * F.col(p)
    return df.withColumns(made)


@dataclass(frozen=True)
class Sum:
    """A signed sum of columns plus an offset."""

    terms: Mapping[str, float]
    offset: float = 0.0

    def column(self, suffix: str) -> Column:
        parts = [F.col(f"{n}{suffix}") * F.lit(float(s)) for n, s in self.terms.items()]
        total = sum(parts[1:], parts[0])
        return total + F.lit(self.offset) if self.offset else total


@dataclass(frozen=True)
class Ratio:
    """``top / bottom``, or only ``top`` when there is no bottom."""

    top: Sum
    bottom: Sum | None = None

    def bases(self) -> list[str]:
        return [*self.top.terms, *(self.bottom.terms if self.bottom else ())]


# The pay-after pairs and the named ratios of the shipped feature set.
PAY_BEFORE = ("B_9", "B_11", "B_14", "B_17", "D_39", "D_131", "S_16", "S_23")
PAY_AFTER = ("P_2", "P_3")
NAMED_RATIOS: dict[str, Ratio] = {
    "c_PD_239": Ratio(Sum({"D_39": 1}), Sum({"P_2": -1}, 0.0001)),
    "c_PB_29": Ratio(Sum({"P_2": -1}), Sum({"B_9": 1}, 0.0001)),
    "c_PR_21": Ratio(Sum({"P_2": -1}), Sum({"R_1": 1}, 0.0001)),
    "c_BBBB": Ratio(Sum({"B_9": 1}, 0.001), Sum({"B_23": 1, "B_3": 1}, 0.0001)),
    "c_BBBB1": Ratio(Sum({"B_33": -1, "B_18": -1, "S_25": 1}, 0.0001)),
    "c_BBBB2": Ratio(Sum({"B_19": 1, "B_20": 1, "B_4": 1}, 0.0001)),
    "c_RRR0": Ratio(Sum({"R_3": 1}, 0.001), Sum({"R_2": 1, "R_4": 1}, 0.0001)),
    "c_RRR1": Ratio(Sum({"D_62": 1}, 0.001), Sum({"D_112": 1, "R_27": 1}, 0.0001)),
    "c_PD_348": Ratio(Sum({"D_48": 1}), Sum({"P_3": 1}, 0.0001)),
    "c_PD_355": Ratio(Sum({"D_55": 1}), Sum({"P_3": 1}, 0.0001)),
    "c_PD_439": Ratio(Sum({"D_39": 1}), Sum({"P_4": 1}, 0.0001)),
    "c_PB_49": Ratio(Sum({"B_9": 1}), Sum({"P_4": 1}, 0.0001)),
    "c_PR_41": Ratio(Sum({"R_1": 1}), Sum({"P_4": 1}, 0.0001)),
}


def ratio_features(
    df: DataFrame, ratios: Mapping[str, Ratio] = NAMED_RATIOS, suffix: str = "_last", on_zero: str = "ieee"
) -> DataFrame:
    """Add the ratios whose input columns (``{base}{suffix}``) all exist."""
    present = set(df.columns)
    made = {}
    for name, ratio in ratios.items():
        if all(f"{b}{suffix}" in present for b in ratio.bases()):
            top = ratio.top.column(suffix)
            made[name] = ieee_divide(top, ratio.bottom.column(suffix), on_zero) if ratio.bottom else top
    return df.withColumns(made)
