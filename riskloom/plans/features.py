"""From statements to model-ready profiles, in the order the steps depend on each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from riskloom.operators.casting import downcast_fixed
from riskloom.operators.derive import last_first_diff, last_mean_diff, last_mean_rate, ratio_features, round_features
from riskloom.operators.encode import apply_dictionary, fit_dictionary
from riskloom.operators.profile import profile
from riskloom.session import materialize


def statement_profiles(
    statements: DataFrame,
    key: str,
    time: str,
    tie: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    markers: Sequence[str] = (),
    with_gaps: bool = False,
    float32: bool = True,
    min_rows: int | None = None,
) -> DataFrame:
    """One profile row per key; with gaps and tenure when asked for, all from one scan and one exchange of the rows.

    A time given as text is parsed here, once, so that every step orders by the same clock.
    """
    statements = with_parsed_time(statements, time)
    result = profile(
        statements, key, [time, *tie], numeric, categorical, min_rows=min_rows,
        gap="SDist" if with_gaps else None, time=time if markers else None, markers=markers,
    )
    if float32:
        counts = [f"{c}_{s}" for c in categorical for s in ("count", "nunique")]
        result = downcast_fixed(result, integers=counts, skip=[key, "LT", time])
    return result


def with_parsed_time(df: DataFrame, time: str) -> DataFrame:
    """The time column as a timestamp without zone, if it is text (years, months and days need no leading zeros)."""
    if not isinstance(df.schema[time].dataType, T.StringType):
        return df
    return df.withColumn(time, F.col(time).cast("timestamp_ntz"))


def with_labels(profiles: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Attach labels, keeping profiles that have none."""
    return profiles.join(labels, key, "left")


def training_frame(
    profiles: DataFrame, categorical: Sequence[str], dictionary: DataFrame | None = None, unseen: str | int = "error"
) -> tuple[DataFrame, DataFrame]:
    """Derived features and category codes; returns the frame and the dictionary used.

    Without a dictionary (training) one is fitted; with one (scoring) it is applied. The profiles
    are computed once although fitting and applying both read them.
    """
    derived = round_features(materialize(profiles) if dictionary is None else profiles)
    for step in (last_mean_diff, last_mean_rate, last_first_diff, ratio_features):
        derived = step(derived)
    used = fit_dictionary(derived, categorical) if dictionary is None else dictionary
    return apply_dictionary(derived, used, categorical, unseen), used
