"""Profiles and scores as tables with a part per chunk of keys, and models applied from their saved folder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.columns import project
from riskloom.operators.folds import assign_chunks
from riskloom.plans.learn import ModelBundle, average_folds
from riskloom.sources.files import read_names, read_parquet, write_parquet

CHUNK = "chunk"


def with_chunks(profiles: DataFrame, statements: DataFrame, key: str, n: int) -> DataFrame:
    """Profiles with the number of their chunk: ``n`` contiguous, balanced blocks of the keys of ``statements``.

    Chunks are numbered once, from the keys alone, and meet the profiles in one join, whatever ``n`` is.
    """
    return profiles.join(assign_chunks(statements, key, n), key)


def write_chunks(rows: DataFrame, path: str) -> None:
    """All chunks in one job, a folder for each."""
    write_parquet(rows, path, [CHUNK])


def read_chunks(spark: SparkSession, path: str, wanted: Sequence[int] | None = None) -> DataFrame:
    """The table of chunks; with ``wanted``, only their folders are read."""
    return read_parquet(spark, path, None if wanted is None else F.col(CHUNK).isin(list(wanted)))


def score_chunks(
    profiles: DataFrame, bundle_path: str, features: Sequence[str], id: str, nominal: Mapping[str, int] | None = None
) -> DataFrame:
    """``(id, chunk, prediction)`` by the fold models of a saved bundle, one narrow pass over all chunks."""
    bundle = ModelBundle.load(profiles.sparkSession, bundle_path)
    carried = [c for c in (id, CHUNK) if c in profiles.columns]
    return average_folds(bundle.models, profiles, features, nominal).select(*carried, "prediction")


def selected_columns(table: DataFrame, list_path: str, always: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The columns of a saved feature list (and those ``always`` kept) of a table, and the names of the features.

    A plain projection, so the scan reads nothing else. A feature that the table lacks is an error.
    """
    names = read_names(table.sparkSession, list_path)
    return project(table, [*always, *names]), names
