"""Reading and writing the tables of the workflow: parquet, CSV, name lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, types as T

from riskloom.functions.missing import normalise_missing

LABEL_SCHEMA = T.StructType(
    [T.StructField("customer_ID", T.StringType()), T.StructField("target", T.IntegerType())]
)
PREDICTION_SCHEMA = T.StructType(
    [T.StructField("customer_ID", T.StringType()), T.StructField("prediction", T.DoubleType())]
)
OOF_SCHEMA = T.StructType([*LABEL_SCHEMA.fields, PREDICTION_SCHEMA["prediction"]])


def read_parquet(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """Parquet scan with NaN turned into NULL.

    ``keep`` selects rows. It is applied to the stored columns, so that the scan
    can skip row groups by it, and again after NaN became NULL.
    """
    stored = spark.read.parquet(path)
    if keep is None:
        return normalise_missing(stored)
    return normalise_missing(stored.where(keep)).where(keep)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV scan with a stated schema (no inference pass)."""
    return normalise_missing(
        spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink; ``partition_by=["chunk"]`` gives one folder per customer chunk."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with header, written by all tasks in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_names(spark: SparkSession, names: Sequence[str], path: str) -> None:
    """Save a feature list, keeping its order."""
    rows = [(i, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "position int, feature string").coalesce(1).write.mode("overwrite").parquet(path)


def read_names(spark: SparkSession, path: str) -> list[str]:
    """Load a feature list. It names columns of a plan, so it is short by nature."""
    return [r.feature for r in spark.read.parquet(path).orderBy("position").collect()]


def attach(wanted: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Put predictions beside the rows that ask for them, by key; NULL where there is none."""
    return wanted.join(predictions, key, "left")
