"""Dictionary encoding: sorted distinct values of a column become codes 0..n-1, missing last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from riskloom.operators.ordering import ranked
from riskloom.operators.skew import DEALS, row_floor, sample_fraction
from riskloom.session import materialize, shuffle_partitions

# A column's dictionary up to this many entries is ranked by one task.
SMALL_DICTIONARY = 100_000

# Dictionaries that together hold so many bytes and entries at most are handed to every task.
BROADCAST_BYTES = 32 * 1024 * 1024
BROADCAST_ENTRIES = 200_000

# Where the parts of a decimal are compared exactly, whatever its precision and scale.
WHOLE, FRACTION = "decimal(38,0)", "decimal(38,38)"

LINE = ("integer", "whole", "fraction", "number", "value")


def _text(df: DataFrame, column: str) -> Column:
    """The value as text; NULL for missing values, NaN included."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    return value.cast("string")


def _line(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Numbers that sort the entries (``feature``, ``value``), read back from the text: exact for integers and decimals, else a double."""
    kinds = {c: df.schema[c].dataType for c in columns}

    def read(these: type | tuple, as_number) -> list[Column]:
        own = {c: k for c, k in kinds.items() if isinstance(k, these)}
        return [F.when(F.col("feature") == c, as_number(F.col("value").try_cast(k))) for c, k in own.items()]

    def one_of(found: list[Column], kind: str) -> Column:
        return F.coalesce(*found, F.lit(None).cast(kind))

    return {
        "integer": one_of(read(T.IntegralType, lambda v: v.cast("bigint")), "bigint"),
        "whole": one_of(read(T.DecimalType, lambda v: F.floor(v).cast(WHOLE)), WHOLE),
        "fraction": one_of(read(T.DecimalType, lambda v: (v - F.floor(v)).cast(FRACTION)), FRACTION),
        "number": one_of(read((T.FloatType, T.DoubleType), lambda v: v.cast("double")), "double"),
    }


def fit_dictionary(df: DataFrame, columns: Sequence[str], small: int = SMALL_DICTIONARY) -> DataFrame:
    """``(feature, value, code)`` for all columns, from one pass over the table.

    Values collapse on the map side before anything is exchanged, and the distinct
    entries are kept, so the table is read once. Their number decides how they are ranked: one window per column while it is small,
    the distributed rank otherwise, which is done once, however often the dictionary is read.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _text(df, c).alias("value")) for i, c in enumerate(columns)]))
    texts = df.select(entries.alias("e")).select("e.*").distinct()
    distinct = materialize(texts.select(F.get(F.lit(list(columns)), F.col("i")).alias("feature"), "value")).withColumns(_line(df, columns))
    largest = distinct.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    if largest <= small:
        order = Window.partitionBy("feature").orderBy(*[F.col(c).asc_nulls_last() for c in LINE])
        code = F.row_number().over(order).cast("long") - 1
        return distinct.select("feature", "value", code.alias("code"))
    # Buckets are cut along one double; the exact numbers decide within them.
    near = F.coalesce("number", F.col("integer").cast("double"), F.col("whole").cast("double"), F.lit(0.0))
    near = F.when(F.col("value").isNull(), F.lit(float("inf"))).otherwise(near)
    line = [near, F.col("value").isNull().cast("int"), *[F.coalesce(c, F.lit(0)) for c in LINE[:3]], F.col("value")]
    placed = ranked(distinct, line, by=["feature"])
    return materialize(placed.select("feature", "value", (F.col("rank") - 1).alias("code")))


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    """Write a fitted dictionary as parquet."""
    dictionary.write.mode("overwrite").parquet(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _split_by_size(dictionary: DataFrame, columns: Sequence[str], most_bytes: int) -> tuple[list[str], list[str]]:
    """Columns whose dictionaries fit into tasks together, smallest first, and the others."""
    size = F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + F.lit(32))
    rows = dictionary.groupBy("feature").agg(size.alias("size"), F.count("*").alias("n")).collect()
    sizes = {r.feature: (r.size, r.n) for r in rows}
    small, bytes_left, entries_left = [], most_bytes, BROADCAST_ENTRIES
    for c in sorted(columns, key=lambda c: sizes.get(c, (0, 0))):
        size, n = sizes.get(c, (0, 0))
        if size > bytes_left or n > entries_left:
            break
        small.append(c)
        bytes_left, entries_left = bytes_left - size, entries_left - n
    return small, [c for c in columns if c not in set(small)]


def apply_dictionary(
    df: DataFrame,
    dictionary: DataFrame,
    columns: Sequence[str],
    unseen: str | int = "error",
    broadcast_bytes: int = BROADCAST_BYTES,
    key: str | None = None,
) -> DataFrame:
    """Replace each column by its code, all columns in one pass.

    ``unseen="error"`` fails on a value the dictionary lacks; a number is used as the code of such values.
    Dictionaries whose measured sizes fit together are looked up in the tasks, without a join. The columns
    of all others are unfolded into one long form that meets its entries in one exchange, values that fill the table dealt
    out, and the codes of a row return to it by ``key``, a column that is unique and not NULL. Without one, the rows are
    numbered and kept first.
    """
    names = df.columns
    small, large = _split_by_size(dictionary, columns, broadcast_bytes)
    texts = {c: _text(df, c) for c in columns}

    def settled(column: str, code: Column, original: Column) -> Column:
        if unseen == "error":
            message = F.concat(F.lit(f"value not in the dictionary of {column}: "), F.coalesce(original.cast("string"), F.lit("NULL")))
            return F.coalesce(code, F.raise_error(message).cast("long"))
        return F.coalesce(code, F.lit(int(unseen)).cast("long"))

    if large:
        row = key
        if row is None:
            row = "_row" + "_" * max(map(len, names))  # no column has this name
            df = materialize(df.withColumn(row, F.monotonically_increasing_id()))
        # A missing value is a value of its own, marked by the empty prefix.
        marked = lambda value: F.coalesce(F.concat(F.lit("="), value), F.lit(""))
        cells = F.array(*[F.struct(F.lit(i).alias("i"), marked(texts[c]).alias("value")) for i, c in enumerate(large)])
        long = df.select(F.col(row).alias("_id"), F.explode(cells).alias("cell")).select("_id", "cell.*")
        place = (F.array_position(F.lit(list(large)), F.col("feature")) - 1).cast("int").alias("i")
        entries = dictionary.where(F.col("feature").isin(large)).select(place, marked(F.col("value")).alias("value"), "code")
        # The cells of a row meet again in one exchange, before any is aggregated.
        hot = _hot_cells(df, cells, len(large))
        met = _met(long, entries, hot).select("_id", "i", "code").repartition("_id")
        codes = [F.max(F.when(F.col("i") == i, F.col("code"))).alias(f"_code_{c}") for i, c in enumerate(large)]
        df = df.join(met.groupBy("_id").agg(*codes).withColumnRenamed("_id", row), row)
    looked, found = _looked_up(df.withColumns({f"_text_{c}": texts[c] for c in small}), dictionary, small) if small else (df, {})
    found |= {c: F.col(f"_code_{c}") for c in large}
    return looked.select(*[settled(c, found[c], F.col(c)).alias(c) if c in found else F.col(f"`{c}`") for c in names])


def _hot_cells(df: DataFrame, cells: Column, n: int) -> list[int]:
    """Hashes of cells that hold more than a partition's worth of all, judged by a sample of rows of fixed size; at most two a partition."""
    floor, parts = row_floor(None), shuffle_partitions(df.sparkSession)
    total = df.count() * n
    if total < floor:
        return []
    fraction = sample_fraction(total, parts)
    seen = df.sample(fraction, seed=7).select(F.explode(cells).alias("cell")).groupBy(F.xxhash64("cell.i", "cell.value").alias("_cell")).count()
    return [r[0] for r in seen.where(F.col("count") >= 0.5 * max(floor, total / parts) * fraction).collect()]


def _met(long: DataFrame, entries: DataFrame, hot: Sequence[int]) -> DataFrame:
    """The cells (``_id``, ``i``, ``value``) with their codes. Cells are exchanged once, and those of values that fill the table dealt out.

    They are sorted by a hash first, which tells nearly all of them apart without a look at the texts.
    """
    cell = F.xxhash64("i", "value")
    long, entries = long.withColumn("_cell", cell), entries.withColumn("_cell", cell)
    if not hot:
        return long.join(entries, ["_cell", "i", "value"], "left")
    is_hot = F.col("_cell").isin(list(hot))
    dealt = long.withColumn("_deal", F.when(is_hot, F.pmod(F.xxhash64("_id"), F.lit(DEALS)).cast("int")).otherwise(0))
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))).alias("_deal")
    return dealt.join(entries.select("*", copies), ["_cell", "i", "value", "_deal"], "left")


def _looked_up(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Codes of small dictionaries, by one multi-column indexer whose labels stand in the order of their codes."""
    entries: dict[str, dict] = {c: {} for c in columns}
    for r in dictionary.where(F.col("feature").isin(list(columns))).collect():
        entries[r.feature][r.value] = r.code
    missing = {c: e.pop(None, None) for c, e in entries.items()}
    labels = {c: sorted(e, key=e.get) for c, e in entries.items()}
    texts, places = [f"_text_{c}" for c in columns], [f"_place_{c}" for c in columns]
    model = StringIndexerModel.from_arrays_of_labels([labels[c] or [""] for c in columns], texts, places, handleInvalid="keep")
    found = {}
    for c in columns:
        place = F.col(f"_place_{c}").cast("int")
        codes = [entries[c][v] for v in labels[c]]
        code = place.cast("long") if codes == list(range(len(codes))) else F.get(F.lit(codes), place).cast("long")
        known = F.when(place < len(codes), code)
        found[c] = F.when(F.col(f"_text_{c}").isNull(), F.lit(missing[c]).cast("long")).otherwise(known)
    return model.transform(df), found
