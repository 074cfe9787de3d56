"""Helpers shared by the operators: words, worker-wide memos, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.operators.skew import spread_join  # noqa: F401  (also used by the operators)
from riskloom.session import prepare, shared_folder

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Entries of one generation of a memo; two generations are held.
MEMO_ENTRIES = 250_000


#: What a Python task receives at once. Texts may be long and stand in rows in pairs, so bytes are bounded as well as rows.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings these operators rely on."""
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    return prepare(spark)


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that start within the block hand at most so many rows to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of ``df``, computed once into a parquet table of the shared folder.

    Used where several later jobs read the same rows. The table outlives lost
    executors, and later readers can skip columns, unlike with a row checkpoint. With ``folder`` (of
    ``session.scratch``), it goes when its readers are done.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a running sum takes at once.
STRETCH = 4096


def running_sums(df: DataFrame, key: str, at: str, sums: dict[str, Column]) -> DataFrame:
    """Add the running sum, in the order of ``at`` within ``key``, of every entry of ``sums``, its own row included.

    ``at`` is a number from 0 that no two rows of a key share. Sums run within stretches of ``STRETCH`` numbers and are
    shifted by the totals of the stretches before, so a key with very many rows is dealt to many tasks. ``df`` is read twice.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(at) / STRETCH))
    window = Window.partitionBy(key, "_stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({name: F.sum(value).over(window) for name, value in sums.items()})
    totals = cut.groupBy(key, "_stretch").agg(*[F.sum(v).alias(f"_all_{n}") for n, v in sums.items()])
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(key, "_stretch", *[F.sum(f"_all_{n}").over(before).alias(f"_shift_{n}") for n in sums])
    shifted = local.join(shifts.where("_stretch > 0"), [key, "_stretch"], "left")
    return shifted.withColumns({n: F.col(n) + F.coalesce(F.col(f"_shift_{n}"), F.lit(0)) for n in sums}).select(*df.columns, *sums)


def filled_id(docs: DataFrame, name: str) -> tuple[Column, Column]:
    """The id with 0 in place of NULL, and whether there was one: pandas would turn integers next to NULL into floats."""
    kind = docs.schema[name].dataType
    return F.coalesce(docs[name], F.lit("0").cast(kind)), docs[name].isNotNull()


def forget(family: str | None = None, objects: bool = False) -> None:
    """Let go of the memos of this Python worker, but for those of ``family``, with ``objects`` of what it loaded (``once``), and hand
    memory that is free back to the system.

    Tasks that remember nothing call it, as others' memos would stay. Workers outlive a stage, and what its tasks have freed would add to what the next one needs.
    """
    import ctypes
    import sys

    import pyarrow

    shelf = sys.__dict__.get("_riskloom_llm_memos", {})
    for old in [x for x, held in shelf.items() if held.family != family]:
        del shelf[old]
    if objects:
        sys.__dict__.get("_riskloom_llm_objects", {}).clear()
    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def memo(name: str, compute: Callable, entries: int = MEMO_ENTRIES, family: str | None = None):
    """A memo of ``compute`` that tasks of one Python worker share and that never exceeds two generations.

    A full generation becomes the old one and a new one begins, so frequent keys
    stay. Lookups of young keys run at the speed of a dict. ``name`` tells what is computed, so whatever the results depend on
    is part of it. Only memos of one ``family`` (by default the name) are held at a time: workers outlive a stage, and what the last one
    remembered is of no use to the next.
    """
    import sys

    class Memo(dict):
        __slots__ = ("old", "compute", "family")

        def __missing__(self, key):
            value = self.old.get(key)
            if value is None:
                value = self.compute(key)
            if len(self) >= entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
            return value

    shelf = sys.__dict__.setdefault("_riskloom_llm_memos", {})
    if name not in shelf:
        forget(family or name)
        shelf[name] = Memo()
        shelf[name].old = {}
        shelf[name].compute = compute
        shelf[name].family = family or name
    return shelf[name]


def once(name: str, make: Callable):
    """An object that tasks of one Python worker share, such as a loaded vocabulary."""
    import sys

    shelf = sys.__dict__.setdefault("_riskloom_llm_objects", {})
    if name not in shelf:
        shelf[name] = make()
    return shelf[name]
