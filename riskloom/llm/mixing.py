"""Mix sources to target weights by repeating or thinning their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.llm.common import WORD

#: No source, and hence no document, is repeated more often than this.
MAX_RATE = 3


def word_count(text: Column) -> Column:
    """Words of a text; NULL counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bernoulli_draw(id_column: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the seed and the document's id (by its text where it has no id)."""
    name = F.coalesce(id_column.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    leading = F.substring(F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")), 1, 8)
    return F.conv(leading, 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources: (source, source_size) in; (source, source_size, target) out.

    Sources in code-point order, NULL last, weigh 1, 2, 3, 1, ... and share the
    total size. A target stops at ``MAX_RATE`` times its source's size; what
    is left over goes to the others by weight, until none is above its limit.
    That end state has a closed form: targets are min(limit, level * weight) for
    one level, and a source is at its limit iff pouring up to its own level
    needs no more than the total. One row per source meets in one task here,
    after aggregation; documents never do.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn(
        "limit", F.col("source_size") * F.lit(float(MAX_RATE))
    )
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = filling.rowsBetween(Window.unboundedPreceding, 0)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    heavier = F.sum("weight").over(everything) - F.sum("weight").over(upto)
    poured = F.sum("limit").over(upto) + F.col("limit") / F.col("weight") * heavier
    full = weighed.withColumns({"total": total, "full": poured <= total})
    spent = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)
    sharing = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    level = full.withColumn("level", (F.col("total") - spent) / F.nullif(sharing, F.lit(0.0)))
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("level") * F.col("weight"))
    return level.select("source", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """How often each document enters the mix.

    Returns one row per row of ``docs``: ``doc`` (all its columns as a
    struct, so names cannot clash), ``size`` (words), ``source_size``,
    ``target`` and ``copies``. A source's rate is its target over its size; a
    document gets floor(rate) copies and one more with the remaining
    fraction as probability, drawn from seed and id.

    NULL and empty texts have size 0 and get copies like any other; NULL is a
    source of its own; a source without words has target 0 and no copies.
    Repeated rows share their draw. An empty table gives an empty plan. Words
    are summed before the exchange, so a source with most rows is no hot key;
    the join is with one row per source.
    """
    sized = docs.select(
        F.struct("*").alias("doc"),
        docs[source_column].alias("source"),
        word_count(docs[text_column]).alias("size"),
        bernoulli_draw(docs[id_column], docs[text_column], seed).alias("draw"),
    )
    totals = docs.select(docs[source_column].alias("source"), word_count(docs[text_column]).alias("size"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("size").alias("source_size")))
    named = targets.withColumnRenamed("source", "of_source")
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("of_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + F.when(F.col("draw") < rate - whole, 1).otherwise(0)
    return joined.select("doc", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as planned."""
    plan = mix_plan(docs, **options).where("copies > 0")
    return plan.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
