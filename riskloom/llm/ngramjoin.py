"""Jaccard join of texts on word n-grams by vertical partitioning, and the classes its links form.

All n-grams have one global order, cut into ``STRIPS`` fragments by the leading bits of their
hashes. The first ``COUNTED`` fragments are ordered by how many texts hold
an n-gram, rarest first; the others follow by hash. Two sets that reach the
similarity share one of the first n-grams of either, which makes the candidates. The sketches of two sets bound what they can share; for the pairs left, the overlap of each part of the order is counted separately
and summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.llm.common import filled_id, spread_join, written
from riskloom.llm.linking import beside, different_texts, digest_of, gram_hashes, hashing, key_of, linked, needed, sketch_of, strips_of, words_of
from riskloom.session import shuffle_partitions

#: Fragments of the order that are ordered by frequency, and the hash at which the others begin.
COUNTED = 32
FIRST_UNCOUNTED = COUNTED << 57

#: Documents looked at to find n-grams that too many texts hold for one task.
SAMPLE_DOCS = 2_000


def first_grams(n: int, percent: int) -> int:
    """How many of a set's first n-grams it shows: one of them is shared with any set that reaches the similarity."""
    return n - -(-n * percent // 100) + 1


def _signed(width: int, seed: int, percent: int):
    """Per text: key and digest of its word sequence, its number of n-grams, their number in the counted fragments, its sketch, and the
    n-grams of the counted fragments with what is missing to those it must show. Of copies within a task only the first shows any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word_hash = hashing()
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = words_of(text)
                if not words:
                    out.append((None, None, 0, None, None, None))
                    continue
                hashes = gram_hashes(words, width, word_hash)
                counted = int(strips_of(hashes)[:COUNTED].sum())
                digest, shown = digest_of(words, seed), None
                if digest not in seen:
                    seen.add(digest)
                    shown = hashes[: max(counted, first_grams(len(hashes), percent))].view(np.int64)
                out.append((key_of(digest), digest, len(hashes), counted, sketch_of(hashes), shown))
            batch = batch.drop(columns="text")
            yield beside(batch, ["key", "digest", "n_shingles", "counted", "sketch", "shown"], out)

    return run


def _hot_grams(signed: DataFrame, total: int) -> list[int]:
    """n-grams that hold more than half of a partition's worth of all rows, judged by a sample of fixed size."""
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    counted = signed.sample(share, seed=7).select(F.explode("shown").alias("shingle")).groupBy("shingle").count()
    least = counted.agg(F.sum("count")).first()[0] or 0
    least = max(100, least / (2 * shuffle_partitions(signed.sparkSession)))
    return [r.shingle for r in counted.where(F.col("count") >= least).collect()]


def _counted(rows: DataFrame, hot: list[int]) -> DataFrame:
    """(``shingle``, ``key``, ``often``): the different rows of n-grams that several texts hold, and how many hold them.

    Rows are exchanged once, by n-gram; an n-gram of very many texts is dealt to many tasks. Most n-grams have one text and go first.
    """
    group = ["shingle", "deal"]
    deal = F.when(F.col("shingle").isin(hot), F.pmod(F.xxhash64("key"), F.lit(64))).otherwise(F.lit(0)) if hot else F.lit(0)
    each = rows.withColumn("deal", deal.cast("int"))
    window = Window.partitionBy(*group)
    several = (F.min("key").over(window) != F.max("key").over(window)) | (F.col("shingle").isin(hot) if hot else F.lit(False))
    each = each.withColumn("several", several).where("several").select(*group, "key").distinct()
    if not hot:
        return each.withColumn("often", F.count("*").over(window)).select("shingle", "key", "often")
    dealt = written(each.withColumn("held", F.count("*").over(window)))
    # At most two n-grams a partition.
    often = dealt.where(F.col("shingle").isin(hot)).groupBy("shingle").agg(F.count("*").alias("often"))
    joined = dealt.join(F.broadcast(often), "shingle", "left")
    return joined.select("shingle", "key", F.coalesce("often", "held").alias("often")).where("often > 1")


def _prefixes(counted: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(``shingle``, ``key``, ``n``, ``at``, ``up``): the n-grams a set shows, with their places in its order.

    n-grams that no other text holds come first and meet nothing, so only their number matters. Uncounted ones take the place of the
    first of them, which is never too late. ``up`` marks
    those shown to sets that are as large or larger: with these more must be shared, so fewer are shown.
    """
    late = (F.col("shingle") < 0) | (F.col("shingle") >= FIRST_UNCOUNTED)
    ordered = F.sort_array(F.collect_list(F.struct(late.alias("late"), F.when(late, 0).otherwise(F.col("often")).alias("often"), "shingle")))
    own = counted.groupBy("key").agg(ordered.alias("grams"), F.count_if(~late).alias("shared"))
    met = own.join(nodes.select("key", "n", "counted"), "key")
    each = met.select("key", "n", "counted", (F.col("counted") - F.col("shared")).alias("alone"), F.posexplode("grams").alias("i", "gram"))
    at = F.least(F.col("alone") + F.col("i"), F.col("counted")).cast("int")
    placed = each.select("key", "n", F.col("gram.shingle").alias("shingle"), at.alias("at"))
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    first_up = F.col("n") - needed(F.col("n"), F.col("n"), percent) + 1
    return placed.where(F.col("at") < first).withColumn("up", F.col("at") < first_up)


def ngram_join(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, percent: int = 85
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Link texts whose sets of word n-grams have a Jaccard similarity of ``percent`` / 100 or more; exact.

    Returns ``(members, classes, links)``. ``members``: one row per row of ``docs``, ``row`` (a number), ``doc_id``, ``key`` (of its word sequence,
    NULL without words), ``n_shingles``. ``classes``: one row per different word sequence, ``key``, ``root`` (one for
    each class), ``component_id`` (smallest doc_id of the class, NULL if none has an id). ``links``:
    pairs of keys that reach the similarity, with their ``overlap``. Pairs that other links connect already are not compared,
    so ``links`` connects every class without listing all its pairs.

    1. Equal word sequences are one key, however many copies there are.
    2. Keys meet by the first n-grams of the global order (module docstring), in rounds (``linked``), so that a large group of near
       copies costs a few pairs a key.
    3. Overlaps are counted part by part on the full sets and summed per pair.

    NULL, empty and blank texts have no n-grams and link with nothing. Repeated rows and equal or missing ids stay rows of
    their own; other columns are not read. Texts are read whole. An empty table gives empty results. Keys are
    64-bit hashes of 128-bit digests, drawn anew should two digests share one.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    doc_id, has_id = filled_id(docs, id_column)
    kind = docs.schema[id_column].dataType.simpleString()
    print = F.xxhash64(text).alias("print")
    rows = docs.select(doc_id.alias("doc_id"), has_id.alias("has_id"), print, text.alias("text"))
    schema = f"doc_id {kind}, has_id boolean, print long, key long, digest binary, n_shingles long, counted int, sketch array<long>, shown array<long>"

    def sign(seed: int) -> DataFrame:
        signed = rows.mapInPandas(_signed(width, seed, percent), schema)
        return signed.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")

    seed, signed, nodes = different_texts(sign, {"counted": F.min("counted")})
    hot = _hot_grams(signed, signed.count())
    shown = written(_prefixes(_counted(signed.select(F.explode("shown").alias("shingle"), "key"), hot), nodes, percent))
    classes, links = linked(nodes, shown, docs.select(print, text.alias("text")), width, percent, seed)
    return signed.select("row", "doc_id", "key", "n_shingles"), classes, links


def class_of_documents(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every document; without words, or ids in its class, its own id."""
    placed = spread_join(members.where("key is not null"), classes, ["key"], ["row"])
    own = F.coalesce("component_id", "doc_id").alias("component_id")
    blank = members.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.select("doc_id", "n_shingles", own).unionByName(blank)
