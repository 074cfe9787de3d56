"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of ``BLOCK`` turns. Conversations are grouped by the prefixes that end with a
block; only where different blocks follow one prefix are turns looked at, to find where between its ends they part.
Where a single block follows, its inner turns have the members of the block.

A prefix is known by a sum of hashes that bind every turn to its place, so sums of stretches of a long conversation
add up to those of the whole, and no task needs a whole conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.llm.common import running_sums, spread_join, written
from riskloom.operators.skew import SLICE, hot_groups, with_slices

#: Turns of a block.
BLOCK = 4

#: Ids that are joined to one text before the texts of a node meet.
RUN = 4_096

#: Four sums of 32-bit pieces; a bigint holds those of 2^31 turns.
MARKS = ("m0", "m1", "m2", "m3")

NODE = ["x", "y"]


def numbered_turns(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv_id``, ``at``, ``digest``, ``bytes``): the turns of every conversation, numbered from 0 in the order of ``turn``.

    NULL comes first; turns of equal number follow the digests of their role and text. A NULL role or text is empty. Rows without
    a conversation are left out. A conversation with very many turns is numbered slice by slice.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said).cast("binary"))
    rows = table.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.unhex(digest).alias("digest"),
        F.octet_length(said).cast("long").alias("bytes"),
    )
    hot = hot_groups(rows, "conv_id")
    sliced, cut = with_slices(rows, "conv_id", [F.col("turn"), F.col("digest")], hot)
    group = ["conv_id", SLICE] if cut else ["conv_id"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("turn").asc_nulls_first(), "digest")).cast("long") - 1
    numbered = sliced.withColumn("at", place)
    if cut:
        # One row per slice of a hot conversation; slices count from the end.
        before = Window.partitionBy("conv_id").orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sliced.where(F.col("conv_id").isin(list(hot.rows))).groupBy(*group).count()
        shifts = sizes.select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
        numbered = numbered.join(F.broadcast(shifts), group, "left").withColumn("at", F.col("at") + F.coalesce("shift", F.lit(0)))
    return numbered.select("conv_id", "at", "digest", "bytes")


def with_shared_heads(turns: DataFrame, family: int, most: int, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``head`` (at most ``most``) turns of the first conversation of their family.

    The family of conversation c begins with c - c % ``family``; ``head`` is a column of ``conv_id``. Its own turns follow
    after the first ``head`` of them. Returns the turns, renumbered, and (``conv_id``, ``length``) of all conversations, turnless ones included.
    """
    turns = written(turns)
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    asked = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % family).alias("first"), head.cast("long").alias("head"))
    firsts = own.toDF("first", "given")
    shared = F.least("head", F.coalesce("given", F.lit(0)))
    convs = asked.join(firsts, "first", "left").select("conv_id", "first", "head", shared.alias("shared"), "own")
    convs = written(convs.withColumn("length", F.col("shared") + F.greatest(F.col("own") - F.col("head"), F.lit(0))))
    # At most ``most`` turns of a first conversation go to at most ``family`` others.
    heads = turns.where(F.col("at") < most).withColumnRenamed("conv_id", "first")
    lent = heads.join(convs.select("conv_id", "first", "shared"), "first").where(F.col("at") < F.col("shared"))
    kept = spread_join(turns, convs.select("conv_id", "head", "shared"), ["conv_id"], ["at"]).where(F.col("at") >= F.col("head"))
    kept = kept.withColumn("at", F.col("at") - F.col("head") + F.col("shared"))
    names = ["conv_id", "at", "digest", "bytes"]
    return lent.select(*names).unionByName(kept.select(*names)), convs.select("conv_id", "length")


def _node(*sums: Column | str) -> list[Column]:
    """The two halves of a prefix's id, from its four sums."""
    return [F.xxhash64(*sums, F.lit(0)).alias("x"), F.xxhash64(F.lit(1), *reversed(sums)).alias("y")]


def _blocks(turns: DataFrame) -> DataFrame:
    """One row per block of a conversation: ``k``, ids of the prefixes before and after it, and its inner prefixes."""
    place = F.md5(F.concat(F.col("at").cast("string").cast("binary"), F.col("digest")))
    marks = [F.conv(F.substring(place, 8 * i + 1, 8), 16, 10).cast("long").alias(m) for i, m in enumerate(MARKS)]
    marked = turns.select("conv_id", "at", F.floor(F.col("at") / BLOCK).alias("k"), "bytes", *marks)
    inner = F.sort_array(F.collect_list(F.struct("at", "bytes", *MARKS)))
    blocks = written(marked.groupBy("conv_id", "k").agg(inner.alias("turns"), *[F.sum(m).alias(m) for m in MARKS]))
    run = running_sums(blocks, "conv_id", "k", {f"s{i}": F.col(m) for i, m in enumerate(MARKS)})
    before = [(F.col(f"s{i}") - F.col(m)).alias(f"b{i}") for i, m in enumerate(MARKS)]
    after = [c.alias(n) for c, n in zip(_node("s0", "s1", "s2", "s3"), NODE, strict=True)]
    placed = run.select("conv_id", "k", "turns", *before, *after)
    return placed.select("*", *[c.alias(n) for c, n in zip(_node("b0", "b1", "b2", "b3"), ["bx", "by"], strict=True)])


def _unfolded(groups: DataFrame, sums: list[str], least: list[str]) -> DataFrame:
    """Nodes of the turns in groups of blocks, with sums and least values over the groups that hold the turn.

    Blocks without siblings (``alone``) lend theirs to their turns; only the others are grouped turn by turn.
    """

    def upto(i: int, size: Column) -> Column:
        start = F.col(f"b{i}")
        return F.aggregate(F.slice("turns", F.lit(1), size), start, lambda total, t: total + t[MARKS[i]])

    carried = [*sums, *least]
    each = groups.select("alone", "turns", "b0", "b1", "b2", "b3", *carried, F.posexplode("turns").alias("i", "turn"))
    each = each.select(
        "alone", *carried, (F.col("turn.at") + 1).alias("depth"), F.col("turn.bytes").alias("bytes"),
        *[upto(i, F.col("i") + 1).alias(f"s{i}") for i in range(4)], *[upto(i, F.col("i")).alias(f"p{i}") for i in range(4)],
    )
    parent = [c.alias(n) for c, n in zip(_node("p0", "p1", "p2", "p3"), ["px", "py"], strict=True)]
    each = each.select("alone", *carried, "depth", "bytes", *_node("s0", "s1", "s2", "s3"), *parent)
    same = ["depth", "bytes", "px", "py"]
    parted = each.where(~F.col("alone")).groupBy(*NODE).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in [*least, *same]]
    )
    names = [*NODE, *sums, *least, *same]
    return each.where("alone").select(*names).unionByName(parted.select(*names))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of sorted ids of one node, as text."""
    for batch in batches:
        out = []
        for (x, y), ids in batch.groupby(NODE, sort=False)["conv_id"]:
            values = ids.tolist()
            out += [(x, y, values[i], ",".join(map(str, values[i : i + RUN]))) for i in range(0, len(values), RUN)]
        yield pd.DataFrame(out, columns=["x", "y", "first", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of every node's runs, which come in order."""
    import hashlib

    node, state = None, None
    for batch in batches:
        out = []
        for x, y, ids in zip(batch["x"], batch["y"], batch["ids"], strict=True):
            if (x, y) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (x, y), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["x", "y", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["x", "y", "ends_sha256"])


def hash_of_ends(ends: DataFrame) -> DataFrame:
    """(``x``, ``y``, ``ends_sha256``) from (``conv_id``, ``x``, ``y``): the hash of a node's ids, ascending, joined by commas.

    Ids are sorted over all tasks, a node's ids in as many as they need, and leave as runs of text;
    a node's runs are read one after the other, as the hash asks for, without being held.
    """
    ordered = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    runs = ordered.select(*NODE, "conv_id").mapInPandas(_chunks, "x long, y long, first long, ids string")
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(_hashed, "x long, y long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns, from the empty one: the trie of all conversations.

    ``turns``: (``conv_id``, ``at`` from 0 without gaps, ``digest``, ``bytes``); ``convs``: (``conv_id``, ``length``) of all
    conversations, those without turns included. Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (NULL at the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``, as the query's contract names them.

    A node belongs to its smallest member. Every node's sums over its subtree are sums over its members: of what
    each member owns, less what the smallest member owns above the node. So they need no walk over the levels:
    the grouping by blocks is done once for the members' numbers and once for what they own.
    Copies of a conversation, a shared first turn or a very long conversation are ordinary rows of partial aggregates. No
    conversations: no rows. Other columns than the named ones are not read.
    """
    paths = written(_blocks(turns))
    held = paths.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first(F.struct("turns", "b0", "b1", "b2", "b3", "bx", "by")).alias("block")
    )
    groups = written(held.select(*NODE, "n_convs", "conv_id", "block.*"))
    siblings = groups.groupBy("bx", "by").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"))
    alone = siblings.where("n = 1").select("x", "y", F.lit(True).alias("single"))
    groups = written(groups.join(alone, NODE, "left").withColumn("alone", F.col("single").isNotNull()).drop("single"))
    nodes = _unfolded(groups, ["n_convs"], ["conv_id"])

    children = nodes.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumn("saving", (F.col("n_convs") - 1) * F.col("bytes")))

    owned = nodes.groupBy("conv_id").agg(F.sum("saving").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    owned = written(owned)
    lent = spread_join(paths.select("conv_id", "k", *NODE), owned, ["conv_id"], ["k"]).groupBy(*NODE).agg(F.sum("owned").alias("owned"), F.sum("leaves").alias("leaves"))
    below = _unfolded(groups.join(lent, NODE), ["owned", "leaves"], []).select(*NODE, "owned", "leaves")

    above = running_sums(nodes.withColumn("place", F.col("depth") - 1), "conv_id", "place", {"run": F.col("saving"), "nth": F.lit(1)})
    summed = written(above.join(below, NODE).withColumn("saved_tokens", F.col("owned") - F.col("run") + F.col("saving")))

    # All other nodes of a member's path have the same smallest member as their parent.
    zero = [F.lit(0).cast("long")] * 4
    counts = ["n_convs", "n_children", "leaves", "saved_tokens"]
    parts = [
        convs.select("conv_id", F.lit(1), F.lit(0), F.lit(0), F.lit(0)).toDF("conv_id", *counts),
        nodes.where("depth = 1").select(F.lit(None).cast("long"), F.lit(0), F.lit(1), F.lit(0), F.lit(0)).toDF("conv_id", *counts),
        owned.select(F.lit(None).cast("long"), F.lit(0), F.lit(0), "leaves", "owned").toDF("conv_id", *counts),
    ]
    whole = reduce(DataFrame.unionByName, parts).agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in counts])
    whole = whole.where("n_convs > 0").select(*_node(*zero), "conv_id", *counts)
    known = nodes.select(*NODE, "conv_id").unionByName(whole.select(*NODE, "conv_id")).toDF("px", "py", "parent_conv_id")
    tops = spread_join(summed.where("nth = 1"), known, ["px", "py"], NODE)
    inner = summed.where("nth > 1").withColumn("parent_conv_id", F.col("conv_id"))

    root = whole.select(
        *NODE, "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        "n_children", F.greatest("leaves", F.lit(1)).alias("leaves"), "saved_tokens",
    )
    names = root.columns
    every = tops.select(*names).unionByName(inner.select(*names)).unionByName(root)

    last = paths.select("conv_id", "k", F.size("turns").alias("n"), *NODE).join(convs, "conv_id")
    last = last.where(F.col("k") * BLOCK + F.col("n") == F.col("length")).select("conv_id", *NODE)
    ends = written(last.unionByName(convs.where("length = 0").select("conv_id", *_node(*zero))))
    found = every.join(hash_of_ends(ends), NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
