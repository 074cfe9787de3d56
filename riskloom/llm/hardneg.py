"""Hard negatives by inner product: STR-packed R-trees over blocks of vectors, searched best first within score windows."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.llm.common import spread_join, written
from riskloom.operators.ordering import ranked
from riskloom.session import shuffle_partitions

#: Rows of a leaf, and boxes under an inner box.
LEAF = 64
FAN = 16

#: Least and most rows of a block, which has a tree of its own.
BLOCK_ROWS = (4_096, 65_536)

#: Anchors that search one copy of a block. With more of them, blocks are copied, so that no task gets them all.
ANCHORS_PER_COPY = 65_536

#: Scores are exact in double precision below this; beyond it the search runs on whole numbers of any length.
EXACT = float(1 << 52)

BIGINT = (1 << 63) - 1


def str_order(codes: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves by sort-tile-recursive packing: label first, then the coordinates, those that vary most first."""
    spread = np.argsort(-np.asarray(vectors, dtype=np.float64).var(axis=0), kind="stable") if len(vectors) else []

    def tile(rows: np.ndarray, dims: Sequence[int]) -> list[np.ndarray]:
        leaves = math.ceil(len(rows) / LEAF)
        if leaves <= 1 or not len(dims):
            return [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)]
        slabs = math.ceil(leaves ** (1 / len(dims)))
        rows = rows[np.argsort(vectors[rows, dims[0]], kind="stable")]
        step = math.ceil(leaves / slabs) * LEAF
        return [leaf for i in range(0, len(rows), step) for leaf in tile(rows[i : i + step], dims[1:])]

    by_label = np.argsort(codes, kind="stable")
    edges = np.flatnonzero(np.diff(codes[by_label])) + 1
    runs = np.split(by_label, edges)
    if len(runs) > math.ceil(len(codes) / LEAF):  # most labels are too rare for a leaf of their own
        return tile(by_label, [])
    return [leaf for run in runs for leaf in tile(run, spread)]


class Tree:
    """Boxes over vectors: per level the least and largest coordinates and label codes of what lies under each box."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        names, codes = np.unique(labels, return_inverse=True)
        self.code_of = {name: i for i, name in enumerate(names.tolist())}
        leaves = str_order(codes, vectors)
        order = np.concatenate(leaves)
        self.ids, self.codes, self.vectors = ids[order], codes[order], vectors[order]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        self.levels = [self._boxes(starts, self.vectors, self.vectors, self.codes, self.codes)]
        while len(self.levels[-1][0]) > 2:
            _, low, high, first, last = self.levels[-1]
            n = len(low)
            self.levels.append(self._boxes(np.array([*range(0, n, FAN), n]), low, high, first, last))

    @staticmethod
    def _boxes(starts, low, high, first, last):
        cut = starts[:-1]
        reduce = lambda f, x: f.reduceat(x, cut, axis=0)
        return starts, reduce(np.minimum, low), reduce(np.maximum, high), reduce(np.minimum, first), reduce(np.maximum, last)

    def bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level, the least and largest inner product of every query with a point of every box."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return [(_within(up @ low.T + down @ high.T), _within(up @ high.T + down @ low.T)) for _, low, high, _, _ in self.levels]

    def search(
        self, query: np.ndarray, own_id: int, label, windows: list[tuple], k: int, same: bool, bounds: list[tuple]
    ) -> list[list[tuple[int, int]]]:
        """Per window of scores (least, largest, both included), its k best rows (-score, id) of the same label or of other ones.

        The box with the largest upper bound is opened first. A box is left out where its interval lies outside all
        windows, strictly below the k-th score of those it touches, or holds no row of a wanted label.
        """
        code = self.code_of.get(label, -1)
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        least = [low for low, _ in windows]
        queue: list[tuple] = []

        def push(level: int, boxes: range) -> None:
            lower, upper = bounds[level]
            _, _, _, first, last = self.levels[level]
            for box in boxes:
                kind = first[box] <= code <= last[box] if same else not first[box] == code == last[box]
                if kind and any(upper[box] >= floor and lower[box] <= w[1] for floor, w in zip(least, windows, strict=True)):
                    heapq.heappush(queue, (-upper[box], level, box))

        top = len(self.levels) - 1
        push(top, range(len(self.levels[top][1])))
        while queue:
            upper, level, box = heapq.heappop(queue)
            if -upper < min(least):
                break
            starts = self.levels[level][0]
            inside = range(starts[box], starts[box + 1])
            if level:
                push(level - 1, inside)
                continue
            part = slice(inside.start, inside.stop)
            scores = _within(self.vectors[part] @ query)
            ids = self.ids[part]
            wanted = ((self.codes[part] == code) == same) & (ids != own_id)
            for i, (_, high) in enumerate(windows):
                hit = np.flatnonzero(wanted & (scores >= least[i]) & (scores <= high))
                if len(hit):
                    found = [(-int(s), int(j)) for s, j in zip(scores[hit], ids[hit], strict=True)]
                    best[i] = sorted(best[i] + found)[:k]
                    if len(best[i]) == k:
                        least[i] = max(least[i], -best[i][-1][0])
        return best


def _numbers(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.float64)


def _whole(values: np.ndarray) -> np.ndarray:
    """The same whole numbers without a limit of size."""
    return np.array([[int(x) for x in row] for row in values], dtype=object).reshape(values.shape)


def _within(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a bigint become its ends; doubles are far from them here."""
    return np.clip(scores, -BIGINT - 1, BIGINT) if scores.dtype == object else scores


def _trees(held: list[pd.DataFrame]) -> dict[int, tuple[Tree, float]]:
    rows = pd.concat(held)
    trees = {}
    for dim, mine in rows.groupby(rows["v"].str.len()):
        vectors = _numbers(mine["v"])
        largest = float(np.abs(vectors).max(initial=0.0))
        trees[dim] = Tree(mine["id"].to_numpy(), mine["label"].to_numpy(), vectors), largest
    return trees


def _searching(k: int, same: bool):
    """Answers anchors from trees; rows come block by block, first the block's vectors, then its anchors, in batches.

    A task holds one block and one batch of anchors.
    """

    def answers(trees, asks: pd.DataFrame) -> list[tuple]:
        rows = []
        for dim, mine in asks.groupby(asks["v"].str.len()):
            if dim not in trees:
                continue
            tree, largest = trees[dim]
            queries = _numbers(mine["v"])
            if largest * float(np.abs(queries).max(initial=0.0)) * dim >= EXACT:
                tree = Tree(tree.ids, np.array(list(tree.code_of))[tree.codes], _whole(tree.vectors))
                queries = _whole(queries)
            bounds = tree.bounds(queries)
            for i, (row, own, label, asked) in enumerate(zip(mine["row"], mine["id"], mine["label"], mine["asked"], strict=True)):
                # Scores of positives p ask for -(-80 p // 100) .. p.
                windows = [(-math.inf, math.inf)] if same else [(-(-80 * int(p) // 100), int(p)) for p in asked]
                near = [(lower[i], upper[i]) for lower, upper in bounds]
                for at, found in enumerate(tree.search(queries[i], own, label, windows, k, same, near)):
                    rows += [(row, at, j, -s) for s, j in found]
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, trees = None, [], {}
        for batch in batches:
            for now, rows in batch.groupby("cell", sort=False):
                if now != cell:
                    cell, held, trees = now, [], {}
                mine, asks = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
                if len(mine):
                    held.append(mine)
                if len(asks):
                    if held:
                        trees, held = _trees(held), []
                    yield pd.DataFrame(answers(trees, asks), columns=["row", "at", "vec_id", "score"], dtype="int64")

    return run


def whole_labelled(table: DataFrame, id: Column, label: Column, vector: Column) -> DataFrame:
    """(``id``, ``label``, ``v``) of the rows that have all three and a vector without NULL, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = table.select(id.cast("long").alias("id"), label.alias("label"), vector.cast("array<double>").alias("v"))
    return rows.where(id.isNotNull() & label.isNotNull() & vector.isNotNull() & ~bad & (F.size(vector) > 0))


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of every component, as doubles; beyond a bigint a double is whole already."""
    product = lambda x: x * F.lit(float(factor))
    return F.transform(vector, lambda x: F.when(F.abs(product(x)) < 2.0**62, F.floor(product(x)).cast("double")).otherwise(product(x)))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5) -> DataFrame:
    """For every anchor and each of its nearest rows of the same label, the best rows of other labels just below it.

    ``vectors`` is (``id``, ``label``, ``v``) without NULLs (``whole_labelled``), components whole numbers as doubles.
    A score is the inner product with the anchor; ties go to the smaller id. An anchor's positives are the first ``positives``
    rows of its label; a positive of score p gets the first ``negatives`` rows of other labels with 80 p <= 100 score <= 100 p.
    Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Rows are ranked by label and first coordinate and cut into blocks, each with an R-tree. Vectors are exchanged once; only anchors
    are copied, to the blocks of their label for the positives and to all blocks for the negatives. Each block answers
    with at most so many rows a window, of which the best remain. A label, a vector or a coordinate that fills the table is cut
    into blocks like any other. Repeated ids: every row is a candidate of the others and an anchor of its own; rows with the
    anchor's id are never its answers. Vectors of other lengths are not compared; empty vectors and rows without an id are
    left out. A score beyond a bigint counts as its end. An empty table gives no rows.
    """
    order = [F.col("label"), F.get("v", F.lit(0)), F.col("id"), F.col("v")]
    total = vectors.count()
    least, most = BLOCK_ROWS
    size = min(most, max(least, -(-total // (2 * shuffle_partitions(vectors.sparkSession)))))
    placed = ranked(vectors.select("id", "label", "v"), order).select("id", "label", "v", F.col("rank").alias("row"))
    held = written(placed.withColumn("block", F.floor((F.col("row") - 1) / size)))
    blocks = max(1, -(-total // size))
    anchors = written(held.where(is_anchor).select("row", "id", "label", "v"))
    copies = max(1, -(-anchors.count() // ANCHORS_PER_COPY))

    def searched(asking: DataFrame, k: int, same: bool) -> DataFrame:
        """``asking``: anchors with the ``block`` to search and the scores ``asked``."""
        cell = F.col("block") * copies
        copied = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
        names = ["row", "id", "label", "v"]
        theirs = copied.select((cell + F.col("copy")).alias("cell"), F.lit(0).alias("kind"), *names, F.lit(None).cast("array<long>").alias("asked"))
        mine = asking.select((cell + F.pmod(F.xxhash64("row"), F.lit(copies))).alias("cell"), F.lit(1).alias("kind"), *names, "asked")
        together = theirs.unionByName(mine).repartitionById(blocks * copies, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind", "row")
        found = together.mapInPandas(_searching(k, same), "row long, at long, vec_id long, score long")
        best = Window.partitionBy("row", "at").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    spans = held.groupBy("label").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    own = spread_join(anchors, spans, ["label"], ["row"]).withColumn("block", F.explode(F.sequence("first", "last")))
    near = searched(own.withColumn("asked", F.lit(None).cast("array<long>")), positives, True)
    gathered = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    asking = written(anchors.join(gathered, "row"))
    everywhere = asking.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asked": F.col("near.score")})
    found = searched(everywhere, negatives, False)
    result = found.join(asking.select("row", F.col("id").alias("anchor_id"), "near"), "row")
    positive = F.get("near", F.col("at").cast("int"))
    return result.select(
        "anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
