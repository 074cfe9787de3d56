"""Exact top-k by inner product: no-random-access aggregation over sorted lists, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a block of queries, and of a block of candidates. A task holds one of each.
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8_192

#: How far the lists are read, as shares of a block; after each, bounds are compared.
DEPTHS = (1 / 64, 1 / 4, 3 / 4, 15 / 16)


def whole_vectors(table: DataFrame, id_column: str, vector: Column) -> DataFrame:
    """(``id``, ``v``) of the rows that have an id and a vector without NULL, NaN or infinite components.

    A row without an id could neither be named in a result nor told from a query's own row.
    """
    limit = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == limit))
    return table.select(table[id_column].cast("long").alias("id"), vector.alias("v")).where(table[id_column].isNotNull() & vector.isNotNull() & ~bad)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def nra_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """The k best candidates of a block for every query, as (query_id, vec_id, score).

    Each component has a list of the candidates by its value. A query with a
    positive weight reads it from the highest value on, with a negative one from the lowest. What
    has been read of all lists to a depth gives every candidate a lower bound (a value not
    read yet is at least the end of the list) and an upper bound (at most the last value read); the
    values last read also bound whoever has not been seen at all. A query stops once its k best lower bounds exceed
    the upper bounds of all but a few, whose scores are then resolved. All queries of the block read
    together, so bounds are two matrix products: reading to a depth equals clipping the values at the last one read.
    Values are integers, exact in double precision.
    """
    n = len(ids)
    take = min(n, k + 1)  # a query may find itself among the candidates
    if not n:
        return []
    up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    lists = np.sort(vectors, axis=0)  # ascending; read from both ends
    low, high = lists[0], lists[-1]
    alive = np.ones((len(queries), n), dtype=bool)
    active = np.arange(len(queries))
    floor = np.full(len(queries), -np.inf)
    for depth in DEPTHS:
        read = min(n - 1, max(1, int(n * depth)))
        from_top, from_bottom = lists[n - 1 - read], lists[read]
        outsider = up[active] @ from_top + down[active] @ from_bottom
        top_read = np.where(vectors >= from_top, vectors, low)
        bottom_read = np.where(vectors <= from_bottom, vectors, high)
        lower = up[active] @ top_read.T + down[active] @ bottom_read.T
        kth = np.partition(lower, n - take, axis=1)[:, n - take]
        floor[active] = np.maximum(floor[active], kth)
        if not (outsider < floor[active]).any() and depth < 0.5:
            continue  # anyone unseen may still qualify
        upper = up[active] @ np.maximum(vectors, from_top).T + down[active] @ np.minimum(vectors, from_bottom).T
        alive[active] &= upper >= floor[active][:, None]
        done = alive[active].sum(axis=1) <= 4 * take
        active = active[~done]
        if not len(active):
            break
    rows = []
    for i in range(len(queries)):
        left = np.flatnonzero(alive[i] & (ids != query_ids[i]))
        scores = vectors[left] @ queries[i]
        for j in _best(scores, ids[left], k):
            rows.append((int(query_ids[i]), int(ids[left[j]]), int(scores[j])))
    return rows


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k candidates with the highest inner products for every query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Both inputs are (``id``, ``v``) with integer components of any numeric type; ids are those of one table, and a query does not
    find its own id. All are returned if there are fewer than k; ties go to the smaller id.

    Queries meet all candidates in blocks of fixed size, dealt out by hashes of ids; a task holds one
    block of each. So the exchange carries each vector once per block of the other side, and nothing is
    broadcast. Each pair of blocks yields at most k rows a query, of which the best remain. Equal
    vectors are ordinary candidates. Repeated ids: every row is a candidate, and a query is answered once per row of its. Empty
    inputs and vectors of different lengths: no rows, and no matches between them.
    """
    many = {"q": queries.count(), "c": candidates.count()}
    q_blocks = max(1, -(-many["q"] // QUERY_BLOCK))
    c_blocks = max(1, -(-many["c"] // CANDIDATE_BLOCK))
    parts = q_blocks * c_blocks
    dealt = [("q", queries, q_blocks, c_blocks), ("c", candidates, c_blocks, q_blocks)]
    sides = {}
    for name, side, own, other in dealt:
        block = F.pmod(F.xxhash64("id", "v"), F.lit(own))
        copied = side.select("id", F.col("v").cast("array<double>").alias("v"), block.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))
        pair = F.col("own") * c_blocks + F.col("other") if name == "q" else F.col("other") * c_blocks + F.col("own")
        sides[name] = copied.select("id", "v", F.size("v").alias("dim"), pair.cast("long").alias("pair"))

    def match(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for dim, mine in q.groupby("dim", sort=True):
            theirs = c[c["dim"] == dim].sort_values("id")
            if dim == 0 or not len(theirs):
                continue
            mine = mine.sort_values("id")
            rows += nra_block(
                np.array(mine["v"].tolist()), mine["id"].to_numpy(), np.array(theirs["v"].tolist()), theirs["id"].to_numpy(), k
            )
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    grouped = sides["q"].repartition(parts, "pair").groupBy("pair").cogroup(sides["c"].repartition(parts, "pair").groupBy("pair"))
    found = grouped.applyInPandas(match, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
