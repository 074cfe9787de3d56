"""Near-duplicate detection: MinHash bands, sequential Bayesian verification, exact confirmation, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import WORD, filled_id, once, spread_join, written
from riskloom.llm.linking import beside, different_texts, digest_of, gram_hashes, hashing, key_of, linked, sketch_of, words_of
from riskloom.session import scratch

SHINGLE = 5

#: Two texts meet if one of their bands of ``ROWS`` minima agrees. There are as many bands as let a pair at exactly the
#: similarity share none with at most this probability (``bands_for``).
LOST = 1 / 20_000
ROWS = 6

#: Minima are compared in batches of this many; after each, the posterior decides.
BATCH = 18

#: A pair is pruned when the posterior probability that it reaches the similarity is below this.
MISS = 1e-6


def bands_for(percent: int) -> int:
    """The number of bands for a similarity of ``percent`` / 100: 21 at 85, 33 at 80."""
    if percent >= 100:
        return 1
    return math.ceil(math.log(LOST) / math.log1p(-((percent / 100) ** ROWS)))


#: The bands at 85, where no other similarity is asked for.
BANDS = bands_for(85)


def shingles_of(words: list[bytes]) -> set[bytes]:
    """Distinct shingles; a shorter text is one shingle. (Words hold no spaces, so joining is exact.)"""
    if not words:
        return set()
    if len(words) < SHINGLE:
        return {b" ".join(words)}
    return {b" ".join(x) for x in zip(*(words[i:] for i in range(SHINGLE)), strict=False)}


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]


def minima(hashes: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One minimum per hash function over a set of shingles, of any size, in blocks."""
    n = bands * ROWS
    a, b = once(f"minhash multipliers {n}", lambda: _multipliers(n))
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full((n, 1), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        y = a * x[None, i : i + 2048] + b
        y ^= y >> np.uint32(15)
        least = np.minimum(least, y.min(axis=1, keepdims=True))
    return least[:, 0]


def _signed(bands: int, seed: int):
    """Per text: key and digest of its words, the size of its set of shingles, its sketch and its signature.

    Of copies within a task only the first carries a signature.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word_hash = hashing()
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = words_of(text)
                if not words:
                    out.append((None, None, 0, None, None))
                    continue
                hashes = gram_hashes(words, SHINGLE, word_hash)
                digest, signature = digest_of(words, seed), None
                if digest not in seen:
                    seen.add(digest)
                    signature = minima(hashes, bands).astype("<u4").tobytes()
                out.append((key_of(digest), digest, len(hashes), sketch_of(hashes), signature))
            batch = batch.drop(columns="text")
            yield beside(batch, ["key", "digest", "n_shingles", "sketch", "signature"], out)

    return run


def fewest_agreeing(similarity: float, bands: int = BANDS) -> np.ndarray:
    """``least[n]``: the fewest agreeing minima among n with which a pair may still reach the similarity.

    Agreeing minima are binomial in the similarity. With a uniform prior on it, the
    posterior after m of n is Beta(m+1, n-m+1), whose upper tail equals a binomial
    lower tail: P(s >= t) = P(Binomial(n+1, t) <= m).
    """
    from math import comb

    n_all = bands * ROWS
    least = np.zeros(n_all + 1, dtype=np.int64)
    for n in {*range(BATCH, n_all, BATCH), n_all}:
        tail, m = 0.0, -1
        while tail < MISS and m < n:
            m += 1
            tail += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        least[n] = m
    return least


def _prune(similarity: float, bands: int):
    """Keep the pairs whose signatures leave the similarity possible, reading them batch by batch."""
    least = fewest_agreeing(similarity, bands)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            n_all = bands * ROWS
            a = np.frombuffer(b"".join(batch["sig_a"]), "<u4").reshape(-1, n_all)
            b = np.frombuffer(b"".join(batch["sig_b"]), "<u4").reshape(-1, n_all)
            alive, agree = np.arange(len(batch)), np.zeros(len(batch), dtype=np.int64)
            for start in range(0, n_all, BATCH):
                cut = slice(start, start + BATCH)
                agree[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
                alive = alive[agree[alive] >= least[min(start + BATCH, n_all)]]
            yield batch.iloc[alive][["a", "b", "need"]]

    return run


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more, transitively.

    Returns ``(members, nodes)``. ``members`` has one row per row of ``docs``: ``row`` (a number), ``doc_id``, ``text_key``
    (digest of its text), ``node`` (key of its word sequence; NULL without words),
    ``n_shingles``. ``nodes`` has one row per different word sequence: ``node``, ``root`` (one
    for each group), ``component_id`` (smallest doc_id of the group, NULL if none has an id).

    1. Equal word sequences are one node, however many copies there are.
    2. Nodes that share a band are candidates. They meet in rounds (``linking.linked``): in a bucket 1, then 8
       nodes meet those not connected to them yet, at last all that are still apart. So a large group of near
       copies costs a few pairs a member and bucket. What their sets' sketches rule out goes first, which loses no link.
    3. Candidates are pruned by comparing signatures in batches (posterior below ``MISS``),
       and the survivors are confirmed on their full sets of shingles.

    Signatures are only fetched for candidates; all else is exchanged by 8-byte keys. What the results are read from lies in ``folder``
    (of ``session.scratch``), if given, and in the shared folder else. NULL, empty and blank texts have no
    shingles and link with nothing; repeated rows and
    equal ids stay rows of their own. Texts are read whole. An empty table gives empty results.
    """
    n_bands = bands_for(percent)
    text = F.coalesce(docs[text_column], F.lit(""))
    doc_id, has_id = filled_id(docs, id_column)
    kind = docs.schema[id_column].dataType.simpleString()
    print = F.xxhash64(text).alias("print")
    digest = F.unhex(F.md5(text.cast("binary"))).alias("text_key")
    rows = docs.select(doc_id.alias("doc_id"), has_id.alias("has_id"), digest, print, text.alias("text"))
    schema = f"doc_id {kind}, has_id boolean, text_key binary, print long, key long, digest binary, n_shingles long, sketch array<long>, signature binary"

    def sign(seed: int) -> DataFrame:
        signed = rows.mapInPandas(_signed(n_bands, seed), schema)
        return signed.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")

    seed, signed, nodes = different_texts(sign, {"signature": F.first("signature", ignorenulls=True)}, folder)
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(n_bands - 1)),
        lambda i: F.xxhash64(i, F.col("signature").substr(i * (4 * ROWS) + 1, F.lit(4 * ROWS))),
    )
    banded = nodes.select("key", F.col("n"), F.explode(bands).alias("shingle"))
    several = banded.groupBy("shingle").count().where("count > 1").select("shingle")
    shown = written(banded.join(several, "shingle").select("shingle", "key", "n", F.lit(0).alias("at"), F.lit(True).alias("up")), folder)
    signatures = nodes.select("key", "signature")

    def likely(pairs: DataFrame) -> DataFrame:
        both = pairs.join(signatures.toDF("a", "sig_a"), "a").join(signatures.toDF("b", "sig_b"), "b")
        return both.mapInPandas(_prune(percent / 100, n_bands), "a long, b long, need long")

    classes, _links = linked(nodes, shown, docs.select(print, text.alias("text")), SHINGLE, percent, seed, likely, folder)
    members = signed.select("row", "doc_id", "text_key", F.col("key").alias("node"), "n_shingles")
    return members, classes.withColumnRenamed("key", "node")


def placed_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members that have words, beside the columns of their nodes; copies of one text are dealt out."""
    return spread_join(members.where("node is not null"), nodes, ["node"], ["row"])


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group, one row with the smallest id stays.

    Rows without words, which are in no group, all stay. Rows without an id
    stay only where no row of their group has one. Of rows with equal id in one group,
    one stays. Columns are those of ``docs``.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    with scratch(docs.sparkSession) as folder:
        members, nodes = near_duplicates(docs, id_column, text_column, percent, folder)
        chosen = placed_members(members, nodes).groupBy("root").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))).alias("c")
        )
        chosen = written(chosen)
    filled, has_id = filled_id(docs, id_column)
    key = ["id", "has_id", "text_key"]
    chosen = chosen.select(
        F.coalesce(F.col("c.id"), F.lit("0").cast(docs.schema[id_column].dataType)).alias("id"),
        (~F.col("c.last")).alias("has_id"),
        F.col("c.key").alias("text_key"),
    )
    keyed = docs.select(
        F.struct("*").alias("doc"),
        filled.alias("id"),
        has_id.alias("has_id"),
        F.unhex(F.md5(text.cast("binary"))).alias("text_key"),
        (F.regexp_count(text, F.lit(WORD)) > 0).alias("worded"),
    )
    # Only rows that agree in id and text are left to choose from; most groups have a single one.
    # They are grouped where the join has put them.
    stay = keyed.join(chosen, key).groupBy(*key).agg(F.first("doc").alias("doc"))
    return stay.select("doc.*").unionByName(keyed.where(~F.col("worded")).select("doc.*"))
