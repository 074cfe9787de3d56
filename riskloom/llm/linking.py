"""Linking texts whose sets of word n-grams are similar: rounds of candidates, exact counts by parts, classes.

Operators bring their own way for texts to meet: rows (``shingle``, ``key``) of lists whose members are candidates of each other. All
texts here are known by the keys of their word sequences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.llm.common import forget, spread_join, written
from riskloom.llm.components import components
from riskloom.session import scratch

#: Fragments of all n-grams, by the leading bits of their hashes.
STRIPS = 128

#: Parts whose overlaps are counted separately; each is a run of fragments.
PARTS = 8

#: Sets that need to share at most so many n-grams are counted in one part.
WHOLE = 4096

#: Bits of a set's sketch, whole words of 64. A bit tells whether an odd number of the set's n-grams falls on it.
SKETCH_BITS = 1024

#: How many of its first lists a set carries behind its sketch in the last round, by which two sets meet once, not in every list they share.
LEAD = 16

#: In the last round so often a pair or two of every text go first, where there are more than ``MANY_PAIRS`` pairs and ``MANY`` a text.
TRIES = 2
MANY = 4
MANY_PAIRS = 10_000

#: How many texts of a list meet all others of the list, by round. In the last round all that are still apart meet.
HUBS = (1, 8, None)

#: After the first round, all of a list meet at once where that makes at most so many times the pairs that the round's hubs would make.
FEW = 16

#: Bits of the filter that keeps most texts without candidates out of the exchange (8 MB, whatever the table).
FILTER_BITS = 1 << 26

SEEDS = 8


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: list[bytes], width: int, word_hash) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams; a shorter text is one n-gram."""
    h = np.fromiter(map(word_hash, words), dtype=np.uint64, count=len(words))
    w = min(len(h), width)
    total = np.full(len(h) - w + 1, np.uint64(w), dtype=np.uint64)
    for i in range(w):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(total)])
    return np.unique(total)


def hashing() -> Callable[[bytes], int]:
    """The hash of a word. It is not remembered: a lookup takes longer than the hash, and a worker's memory would grow with its words."""
    import xxhash

    forget()
    return xxhash.xxh64_intdigest


def digest_of(words: list[bytes], seed: int) -> bytes:
    import hashlib

    return hashlib.blake2b(b" ".join(words), digest_size=16, key=bytes([seed])).digest()


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def strips_of(hashes: np.ndarray) -> np.ndarray:
    """How many n-grams lie in each fragment."""
    return np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=STRIPS).astype(np.int32)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """The set's sketch. Where two sketches differ, an n-gram that only one of the sets holds must have fallen."""
    odd = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def beside(batch: pd.DataFrame, names: list[str], rows: list[tuple]) -> pd.DataFrame:
    """The batch with further columns. Whole numbers stay whole beside NULLs, which a plain frame would turn to doubles."""
    made = {}
    for i, name in enumerate(names):
        values = [row[i] for row in rows]
        whole = any(isinstance(v, int) for v in values)
        made[name] = pd.array(values, dtype="Int64") if whole else pd.Series(values, dtype=object).to_numpy()
    return pd.concat([batch, pd.DataFrame(made, index=batch.index)], axis=1)


def different_texts(
    sign: Callable[[int], DataFrame], also: dict[str, Column] | None = None, folder: str | None = None
) -> tuple[int, DataFrame, DataFrame]:
    """Signed rows and one row per key, for the first seed that gives different digests different keys.

    ``sign(seed)`` has ``key`` (NULL without words), ``digest``, ``doc_id``, ``n_shingles``, ``sketch``, ``print``.
    Keys are 64-bit hashes; raises if ``SEEDS`` draws do not separate all digests.
    """
    for seed in range(SEEDS):
        signed = written(sign(seed).withColumn("row", F.monotonically_increasing_id()), folder)
        nodes = signed.where("key is not null").groupBy("key").agg(
            F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
            F.min("print").alias("print"), F.min("digest").alias("digest"), F.max("digest").alias("last"),
            *[v.alias(c) for c, v in (also or {}).items()],
        )
        nodes = written(nodes, folder)
        if nodes.where("digest != last").isEmpty():
            return seed, signed, nodes.drop("digest", "last")
    raise RuntimeError(f"keys of word sequences collided in {SEEDS} draws")


def needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """What two sets of these sizes share at least if they reach the similarity."""
    return F.floor(((n_a + n_b) * percent + (99 + percent)) / (100 + percent))


def apart_at_least(sketch_a: str, sketch_b: str) -> Column:
    """How many n-grams at least only one of two sets holds: every bit in which their sketches differ stands for another one."""
    differing = [F.bit_count(F.col(sketch_a)[i].bitwiseXOR(F.col(sketch_b)[i])) for i in range(SKETCH_BITS // 64)]
    return sum(differing[1:], differing[0])


def reachable(need: Column, both: Column) -> Column:
    """Whether two sets of ``both`` n-grams together may share ``need``, by their sketches."""
    return apart_at_least("sketch_a", "sketch_b") <= both - 2 * need


def _parts(width: int, seed: int, held: list[tuple[int, bytes]], percent: int = 0):
    """(``key``, ``parts``, ``part``, ``grams``) of the texts whose prints the filter lets through, copies within a task once.

    A set is cut into 1 or ``PARTS`` parts, or both ways, if pairs of either kind may hold it (they need between ``percent`` and 100 % of its size).
    """
    bits = dict(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word_hash = hashing()
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for text, at in zip(batch["text"], batch["print"] % FILTER_BITS, strict=True):
                bucket, place = at // 32_768 + 1, at % 32_768
                if bucket not in bits or not bits[bucket][place // 8] >> (place % 8) & 1:
                    continue
                words = words_of(text)
                if not words or (digest := digest_of(words, seed)) in seen:
                    continue
                seen.add(digest)
                hashes = gram_hashes(words, width, word_hash)
                if 100 * WHOLE >= percent * len(hashes):
                    out.append((key_of(digest), 1, 0, hashes.view(np.int64)))
                if len(hashes) > WHOLE:
                    edges = np.searchsorted(hashes >> np.uint64(57), np.arange(1, PARTS, dtype=np.uint64) * np.uint64(STRIPS // PARTS))
                    out += [(key_of(digest), PARTS, i, part.view(np.int64)) for i, part in enumerate(np.split(hashes, edges))]
            if out:
                yield pd.DataFrame(out, columns=["key", "parts", "part", "grams"])

    return run


def met(rows: DataFrame, percent: int, hubs: int | None, turn: int) -> DataFrame:
    """Candidates (``a``, ``b``, ``need``) among ``rows``, the lists (``shingle``) whose keys are not all connected.

    With ``hubs``, so many texts of every list, drawn by their keys, meet the others of it; else all do. Where rows carry their sketches
    (``sketch``), these decide within the join, and where all meet, two sets do so in the first list they share, if
    it is among the first ``LEAD`` of both, which follow the sketch. A pair is kept where its places (``at``) leave the similarity possible; ``up``
    marks the places at which a set meets those that are as large or larger.
    """
    names = [c for c in rows.columns if c != "shingle"]
    left = rows
    if hubs is not None:
        draw = Window.partitionBy("shingle").orderBy(F.xxhash64("key", F.lit(turn)), "key")
        left = rows.withColumn("drawn", F.row_number().over(draw)).where(F.col("drawn") <= hubs)
    a = left.select("shingle", *(F.col(c).alias(f"{c}_a") for c in names))
    b = rows.select("shingle", *(F.col(c).alias(f"{c}_b") for c in names))
    smaller = F.struct("n_a", "key_a") < F.struct("n_b", "key_b")
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    need = needed(F.col("n_a"), F.col("n_b"), percent)
    left_over = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    possible = (F.col("root_a") != F.col("root_b")) & fits & (left_over >= need)
    possible = possible & (smaller & F.col("up_a") if hubs is None else F.when(smaller, F.col("up_a")).otherwise(F.col("up_b")))
    if "sketch" in names:
        possible = possible & reachable(need, F.col("n_a") + F.col("n_b"))
        if hubs is None:
            # Both carry the lists in one order, so the first in both is the first of all they share; there the places decide for the pair.
            lead_a, lead_b = (F.slice(c, SKETCH_BITS // 64 + 1, LEAD) for c in ("sketch_a", "sketch_b"))
            possible = possible & F.coalesce(F.get(F.array_intersect(lead_a, lead_b), F.lit(0)) == F.col("shingle"), F.lit(True))
    pairs = a.join(b, "shingle").where(possible)
    return pairs.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), need.alias("need")).distinct()


def with_leads(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """``rows`` (as ``met`` takes them) with ``sketch``, the sets' sketches and behind them the first ``LEAD`` of their lists by place and number."""
    own = rows.groupBy("key").agg(
        F.min("n").alias("n"), F.min("root").alias("root"), F.sort_array(F.collect_list(F.struct("at", "shingle", "up"))).alias("shows")
    )
    carried = F.concat("sketch", F.slice("shows", 1, LEAD)["shingle"]).alias("sketch")
    each = own.join(sketches, "key").select("key", "n", "root", carried, F.explode("shows").alias("shown"))
    return each.select("key", "shown.shingle", "n", "shown.at", "shown.up", "root", "sketch")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int, seed: int, folder: str) -> DataFrame:
    """The pairs (``a``, ``b``, ``overlap``) whose full sets share what they need: overlaps of long ones are counted part by part and summed."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    at = F.pmod("print", F.lit(FILTER_BITS)) + 1
    bucket = F.bitmap_bucket_number(at).alias("bucket")
    held = nodes.select("key", "print").join(keys, "key").groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    held = [(r.bucket, bytes(r.bits)) for r in held]
    # The filter lets few others through, which meet no pair.
    found = texts.mapInPandas(_parts(width, seed, held, percent), "key long, parts int, part int, grams array<long>")
    parts = written(found.groupBy("key", "parts", "part").agg(F.first("grams").alias("grams")), folder)
    cut = pairs.withColumn("parts", F.when(F.col("need") <= WHOLE, 1).otherwise(PARTS))
    both = cut.join(parts.toDF("b", "parts", "part", "grams_b"), ["b", "parts"])
    both = both.join(parts.toDF("a", "parts", "part", "grams_a"), ["a", "parts", "part"])
    shares = both.select("a", "b", "need", F.size(F.array_intersect("grams_a", "grams_b")).alias("share"))
    summed = shares.groupBy("a", "b", "need").agg(F.sum("share").alias("overlap")).where("overlap >= need")
    return summed.select("a", "b", "overlap")


def joined_classes(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (``node``, ``root``) after new ``links``, of which only those between classes are looked at."""
    of = lambda end: found.withColumnsRenamed({"node": end, "root": f"root_{end}"})
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), "a", "b")
    kept = found.join(moved.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return kept.union(moved.join(found, "node", "left_anti"))


def one_of_each_text(pairs: DataFrame) -> DataFrame:
    """A pair of every text that has one, at most two a text, whatever their number."""
    other = lambda c: F.min(F.struct(F.xxhash64("a", "b").alias("draw"), F.col(c), F.col("need"))).alias("x")
    first = pairs.groupBy("a").agg(other("b")).select("a", "x.b", "x.need")
    return first.union(pairs.groupBy("b").agg(other("a")).select("x.a", "b", "x.need")).distinct()


def linked(
    nodes: DataFrame,
    shown: DataFrame,
    texts: DataFrame,
    width: int,
    percent: int,
    seed: int,
    likely: Callable[[DataFrame], DataFrame] | None = None,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Classes (``key``, ``root``, ``component_id``) and links (``a``, ``b``, ``overlap``) among keys that meet in the lists of ``shown``.

    In every list 1, then 8 of its keys meet those not yet connected to them; classes are renewed after each round. At last all
    keys of a list that are still apart meet, where their sketches allow the similarity. They do so
    as soon as lists are so short that this makes few pairs more (``FEW``). So a
    large group of near copies is connected by the first rounds and costs a few pairs a key. Should very many pairs be left in the last
    round, a pair or two of every text are compared first, and those that this connects no more. ``likely`` may rule out pairs before
    their sets are counted. What is kept for the result lies in ``folder``, if given. ``shown``: (``shingle``, ``key``, ``n``, ``at``, ``up``); ``texts``: (``print``, ``text``).

    Lists are told apart by narrow rows; only what then meets carries its sketch. A key in very many pairs meets its sketch or set in a
    merge join of two exchanged tables, which Spark can split.
    """
    links = nodes.sparkSession.createDataFrame([], "a long, b long, overlap long")
    found = nodes.sparkSession.createDataFrame([], "node long, root long")
    sketches = nodes.select("key", "sketch")
    for turn, hubs in enumerate(HUBS):
        with scratch(nodes.sparkSession) as passing:
            if not turn:
                # A pair a row at most, with the sketches of the different pairs only.
                pairs = written(met(shown.withColumn("root", F.col("key")), percent, hubs, turn), passing)
                sizes = nodes.select("key", "n", "sketch")
                sized = pairs.join(sizes.toDF("a", "n_a", "sketch_a"), "a").join(sizes.toDF("b", "n_b", "sketch_b"), "b")
                pairs = sized.where(reachable(F.col("need"), F.col("n_a") + F.col("n_b"))).select("a", "b", "need")
            else:
                placed = shown.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
                lists = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").cast("double").alias("m"))
                lists = written(lists.where("lo != hi"), passing)
                m = F.col("m")
                all_pairs, with_hubs = lists.agg(F.sum(m * m / 2), F.sum(F.least(m, F.lit(float(hubs or 0))) * m)).first()
                if all_pairs is None:
                    break
                if hubs is not None and all_pairs <= FEW * with_hubs:
                    hubs = None
                apart = placed.join(lists.select("shingle"), "shingle", "left_semi")
                apart = with_leads(apart, sketches) if hubs is None else apart.join(sketches, "key")
                pairs = met(written(apart, passing), percent, hubs, turn)
            pairs = written(pairs, passing)
            if likely is not None:
                pairs = written(likely(pairs), passing)
            for tries in range(TRIES + 1):
                n, batch = pairs.count(), pairs
                if not n:
                    break
                if hubs is None and tries < TRIES and n > MANY_PAIRS and n > MANY * pairs.select(F.explode(F.array("a", "b"))).distinct().count():
                    batch = written(one_of_each_text(pairs), passing)
                fresh = written(verified(batch, nodes, texts, width, percent, seed, passing), folder)
                links = links.unionByName(fresh)
                found = written(joined_classes(found, fresh), folder)
                if batch is pairs:
                    break
                root = lambda end: found.withColumnsRenamed({"node": end, "root": f"root_{end}"})
                rest = pairs.join(batch, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
                rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
                pairs = written(rest.select("a", "b", "need"), passing)
        if hubs is None:
            break

    joined = nodes.select("key", "least_id").join(found.withColumnRenamed("node", "key"), "key", "left")
    joined = written(joined.withColumn("root", F.coalesce("root", "key")), folder)
    smallest = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return spread_join(joined, smallest, ["root"], ["key"]).select("key", "root", "component_id"), links
