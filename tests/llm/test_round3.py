"""Prefix trie, n-gram join and hard negatives against plain Python, on planted, skewed and edge rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hardneg, ngramjoin, prefixtrie
from riskloom.llm.common import running_sums, spread_join
from riskloom.llm.neardup import words_of
from riskloom.llm.queries import QUERIES

# --- conversation prefix trie -------------------------------------------------------------


def trie_by_hand(rows):
    """The contract of the query, walked node by node."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    found = []
    for node, group in members.items():
        inside = [n for n in members if n[: len(node)] == node]
        children = {n for n in inside if len(n) == len(node) + 1}
        leaves = [n for n in inside if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in inside if n)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ids.encode()).hexdigest()
        found.append((min(group), len(node), parent, len(group), len(children), len(leaves), saved, digest))
    return sorted(found, key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string, x long, conv string"


def trie(spark, tmp_path, rows):
    path = str(tmp_path / f"conversations{random.random()}")
    spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATIONS).write.parquet(f"{path}/conversations.parquet")
    got = QUERIES["op11_prefix_trie"](spark, path)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def random_conversations(seed, n, turns):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randrange(turns)):
            rows.append((c, t, rng.choice(["user", "user", "bot", None]), rng.choice(["a", "a", "a", "é", "", None])))
        rows.append((c, rng.choice([None, 100]), "user", rng.choice(["end", "", "other"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_python(spark, tmp_path, seed):
    rows = random_conversations(seed, 40, 14)
    assert trie(spark, tmp_path, rows) == trie_by_hand(rows)


def test_trie_of_copies_and_a_long_conversation(spark, tmp_path, monkeypatch, low_floor):
    monkeypatch.setattr("riskloom.llm.common.STRETCH", 3)
    monkeypatch.setattr("riskloom.llm.prefixtrie.RUN", 2)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 60, 5) for t in range(6)]  # copies
    rows += [(1000, t, "user", f"turn {t}") for t in range(90)]  # one conversation with most turns
    rows += [(1005, t, "user", f"turn {t}" if t < 60 else "else") for t in range(70)]
    assert trie(spark, tmp_path, rows) == trie_by_hand(rows)


def test_trie_of_edge_rows(spark, tmp_path):
    assert trie(spark, tmp_path, []) == []
    # No conversation, no turn number, repeated rows, ties, a negative id, and a family whose first conversation is absent.
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, None, None), (-3, 1, "a", "b"), (-3, 1, "a", "b"), (11, 0, "u", "x" * 100_000)]
    assert trie(spark, tmp_path, rows) == trie_by_hand(rows)


def test_running_sums_shift_by_stretches(spark, monkeypatch):
    monkeypatch.setattr("riskloom.llm.common.STRETCH", 4)
    df = spark.range(50).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("at"), "id")
    got = {(r.k, r["at"]): r.s for r in running_sums(df, "k", "at", {"s": F.col("id")}).collect()}
    assert got == {(k, a): sum(3 * i + k for i in range(a + 1)) for k, a in got} and len(got) == 50


def test_spread_join_is_an_inner_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    lookup = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = spread_join(rows, lookup, ["k"], ["id"])
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, rows.join(lookup, "k").select("k", "id", "v").collect()))


# --- n-gram join ---------------------------------------------------------------------------


def grams(text, width=4):
    words = [w.decode("utf-8", "surrogatepass") for w in words_of(text or "")]
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def classes_by_hand(rows, percent=85):
    """(doc_id, set size, class) by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least.get(find(i), doc) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def planted_texts():
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, base, passage = [], text(120), text(70)
    for _ in range(60):  # a large group near the threshold, in which some pairs reach it and many do not
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(words))
    rows += [" ".join(text(rng.randrange(20, 60)) + passage) for _ in range(40)]  # a passage that many share
    chain = text(200)
    for step in range(10):
        chain[step * 18 : step * 18 + 3] = text(3)
        rows.append(" ".join(chain))
    rows += [" ".join(base)] * 5 + ["a b c", "A  b\tC", "a b", "a b c d", "one", "x y " * 40, "x y " * 41]
    rows += [" ".join(text(rng.randrange(1, 40))) for _ in range(40)]
    rows += ["", None, " \n"]  # blank texts stand in batches with others
    rng.shuffle(rows)
    return list(enumerate(rows))


def joined(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members, classes, links = ngramjoin.ngram_join(docs, **options)
    out = ngramjoin.class_of_documents(members, classes)
    return sorted((tuple(r) for r in out.collect()), key=repr), links


@pytest.mark.parametrize("percent", [85, 60])
def test_classes_equal_all_pairs(spark, percent):
    rows = planted_texts()
    got, links = joined(spark, rows, percent=percent)
    assert got == classes_by_hand(rows, percent)
    assert links.count() < 1000


def test_ngrams_of_very_many_texts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "_hot_grams", lambda signed, total: [
        r.shingle for r in signed.select(F.explode("shown").alias("shingle")).groupBy("shingle").count().where("count > 20").collect()
    ])
    rows = planted_texts()
    assert joined(spark, rows)[0] == classes_by_hand(rows)


def test_last_round_alone_is_exact(spark, monkeypatch):
    monkeypatch.setattr("riskloom.llm.linking.HUBS", (None,))
    rows = planted_texts()
    assert joined(spark, rows)[0] == classes_by_hand(rows)


def test_join_of_edge_rows(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        members, classes, _ = ngramjoin.ngram_join(docs)
        got = sorted((tuple(r) for r in ngramjoin.class_of_documents(members, classes).collect()), key=repr)
        assert got == classes_by_hand([(r.doc_id, r.text) for r in docs.collect()])


# --- hard negatives --------------------------------------------------------------------------


def mined_by_hand(rows, anchor):
    """Per anchor row, all scores; ids and labels decide as the operator states."""
    found = []
    for a, la, va in rows:
        if not anchor(a):
            continue
        product = lambda vc: max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(va, vc, strict=True))))  # noqa: E731, B023
        scored = sorted((-product(vc), c, lc) for c, lc, vc in rows if c != a and len(vc) == len(va))
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            fits = [x for x in scored if x[2] != la and -80 * s <= -100 * x[0] <= -100 * s][:5]
            found += [(a, p, i + 1, n, -s, -t) for i, (t, n, _) in enumerate(fits)]
    return sorted(found)


def mined(spark, rows, label="int"):
    df = spark.createDataFrame(rows, f"id long, label {label}, v array<double>")
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, F.col("id") % 10 == 0).collect())


def vectors(seed, n, dim, spread=20):
    rng = np.random.default_rng(seed)
    return [(int(i), int(rng.integers(3)), [float(x) for x in rng.integers(-spread, spread, dim) + 6]) for i in rng.permutation(n)]


@pytest.mark.parametrize(("n", "dim"), [(900, 6), (300, 1), (12, 3)])
def test_negatives_equal_all_scores(spark, monkeypatch, n, dim):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", (200, 200))
    monkeypatch.setattr(hardneg, "ANCHORS_PER_COPY", 50)
    rows = vectors(n, n, dim)
    assert mined(spark, rows) == mined_by_hand(rows, lambda i: i % 10 == 0)


def test_negatives_under_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", (64, 64))
    rows = [(i, i % 2, [3.0, 4.0]) for i in range(150)]  # one vector fills the table
    rows += [(1000 + i, i, [float(i), 1.0]) for i in range(60)]  # every label is rare
    rows += [(2000, 0, [1.0]), (2001, 1, [1.0]), (2002, 0, [0.0, 0.0]), (2010, 0, [2.0])]
    assert mined(spark, rows) == mined_by_hand(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []


@pytest.mark.parametrize("size", [2.0**29, 2.0**31, 2.0**100])
def test_scores_beyond_double_precision_are_exact(spark, size):
    rows = [(10, 0, [size, 1.0]), (11, 0, [size, 3.0])] + [(20 + i, 1, [size, float(i)]) for i in range(1, 9)]
    assert mined(spark, rows) == mined_by_hand(rows, lambda i: i % 10 == 0) != []


def test_rows_without_whole_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0]), (None, 0, [1.0]), (2, None, [1.0]), (3, 0, None), (4, 0, [nan]), (5, 0, [inf]), (6, 0, [None]), (7, 0, []), (8, 0, [-0.25])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    whole = hardneg.whole_labelled(df, F.col("vec_id"), F.col("label"), F.col("embedding"))
    got = whole.withColumn("v", hardneg.scaled(F.col("v"), 3)).collect()
    assert sorted((r.id, r.v) for r in got) == [(1, [3.0]), (8, [-1.0])]


def test_boxes_are_left_out(monkeypatch):
    """Near its end the search has opened few leaves: the bounds prune."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 10, (2000, 2)), rng.integers(900, 1000, (64, 2))]).astype(float)
    tree = hardneg.Tree(np.arange(len(points)), np.zeros(len(points), dtype=int), points)
    opened = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            opened.extend([key] * isinstance(key, slice))
            return super().__getitem__(key)

    tree.ids = tree.ids.view(Counting)
    query = np.array([[1.0, 1.0]])
    near = [(low[0], high[0]) for low, high in tree.bounds(query)]
    best = tree.search(query[0], -1, 0, [(-np.inf, np.inf)], 5, True, near)[0]
    want = sorted((-int(s), i) for i, s in zip(np.arange(len(points)), points.sum(axis=1), strict=True))[:5]
    assert [(int(s), int(i)) for s, i in best] == want and len(opened) <= 3
