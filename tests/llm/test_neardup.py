"""Near duplicates against all pairs, on planted groups, chains and edge rows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm.components import components
from riskloom.llm.neardup import BATCH, BANDS, ROWS, fewest_agreeing, near_duplicates, one_of_each, shingles_of, words_of


def brute(docs, percent=85):
    """Component ids by comparing all pairs of different word sequences."""
    rows = [(r.doc_id, tuple(words_of(r.text or ""))) for r in docs.collect()]
    distinct = sorted({w for _, w in rows if w})
    sets = [shingles_of(list(w)) for w in distinct]
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x]}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    place = {w: i for i, w in enumerate(distinct)}
    least = {}
    for doc_id, w in rows:
        if w and doc_id is not None:
            root = find(place[w])
            least[root] = min(least.get(root, doc_id), doc_id)
    return [(d, len(shingles_of(list(w))), least.get(find(place[w])) if w else d) for d, w in rows]


def got(docs, percent=85):
    members, nodes = near_duplicates(docs, percent=percent)
    rows = members.join(nodes, "node", "left").selectExpr("doc_id", "n_shingles", "coalesce(component_id, if(node is null, doc_id, null)) c")
    return [tuple(r) for r in rows.collect()]


def planted(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows, chain, common = [], text(400), text(60)
    for step in range(12):  # each near the one before, the ends far apart
        chain[step * 20 : step * 20 + 4] = text(4)
        rows.append(" ".join(chain))
    base = text(300)
    for _ in range(60):  # a group of different near copies
        copy = list(base)
        copy[rng.randrange(300)] = "other"
        rows.append(" ".join(copy))
    rows += [" ".join(base)] * 40 + [" ".join(base).upper().replace(" ", "\n\t ")] * 3
    for k in (4, 6, 8, 12, 20):  # around the similarity
        copy = list(base)
        for i in rng.sample(range(300), k):
            copy[i] = "far"
        rows.append(" ".join(copy))
    rows += [" ".join(text(40) + common + text(40)) for _ in range(30)]
    rows += ["a b", "A  b", "a b c", "é è", "É è", ""]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)


@pytest.mark.parametrize("percent", [85, 80])
def test_planted_groups(spark, percent):
    docs = planted(spark)
    assert sorted(got(docs, percent)) == sorted(brute(docs, percent))


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(got(docs)) == sorted(brute(docs))


def test_edges(spark, edge_docs, no_docs):
    assert sorted(got(edge_docs), key=repr) == sorted(brute(edge_docs), key=repr)
    assert got(no_docs) == []
    stay = one_of_each(edge_docs)
    assert stay.columns == edge_docs.columns and one_of_each(no_docs).collect() == []
    texts = [" ".join((r.text or "").split()) for r in stay.collect()]
    worded = [t for t in texts if t]
    assert len(worded) == len(set(worded)) and set(worded) == {" ".join(r.text.split()) for r in edge_docs.collect() if (r.text or "").split()}
    assert texts.count("") == sum(not (r.text or "").strip(" \t\r\n\f\v") for r in edge_docs.collect())


def test_one_of_each_keeps_smallest(spark):
    docs = planted(spark)
    kept = {r.doc_id for r in one_of_each(docs).collect()}
    assert kept == {d for d, _, c in brute(docs) if d == c}


def test_pruning_is_the_posterior():
    least = fewest_agreeing(0.85)
    rng = np.random.default_rng(0)
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        assert 0 < least[n] < 0.85 * n
        tail = (rng.beta(least[n] + 5, n - least[n] - 4, 200_000) >= 0.85).mean()
        assert tail > 1e-6 / 2


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_components(spark, n):
    path = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (102, 102), (100, 103)]
    links = spark.createDataFrame(path, "a long, b long")
    found = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert found == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100, 103: 100}
    assert components(links.where("false"), "a", "b").collect() == []


def test_last_round_finds_every_link_of_a_bucket(spark, monkeypatch):
    """One large group that resembles but mostly does not link: without hubs, all of a bucket meet."""
    monkeypatch.setattr("riskloom.llm.linking.HUBS", (None,))
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(60)] + [" ".join(base + ["tail", str(i)]) for i in range(6)]
    texts += [" ".join(f"y{i}" if i % k == 0 else w for i, w in enumerate(base)) for k in (29, 31, 33, 35, 37, 41, 43)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(got(docs)) == sorted(brute(docs))
