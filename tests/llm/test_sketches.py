"""F2 of round 3: which pairs of texts are compared."""

import numpy as np

from riskloom.llm.linking import apart_at_least, sketch_of
from riskloom.llm.ngramjoin import class_of_documents, ngram_join


def resembling(n_groups, members, length, edits, seed):
    """Groups of texts that differ from one base in ``edits`` single words each."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        base = [f"g{g}w{i}" for i in range(length)]
        for m in range(members):
            words = list(base)
            for at in rng.choice(np.arange(4, length - 4, 8), edits, replace=False):
                words[at] = f"g{g}m{m}at{at}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_sketches_never_claim_too_much(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in (1, 5, 300, 4000):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(n * share)], rng.integers(0, 1 << 63, n, dtype=np.uint64)[: n - int(n * share)]]))
            rows.append((sketch_of(a).tolist(), sketch_of(b).tolist(), len(np.setxor1d(a, b))))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, apart long").select(apart_at_least("a", "b").alias("least"), "apart").collect()
    assert all(r.least <= r.apart for r in got)
    assert all(r.least >= 0.9 * r.apart for r in got if r.apart <= 60)


def test_texts_that_only_resemble_are_not_compared(spark, monkeypatch):
    """Members of a group stay below 0.85: the sizes of fragments let many pairs pass, the sketches none."""
    from riskloom.llm import linking

    meet, verify, rounds, compared = linking.met, linking.verified, [], []
    monkeypatch.setattr(linking, "met", lambda rows, percent, hubs, turn: rounds.append(hubs) or meet(rows, percent, hubs, turn))
    monkeypatch.setattr(linking, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verify(pairs, *rest))
    rows = resembling(2, 40, 300, 5, 13) + [(80, "alone with some words here"), (81, "Alone  with some words here")]
    members, classes, _ = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in class_of_documents(members, classes).collect()}
    assert got == {**{i: i for i in range(81)}, 81: 80}
    assert sum(compared) == 0
    assert rounds == [1, None]


def test_close_texts_still_link_whatever_the_rounds(spark):
    """Members differ in two words from their base, at about 0.90: every group is one class."""
    rows = resembling(3, 30, 300, 2, 7)
    members, classes, links = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in class_of_documents(members, classes).collect()}
    assert got == {i: i - i % 30 for i in range(90)}
    for r in links.collect():
        assert r.overlap >= 273
