"""F2 and F3 of round 3: what large groups of near copies cost."""

import random
from collections import Counter

import pytest

from riskloom.llm.ngramjoin import class_of_documents, ngram_join


def near_copies(groups, members, length, seed):
    """Groups whose members change 1 to 4 words of their base: some pairs link, others do not."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(length)]
        for m in range(members):
            words = list(base)
            for k in rng.sample(range(length // 5), rng.randint(1, 4)):
                words[5 * k] = f"g{g}m{m}x{k}"
            rows.append((len(rows), " ".join(words)))
    return rows


def linked_by_hand(rows, width=4, percent=85):
    words = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} for i, w in words.items()}
    want = {i: i for i in sets}
    for i in sorted(sets):
        for j in range(i):
            if want[i] != want[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    return want


@pytest.mark.parametrize("whole", [4096, 60, 0])
def test_classes_whatever_the_parts_and_batches(spark, monkeypatch, whole):
    """Whole sets, parts, and both in one group; pairs in batches, where some are left after the hubs."""
    from riskloom.llm import linking

    monkeypatch.setattr(linking, "HUBS", (1, None))
    monkeypatch.setattr(linking, "WHOLE", whole)
    monkeypatch.setattr(linking, "MANY_PAIRS", 0)
    monkeypatch.setattr(linking, "MANY", 1)
    rows = near_copies(3, 30, 64, 3)
    members, classes, _ = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in class_of_documents(members, classes).collect()}
    assert got == linked_by_hand(rows)
    assert 3 < len(set(got.values())) < 90


def test_two_sets_meet_once_in_the_last_round(spark, monkeypatch):
    from riskloom.llm import linking

    met, rows_made = linking.met, []

    def noted(rows, percent, hubs, turn):
        frame, made = type(rows), []
        distinct = frame.distinct
        monkeypatch.setattr(frame, "distinct", lambda self: made.append(self) or distinct(self))
        pairs = met(rows, percent, hubs, turn)
        monkeypatch.setattr(frame, "distinct", distinct)
        if hubs is None:
            rows_made.append((made[-1].count(), pairs.count()))
        return pairs

    monkeypatch.setattr(linking, "met", noted)
    rows = near_copies(4, 40, 120, 5)
    members, classes, _ = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in class_of_documents(members, classes).collect()}
    assert got == linked_by_hand(rows)
    [(made, pairs)] = rows_made
    assert 0 < pairs <= made <= 1.5 * pairs


def test_short_sets_are_one_row_a_text():
    import pandas as pd

    from riskloom.llm.linking import FILTER_BITS, PARTS, WHOLE, _parts

    texts = [" ".join(f"w{i}" for i in range(n)) for n in (3, 900, WHOLE * 100 // 85, 2 * WHOLE)]
    batch = pd.DataFrame({"print": range(len(texts)), "text": texts})
    assert FILTER_BITS > len(texts)
    held = [(1, b"\xff" * 4096)]
    cuts = Counter(n for made in _parts(4, 0, held, 85)(iter([batch])) for n in made["parts"])
    assert cuts == {1: 3, PARTS: 2 * PARTS}
