"""The pipeline's near-duplicate stage links from 0.80 on, against all pairs."""

import random

import corpus_pipeline
import pytest

from riskloom.llm.neardup import BANDS, ROWS, bands_for, one_of_each, shingles_of, words_of


def kept_at(texts, percent):
    sets = [shingles_of(words_of(t)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return set(root)


def test_stage_links_from_80_on(spark):
    rng = random.Random(9)
    texts = []
    for group in range(120):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(200)]
        copy = list(base)
        # Each changed word takes five shingles from either set: 2 to 9 of 200 give similarities of 0.90 to 0.63.
        for k in range(2 + group % 8):
            copy[10 + 20 * k] = f"other{group}x{k}"
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    at_80, at_85 = kept_at(texts, 80), kept_at(texts, 85)
    assert len(at_80) < len(at_85) < len(texts)
    assert {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()} == at_80
    assert {r.doc_id for r in one_of_each(docs).collect()} == at_85


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 90, 99, 100])
def test_bands_lose_a_pair_at_the_similarity_as_rarely(percent):
    assert (1 - (percent / 100) ** ROWS) ** bands_for(percent) <= 1 / 20_000
    assert bands_for(85) == BANDS == 21
