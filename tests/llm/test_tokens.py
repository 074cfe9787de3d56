"""Token counts, packing and mixing against the tokenisers and plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from riskloom.llm.mixing import mix_plan, mixed  # noqa: E402
from riskloom.llm.packing import Limits, fill, pack  # noqa: E402
from riskloom.llm.tokencount import letters_apart, token_counts  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def some_docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("edge", [True, False])
def test_token_counts(spark, sf_small, edge_docs, edge):
    import sentencepiece

    docs = edge_docs if edge else some_docs(spark, sf_small)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect()]
    got = [tuple(r) for r in token_counts(docs, PIECES).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rare_pre_tokens_meet_their_pieces_in_buckets(spark, sf_small, edge_docs, no_docs):
    """Hardly any run is frequent, packs are small, texts under one id or none differ."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    more = spark.createDataFrame([(None, f"number {i} \ue000x.\nY{i}.²³ 1{i}▁a") for i in range(300)] + [(3, f"z{i}-y") for i in range(50)], "doc_id long, text string")
    docs = some_docs(spark, sf_small).union(edge_docs.select("doc_id", "text")).union(more).repartition(5)
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect()]
    got = [tuple(r) for r in token_counts(docs, PIECES, share=1 / 40, pack_entries=2000).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_counts(no_docs, PIECES).collect() == []


def test_runs_are_cut_only_where_no_piece_joins_them():
    assert letters_apart(["▁a", "ab", "▁,", ",,", "1", "▁▁"]) and not letters_apart(["a,"]) and not letters_apart(["a▁b"])


def check_packing(rows, docs, limits):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    for mine in ids.values():
        want = Counter()
        for x in mine:
            cuts = [(i, min(limits.tokens, len(x) - i)) for i in range(0, len(x), limits.tokens)]
            for i, n in cuts:
                want[(i, n, np.array(x[i : i + n], "<u4").tobytes(), len(x))] += 1
        doc_id = next(k for k, v in ids.items() if v is mine)
        got = Counter((r.start, r.length, bytes(r.ids), r.doc_tokens) for r in rows if r.doc_id == doc_id)
        assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(r.loss_tokens for r in pieces) <= limits.loss_tokens
    return sum(r.length for r in rows) / (len(sequences) * limits.tokens)


def test_packing_edges(edge_docs, no_docs):
    rows = pack(edge_docs, BPE).collect()
    check_packing(rows, edge_docs, Limits())
    assert pack(no_docs, BPE).collect() == []


def test_packing_table(spark, sf_small):
    docs = some_docs(spark, sf_small)
    assert check_packing(pack(docs, BPE).collect(), docs, Limits()) > 0.98
    tight = Limits(tokens=256, segments=3, loss_tokens=255)
    check_packing(pack(docs, BPE, limits=tight).collect(), docs, tight)


def test_loss_limit_binds_while_tokens_do_not(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(i, words, share) for i, share in enumerate([1.0, 0.5, 0.0, None] * 10)]
    docs = spark.createDataFrame([*rows, (99, words * 30, 1.0)], "doc_id long, text string, bearing double")
    limits = Limits(tokens=1024, segments=256, loss_tokens=200)
    placed = pack(docs, BPE, limits=limits, loss_share=docs["bearing"]).collect()
    sequences, whole = defaultdict(list), defaultdict(list)
    for r in placed:
        sequences[r.sequence_id].append(r)
        whole[r.doc_id].append(r)
    assert max(sum(r.loss_tokens for r in x) for x in sequences.values()) <= 200
    assert max(sum(r.length for r in x) for x in sequences.values()) <= 1024
    # Examples without loss fill up sequences whose loss is spent.
    assert any(sum(r.length for r in x) > 300 for x in sequences.values())
    by_id = {r.doc_id: r for r in docs.collect()}
    for doc_id, pieces in whole.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        assert sum(r.length for r in pieces) == pieces[0].doc_tokens
        share = by_id[doc_id].bearing
        assert all(r.loss_tokens == int(np.ceil((r.length - 1) * (1.0 if share is None else share))) for r in pieces)


def test_query_gives_checksums_of_the_ids(spark, sf_small):
    from riskloom.llm.queries import QUERIES

    ids = {(r.doc_id, r.start): bytes(r.ids) for r in pack(spark.read.parquet(f"{sf_small}/documents.parquet"), BPE).collect()}
    got = {(r.doc_id, r.start): r.ids_crc32 for r in QUERIES["op4_packing"](spark, sf_small).collect()}
    assert got == {k: zlib.crc32(v) for k, v in ids.items()}


def test_fill_respects_every_limit():
    rng = np.random.default_rng(1)
    demands = rng.random((500, 3)) * np.array([1, 0.3, 0.6])
    bins = fill(demands)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all((demands[b].sum(axis=0) <= 1 + 1e-6).all() for b in bins)
    assert len(bins) < 1.05 * demands[:, 0].sum() + 2
    assert fill(np.empty((0, 3))) == []
    assert [len(b) for b in fill(np.ones((3, 2)))] == [1, 1, 1]


def brute_targets(sizes):
    """Reshare until none is above three times its size."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [k for k in sizes if k is None]
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            return target | share
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
        free -= over
    return target


def test_mixing(edge_docs, no_docs):
    rows = mix_plan(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    sizes = Counter()
    for r in edge_docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = brute_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.doc.source]
        assert r.target == pytest.approx(target[r.doc.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 3
    assert mix_plan(no_docs).collect() == [] and mixed(no_docs).collect() == []
    assert mixed(edge_docs).columns == edge_docs.columns
    assert mixed(edge_docs).count() == sum(r.copies for r in rows)


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(30_000).selectExpr("id doc_id", "repeat('w ', int(1 + id % 40)) text", "concat('s', least(id % 9, 4)) source")
    taken = mix_plan(docs).selectExpr("doc.source", "target", "size * copies taken").groupBy("source", "target").sum("taken")
    for r in taken.collect():
        assert r["sum(taken)"] == pytest.approx(r.target, rel=0.05)
