"""Quality rules and URL filter against plain Python."""

import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm.quality import BUCKETS, quality_rules, ratio_table
from riskloom.llm.queries import URL_RULES
from riskloom.llm.urlfilter import filter_urls, fit_urls, host_and_path, lexical, matching_rule, parse_rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def hashed(text):
    def xx(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed=seed)

    words = [xx(w.encode()) for w in WORD.findall(text or "")]
    pairs = [xx(b.to_bytes(8, "little"), seed=xx(a.to_bytes(8, "little"))) for a, b in zip(words, words[1:], strict=False)]
    signed = [x - (1 << 64) if x >> 63 else x for x in words + pairs]
    return [x % BUCKETS for x in signed]


REPEATS = [
    "a b c d e f g h " * 3, "x " * 30, "a b c d e f g h i a b c d e f g h", "\n".join(["same line", "same line", " ", "", "other", "same line "]),
    "one two three four five six seven", " ".join(map(str, range(50))) + " " + " ".join(map(str, range(10))),
]


def test_quality(spark, edge_docs, no_docs, sf_small):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(REPEATS)], "doc_id long, text string")
    given = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    docs = edge_docs.select("doc_id", "text").unionByName(more).unionByName(given)
    trusted = spark.createDataFrame([(0,), (1000,), (1000,), (None,), (5,), (7,), (9,)], "doc_id long")
    ratios = ratio_table(docs, trusted)
    rows = quality_rules(docs, ratios).collect()
    assert len(rows) == docs.count()
    raw, target = Counter(), Counter()
    for r in docs.collect():
        raw.update(hashed(r.text))
        if r.doc_id in (0, 1000, 5, 7, 9):
            target.update(hashed(r.text))
    from math import log

    n_raw, n_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    for r in rows:
        want = counts(r.doc.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        grams = hashed(r.doc.text)
        score = sum(log((target[b] + 1) / n_target) - log((raw[b] + 1) / n_raw) for b in grams) / len(grams) if grams else 0
        assert r.score == pytest.approx(score, abs=2e-6)
    assert quality_rules(no_docs, ratios).collect() == []
    assert quality_rules(edge_docs, ratios).select("doc.*").columns == edge_docs.columns
    assert set(ratio_table(no_docs, trusted)) == {0}


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    best = None
    for line in URL_RULES:
        verdict, target = line.split(" ")
        h, _, p = target.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(target) > len(best[1])):
            best = verdict, target
    return best


URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/1?x=1",
    "http://notexample.com/en/", "https://x.net/es/1", "x://y.net/fr/", "http://y.net/fr", "http://y.net?fr/", "http://Ü.net/es/#a",
    "http://com/", "http://com", "://com/", "a://b://c.com/", "http://q.org/en/" + "a" * 4000, "http://q.org/en/1", "http://q.org/en/1",
]


def test_urls(spark, sf_small):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, None, None)]
    edge = spark.createDataFrame(rows, "page_id long, url string, host string")
    given = spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "url", F.lit("h").alias("host"))
    rules = [parse_rule(x) for x in URL_RULES]
    for pages in (edge.unionByName(given), edge, edge.where("page_id in (4, 5, 8)"), edge.where("page_id > 17"), edge.where("false")):
        out = filter_urls(pages, rules).collect()
        assert len(out) == pages.count()
        for r in out:
            host, path = parsed(r.page.url)
            best = ruled(host, path)
            assert (r.host, r.path) == (host, path)
            assert r.rule == (best[1] if best else None)
            assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    from riskloom.llm.urlfilter import fit_urls, host_and_path, lexical

    urls = [(f"http://h{i % 7}.org/a/{'1234567890' * (i % 2)}{i}", float(i % 2)) for i in range(400)]
    host, path = host_and_path(F.col("url"))
    frame = lexical(spark.createDataFrame(urls, "url string, blocked double").withColumns({"host": host, "path": path}))
    model = fit_urls(frame.where("url not like '%7'"))
    wrong = model.score(frame.where("url like '%7'")).where("(block_score >= 0.5) != (blocked = 1.0)").count()
    assert wrong == 0


def labelled_urls(spark, rows):
    host, path = host_and_path(F.col("url"))
    parsed = rows.select("url", host.alias("host"), path.alias("path"))
    _, verdict = matching_rule([parse_rule(x) for x in URL_RULES], F.col("host"), F.col("path"))
    return lexical(parsed.withColumn("blocked", F.when(verdict == "block", 1.0).when(verdict == "allow", 0.0)).where("blocked is not null"))


def test_trees_on_held_out_hosts_of_the_given_table(spark):
    rows = labelled_urls(spark, spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).withColumn("out", F.crc32(F.col("host").cast("binary")) % 4 == 0)
    model = fit_urls(rows.where("not out").drop("out"))
    judged = model.score(rows.where("out")).select("blocked", (F.col("block_score") >= 0.5).cast("double").alias("p")).collect()
    hit = [sum(r.p == r.blocked for r in judged if r.blocked == k) / sum(r.blocked == k for r in judged) for k in (0.0, 1.0)]
    assert len(judged) > 100 and sum(hit) / 2 > 0.7, hit


def test_one_url_on_most_rows_changes_no_verdict(spark):
    rows = labelled_urls(spark, spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    hot = rows.where("blocked = 1").orderBy("url").limit(1).crossJoin(spark.range(3000)).drop("id")
    once, often = [sorted((r.url, r.block_score) for r in fit_urls(x, 40).score(rows).collect()) for x in (rows, rows.unionByName(hot))]
    assert [u for u, _ in once] == [u for u, _ in often]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(once, often, strict=True))
