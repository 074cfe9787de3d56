"""Pseudonyms: validity, format, linkage, and that the permutation is one."""

import datetime
import re

from pyspark.sql import functions as F

from riskloom.llm.pii import permuted_number, permuted_text, pseudonymised


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def changed(spark, *texts, key="k"):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.new_text for r in pseudonymised(docs, key).orderBy("doc.doc_id").collect()]


def test_permutations(spark):
    n = spark.range(1 << 16).select(permuted_number(F.col("id"), 8, "k", "x").alias("p"))
    assert n.distinct().count() == 1 << 16 and n.where("p between 0 and 65535").count() == 1 << 16
    t = spark.range(10_000).select(permuted_text(F.format_string("%04d", "id"), "k", "x").alias("p"))
    assert t.distinct().count() == 10_000 and t.where("p rlike '^[0-9]{4}$'").count() == 10_000


def test_formats_hold(spark):
    cards = ["4111111111111111", "4111-1111-1111-1111", "5500 0000 0000 0004", "378282246310005"]
    for old, new in zip(cards, changed(spark, *cards), strict=True):
        assert re.sub(r"\d", "9", old) == re.sub(r"\d", "9", new) and luhn(new) and new != old
    values = ["+1 (017) 555-7713", "und.34@mail7.example.com", "123-45-6789", "(212) 555-0199"]
    for old, new in zip(values, changed(spark, *values), strict=True):
        assert re.sub(r"[a-z]", "a", re.sub(r"\d", "9", old)).split("@")[0] == re.sub(r"[a-z]", "a", re.sub(r"\d", "9", new)).split("@")[0]
        assert new != old
    assert changed(spark, "+1 (017) 555-7713")[0].startswith("+1 (")
    assert changed(spark, "a@b.org")[0].endswith("@b.org")
    (address,) = changed(spark, "at 233.254.104.120.")
    assert all(int(x) < 256 for x in re.search(r"at ([\d.]+)\.$", address).group(1).split("."))


def test_dates_stay_dates_and_agree_between_notations(spark):
    iso, us, dotted, leap = changed(spark, "1985-10-26", "10/26/1985", "26.10.1985", "2024-02-29")
    day = datetime.date.fromisoformat(iso)
    assert day != datetime.date(1985, 10, 26) and datetime.date.fromisoformat(leap)
    assert us == day.strftime("%m/%d/%Y") and dotted == day.strftime("%d.%m.%Y")


def test_invalid_values_stay(spark):
    texts = ["4111111111111112", "2023-02-30", "300.1.1.1", "1.2.3.4.5", "version 3.0", "0000-00-00", "1234567890123", "", " ", "no digits",
             "12345678901234567890", "1850-01-01"]
    keep = [t for t in texts if t != "1234567890123" or not luhn(t)]
    assert changed(spark, *keep) == keep


def test_equal_values_are_linked_and_the_rest_is_untouched(spark):
    a, b, c = changed(spark, "é x 4111111111111111, und\n\n4111111111111111!", "card:4111111111111111", "4111111111111111 4111111111111111 ")
    new = re.search(r"\d{16}", a).group()
    assert a == f"é x {new}, und\n\n{new}!" and b == f"card:{new}" and c == f"{new} {new} "
    assert changed(spark, "4111111111111111", key="other")[0] != new


def test_edges(spark, edge_docs, no_docs):
    out = pseudonymised(edge_docs, "k")
    assert out.select("doc.*").columns == edge_docs.columns
    for r in out.collect():
        assert r.new_text == r.doc.text and r.n_replaced == 0
    assert pseudonymised(no_docs, "k").collect() == []
    (long,) = changed(spark, "1" * 100_000 + " a" * 50_000 + " 4111111111111111")
    assert long[:200_000] == "1" * 100_000 + " a" * 50_000 and luhn(long[-16:])


def test_nothing_valid_is_left_of_the_given_table(spark, sf_small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = re.compile(r"(?<!\d)\d{16}(?!\d)|[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d)")
    n = 0
    for r in pseudonymised(docs, "k").collect():
        before = [x for x in found.findall(r.doc.text) if not x.isdigit() or luhn(x)]
        n += len(before)
        assert r.n_replaced >= len(set(before)) - 1
        assert len(found.findall(r.new_text)) == len(found.findall(r.doc.text))
        for x in before:
            assert x not in found.findall(r.new_text) or len(x) < 9
    assert n > 20
