"""Quality rules: countable properties of a text, and a hashed n-gram likelihood ratio against the raw corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of the hashed n-grams; this bounds the models and what the driver holds of them.
BUCKETS = 1 << 16

#: Ratios are kept in millionths, so that sums of them are exact.
UNIT = 1_000_000

#: Texts whose mean ratio (nats per n-gram) is below this are dropped.
THRESHOLD = -0.09

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

SPACE = r"[\x20\x09-\x0D]"
ANY_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def _ahead(items: Column, by: int) -> Column:
    """The array without its first ``by`` items."""
    return F.slice(items, by + 1, F.size(items))


def _first(items: Column, n: Column) -> Column:
    return F.slice(items, 1, F.greatest(n, F.lit(0)))


def _pairs(hashes: Column, by: int, length: Column) -> Column:
    """Hashes of every item with the one ``by`` places later."""
    joined = F.zip_with(hashes, _ahead(hashes, by), lambda a, b: F.xxhash64(a, b))
    return _first(joined, length)


def with_hashes(docs: DataFrame, *columns: Column, text: Column) -> DataFrame:
    """``columns`` and hashed words (``h1``) and word pairs (``h2``); each step is a projection of its own, evaluated once."""
    names = [f"_c{i}" for i in range(len(columns))]
    split = docs.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], words(text).alias("words"))
    first = split.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    return first.withColumn("h2", _pairs(F.col("h1"), 1, F.size("h1") - 1))


def base_counts(hashed: DataFrame, text: Column) -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` to rows of ``with_hashes``."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(ANY_WORD))
    counted = hashed.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
            "lines": lines,
            "h4": _pairs(F.col("h2"), 2, F.size("h2") - 2),
        }
    ).drop("words")
    eights = counted.withColumns(
        {
            "h8": _pairs(F.col("h4"), 4, F.size("h4") - 4),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("lines", "h4")
    # Few texts repeat a window; only those are sorted.
    repeats = F.size(F.array_distinct("h8")) < F.size("h8")
    at = F.zip_with("h8", F.sequence(F.lit(0), F.size("h8") - 1), lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    sorted_ = eights.withColumn("by_hash", F.when(repeats, F.sort_array(at))).drop("h8")
    near = F.col("by_hash")
    twice = F.filter(
        near,
        lambda x, i: F.coalesce((i > 0) & (F.get(near, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]), F.lit(False))
        | F.coalesce(F.get(near, i + 1)["h"] == x["h"], F.lit(False)),
    )
    starts = sorted_.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("by_hash")
    # A window covers its words up to where the next repeated window begins.
    covered = F.zip_with("starts", _ahead(F.col("starts"), 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    summed = F.aggregate(covered, F.lit(0).cast("long"), lambda total, n: total + n)
    return starts.withColumn("n_repeat_words", F.coalesce(summed, F.lit(0).cast("long"))).drop("starts")


def bucket_counts(docs: DataFrame, text: Column) -> DataFrame:
    """N-grams per bucket (single words and pairs), summed in the tasks before anything is exchanged."""
    hashed = with_hashes(docs, text=text)
    grams = hashed.select(F.explode(F.concat("h1", "h2")).alias("h"))
    return grams.select(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def ratio_table(docs: DataFrame, trusted_ids: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> list[int]:
    """Per bucket, the log of its share among n-grams of trusted documents over its share in all documents, in ``UNIT``.

    Both multinomials count every document concerned, and start from one n-gram per bucket. Their
    ``BUCKETS`` ratios are the model; nothing of the vocabulary is kept.
    """
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("trusted_id")).where("trusted_id is not null").distinct()
    slim = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    # The ids grow with the corpus: a merge join at every size, never a broadcast.
    trusted = slim.join(ids.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi")
    raw, target = bucket_counts(slim, F.col("text")), bucket_counts(trusted, F.col("text"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "raw"), "bucket", "left").join(target.withColumnRenamed("n", "target"), "bucket", "left")
    rows = both.select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")).collect()
    from math import log

    raw_total, target_total = sum(r.raw + 1 for r in rows), sum(r.target + 1 for r in rows)
    table = [0] * BUCKETS
    for r in rows:
        table[r.bucket] = round(UNIT * (log((r.target + 1) / target_total) - log((r.raw + 1) / raw_total)))
    return table


def quality_rules(docs: DataFrame, ratios: list[int], text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Judge the whole text of every row: ``doc`` (all columns as a struct), the counts, ``base_failed``, ``score``, ``kept``.

    ``score`` is the mean ratio of a text's n-grams. A text that passes the base rules stays if it reaches
    the threshold; the decision depends on nothing but the text and the table.

    NULL, empty and blank texts have no words, fail the base rules and score 0.
    Repeated rows are judged alike; texts of any length are read whole. Everything is built-in expressions; the table is a
    constant of the plan, whose size is fixed.
    """
    text = docs[text_column]
    hashed = with_hashes(docs, F.struct("*"), text, text=text)
    counted = base_counts(hashed, F.col("_c1"))
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")

    def total(hashes: str) -> Column:
        return F.aggregate(
            hashes, F.lit(0).cast("long"), lambda sum_, h: sum_ + F.get(table, F.pmod(h, F.lit(BUCKETS)).cast("int"))
        )

    grams = F.size("h1") + F.size("h2")
    score = F.when(grams > 0, (total("h1") + total("h2")) / (grams * F.lit(float(UNIT)))).otherwise(0.0)
    scored = counted.withColumn("score", score).drop("h1", "h2")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.select(
        F.col("_c0").alias("doc"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"),
    )
