"""Toxic spans by a linear-chain conditional random field, aggregated to document scores."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.llm.common import memo, written

#: The field is fitted on at most so many labelled documents of either label.
TRAIN_DOCS = 8_000

#: A feature is known if it occurs in this many training documents, and either so many times likelier in
#: toxic ones or in this share of all. The field has no use for rare features that lean nowhere.
MIN_DOCS = 5
KNOWN_LIFT = 3.0
KNOWN_SHARE = 0.003

#: A token of a toxic document is labelled toxic if one of its features is this many times likelier in toxic documents.
LIFT = 12.0

#: Passes over the training documents; after each, the weights that parts of them have arrived at are averaged.
ROUNDS = 5
PARTS = 6

#: Tokens per gradient step.
STEP_TOKENS = 12_000


def features(word: str) -> list[str]:
    """The word in lower case without outer punctuation, and its beginnings."""
    word = word.lower().strip(".,;:!?*%&#$\"'()[]{}<>|-_")
    return [f"w={word}", f"4={word[:4]}", f"5={word[:5]}", f"3={word[-3:]}"]


def _chain(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """Forward odds of state 1 along tokens, for many texts in one array (``first`` marks where one begins).

    A token maps the odds before it to ``e * (a01 + a11 r) / (a00 + a10 r)``, a 2x2 matrix up to scale.
    The array is cut into rows that are walked side by side: once to multiply each row's matrices, then,
    with the odds at the rows' beginnings known, once for the odds themselves.
    """
    n = len(e)
    width = max(1, int(math.sqrt(n)))
    rows = -(-n // width)
    pad = rows * width - n
    grid = np.concatenate([e, np.ones(pad)]).reshape(rows, width).T
    begin = np.concatenate([first, np.ones(pad, dtype=bool)]).reshape(rows, width).T
    a00, a01 = np.where(begin, 1.0, trans[0, 0]), np.where(begin, start, trans[0, 1])
    a10, a11 = np.where(begin, 1.0, trans[1, 0]), np.where(begin, start, trans[1, 1])
    # The matrix takes (weight of 0, weight of 1) before a token to the same after it.
    p00, p01, p10, p11 = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(width):
        x = grid[k]
        q00, q01 = p00 * a00[k] + p01 * a10[k], (p00 * a01[k] + p01 * a11[k]) * x
        q10, q11 = p10 * a00[k] + p11 * a10[k], (p10 * a01[k] + p11 * a11[k]) * x
        scale = 1.0 / (q00 + q01 + q10 + q11)
        p00, p01, p10, p11 = q00 * scale, q01 * scale, q10 * scale, q11 * scale
    before = np.empty(rows)
    r = 0.0
    for i in range(rows):
        before[i] = r
        r = (p01[i] + r * p11[i]) / (p00[i] + r * p10[i])
    out = np.empty((width, rows))
    r = before
    for k in range(width):
        r = grid[k] * (a01[k] + a11[k] * r) / (a00[k] + a10[k] * r)
        out[k] = r
    return out.T.ravel()[:n]


def forward_backward(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float):
    """Marginals of state 1, and the pairwise ones of each token with the one before it (zero where a text begins).

    ``score`` is each token's log potential of state 1 against 0, ``trans`` the 2x2
    transition potentials, ``start`` the potential of state 1 against 0 at a first token.
    """
    e = np.exp(np.clip(score, -30, 30))
    ahead = _chain(e, first, trans, start)
    last = np.append(first[1:], True)
    # Backwards, odds before a token's own evidence: walk the reversed array with the evidence of the next token.
    back = _chain(e[::-1], last[::-1], trans.T, 1.0)[::-1]
    behind = np.ones(len(e))
    inner = ~last
    r = np.append(back[1:], 1.0)
    behind[inner] = ((trans[1, 0] + trans[1, 1] * r) / (trans[0, 0] + trans[0, 1] * r))[inner]
    odds = ahead * behind
    p = odds / (1 + odds)
    prev = np.append(1.0, ahead[:-1])
    cells = np.stack([np.full(len(e), trans[0, 0]), trans[0, 1] * e * behind, prev * trans[1, 0], prev * trans[1, 1] * e * behind])
    cells = np.where(first, 0.0, cells / cells.sum(axis=0))
    return p, cells


@dataclass
class Field:
    """A fitted field: weights of features, transitions, and how marginals make a document's score."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    start: float
    document: tuple[float, ...] = ()


def _broadcast(spark: SparkSession, field: Field):
    """The parts of a field, as types that every executor knows."""
    return spark.sparkContext.broadcast((field.weights, field.bias, field.trans, field.start, field.document))


def _flat(texts: list[str], emission) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all tokens of some texts in one array, where texts begin, and the text of each token."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words])
    score = np.fromiter((emission[x] for w in words for x in w), dtype=np.float64, count=int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, dtype=bool)
    return score, first, owner


def _summary(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per document: log of the expected number of toxic tokens, the largest marginal, the share of toxic tokens."""
    total = np.bincount(owner, weights=p, minlength=n)
    tokens = np.maximum(1, np.bincount(owner, minlength=n))
    most = np.zeros(n)
    np.maximum.at(most, owner, p)
    return np.column_stack([np.log1p(total), most, np.minimum(1.0, 20 * total / tokens)])


def _scorer(field: Field):
    """Per text: the document features, and the offsets of toxic spans as (start, length) in code points."""
    import re

    def weight(word: str) -> float:
        return field.bias + sum(field.weights.get(f, 0.0) for f in features(word))

    token = re.compile(r"\S+")

    def run(texts: list[str], name: str):
        # Words mean the same to every task that has this field.
        emission = memo(f"crf:{name}", weight)
        score, first, owner = _flat(texts, emission)
        if not len(score):
            return np.zeros((len(texts), 3)), [[] for _ in texts]
        p, _ = forward_backward(score, first, field.trans, field.start)
        begins = np.searchsorted(owner, np.arange(len(texts) + 1))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for i in np.unique(owner[p >= 0.5]):
            toxic = p[begins[i] : begins[i + 1]] >= 0.5
            text, found = texts[i], []
            for k, m in enumerate(token.finditer(text)):
                if toxic[k]:
                    if k and toxic[k - 1]:
                        found[-1] = (found[-1][0], m.end() - found[-1][0])
                    else:
                        found.append((m.start(), m.end() - m.start()))
            spans[i] = found
        return _summary(p, owner, len(texts)), spans

    return run


def _document_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many toxic and other documents each feature occurs."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            found = {f for w in set(text.split()) for f in features(w)}
            (toxic if label else other).update(found)
    names = list(toxic.keys() | other.keys())
    if names:
        yield pd.DataFrame({"feature": names, "toxic": [toxic[f] for f in names], "other": [other[f] for f in names]})


def _blocks(texts: list[str], size: int) -> Iterator[list[int]]:
    """Consecutive texts with about ``size`` characters together; a longer text is a block by itself."""
    block, held = [], 0
    for i, t in enumerate(texts):
        if block and held + len(t) > size:
            yield block
            block, held = [], 0
        block.append(i)
        held += len(t)
    if block:
        yield block


def _trainer(names: dict[str, int], lexicon: set[str], state: np.ndarray):
    """One pass of gradient steps over a part of the training documents, from shared weights."""

    def tokens(word: str):
        own = features(word)
        ids = [names.get(f, 1) for f in own]
        return (*ids, any(f in lexicon for f in own))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, known = state.copy(), {}
        squares = np.full(len(w), 1e-2)
        size, seen = len(w) - 4, 0
        for batch in batches:
            texts = batch["text"].tolist()
            toxic = batch["toxic"].to_numpy(dtype=bool)
            for block in _blocks(texts, STEP_TOKENS * 6):
                words = [texts[i].split() for i in block]
                counts = [len(x) for x in words]
                if not sum(counts):
                    continue
                table = np.array([known.get(x) or known.setdefault(x, tokens(x)) for ws in words for x in ws], dtype=np.int64)
                owner = np.repeat(np.arange(len(block)), counts)
                first = np.append(True, owner[1:] != owner[:-1])
                ids, y = table[:, :4], table[:, 4] * toxic[block][owner]
                trans = np.exp(np.array([[0.0, w[-4]], [w[-3], w[-2]]]))
                p, cells = forward_backward(w[0] + w[ids].sum(axis=1), first, trans, math.exp(w[-1]))
                slope = y - p
                grad = np.zeros(len(w))
                for k in range(4):
                    grad[:size] += np.bincount(ids[:, k], weights=slope, minlength=size)
                grad[0], grad[1] = slope.sum(), 0.0
                prev = np.append(0, y[:-1])
                real = ~first
                for cell, (i, j) in ((1, (0, 1)), (2, (1, 0)), (3, (1, 1))):
                    grad[-5 + cell] = ((prev == i) & (y == j) & real).sum() - cells[cell].sum()
                grad[-1] = slope[first].sum()
                grad -= 1e-3 * w
                squares += grad**2
                w += 0.4 * grad / np.sqrt(squares)
                seen += len(block)
        yield pd.DataFrame({"weights": [w.astype("<f8").tobytes()], "docs": [seen]})

    return run


def training_sample(docs: DataFrame, labels: DataFrame, where: Column, per_label: int = TRAIN_DOCS) -> DataFrame:
    """At most ``per_label`` labelled documents of each label, those with the smallest digests of their ids.

    A document that is labelled both ways counts as toxic; of several texts with one id, the first in byte order is taken.
    """
    own = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("label_id").cast("string").cast("binary"))
    fit = own.where(where).withColumn("order", order)
    few = [fit.where(F.col("toxic") == k).orderBy("order", "label_id").limit(per_label) for k in (0, 1)]
    chosen = few[0].unionByName(few[1]).drop("order")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def fit_field(sample: DataFrame) -> Field:
    """Fit a field on a bounded sample (``doc_id``, ``text``, ``toxic``).

    Labels are of documents; tokens are labelled from them: in a toxic document, those with a feature that is ``LIFT``
    times likelier in toxic documents than in others. Passes run over parts of the sample in
    tasks, and their weights are averaged (iterative parameter mixing). The
    driver holds one weight per known feature, of which a bounded sample has boundedly many.
    """
    spark = sample.sparkSession
    sample = written(sample.repartition(PARTS, F.md5(F.col("doc_id").cast("string").cast("binary"))).sortWithinPartitions(F.md5("text")))
    total = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    counted = sample.mapInPandas(_document_features, "feature string, toxic long, other long").groupBy("feature")
    counted = counted.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    docs = F.col("toxic") + F.col("other")
    leaning = (F.col("toxic") + 0.5) / (n1 + 1) >= KNOWN_LIFT * (F.col("other") + 0.5) / (n0 + 1)
    common = docs >= KNOWN_SHARE * (n0 + n1)
    known = counted.where((docs >= MIN_DOCS) & (leaning | common)).orderBy("feature").collect()
    lift = {r.feature: ((r.toxic + 0.5) / (n1 + 1)) / ((r.other + 0.5) / (n0 + 1)) for r in known}
    lexicon = {f for f, x in lift.items() if x >= LIFT and f[0] != "3"}
    names = {r.feature: i for i, r in enumerate(known, 2)}
    # Bias, a zero for unknown features, one weight per feature; then 0->1, 1->0, 1->1, and start.
    state = np.zeros(len(names) + 2 + 4)
    state[0] = -2.0
    for _ in range(ROUNDS if n1 and n0 else 0):
        parts = sample.mapInPandas(_trainer(names, lexicon, state), "weights binary, docs long").where("docs > 0").collect()
        share = np.array([r.docs for r in parts], dtype=float)
        state = np.average([np.frombuffer(r.weights, "<f8") for r in parts], axis=0, weights=share)
    trans = np.exp(np.array([[0.0, state[-4]], [state[-3], state[-2]]]))
    weights = {f: float(state[i]) for f, i in names.items() if abs(state[i]) > 1e-4}
    field = Field(weights, float(state[0]), trans, math.exp(state[-1]))
    if not (n1 and n0):
        return field

    shared, name = _broadcast(spark, field), uuid.uuid4().hex

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = _scorer(Field(*shared.value))
        for batch in batches:
            values, _ = run(batch["text"].tolist(), name)
            yield pd.DataFrame(values, columns=["a", "b", "c"]).assign(label=batch["toxic"].to_numpy(dtype=float))

    points = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        sample.mapInPandas(summaries, "a double, b double, c double, label double")
    )
    fitted = LogisticRegression(maxIter=40, regParam=1e-3, standardization=False).fit(points)
    field.document = (float(fitted.intercept), *map(float, fitted.coefficients))
    return field


def toxicity(docs: DataFrame, field: Field, text_column: str = "text") -> DataFrame:
    """Score the whole text of every row: ``doc`` (all columns of ``docs`` as a struct), ``score``, ``spans``.

    Marginals from forward-backward over all words of a text give its expected
    number and share of toxic words and the largest marginal; a logistic function of these is the score (0 to 1).
    ``spans`` are the offending offsets: runs of words with a marginal of at least one half,
    as (start, length) in code points. Labels, ids, languages and sources play no part.

    NULL, empty and blank texts are scored as texts without words, with no spans. Repeated rows are scored alike, texts
    of any length whole. Without labels of both kinds every score is 0.
    """
    shared = _broadcast(docs.sparkSession, field)
    name = uuid.uuid4().hex

    @F.pandas_udf("score double, spans array<struct<start:int,length:int>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        own = Field(*shared.value)
        run = _scorer(own)
        texts = texts.fillna("").tolist()
        score, spans = np.zeros(len(texts)), []
        for block in _blocks(texts, 2_000_000):
            values, found = run([texts[i] for i in block], name)
            if own.document:
                score[block] = 1 / (1 + np.exp(-(own.document[0] + values @ np.array(own.document[1:]))))
            spans += found
        return pd.DataFrame({"score": score, "spans": spans})

    judged = docs.select(F.struct("*").alias("doc"), judge(docs[text_column]).alias("judged"))
    return judged.select("doc", "judged.score", "judged.spans")


def in_training(id_column: Column) -> Column:
    """Labels whose rows may be learned from: four of five, by the checksum of the id."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 != 0
