"""Rank metrics and losses, each usable for many groups (folds, candidates) in one job.

Negatives weigh 20 and positives 1. Rows are ordered by descending score; equal
scores are ordered by id, so every value is reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.arith import bernoulli_loss, sigmoid
from riskloom.operators.ordering import descending, ranked

NEGATIVE_WEIGHT = 20
TOP_SHARE = 0.04


def row_weight(label: str) -> Column:
    return F.when(F.col(label) == 0, F.lit(NEGATIVE_WEIGHT)).otherwise(F.lit(1)).cast("long")


def ranked_by_score(df: DataFrame, label: str, score: str, id: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with rank, running weight and running positives by descending score.

    Adds ``cum_w``, ``cum_p``, ``total_w``, ``total_p``, ``rank``, ``n_rows`` and
    ``in_top`` (the running weight is within the top share of all weight).
    Only the needed columns take part in the exchange.
    """
    needed = df.select(*by, id, F.col(label).cast("int").alias(label), score)
    rows = ranked(needed, [descending(score), F.col(id)], by, {"p": F.col(label)})
    # Weights follow from counts, so only the label travels with the order.
    weigh = lambda n, p: F.lit(NEGATIVE_WEIGHT) * (n - p) + p
    weighted = rows.withColumns(
        {
            "cum_w": weigh(F.col("rank"), F.col("cum_p")),
            "total_w": weigh(F.col("n_rows"), F.col("total_p")),
        }
    )
    return weighted.withColumn("in_top", F.col("cum_w") <= F.floor(F.lit(TOP_SHARE) * F.col("total_w")))


def rank_score(df: DataFrame, label: str, score: str, id: str, by: Sequence[str] = ()) -> DataFrame:
    """``top_capture`` (D), ``weighted_gini`` (G) and ``rank_score`` = (G + D) / 2 per group.

    The best possible Gini has a closed form, so the rows are ordered only once.
    A group with one class only has no score (NULL).
    """
    rows = ranked_by_score(df, label, score, id, by)
    lift = F.col("cum_p") / F.col("total_p") - F.col("cum_w") / F.col("total_w")
    both = F.col("total_p").between(1, F.col("n_rows") - 1)
    summed = rows.groupBy(*by).agg(
        F.sum(F.when(both, lift * row_weight(label))).alias("_gini"),
        F.sum(F.when(F.col("in_top"), F.col(label).cast("long"))).alias("_caught"),
        F.max("total_p").alias("_p"),
        F.max("total_w").alias("_w"),
        F.max("n_rows").alias("n_rows"),
    )
    negatives = F.col("n_rows") - F.col("_p")
    best = F.lit(NEGATIVE_WEIGHT / 2) * negatives * (F.lit(1.0) - F.lit(NEGATIVE_WEIGHT - 1.0) / F.col("_w"))
    defined = F.col("_p").between(1, F.col("n_rows") - 1)
    capture = F.when(defined, F.coalesce(F.col("_caught"), F.lit(0)) / F.col("_p"))
    gini = F.when(defined, F.col("_gini") / best)
    return summed.select(
        *by,
        capture.alias("top_capture"),
        gini.alias("weighted_gini"),
        (F.lit(0.5) * (gini + capture)).alias("rank_score"),
        "n_rows",
    )


def _falling_weight(steepness: float, max_weight: float) -> Column:
    """``1 + exp(-a (m-1) (1 - r/(n-1)))`` for the r-th best of n rows, counted from 0."""
    last = F.greatest(F.col("n_rows") - 1, F.lit(1))
    remaining = F.lit(1.0) - (F.col("rank") - 1) / last
    return F.lit(1.0) + F.exp(F.lit(-steepness * (max_weight - 1.0)) * remaining)


def rank_weighted_gradients(
    df: DataFrame,
    label: str,
    raw_score: str,
    id: str,
    by: Sequence[str] = (),
    steepness: float = 5.0,
    max_weight: float = 2.0,
    min_hessian: float | None = 1e-16,
) -> DataFrame:
    """First and second derivative of the rank-weighted log loss at raw scores.

    Positives outside the top share get a weight that grows as they rank lower;
    all other rows weigh 1. Adds ``weight``, ``grad`` and ``hess``.
    """
    rows = ranked_by_score(df, label, raw_score, id, by)
    return gradients_of_ranked(rows, label, raw_score, id, by, steepness, max_weight, min_hessian)


def gradients_of_ranked(
    rows: DataFrame,
    label: str,
    raw_score: str,
    id: str,
    by: Sequence[str] = (),
    steepness: float = 5.0,
    max_weight: float = 2.0,
    min_hessian: float | None = 1e-16,
) -> DataFrame:
    """:func:`rank_weighted_gradients` of rows that :func:`ranked_by_score` has ranked."""
    y = F.col(label).cast("double")
    missed = (F.col(label) == 1) & ~F.col("in_top")
    weighted = rows.withColumns(
        {
            "weight": F.when(missed, _falling_weight(steepness, max_weight)).otherwise(F.lit(1.0)),
            "_prob": sigmoid(F.col(raw_score)),
        }
    )
    p, scale = F.col("_prob"), F.lit(1.0) + F.col("weight") * y - y
    hess = p * (F.lit(1.0) - p) * scale
    return weighted.select(
        *by,
        id,
        label,
        raw_score,
        "rank",
        "weight",
        (p * scale - F.col("weight") * y).alias("grad"),
        (hess if min_hessian is None else F.greatest(hess, F.lit(min_hessian))).alias("hess"),
    )


def rank_weighted_log_loss(
    df: DataFrame,
    label: str,
    raw_score: str,
    id: str,
    by: Sequence[str] = (),
    steepness: float = 5.0,
    max_weight: float = 2.0,
) -> DataFrame:
    """Mean log loss at raw scores where every positive carries its rank weight."""
    return log_loss_of_ranked(ranked_by_score(df, label, raw_score, id, by), label, raw_score, by, steepness, max_weight)


def log_loss_of_ranked(
    rows: DataFrame, label: str, raw_score: str, by: Sequence[str] = (), steepness: float = 5.0, max_weight: float = 2.0
) -> DataFrame:
    """:func:`rank_weighted_log_loss` of rows that :func:`ranked_by_score` has ranked."""
    y, p = F.col(label).cast("double"), sigmoid(F.col(raw_score))
    loss = -_falling_weight(steepness, max_weight) * y * F.log(p) - (F.lit(1.0) - y) * F.log(F.lit(1.0) - p)
    return rows.groupBy(*by).agg(F.avg(loss).alias("rank_weighted_log_loss"))


def log_loss(df: DataFrame, label: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy; no ordering and one map-side combined aggregate."""
    return df.groupBy(*by).agg(F.avg(bernoulli_loss(F.col(label), F.col(probability))).alias("log_loss"))


def confusion_counts(df: DataFrame, label: str, predicted: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """One row per label with the number of rows predicted as each class."""
    counts = [F.count_if(F.col(predicted) == c).alias(f"pred_{c}") for c in classes]
    return df.groupBy(label).agg(*counts)


def fold_summary(scores: DataFrame, score: str) -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.agg(
        F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"), F.count(score).alias("folds")
    )


class RankScoreEvaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """The combined rank score as a Spark ML evaluator (larger is better).

    ``predictionCol`` is a score column or a probability vector, whose second
    entry is then used.
    """

    idCol: Param[str] = Param(Params._dummy(), "idCol", "row id, orders equal scores", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "probability", idCol: str = "id"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="probability", idCol="id")
        self._set(**self._input_kwargs)

    def isLargerBetter(self) -> bool:
        return True

    def _evaluate(self, dataset: DataFrame) -> float:
        score = self.getPredictionCol()
        value = F.col(score)
        if isinstance(dataset.schema[score].dataType, VectorUDT):
            value = vector_to_array(value)[1]
        label, id = self.getLabelCol(), self.getOrDefault(self.idCol)
        rows = dataset.select(F.col(label).cast("int").alias("label"), F.col(id).alias("id"), value.alias("score"))
        return rank_score(rows, "label", "score", "id").first().rank_score
