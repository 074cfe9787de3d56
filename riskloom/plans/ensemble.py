"""Combining models: score matrix, stacking, fitted blend weights, bounded weight search."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskloom.functions.arith import bernoulli_loss, clip, linear_blend, two_way_mix, weighted_average
from riskloom.operators.folds import contiguous_folds
from riskloom.operators.metrics import NEGATIVE_WEIGHT, TOP_SHARE, gradients_of_ranked, log_loss_of_ranked, rank_score, ranked_by_score
from riskloom.operators.ordering import BUCKETS_PER_PART
from riskloom.operators.skew import row_floor
from riskloom.plans import intasks
from riskloom.plans.learn import ModelBundle, average_folds, boosted_trees, cross_validate, fold_scores
from riskloom.session import materialize, shuffle_partitions

EPS = 1e-15

# A fall of the loss below this (relative to it) is not measurable in double precision.
GAIN = 1e-13

# The first two-way mix, the bound of the weight search and its number of trials.
FIRST_MIX_WEIGHT = 0.03221084221328546
SEARCH_MAX_WEIGHT = 0.001
SEARCH_STEPS = 100

# Rows, one for each candidate, that a task orders.
ROWS_PER_TASK = 4_000_000

# Equal steps of the score from which the search makes its buckets.
CELLS = 4096

# Cells that bound the candidates left beside the leader.
FINE_CELLS = 1 << 16

# Buckets beyond those that balance the tasks only tighten the bounds.
MOST_BUCKETS = 2048

# A bucket with so many times the rows of an average one is too much for a task.
HOT_BUCKET = 16

# Scores closer than this are compared by their exact values, not by bounds.
ROUNDING = 1e-9


def score_matrix(scores: DataFrame, id: str, model: str, score: str, models: Sequence[str]) -> DataFrame:
    """Long ``(id, model, score)`` rows to one row per id with a column per model.

    One exchange by id whatever the number of models. Ids without a score of
    every model are left out, as in a chain of inner joins.
    """
    columns = [F.max(F.when(F.col(model) == m, F.col(score))).alias(m) for m in models]
    wanted = scores.where(F.col(model).isin(list(models))).select(id, model, score)
    return wanted.repartition(id).groupBy(id).agg(*columns).na.drop(subset=list(models))


@dataclass
class StackFit:
    """The settled bundle, the fold-averaged prediction of the test rows, and the rounds that led there.

    ``rounds`` holds ``(round, id, label, raw, weight)``: the out-of-fold raw score of every round and the weight that
    follows from it for the next one. ``losses`` are the rank-weighted losses by round.
    """

    bundle: ModelBundle
    predictions: DataFrame
    rounds: DataFrame
    losses: list[float]


def stack_until_settled(
    oof: DataFrame,
    test: DataFrame,
    members: Sequence[str],
    label: str,
    id: str,
    k: int = 5,
    seed: int = 42,
    rounds: int = 10,
    depth: int = 3,
    tolerance: float = 1e-2,
    most: int = 12,
) -> StackFit:
    """Meta-learner on member predictions whose row weights follow its own scores.

    The first fit is unweighted. After each, rows get the weights of the rank-weighted loss at their out-of-fold scores, and
    the next fit trains with them, until the rank-weighted loss changes by no more than ``tolerance`` of itself. Weights are at
    most 2, so a round never strays far. Raises if the loss has not settled after ``most`` fits.
    """
    held, losses, bundle, weighted = [], [], None, oof
    while True:
        weight = "weight" if held else None
        stages = lambda weight=weight: [boosted_trees(rounds, depth, seed=seed, weight=weight, label=label)]
        bundle = cross_validate(weighted, members, label, id, stages, k, seed, carry=["weight"] if weight else [], scored=False)
        p = clip(F.col("prediction"), EPS, 1.0 - EPS)
        raw = bundle.oof.select(id, label, F.log(p / (F.lit(1.0) - p)).alias("raw"))
        # Ranked once, for the weights and for the loss.
        ranked = materialize(ranked_by_score(raw, label, "raw", id))
        weights = gradients_of_ranked(ranked, label, "raw", id).select(id, label, "raw", "weight")
        losses.append(log_loss_of_ranked(ranked, label, "raw").first().rank_weighted_log_loss)
        held.append(weights.select(F.lit(len(held)).alias("round"), "*"))
        if len(losses) > 1 and abs(losses[-1] - losses[-2]) <= tolerance * abs(losses[-1]):
            break
        if len(losses) == most:
            raise RuntimeError(f"the weighted loss has not settled after {most} fits: {losses}")
        weighted = oof.join(weights.select(id, "weight"), id)
    bundle.oof = bundle.oof.drop("weight")
    # Only the settled bundle is scored; those before it are not kept.
    bundle.scores = fold_scores(bundle.oof.withColumn("repeat", F.lit(0)), bundle.oof, label, id)
    return StackFit(bundle, average_folds(bundle.models, test, members), reduce(DataFrame.unionByName, held), losses)


def stack(oof: DataFrame, test: DataFrame, members: Sequence[str], label: str, id: str, **options) -> tuple[ModelBundle, DataFrame]:
    """The settled bundle and the prediction of ``test`` (:func:`stack_until_settled`)."""
    made = stack_until_settled(oof, test, members, label, id, **options)
    return made.bundle, made.predictions


@dataclass
class BlendFit:
    """Blend weights per fold and their mean; the last member takes the rest to one."""

    fold_weights: np.ndarray
    weights: np.ndarray
    passes: int


def blend_objective(df: DataFrame, label: str, weights: dict[str, float], k: int) -> DataFrame:
    """Log loss of a fixed blend on the training part of each of ``k`` folds (column ``fold``)."""
    loss = bernoulli_loss(F.col(label), linear_blend(weights))
    losses = [F.avg(F.when(F.col("fold") != f, loss)).alias(f"l{f}") for f in range(k)]
    row = df.agg(*losses)
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"l{f}").alias("log_loss")) for f in range(k)])).alias("e")).select("e.*")


def fit_blend(
    df: DataFrame,
    members: Sequence[str],
    label: str,
    id: str,
    k: int = 5,
    tolerance: float = 1e-9,
    max_passes: int = 200,
) -> BlendFit:
    """Weights that minimise the log loss of the clipped blend, per contiguous fold, averaged.

    Every pass evaluates value, slope and curvature of all folds in one aggregate over the
    table (a few sums per fold); the driver solves k systems of size m-1. Rows whose
    blend is clipped have a constant loss, hence no slope. A step is halved until the loss
    falls. A fold has converged when its next step is below ``tolerance`` or promises
    no measurable gain. Raises if a fold does not get there in ``max_passes``.
    """
    placed = materialize(contiguous_folds(df.select(id, label, *members), id, k))
    m = len(members)
    free = m - 1
    current = np.full((k, free), 1.0 / m)
    if free == 0:
        return BlendFit(current, np.ones(1), 0)
    step = np.zeros((k, free))
    scale = np.ones(k)
    best = np.full(k, np.inf)
    promised = np.full(k, np.inf)
    done = np.zeros(k, dtype=bool)
    passes = 0
    while not done.all():
        if passes == max_passes:
            raise RuntimeError(f"blend weights of folds {np.flatnonzero(~done).tolist()} did not converge in {passes} passes")
        passes += 1
        value, grad, hess = _blend_sums(placed, members, label, current + step * scale[:, None])
        for f in np.flatnonzero(~done):
            if value[f] <= best[f]:
                gain = best[f] - value[f]
                current[f] = current[f] + step[f] * scale[f]
                best[f] = value[f]
                step[f], promised[f] = _descent(grad[f], hess[f])
                scale[f] = 1.0
                small = GAIN * (1.0 + abs(best[f]))
                done[f] = np.abs(step[f]).max() < tolerance or (promised[f] < small and gain < small)
            else:
                scale[f] /= 2.0
                # A slope that promises nothing measurable over the rest of the step is a minimum.
                done[f] = promised[f] * scale[f] < GAIN * (1.0 + abs(best[f])) or np.abs(step[f]).max() * scale[f] < tolerance
            if done[f]:
                step[f] = 0.0
    mean = current.mean(axis=0)
    return BlendFit(current, np.append(mean, 1.0 - mean.sum()), passes)


def _descent(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton step, and the fall of the loss it promises; along the slope where the curvature gives no descent."""
    step = -np.linalg.lstsq(hess, grad, rcond=None)[0]
    if grad @ step >= 0.0 and np.abs(grad).max() > 0.0:
        step = -grad / max(1.0, np.abs(grad).max())
    return step, float(-grad @ step)


def blend_moments(df: DataFrame, members: Sequence[str], label: str, weights: np.ndarray) -> DataFrame:
    """``(training, moments)``: loss, slope and curvature of the blend on the training rows of every fold, as one vector each.

    A row's ``fold`` is the one it is held out of; it counts for all others. The vector holds the mean loss, the slope along every member but
    the last, and the curvature packed row by row (i, j <= i). Tasks sum their rows by matrix products, and only the sums are exchanged.
    """
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("fold", label, *members)])
    values = [F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(members)]
    rows = df.where(complete).select("fold", F.col(label).cast("double").alias("y"), *values)
    parts = rows.mapInArrow(intasks.moment_sums(weights, EPS), "training int, n long, sums array<double>")
    each = parts.select("training", "n", F.posexplode("sums").alias("at", "sum"))
    whole = each.groupBy("training", "at").agg((F.sum("sum") / F.sum("n")).alias("mean"))
    gathered = whole.groupBy("training").agg(F.sort_array(F.collect_list(F.struct("at", "mean"))).alias("means"))
    return gathered.select("training", F.col("means.mean").alias("moments"))


def _blend_sums(df: DataFrame, members: Sequence[str], label: str, weights: np.ndarray):
    """Loss, slope and curvature of every fold's training rows, in one job."""
    k, free = weights.shape
    value, grad, hess = np.zeros(k), np.zeros((k, free)), np.zeros((k, free, free))
    low = np.tril_indices(free)
    for r in blend_moments(df, members, label, weights).collect():
        own = np.array(r.moments)
        value[r.training], grad[r.training] = own[0], own[1 : 1 + free]
        hess[r.training][low] = own[1 + free :]
        hess[r.training] += np.tril(hess[r.training], -1).T
    return value, grad, hess


@dataclass(frozen=True)
class _Candidates:
    """Rows of two members, the weights to try, and ordered buckets of the mixed score, the highest first."""

    rows: DataFrame
    id: str
    label: str
    members: tuple[str, str]
    max_weight: float
    steps: int
    low: float
    high: float
    bucket_of_cell: list[int]
    positives: int
    negatives: int

    @property
    def weight(self) -> int:
        return NEGATIVE_WEIGHT * self.negatives + self.positives

    def weight_of(self, candidate: Column) -> Column:
        return candidate * F.lit(self.max_weight) / F.lit(float(self.steps))

    def mix(self, candidate: Column) -> Column:
        return two_way_mix(F.col(self.members[0]), F.col(self.members[1]), self.weight_of(candidate))

    def cell(self, candidate: Column) -> Column:
        """Cell of the mixed score, 0 for the highest; missing scores come last. It never rises with the score."""
        mixed, last = self.mix(candidate), F.lit(CELLS - 1.0)
        if self.high > self.low:
            place = (F.lit(self.high) - mixed) * F.lit(CELLS / (self.high - self.low))
        else:
            place = F.when(mixed > self.high, 0.0).when(mixed < self.low, last).otherwise(1.0)
        place = F.least(last, F.greatest(F.lit(0.0), place))
        return F.floor(F.when(mixed.isNull() | F.isnan(mixed), last).otherwise(place)).cast("int")

    def placing(self, cells: int = CELLS) -> intasks.Placing:
        return intasks.Placing(self.members, self.max_weight, self.steps, self.low, self.high, cells)

    def spread(self, candidates: Sequence[int]) -> DataFrame:
        """Every row once per bucket that it visits, with the run of candidates (positions ``start``..``stop``) for which it does.

        A mixed score moves one way as the weight grows, so a row visits few buckets, and with small weights one or two.
        """
        schema = T.StructType([*self.rows.schema.fields, *[T.StructField(c, T.IntegerType()) for c in ("bucket", "start", "stop")]])
        return self.rows.mapInArrow(intasks.runs(self.placing(), np.array(self.bucket_of_cell), list(candidates)), schema)

    def counted(self, candidates: Sequence[int], cells: int, bucket_of_cell: Sequence[int]) -> DataFrame:
        """``(at, bucket, n, p)``: rows and positives per candidate and bucket; only these counts are exchanged."""
        counts = intasks.counts(self.placing(cells), np.array(bucket_of_cell), list(candidates), self.label)
        parts = self.rows.select(self.label, *self.members).mapInArrow(counts, "at int, bucket int, n long, p long")
        return parts.groupBy("at", "bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))

    def totals(self, candidates: Sequence[int]) -> np.ndarray:
        """Rows and positives per candidate and bucket. Their number is set by settings and steps."""
        made = np.zeros((len(candidates), max(self.bucket_of_cell) + 1, 2), dtype=np.int64)
        for r in self.counted(candidates, CELLS, self.bucket_of_cell).collect():
            made[r["at"], r.bucket] = r.n, r.p
        return made

    def upper(self, candidates: Sequence[int]) -> dict[int, float]:
        """Largest possible score of every candidate, by cells so narrow that few rows share one. One row a candidate is collected."""
        weight = F.lit(NEGATIVE_WEIGHT) * (F.col("n") - F.col("p")) + F.col("p")
        above = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        cells = self.counted(candidates, FINE_CELLS, range(FINE_CELLS)).withColumn("before", F.coalesce(F.sum(weight).over(above), F.lit(0)))
        area = F.col("p") * (F.lit(self.weight + 1.0) - F.col("before")) - F.col("p") * (F.col("p") + 1) / 2
        caught = F.least(F.col("p"), F.greatest(F.lit(0), F.lit(math.floor(TOP_SHARE * self.weight)) - F.col("before")))
        ends = cells.groupBy("at").agg(F.sum(area).alias("area"), F.sum(caught).alias("caught")).collect()
        return {candidates[r["at"]]: self._score(r.area, r.caught) for r in ends}

    def bounds(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of every candidate: negatives, or positives, first in every bucket."""
        n, p = totals[..., 0], totals[..., 1]
        m = n - p
        before = np.cumsum(NEGATIVE_WEIGHT * m + p, axis=1) - (NEGATIVE_WEIGHT * m + p)
        limit = math.floor(TOP_SHARE * self.weight)
        ends = []
        for behind in (NEGATIVE_WEIGHT * m, 0 * m):
            area = (p * (self.weight + 1.0 - before - behind) - p * (p + 1) / 2).sum(axis=1)
            ends.append(self._score(area, np.clip(limit - before - behind, 0, p).sum(axis=1)))
        return ends[0], ends[1]

    def _score(self, area, caught):
        """Score from the weight at or after each positive, summed, and the positives within the top share.

        The running weight times the weight, summed over all rows, does not depend on their order.
        """
        w, p, m = self.weight, self.positives, self.negatives
        best = NEGATIVE_WEIGHT / 2 * m * (1.0 - (NEGATIVE_WEIGHT - 1.0) / w)
        gini = (area / p - (w * w + NEGATIVE_WEIGHT**2 * m + p) / (2.0 * w)) / best
        return 0.5 * (gini + caught / p)

    def exact(self, candidates: Sequence[int], totals: np.ndarray, min_rows: int | None = None) -> DataFrame:
        """``(candidate, rank_score)``: rows are exchanged once per bucket they visit and ordered there for every candidate."""
        buckets = totals.shape[1]
        if totals[..., 0].max() > max(row_floor(min_rows), HOT_BUCKET * totals[0, :, 0].sum() / buckets):
            # A score shared by so many rows that one bucket is too much for a task: the general rank slices such ties.
            copies = self.rows.withColumn("candidate", F.explode(F.lit(list(candidates)))).withColumn("_mix", self.mix(F.col("candidate")))
            return rank_score(copies, self.label, "_mix", self.id, by=["candidate"]).select("candidate", "rank_score")
        n, p = totals[..., 0], totals[..., 1]
        # As many numbers as candidates and buckets, whatever the table.
        before = np.cumsum(NEGATIVE_WEIGHT * (n - p) + p, axis=1) - (NEGATIVE_WEIGHT * (n - p) + p)
        tasks = max(1, min(buckets, math.ceil(int(n.sum()) / ROWS_PER_TASK)))
        order = intasks.ordered(
            self.placing(), self.id, self.label, list(candidates), before, NEGATIVE_WEIGHT, self.weight, math.floor(TOP_SHARE * self.weight)
        )
        placed = self.spread(candidates).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(order, "at int, area long, caught long")
        summed = placed.groupBy("at").agg(F.sum("area").alias("area"), F.sum("caught").alias("caught"))
        score = self._score(F.col("area"), F.col("caught"))
        return summed.select(F.get(F.lit(list(candidates)), F.col("at")).alias("candidate"), score.alias("rank_score"))


def _candidates(df: DataFrame, label: str, first: str, second: str, id: str, max_weight: float, steps: int) -> _Candidates | None:
    """Buckets of similar size over the mixed scores of a few weights; None if the table has one class only."""
    rows = df.select(id, F.col(label).cast("int").alias(label), F.col(first).cast("double").alias(first), F.col(second).cast("double").alias(second))
    finite = [F.when(F.abs(c) < F.lit(float("inf")), F.col(c)) for c in (first, second)]
    row = rows.agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"),
        F.min(F.least(*finite)).alias("low"), F.max(F.greatest(*finite)).alias("high"),
    ).first()
    if not row.p or row.p == row.n:
        return None
    low, high = (row.low, row.high) if row.low is not None else (0.0, 0.0)
    made = _Candidates(rows, id, label, (first, second), max_weight, steps, low, high, [0] * CELLS, row.p, row.n - row.p)
    probes = sorted({round(i * steps / 4) for i in range(5)})
    seen = rows.select(F.explode(F.array(*[made.cell(F.lit(c)) for c in probes])).alias("cell")).groupBy("cell").count().collect()
    counts = np.zeros(CELLS, dtype=np.int64)
    for r in seen:
        counts[r.cell] = r["count"]
    tasks = max(1, math.ceil(row.n * (steps + 1) / ROWS_PER_TASK))
    # Enough for all tasks, and narrow for tight bounds, but no more counts than rows.
    wanted = max(BUCKETS_PER_PART * max(tasks, shuffle_partitions(df.sparkSession)), min(MOST_BUCKETS, row.n // (steps + 1)))
    share = (np.cumsum(counts) - counts) * wanted // max(1, counts.sum())
    # Numbers without gaps; cells that hold nothing join the bucket before.
    buckets = np.unique(share, return_inverse=True)[1]
    return replace(made, bucket_of_cell=[int(b) for b in buckets])


def blend_grid(
    df: DataFrame,
    label: str,
    first: str,
    second: str,
    id: str,
    max_weight: float = SEARCH_MAX_WEIGHT,
    steps: int = SEARCH_STEPS,
    min_rows: int | None = None,
) -> DataFrame:
    """Rank score of ``(1-w) first + w second`` for evenly spaced w in [0, max_weight].

    Rows are exchanged once per bucket of scores that they visit, not once per candidate, and ordered per candidate where they arrive.
    """
    tried = list(range(steps + 1))
    made = _candidates(df, label, first, second, id, max_weight, steps)
    if made is None:
        nothing = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("candidate"), F.lit(None).cast("double").alias("rank_score"))
        return nothing.select("candidate", _weight_of(max_weight, steps), "rank_score")
    return made.exact(tried, made.totals(tried), min_rows).select("candidate", _weight_of(max_weight, steps), "rank_score")


def _weight_of(max_weight: float, steps: int) -> Column:
    return (F.col("candidate") * F.lit(max_weight) / F.lit(float(steps))).alias("weight")


@dataclass(frozen=True)
class BlendSearch:
    """The best candidate of a grid, its weight and score, and the candidates whose rows had to be ordered."""

    candidate: int
    weight: float
    rank_score: float | None
    ordered: list[int]


def search_best(
    df: DataFrame,
    label: str,
    first: str,
    second: str,
    id: str,
    max_weight: float = SEARCH_MAX_WEIGHT,
    steps: int = SEARCH_STEPS,
    min_rows: int | None = None,
) -> BlendSearch:
    """The grid's best candidate by branch and bound; the smallest weight wins a tie.

    Counts per candidate and bucket bound every score from both sides, without ordering a row. The candidate that may score highest is ordered first; of the
    others, only those are ordered whose upper bound reaches the best score known, by the buckets and then by cells many times as narrow.
    """
    made = _candidates(df, label, first, second, id, max_weight, steps)
    if made is None:
        return BlendSearch(0, 0.0, None, [])
    tried = list(range(steps + 1))
    totals = made.totals(tried)
    lower, upper = made.bounds(totals)
    leader = int(np.argmax(upper))

    def ordered(candidates: list[int]) -> dict[int, float]:
        rows = made.exact(candidates, totals[candidates], min_rows).collect()
        return {r.candidate: r.rank_score for r in rows}

    scores = ordered([leader])
    least = max(float(lower.max()), scores[leader]) - ROUNDING
    rest = [c for c in tried if c != leader and upper[c] >= least]
    if rest:
        closer = made.upper(rest)
        rest = [c for c in rest if closer[c] >= least]
    if rest:
        scores |= ordered(rest)
    best = min(scores, key=lambda c: (-scores[c], c))
    return BlendSearch(best, best * max_weight / float(steps), scores[best], sorted(scores))


def search_blend(df: DataFrame, label: str, first: str, second: str, id: str, **grid) -> float:
    """Weight of the best candidate; the smallest weight wins a tie."""
    return search_best(df, label, first, second, id, **grid).weight


def mix_and_search(
    oof: DataFrame,
    test: DataFrame,
    label: str,
    id: str,
    first: str,
    second: str,
    third: str,
    mix_weight: float = FIRST_MIX_WEIGHT,
    **grid,
) -> tuple[float, DataFrame, DataFrame]:
    """Mix two members with a fixed weight, then search the weight of a third.

    Returns the weight found and the blended ``prediction`` of both frames.
    """
    base = two_way_mix(F.col(first), F.col(second), mix_weight).alias("_base")
    mixed = materialize(oof.select(id, label, base, third))
    weight = search_blend(mixed, label, "_base", third, id, **grid)
    final = two_way_mix(F.col("_base"), F.col(third), weight).alias("prediction")
    return weight, mixed.select(id, label, final), test.select(id, base, third).select(id, final)


def apply_blend(df: DataFrame, id: str, members: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """``(id, prediction)``: the fitted weights applied to member predictions."""
    return df.select(id, weighted_average(members, weights).alias("prediction"))
