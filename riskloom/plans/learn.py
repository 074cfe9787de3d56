"""Cross-validated training, fold-averaged scoring and model bundles on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasValidationIndicatorCol
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions.missing import SENTINEL, fill_sentinel
from riskloom.operators.folds import balanced_grouped_folds, repeated_stratified_folds, stratified_folds
from riskloom.operators.metrics import fold_summary, log_loss, rank_score
from riskloom.session import materialize, scratch

MODEL_OUTPUTS = ("scaled", "rawPrediction", "probability", "prediction")
VALIDATION = "_is_validation"

MakeStages = Callable[[], list]
Metric = Callable[[DataFrame, str, str, str, Sequence[str]], DataFrame]


def boosted_trees(
    rounds: int = 20,
    depth: int = 4,
    step: float = 0.1,
    seed: int = 42,
    weight: str | None = None,
    label: str = "label",
    row_share: float = 1.0,
    feature_share: str = "all",
    leaf_rows: int = 1,
    bins: int = 32,
) -> GBTClassifier:
    """Boosted-tree member: binary objective, stops early on the held-out fold.

    ``row_share`` and ``feature_share`` are drawn anew for every tree and node; ``bins`` must not be
    below the number of values of a nominal feature.
    """
    params = dict(
        labelCol=label,
        featuresCol="features",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=step,
        seed=seed,
        validationIndicatorCol=VALIDATION,
        subsamplingRate=row_share,
        featureSubsetStrategy=feature_share,
        minInstancesPerNode=leaf_rows,
        maxBins=bins,
    )
    return GBTClassifier(**params, **({"weightCol": weight} if weight else {}))


def neural_stages(inputs: int, hidden: Sequence[int] = (16, 8), rounds: int = 50, seed: int = 42, label: str = "label") -> list:
    """Neural member, for diversity in the ensemble: standardised inputs, a small perceptron."""
    return [
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        MultilayerPerceptronClassifier(
            labelCol=label, featuresCol="scaled", layers=[inputs, *hidden, 2], maxIter=rounds, seed=seed
        ),
    ]


class StagedPerceptron(Estimator, HasLabelCol, HasFeaturesCol, HasValidationIndicatorCol):
    """A small perceptron on standardised inputs that is trained in short stages and stops early.

    Every stage goes on from the weights of the one before. After each, the log loss of the held-out rows is taken; training ends
    when it has not fallen for ``patience`` stages, and the weights of the best stage are kept. Inputs are
    standardised by the training rows. The fitted pipeline has the losses as ``stage_losses``.
    """

    def __init__(self, layers: Sequence[int], stage_rounds: int = 5, stages: int = 20, patience: int = 2, seed: int = 42, label: str = "label"):
        super().__init__()
        self._set(labelCol=label, featuresCol="features", validationIndicatorCol=VALIDATION)
        self.layers, self.stage_rounds, self.stages, self.patience, self.seed = list(layers), stage_rounds, stages, patience, seed

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        held_out, label = F.col(self.getValidationIndicatorCol()), self.getLabelCol()
        scaler = StandardScaler(inputCol=self.getFeaturesCol(), outputCol="scaled", withMean=True, withStd=True).fit(dataset.where(~held_out))
        scaled = scaler.transform(dataset).select(label, "scaled", held_out.alias(VALIDATION))
        losses: list[float] = []
        best = weights = None
        while len(losses) < self.stages:
            learner = MultilayerPerceptronClassifier(
                labelCol=label, featuresCol="scaled", layers=self.layers, maxIter=self.stage_rounds, seed=self.seed
            )
            if weights is not None:
                learner.setInitialWeights(weights)
            model = learner.fit(scaled.where(~F.col(VALIDATION)))
            weights = model.weights
            judged = model.transform(scaled.where(VALIDATION)).withColumn("_p", positive_probability())
            losses.append(log_loss(judged, label, "_p").first().log_loss)
            least = losses.index(min(losses))
            if least == len(losses) - 1:
                best = model
            elif len(losses) - 1 - least >= self.patience:
                break
        fitted = PipelineModel([scaler, best])
        fitted.stage_losses = losses
        return fitted


def early_stopping_stages(inputs: int, hidden: Sequence[int] = (16, 8), label: str = "label", **options) -> list:
    """Neural member that stops on the held-out fold (:class:`StagedPerceptron`)."""
    return [StagedPerceptron([inputs, *hidden, 2], label=label, **options)]


@dataclass
class ModelBundle:
    """Fold models over a ``features`` vector, out-of-fold predictions and scores (None if they were not asked for)."""

    models: list[PipelineModel]
    oof: DataFrame
    scores: DataFrame | None

    def save(self, path: str) -> None:
        """One folder: a pipeline per fold, and parquet for predictions and scores."""
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/model_{i}")
        self.oof.write.mode("overwrite").parquet(f"{path}/oof")
        self.scores.withColumn("models", F.lit(len(self.models))).write.mode("overwrite").parquet(f"{path}/scores")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelBundle:
        scores = spark.read.parquet(f"{path}/scores")
        count = scores.first().models
        models = [PipelineModel.load(f"{path}/model_{i}") for i in range(count)]
        return cls(models, spark.read.parquet(f"{path}/oof"), scores.drop("models"))


def assemble(
    df: DataFrame, features: Sequence[str], sentinel: float = SENTINEL, nominal: Mapping[str, int] | None = None
) -> DataFrame:
    """Add the ``features`` vector; missing and infinite values become the sentinel.

    ``nominal`` names features that are dictionary codes, with their number: trees split them by sets of
    values, not by order. A missing or unknown code is one more value. The columns themselves stay as they are.
    """
    nominal = nominal or {}
    filled = {f"_in_{c}": fill_sentinel(F.col(c).cast("double"), sentinel) for c in features}
    for c, n in nominal.items():
        known = F.col(c).between(0, n - 1)
        filled[f"_in_{c}"] = F.when(known, F.col(c).cast("double")).otherwise(F.lit(float(n)))
    ready = df.withColumns(filled)
    for c, n in nominal.items():
        ready = ready.withMetadata(f"_in_{c}", {"ml_attr": {"type": "nominal", "num_vals": n + 1}})
    assembler = VectorAssembler(inputCols=list(filled), outputCol="features")
    return assembler.transform(ready).drop(*filled)


def positive_probability() -> Column:
    return vector_to_array("probability")[1]


def _needs_validation(stages: Sequence) -> bool:
    last = stages[-1]
    return isinstance(last, Estimator) and last.hasParam("validationIndicatorCol") and last.isSet("validationIndicatorCol")


def fit_fold(assembled: DataFrame, make_stages: MakeStages, held_out: Column) -> PipelineModel:
    """Fit on the rows that are not held out.

    A learner with a validation column sees the held-out rows too, but only to
    decide when to stop.
    """
    stages = make_stages()
    training = assembled.withColumn(VALIDATION, held_out) if _needs_validation(stages) else assembled.where(~held_out)
    return Pipeline(stages=stages).fit(training)


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    id: str,
    make_stages: MakeStages,
    k: int = 5,
    seed: int = 42,
    group: str | None = None,
    repeats: int = 1,
    threads: int = 2,
    carry: Sequence[str] = (),
    nominal: Mapping[str, int] | None = None,
    metric: Metric = rank_score,
    measure: str = "rank_score",
    scored: bool = True,
) -> ModelBundle:
    """Train one model per fold and predict every row with the model that did not see it.

    Only ids, label and the assembled vector are kept, computed once into a table of the
    shared folder with a part for each fold, so that a fold's model reads the other parts only; folds are fitted
    from a few driver threads. ``group`` keeps all rows of an entity
    in one fold. With ``repeats`` the out-of-fold prediction of a row is the mean
    over repeats. ``metric(rows, label, score, id, by)`` gives the column ``measure`` of the scores; ``scored=False`` leaves them out.
    """
    with scratch(df.sparkSession) as folder:
        return _cross_validate(
            df, features, label, id, make_stages, k, seed, group, repeats, threads, carry, nominal, metric, measure, scored, folder
        )


def _cross_validate(
    df, features, label, id, make_stages, k, seed, group, repeats, threads, carry, nominal, metric, measure, scored, folder
) -> ModelBundle:
    kept = list(dict.fromkeys([id, label, *([group] if group else []), *carry, "features"]))
    # Placing the rows in folds reads them several times.
    rows = materialize(assemble(df, features, nominal=nominal).select(*kept).withColumn(label, F.col(label).cast("int")))
    if group:
        placed = balanced_grouped_folds(rows, group, label, k, seed).withColumn("repeat", F.lit(0))
    elif repeats > 1:
        placed = repeated_stratified_folds(rows, id, label, k, repeats, seed)
    else:
        placed = stratified_folds(rows, id, label, k, seed).withColumn("repeat", F.lit(0))
    placed.write.partitionBy("repeat", "fold").parquet(folder)
    placed = df.sparkSession.read.schema(placed.schema).parquet(folder)

    def one(part: tuple[int, int]) -> PipelineModel:
        r, f = part
        return fit_fold(placed.where(F.col("repeat") == r), make_stages, F.col("fold") == f)

    parts = [(r, f) for r in range(repeats) for f in range(k)]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        models = list(pool.map(inheritable_thread_target(df.sparkSession)(one), parts))

    def held_out_predictions(part: tuple[int, int], model: PipelineModel) -> DataFrame:
        r, f = part
        rows = placed.where((F.col("repeat") == r) & (F.col("fold") == f))
        return model.transform(rows).select(
            id, *carry, "repeat", "fold", label, positive_probability().alias("prediction")
        )

    each = materialize(
        reduce(DataFrame.unionByName, [held_out_predictions(p, m) for p, m in zip(parts, models, strict=True)])
    )
    if repeats > 1:
        oof = each.groupBy(id, *carry, label).agg(F.avg("prediction").alias("prediction"))
        oof = materialize(oof.withColumn("fold", F.lit(None).cast("int")).select(id, *carry, "fold", label, "prediction"))
    else:
        oof = each.drop("repeat")
    return ModelBundle(models, oof, fold_scores(each, oof, label, id, metric, measure) if scored else None)


def fold_scores(
    each: DataFrame, oof: DataFrame, label: str, id: str, metric: Metric = rank_score, measure: str = "rank_score"
) -> DataFrame:
    """``(measure, repeat, fold, value)``: every fold, their mean and deviation, and all rows."""
    folds = metric(each, label, "prediction", id, ["repeat", "fold"])
    folds = materialize(folds.select("repeat", "fold", F.col(measure).alias("value")))
    summary = fold_summary(folds, "value")
    nowhere = [F.lit(None).cast("int").alias(c) for c in ("repeat", "fold")]
    parts = [
        folds.select(F.lit("fold").alias("measure"), "repeat", "fold", "value"),
        summary.select(F.lit("cv_mean").alias("measure"), *nowhere, F.col("cv_mean").alias("value")),
        summary.select(F.lit("cv_std").alias("measure"), *nowhere, F.col("cv_std").alias("value")),
        metric(oof, label, "prediction", id, []).select(
            F.lit("oof").alias("measure"), *nowhere, F.col(measure).alias("value")
        ),
    ]
    return materialize(reduce(DataFrame.unionByName, parts))


def average_folds(
    models: Sequence[PipelineModel], df: DataFrame, features: Sequence[str], nominal: Mapping[str, int] | None = None
) -> DataFrame:
    """Mean probability of the fold models as ``prediction``, added to all columns of ``df``.

    One narrow pass: the models are applied one after another to the same rows,
    no exchange and no chunk loop.
    """
    scored = assemble(df, features, nominal=nominal)
    for i, model in enumerate(models):
        scored = model.transform(scored).withColumn(f"_p{i}", positive_probability()).drop(*MODEL_OUTPUTS)
    total = reduce(Column.__add__, [F.col(f"_p{i}") for i in range(len(models))])
    return scored.select(*df.columns, (total / F.lit(float(len(models)))).alias("prediction"))


def statement_meta_feature(
    statements: DataFrame,
    labels: DataFrame,
    key: str,
    id: str,
    label: str,
    features: Sequence[str],
    make_stages: MakeStages,
    k: int = 5,
    seed: int = 42,
    by_group: bool = True,
) -> tuple[DataFrame, ModelBundle]:
    """Out-of-fold prediction per statement row, added as ``preds``.

    Every statement carries its entity's label. ``by_group`` keeps an entity's
    statements in one fold, so that its label does not leak between folds.
    """
    labelled = statements.join(labels.select(key, label), key)
    bundle = cross_validate(
        labelled, features, label, id, make_stages, k, seed, group=key if by_group else None
    )
    preds = bundle.oof.select(id, F.col("prediction").alias("preds"))
    return statements.join(preds, id), bundle


def apply_meta_feature(bundle: ModelBundle, statements: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fold-averaged prediction per statement row of a new table, as ``preds``."""
    return average_folds(bundle.models, statements, features).withColumnRenamed("prediction", "preds")
