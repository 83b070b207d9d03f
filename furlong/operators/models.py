"""Win and upset models: ``pyspark.ml`` pipelines over entry features."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong import settings
from furlong.operators.boosting import BoostedTrees
from furlong.operators.metrics import metric_rows, race_table, roc_auc
from furlong.operators.select import check_features, roles_of, top_features, with_roles
from furlong.operators.split import assert_unweighted, check_base_rate, kfold
from furlong.operators.strategy import feature_correlation
from furlong.scale.storage import lay_down, small_splits

SEED = 7
# Bytes of a stored table that a training task reads: learners hold its rows as objects of several times that size.
TRAINING_SPLIT = 32 << 20


def random_forest(label: str) -> list[Estimator]:
    return [
        RandomForestClassifier(
            featuresCol="features", labelCol=label, numTrees=20, maxDepth=6, seed=SEED
        )
    ]


def boosted_trees(label: str) -> list[Estimator]:
    """Gradient-boosted trees, in the place of the XGBoost and LightGBM learners."""
    return [BoostedTrees(featuresCol="features", labelCol=label, maxIter=10, maxDepth=4, seed=SEED)]


def boosted_trees_wide(label: str) -> list[Estimator]:
    """The second boosted-tree parameter set: more, shallower trees on row samples."""
    return [
        BoostedTrees(
            featuresCol="features", labelCol=label, maxIter=20, maxDepth=3, stepSize=0.05,
            subsamplingRate=0.8, seed=SEED,
        )
    ]


def logistic(label: str) -> list[Estimator]:
    return [
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol=label, regParam=0.001, maxIter=50),
    ]


def linear_svm(label: str) -> list[Estimator]:
    """Linear SVM; a logistic fit on its margin supplies the probability."""
    return [
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        LinearSVC(
            featuresCol="scaled", labelCol=label, regParam=0.01, maxIter=30,
            rawPredictionCol="margin", predictionCol="side",
        ),
        LogisticRegression(featuresCol="margin", labelCol=label, regParam=0.0, maxIter=50),
    ]


LEARNERS: dict[str, Callable[[str], list[Estimator]]] = {
    "random_forest": random_forest,
    "boosted_trees": boosted_trees,
    "boosted_trees_wide": boosted_trees_wide,
    "logistic": logistic,
    "linear_svm": linear_svm,
}


def fit(
    train: DataFrame,
    features: Sequence[str],
    label: str = "win",
    learner: str = "random_forest",
    roles: Mapping[str, str] | None = None,
    allow_market: bool = False,
) -> PipelineModel:
    """Fit one learner.

    Refused are columns that nobody called a feature, by ``roles`` or by the role the
    column carries; class weights; and training sets that were resampled since their
    base rate was recorded. Rows without a label do not train; the model's
    ``null_labels`` says how many there were.
    """
    check_features(features, {**roles_of(train), **(roles or {})}, allow_market)
    stages = LEARNERS[learner](label)
    for stage in stages:
        assert_unweighted(stage)
    check_base_rate(train)
    rows, labelled = train.agg(F.count(F.lit(1)), F.count(label)).first()
    if not labelled:
        raise ValueError(f"no row has a label in {label}")
    data = train.where(F.col(label).isNotNull()).select(
        *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label)
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    with small_splits(train.sparkSession, TRAINING_SPLIT):
        model = Pipeline(stages=[assembler, *stages]).fit(data)
    model.null_labels = rows - labelled
    return model


def score(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """``df`` plus the probability of the positive class."""
    cols = df.columns
    out = model.transform(df)
    return out.select(*cols, vector_to_array("probability")[1].alias(name))


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Feature importances of the tree model in the pipeline, one row per feature."""
    from pyspark.sql import SparkSession

    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, score double")


def evaluate(
    scored: DataFrame,
    model: str,
    keys: Sequence[str],
    score_col: str = "p",
    label: str = "win",
    race: str = "race_id",
) -> DataFrame:
    """AUC of the score, log loss and Top-1 of the race-normalised score, as rows.

    ``scored`` is read twice; store it when scoring is expensive.
    """
    per_race = race_table(scored, [score_col], keys, label, race, normalize=True).agg(
        F.avg(f"loss_{score_col}").alias("log_loss"), F.avg(f"hit_{score_col}").alias("top1_rate")
    )
    auc = roc_auc(scored, score_col, label).select("auc")
    return metric_rows(auc, model).unionByName(metric_rows(per_race, model))


def out_of_fold(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    learner: str,
    name: str,
    folds: int = settings.FOLDS,
    race: str = "race_id",
    roles: Mapping[str, str] | None = None,
    allow_market: bool = False,
) -> DataFrame:
    """``train`` plus a score from models that never saw the row's race; the score is a feature."""
    parts = kfold(train, folds, race, "_fold")
    out = None
    for fold in range(folds):
        model = fit(parts.where(F.col("_fold") != fold), features, label, learner, roles, allow_market)
        scored = score(model, parts.where(F.col("_fold") == fold), name)
        out = scored if out is None else out.unionByName(scored)
    return with_roles(out.drop("_fold"), {name: "feature"})


def cross_validate(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    learner: str,
    folds: int = settings.FOLDS,
    race: str = "race_id",
    roles: Mapping[str, str] | None = None,
    allow_market: bool = False,
) -> DataFrame:
    """AUC of every fold; for tuning only, the folds are not ordered in time."""
    parts = kfold(train, folds, race, "_fold")
    out = None
    for fold in range(folds):
        model = fit(parts.where(F.col("_fold") != fold), features, label, learner, roles, allow_market)
        held = score(model, parts.where(F.col("_fold") == fold), "_p")
        row = roc_auc(held, "_p", label).select(F.lit(fold).alias("fold"), "auc")
        out = row if out is None else out.unionByName(row)
    return out


def two_stage(
    train: DataFrame,
    df: DataFrame,
    features: Sequence[str],
    label: str = "win",
    first: str = "random_forest",
    second: str = "logistic",
    folds: int = settings.FOLDS,
    roles: Mapping[str, str] | None = None,
    allow_market: bool = False,
    whole: Callable[[], PipelineModel] | None = None,
) -> DataFrame:
    """A first model's out-of-fold score becomes a feature of a second model.

    ``whole`` gives the first model where it is fitted on all of ``train`` already; it is
    asked for after the folds.
    """
    guard = (roles, allow_market)
    inner = out_of_fold(train, features, label, first, "stage1", folds, roles=roles, allow_market=allow_market)
    combined = fit(lay_down(inner, "stage1"), [*features, "stage1"], label, second, *guard)
    model = whole() if whole else fit(train, features, label, first, *guard)
    return score(combined, score(model, df, "stage1"), "p")


def feature_counts(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    counts: Sequence[int],
    label: str = "win",
    learner: str = "logistic",
    roles: Mapping[str, str] | None = None,
) -> DataFrame:
    """(k, features, auc): models of the ``k`` best features, scored on ``test``.

    Features are ranked by their correlation with the label in ``train`` alone, so the
    sets are nested and ``test`` has no say in them.
    """
    ranked = feature_correlation(train, features, label).where(F.col("score").isNotNull())
    order = [r["feature"] for r in top_features(ranked, len(features)).collect()]
    out = None
    for k in counts:
        scored = lay_down(score(fit(train, order[:k], label, learner, roles), test).select(label, "p"), "feature-count")
        row = roc_auc(scored, "p", label).select(
            F.lit(len(order[:k])).cast("long").alias("k"), F.lit(" ".join(sorted(order[:k]))).alias("features"), "auc"
        )
        out = row if out is None else out.unionByName(row)
    return out
