"""Tree models of conversion: fit, score, save, load.

Induction and scoring are Spark ML's, but for forests of regression trees: see ``grown``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.operators.grown import grow_forest


@dataclass(frozen=True)
class TreeSpec:
    """Settings of one kind of model; ``trees`` None means one per square root of rows."""

    model_type: str
    max_depth: int
    max_bins: int
    trees: int | None = None
    seed: int = 7


# The settings of the four kinds of model.
TREE_REGRESSOR = TreeSpec("tree_regressor", max_depth=24, max_bins=4096)
FOREST_REGRESSOR = TreeSpec("forest_regressor", max_depth=24, max_bins=4096)
TREE_CLASSIFIER = TreeSpec("tree_classifier", max_depth=16, max_bins=512)
FOREST_CLASSIFIER = TreeSpec("forest_classifier", max_depth=16, max_bins=512, trees=3)

_MODELS = {
    "tree_regressor": DecisionTreeRegressionModel,
    "forest_regressor": RandomForestRegressionModel,
    "tree_classifier": DecisionTreeClassificationModel,
    "forest_classifier": RandomForestClassificationModel,
}


def forest_size(spec: TreeSpec, n_rows: int) -> int:
    """The number of trees that a spec's model has for ``n_rows`` training rows."""
    if spec.model_type.startswith("tree"):
        return 1
    return spec.trees or max(1, math.isqrt(n_rows))


def tree_estimator(spec: TreeSpec, n_rows: int) -> Estimator:
    """The Spark ML estimator of a spec; any other estimator may be passed to ``fit_tree``.

    A forest keeps each row's node in every tree beside the rows: otherwise all trees grown
    so far, which together grow faster than the rows, go to every task of every level. The
    trees are the same either way.
    """
    common = dict(
        featuresCol="vector",
        labelCol="label",
        maxDepth=spec.max_depth,
        maxBins=spec.max_bins,
        seed=spec.seed,
        maxMemoryInMB=512,
    )
    trees = forest_size(spec, n_rows)
    match spec.model_type:
        case "tree_regressor":
            return DecisionTreeRegressor(impurity="variance", **common)
        case "forest_regressor":
            return RandomForestRegressor(
                impurity="variance", numTrees=trees, featureSubsetStrategy="auto", cacheNodeIds=True, **common
            )
        case "tree_classifier":
            return DecisionTreeClassifier(impurity="gini", **common)
        case "forest_classifier":
            return RandomForestClassifier(
                impurity="gini", numTrees=trees, featureSubsetStrategy="auto", cacheNodeIds=True, **common
            )
    raise ValueError(f"unknown model type {spec.model_type}")


class CategoryLimitError(ValueError):
    """A categorical feature has more values than a tree can split on."""


def check_categories(
    arities: dict[int, int], names: list[str], max_bins: int, n_rows: int
) -> None:
    """Refuse, by name, a feature whose categories exceed the bins or the training rows."""
    for pos, arity in sorted(arities.items()):
        if arity > min(max_bins, n_rows):
            raise CategoryLimitError(
                f"categorical feature '{names[pos]}' has {arity} values; at most "
                f"{min(max_bins, n_rows)} can be used ({max_bins} bins, {n_rows} training rows)"
            )


def vector_metadata(arities: dict[int, int], names: list[str]) -> dict:
    """Column metadata telling Spark ML which positions are categories and how many they have."""
    nominal = [
        {"idx": i, "name": n, "num_vals": arities[i], "ord": False}
        for i, n in enumerate(names)
        if i in arities
    ]
    numeric = [{"idx": i, "name": n} for i, n in enumerate(names) if i not in arities]
    attrs = {key: value for key, value in (("nominal", nominal), ("numeric", numeric)) if value}
    return {"ml_attr": {"attrs": attrs, "num_attrs": len(names)}}


def with_vector(df: DataFrame, arities: dict[int, int], names: list[str]) -> DataFrame:
    """Add ``vector``, the features as an ML vector with its category metadata."""
    return df.withColumn("vector", array_to_vector("features")).withMetadata(
        "vector", vector_metadata(arities, names)
    )


def fit_tree(
    train: DataFrame,
    arities: dict[int, int],
    names: list[str],
    spec: TreeSpec,
    n_rows: int | None = None,
    estimator: Estimator | None = None,
) -> Model:
    """Fit one app's model on coded ``features`` and ``label``.

    A forest of regression trees is grown from counted rows, unless ``estimator`` is given
    or there are too many different rows.
    """
    rows = train.count() if n_rows is None else n_rows
    check_categories(arities, names, spec.max_bins, rows)
    if estimator is None and spec.model_type == "forest_regressor":
        grown = grow_forest(train, arities, len(names), tree_estimator(spec, rows))
        if grown is not None:
            return grown
    return (estimator or tree_estimator(spec, rows)).fit(with_vector(train, arities, names))


def _score_column(model: Model, prefix: str) -> Column:
    """The score left behind by ``_scorer``: a regression value or the chance of label 1."""
    if model.hasParam("probabilityCol"):
        return F.get(vector_to_array(F.col(f"{prefix}_probability")), F.lit(1))
    return F.col(f"{prefix}_prediction")


def _scorer(model: Model, features: str, prefix: str) -> Model:
    extra = {model.featuresCol: features, model.predictionCol: f"{prefix}_prediction"}
    if model.hasParam("probabilityCol"):
        extra[model.probabilityCol] = f"{prefix}_probability"
        extra[model.rawPredictionCol] = f"{prefix}_raw"
    return model.copy(extra)


def score_rows(model: Model, df: DataFrame) -> DataFrame:
    """Add ``score`` to rows with coded ``features``."""
    keep = df.columns
    ready = df.withColumn("_v", array_to_vector("features"))
    scored = _scorer(model, "_v", "_m").transform(ready)
    return scored.select(*keep, _score_column(model, "_m").alias("score"))


def score_options(model: Model, df: DataFrame, options: list[Column]) -> DataFrame:
    """Add ``scores``: one score per option appended to the row's coded ``features``.

    The model is applied once per option to the same row, so a visitor is never
    expanded into rows and no shuffle is needed to bring the scores together.
    """
    keep = df.columns
    rows = df
    for i, option in enumerate(options):
        vector = array_to_vector(F.concat(F.col("features"), F.array(option.cast("double"))))
        rows = _scorer(model, f"_v{i}", f"_m{i}").transform(rows.withColumn(f"_v{i}", vector))
    scores = F.array(*[_score_column(model, f"_m{i}") for i in range(len(options))])
    return rows.select(*keep, scores.alias("scores"))


def class_positions(model: Model, df: DataFrame) -> DataFrame:
    """Add ``variation_idx``: the predicted class itself read as a variation position.

    For a classifier fitted on identity features alone, labelled by position.
    """
    keep = df.columns
    scored = _scorer(model, "_v", "_m").transform(df.withColumn("_v", array_to_vector("features")))
    return scored.select(*keep, F.col("_m_prediction").cast("int").alias("variation_idx"))


def save_model(model: Model, mapping: DataFrame, path: str) -> None:
    """Write a model together with the category codes it was fitted on."""
    model.write().overwrite().save(f"{path}/model")
    mapping.write.mode("overwrite").parquet(f"{path}/mapping")


def load_model(spark: SparkSession, path: str, model_type: str) -> tuple[Model, DataFrame]:
    """A model of one of the four kinds, or of the class that Spark ML saved it as."""
    if model_type in _MODELS:
        model = _MODELS[model_type].load(f"{path}/model")
    else:
        model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    return model, spark.read.parquet(f"{path}/mapping")
