"""Severity classifiers on MLlib: training, comparison, selection, prediction."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRestModel, RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dietlens.constants import SEED
from dietlens.operators.encode import features
from dietlens.operators.metrics import best_model, confusion, summary_scores
from dietlens.operators.split import check_splittable, class_weights, stratified_split
from dietlens.session import lookup_join, materialize

_COLUMNS = {"featuresCol": "features", "labelCol": "label_index", "predictionCol": "prediction"}


def logistic(max_iter: int = 5000):
    return LogisticRegression(family="multinomial", weightCol="weight", maxIter=max_iter, **_COLUMNS)


def forest(trees: int = 300, seed: int = SEED):
    return RandomForestClassifier(numTrees=trees, seed=seed, weightCol="weight", **_COLUMNS)


def network(inputs: int, classes: int, hidden=(256, 128), max_iter: int = 300, seed: int = SEED):
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], maxIter=max_iter, seed=seed, **_COLUMNS)


class Boosted:
    """One boosted ensemble per class, against all other classes.

    A tenth of the training rows is held out; an ensemble ends before `rounds` once its error there no longer falls.
    """

    def __init__(self, rounds: int, seed: int):
        self.rounds, self.seed = rounds, seed

    def fit(self, train: DataFrame) -> OneVsRestModel:
        rows = materialize(train.select("label_index", "features").withColumn("held_out", F.rand(self.seed) < 0.1), "boosted")
        trees = GBTClassifier(
            maxIter=self.rounds, stepSize=0.05, maxDepth=6, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=self.seed,
            labelCol="is_class", featuresCol="features", validationIndicatorCol="held_out",
        )
        classes = int(rows.agg(F.max("label_index")).first()[0]) + 1
        found = [trees.fit(rows.withColumn("is_class", (F.col("label_index") == c).cast("double"))) for c in range(classes)]
        return OneVsRestModel(found).setFeaturesCol("features").setPredictionCol("prediction")


def boosted(rounds: int = 300, seed: int = SEED) -> Boosted:
    """Opt-in: at most `rounds` rounds per class, see `Boosted`."""
    return Boosted(rounds, seed)


def default_estimators(inputs: int, classes: int) -> dict:
    return {"logreg": logistic(), "random_forest": forest(), "mlp": network(inputs, classes)}


def prepare_training(
    rows: DataFrame, label: str = "severity", key: str = "row_id", vector: str = "embedding"
) -> DataFrame:
    """(key, label, features, is_test, weight) from rows written once, which all later passes read.

    Training rows get the balanced weight of their class among the training rows, test rows get 1.
    """
    slim = materialize(rows.select(key, F.col(label).cast("string").alias(label), vector), "training")
    check_splittable(slim, label)
    split = stratified_split(slim, label, key)
    weights = class_weights(split.filter(~F.col("is_test")).select(label), label).select(label, "weight")
    weighted = lookup_join(split, weights, label, [key])
    return weighted.select(
        key, label, features(vector).alias("features"), "is_test",
        F.when(F.col("is_test"), 1.0).otherwise(F.col("weight")).alias("weight"),
    )


def fit(train: DataFrame, estimator, label: str = "severity") -> PipelineModel:
    """Label indexer in sorted order, classifier, index back to label."""
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc").fit(train)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    fitted = estimator.fit(indexer.transform(train))
    # Prediction takes no label; the encoder is kept in the last stage.
    return PipelineModel(stages=[fitted, back])


def train_and_compare(prepared: DataFrame, estimators: dict, label: str = "severity"):
    """Fit every estimator on the training rows and score it on the test rows.

    Returns (models, confusion counts per model, metrics table). `prepared` comes from
    `prepare_training`.
    """
    train, test = prepared.filter(~F.col("is_test")), prepared.filter("is_test")
    models = {name: fit(train, estimator, label) for name, estimator in estimators.items()}
    if not models:
        raise ValueError("no model was trained")
    predictions = [
        model.transform(test).select(F.lit(name).alias("model"), F.col(label).alias("actual"), "predicted")
        for name, model in models.items()
    ]
    counts = materialize(confusion(reduce(DataFrame.unionByName, predictions), ["model"]), "confusion")
    ordinal = F.array_position(F.array(*[F.lit(n) for n in models]), F.col("model")).cast("int")
    metrics = summary_scores(counts, ["model"]).withColumn("ordinal", ordinal)
    return models, counts, metrics


def select_best(models: dict, metrics: DataFrame):
    """(name, model) of the best model; raises if there is none."""
    best = best_model(metrics).first()
    if best is None:
        raise ValueError("no model was trained")
    return best.model, models[best.model]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classify(model: PipelineModel, queries: DataFrame, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, classifier_pred, classifier_probs): label of highest probability and all probabilities.

    A one-versus-rest model has no probabilities; its map is null.
    """
    labels = F.array(*[F.lit(x) for x in model.stages[-1].getLabels()])
    scored = model.transform(queries.select(query_id, features(vector).alias("features")))
    if "probability" in scored.columns:
        probs = vector_to_array("probability")
        best = F.element_at(labels, F.array_position(probs, F.array_max(probs)).cast("int"))
        return scored.select(
            query_id, best.alias("classifier_pred"), F.map_from_arrays(labels, probs).alias("classifier_probs")
        )
    return scored.select(
        query_id,
        F.col("predicted").alias("classifier_pred"),
        F.lit(None).cast("map<string,double>").alias("classifier_probs"),
    )
