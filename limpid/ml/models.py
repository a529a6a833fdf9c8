"""Role, domain and chart models on MLlib: the trainers return fitted pipelines, ready to save or apply."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (CountVectorizer, IDF, IndexToString, NGram, RegexTokenizer, SQLTransformer, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from limpid import vocab
from limpid.ml.features import NAME_FEATURES, VALUE_FEATURES

ROLE_FEATURES = [*NAME_FEATURES, *VALUE_FEATURES]
CHART_FEATURES = [*(f"role_count_{r}" for r in vocab.ROLE_LABELS), "has_primary_date", "has_metric"]


def balanced(data: DataFrame, label: str) -> DataFrame:
    """Row weights that give every class the same total. Classes are few, so their counts are broadcast."""
    counts = data.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weighed = data.join(F.broadcast(counts), label)
    return weighed.withColumn("weight", F.lit(totals["n"]) / (F.col("_n") * totals["k"])).drop("_n")


def _forest(features, label: str, trees: int, labels, seed: int) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        StringIndexer(inputCol=label, outputCol="target", handleInvalid="keep").setStringOrderType("alphabetAsc"),
        RandomForestClassifier(featuresCol="features", labelCol="target", weightCol="weight", numTrees=trees,
                               seed=seed, maxDepth=8),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=labels),
    ])


def _labels(data: DataFrame, label: str) -> list[str]:
    return sorted(r[0] for r in data.select(label).distinct().collect())


def train_roles(data: DataFrame, label: str = "role", trees: int = 400, seed: int = vocab.SEED):
    """Role classifier on column features: ``(model, accuracy on a held-out fifth)``; a held-out row of a class that
    training has not seen is a miss."""
    train, held_out = data.randomSplit([0.8, 0.2], seed)
    model = _forest(ROLE_FEATURES, label, trees, _labels(train, label), seed).fit(balanced(train, label))
    scored = model.transform(held_out.withColumn("weight", F.lit(1.0)))
    accuracy = MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy").evaluate(scored) \
        if not scored.isEmpty() else None
    return model, accuracy


def predict_roles(model: PipelineModel, data: DataFrame) -> DataFrame:
    """``data`` with ``predicted`` and its ``probability``."""
    ready = data.withColumn("weight", F.lit(1.0))
    stages = [model.stages[0], *model.stages[2:]]
    for stage in stages:
        ready = stage.transform(ready)
    best = F.array_max(vector_to_array("probability"))
    return ready.withColumn("confidence", best).drop("features", "rawPrediction", "probability", "prediction", "weight")


def domain_text(headers: DataFrame, histogram: DataFrame) -> DataFrame:
    """``(dataset, text)``: header names plus one ``role_count_*:n`` token per role."""
    counts = [F.concat(F.lit(f"role_count_{r}:"), F.col(f"role_count_{r}").cast("string")) for r in vocab.ROLE_LABELS]
    return headers.join(histogram, "dataset").select("dataset", F.concat_ws(" ", "header", *counts).alias("text"))


def train_domain(data: DataFrame, label: str = "domain") -> PipelineModel:
    """Domain classifier on text: TF-IDF of words and word pairs, then logistic regression."""
    labels = _labels(data, label)
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True),
        NGram(inputCol="words", outputCol="pairs", n=2),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=(1 << 31) - 1),  # all terms
        IDF(inputCol="tf", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="target", handleInvalid="error").setStringOrderType("alphabetAsc"),
        LogisticRegression(featuresCol="features", labelCol="target", maxIter=200, regParam=0.01),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=labels),
    ]).fit(data)


def predict_domain(model: PipelineModel, data: DataFrame) -> DataFrame:
    ready = data
    for stage in [*model.stages[:5], *model.stages[6:]]:
        ready = stage.transform(ready)
    return ready.select(*data.columns, "predicted")


def train_charts(data: DataFrame, label: str = "label", trees: int = 300, seed: int = vocab.SEED) -> PipelineModel:
    """Chart-type classifier on role counts and flags."""
    return _forest(CHART_FEATURES, label, trees, _labels(data, label), seed).fit(balanced(data, label))


def rank_charts(model: PipelineModel, data: DataFrame, k: int = 4) -> DataFrame:
    """``(dataset, types)``: the ``k`` most likely chart types, best first."""
    labels = model.stages[1].labels
    ready = data.withColumn("weight", F.lit(1.0))
    for stage in [model.stages[0], model.stages[2]]:
        ready = stage.transform(ready)
    pairs = F.zip_with(F.slice(vector_to_array("probability"), 1, len(labels)), F.array(*map(F.lit, labels)),
                       lambda p, name: F.struct((-p).alias("p"), name.alias("name")))
    return ready.select("dataset", F.slice(F.array_sort(pairs), 1, k)["name"].alias("types"))
