"""Title classification by counts or logistic regression, and its metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tongueloom.functions.text import words
from tongueloom.session import lookup_join, stage


@dataclass(frozen=True)
class BayesModel:
    """Word counts per label stay a table; only one number per label lives on the driver."""

    labels: list[str]
    log_prior: list[float]
    log_denominator: list[float]
    counts: DataFrame  # (word, c array<bigint> in label order), staged


def _doc_words(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Words counted per record before anything is shuffled by word."""
    return (
        df.select(*keys, F.explode(words(F.col(text))).alias("word")).where(F.col("word") != "")
        .groupBy(*keys, "word").agg(F.count("*").alias("m"))
    )


def nb_fit(train: DataFrame, labels: Sequence[str], text: str = "input", label: str = "label") -> BayesModel:
    """Multinomial naive Bayes with add-one smoothing over a fixed label list."""
    tokens = train.select(label, F.explode(words(F.col(text))).alias("word")).where(F.col("word") != "")
    per_label = [F.count(F.when(F.col(label) == x, 1)) for x in labels]
    counts = stage(tokens.groupBy("word").agg(F.array(*per_label).alias("c")), "bayes")
    sums = counts.agg(F.count("*").alias("v"), *[F.sum(F.col("c")[i]).alias(f"t{i}") for i in range(len(labels))]).first()
    docs = train.agg(*[F.count(F.when(F.col(label) == x, 1)).alias(f"d{i}") for i, x in enumerate(labels)]).first()
    n_docs = sum(docs)
    return BayesModel(
        list(labels),
        [math.log(d / n_docs) if d else -math.inf for d in docs],
        [math.log((sums[f"t{i}"] or 0) + sums["v"]) for i in range(len(labels))],
        counts,
    )


def nb_predict(test: DataFrame, model: BayesModel, key: str = "row_id", text: str = "input") -> DataFrame:
    """(key, prediction, score): best label by rounded log score, ties to the smaller label.

    Words never seen in training are ignored; a record without known words falls back to the priors.
    """
    found = lookup_join(_doc_words(test, [key], text), model.counts, ["word"], "inner", staged=True)
    part = [
        F.sum(F.col("m") * (F.log(F.col("c")[i] + F.lit(1)) - F.lit(model.log_denominator[i]))).alias(f"s{i}")
        for i in range(len(model.labels))
    ]
    scored = test.select(key).join(found.groupBy(key).agg(*part), key, "left")
    options = F.array(*[
        F.struct((-F.round(F.coalesce(f"s{i}", F.lit(0.0)) + F.lit(model.log_prior[i]), 6)).alias("neg"), F.lit(x).alias("label"))
        for i, x in enumerate(model.labels)
    ])
    best = F.array_min(options)
    return scored.select(key, best["label"].alias("prediction"), (-best["neg"]).alias("score"))


def lr_fit(train: DataFrame, text: str = "news_title", label: str = "label_id", features: int = 1 << 17, max_iter: int = 100):
    """Hashed TF-IDF and multinomial logistic regression as one Spark ML pipeline.

    Texts are hashed once and staged as sparse counts, so no words are held in memory: what the solver keeps of them are its own blocks, on disk where
    memory is short.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF

    hashing = HashingTF(inputCol="words", outputCol="tf", numFeatures=features)
    rows = stage(hashing.transform(train.select(label, words(F.col(text)).alias("words"))).select(label, "tf"), "term-counts")
    weights = IDF(inputCol="tf", outputCol="features").fit(rows)
    solver = LogisticRegression(labelCol=label, featuresCol="features", family="multinomial", maxIter=max_iter)
    return PipelineModel([hashing, weights, solver.fit(weights.transform(rows).select(label, "features"))])


def lr_predict(test: DataFrame, model, text: str = "news_title") -> DataFrame:
    scored = model.transform(test.withColumn("words", words(F.col(text))))
    return scored.withColumn("prediction", F.col("prediction").cast("bigint")).drop(
        "words", "tf", "features", "rawPrediction", "probability"
    )


def class_counts(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(cls, tp, n_gold, n_pred) for every class that is gold or predicted."""
    pairs = df.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("g").alias("cls"), hit.alias("tp"), F.col("n").alias("n_gold"), zero.alias("n_pred")),
        F.struct(F.col("p").alias("cls"), zero.alias("tp"), zero.alias("n_gold"), F.col("n").alias("n_pred")),
    )
    return (
        pairs.select(F.explode(sides).alias("s")).groupBy("s.cls")
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "n_gold", "n_pred")])
    )


def ratio(top, bottom):
    """Division that gives 0 where the ratio is undefined."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def macro_metrics(df: DataFrame, gold: str = "gold", pred: str = "prediction") -> DataFrame:
    """One row: accuracy and macro precision, recall and F1 over gold and predicted classes."""
    tp, g, p = F.col("tp"), F.col("n_gold"), F.col("n_pred")
    return class_counts(df, gold, pred).agg(
        (F.sum(tp) / F.sum(g)).alias("accuracy"),
        F.avg(ratio(tp, p)).alias("precision"), F.avg(ratio(tp, g)).alias("recall"),
        F.avg(ratio(F.lit(2.0) * tp, g + p)).alias("f1"),
    )


def cross_eval(train: DataFrame, test: DataFrame, labels: Sequence[str], key: str = "row_id", text: str = "input") -> DataFrame:
    """Fit on one domain, report the metrics on another."""
    predicted = nb_predict(test, nb_fit(train, labels, text), key, text)
    return macro_metrics(test.select(key, F.col("label").alias("gold")).join(predicted, key))
