"""The character n-gram classifier: training, scoring, blending, evaluation."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    Normalizer,
    SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.functions import text as tx
from credsieve.operators import logistic, terms

# An exact vocabulary keeps every term: as many as Spark ML can number.
ALL_TERMS = (1 << 31) - 1
HASHED_FEATURES = 1 << 22
MAX_ITERATIONS = 1000
# The optimiser ends when the objective can be above its optimum by no more than this part of it.
TOLERANCE = 1e-6

_INPUT = "model_text"
_TOKENS = f"SELECT *, {tx.char_ngrams_sql(_INPUT)} AS tokens FROM __THIS__"
_STAGE_COLUMNS = (_INPUT, "tokens", "counts", "weighted", "features", "rawPrediction",
                  "probability", "prediction")


def ngram_frequencies(texts: DataFrame, column: str = "text") -> DataFrame:
    """Occurrences and number of texts of every character n-gram, in one shuffle."""
    return (
        _term_counts(texts, column)
        .groupBy("ngram")
        .agg(F.sum("tf").alias("occurrences"), F.count("*").alias("texts"))
    )


def _term_counts(texts: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row (ngram, tf) per text and distinct n-gram, counted inside the text's own row.

    In the sorted n-grams those of one kind are a run; a run ends where the next n-gram differs.
    """
    grams = texts.select(*keep, F.array_sort(tx.char_ngrams(column)).alias("grams"))
    size = F.size("grams")
    ends = F.filter(
        F.sequence(F.lit(1), size),
        lambda i: (i == size) | (F.element_at("grams", i) != F.get("grams", i)),
    )
    listed = grams.filter(size > 0).select(*keep, "grams", ends.alias("ends"))
    runs = F.transform(
        "ends",
        lambda end, i: F.struct(
            F.element_at("grams", end).alias("ngram"),
            (end - F.coalesce(F.get("ends", i - 1), F.lit(0))).alias("tf"),
        ),
    )
    return listed.select(*keep, F.inline(runs))


def idf_weights(texts: DataFrame, column: str = "text") -> DataFrame:
    """(ngram, texts, idf) with ``idf = ln((1 + n) / (1 + texts)) + 1`` over n texts."""
    total = texts.agg(F.count("*").alias("n"))  # one row
    counted = _term_counts(texts, column).groupBy("ngram").agg(F.count("*").alias("texts"))
    weight = F.log((1 + F.col("n")) / (1 + F.col("texts"))) + 1
    return counted.join(F.broadcast(total)).select("ngram", "texts", weight.alias("idf"))


def tfidf_features(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, ngram, weight): the unit-length weights that the classifier sees."""
    terms = _term_counts(texts, column, key).join(idf_weights(texts, column), "ngram")
    weighted = terms.select(key, "ngram", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, key).select(key, "ngram", (F.col("w") / F.col("norm")).alias("weight"))


# --- training --------------------------------------------------------------------------------


def in_training(text: Column, label: Column) -> Column:
    """Whether a sample belongs to the 80% used for training.

    By a hash of the sample, hence the same in every run and on every engine.
    """
    digest = F.md5(F.concat_ws(":", label.cast("string"), text).cast("binary"))
    # The first 80% of the four-digit prefixes.
    return F.substring(digest, 1, 4) < "cccd"


def split(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test samples. Equal samples fall on the same side, so the two never overlap."""
    training = in_training(F.col("text"), F.col("label"))
    return samples.filter(training), samples.filter(~training)


def _vectorizer(terms_of: DataFrame) -> tuple[CountVectorizerModel, pa.Array]:
    """Spark ML's model of the distinct terms of rows (tokens), in their order, and the terms.

    The estimator would count them text by text and hand them to Python through one call, in copies that take more
    memory than the model; here they go from the executors to the model, and as Arrow data to Python.
    """
    spark = terms_of.sparkSession
    listed = terms_of.select(F.explode("tokens").alias("term")).distinct().orderBy("term").persist(StorageLevel.DISK_ONLY)
    found = listed.toArrow().column(0).combine_chunks()
    if not len(found):
        raise ValueError("no samples to train on")
    strings = getattr(listed._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING()).collect()
    vectorizer = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", strings)
    listed.unpersist()
    return vectorizer._set(inputCol="tokens", outputCol="counts", vocabSize=ALL_TERMS, minDF=1.0), found


# What scoring sends to the executors, by model; a broadcast ends with its context.
_SENT: WeakKeyDictionary = WeakKeyDictionary()


def _sent(key, make):
    context = SparkSession.active().sparkContext
    application, found = _SENT.get(key, (None, None))
    if application != context.applicationId:
        _SENT[key] = application, found = context.applicationId, context.broadcast(make())
    return found


def _numbers(vectorizer: CountVectorizerModel, listed: pa.Array | None = None):
    """The numbers of a model's terms, for the executors."""
    return _sent(vectorizer, lambda: terms.Vocabulary(pa.array(vectorizer.vocabulary) if listed is None else listed))


def fit(
    training: DataFrame,
    vocabulary: str = "exact",
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    max_training_rows: int | None = None,
) -> PipelineModel:
    """TF-IDF over character n-grams plus logistic regression, as one saveable pipeline.

    ``vocabulary`` is ``exact`` (every term, held on the driver as the model is) or ``hashed``, for
    the caller to choose. ``max_training_rows`` bounds the labelled rows, off by default: the rows
    of the smallest hash are kept. The weights are ``ln((1+n)/(1+df)) + 1``
    with unit length, and the regularisation is that of the sum-of-losses form with C = 1. The optimum is
    found by ``logistic.fit``; the model is Spark ML's.
    """
    if vocabulary not in ("exact", "hashed"):
        raise ValueError("vocabulary is 'exact' or 'hashed'")
    tokenizer = SQLTransformer(statement=_TOKENS)
    samples = training.select(F.col("text").alias(_INPUT), F.col("label").cast("double"))
    if max_training_rows is not None:
        samples = samples.orderBy(F.md5(_INPUT), _INPUT, "label").limit(max_training_rows)
    # The words are stored, not their n-grams, which take some fifty times as much and are as fast to make again.
    words = F.expr(tx.words_sql(f"coalesce({_INPUT}, '')"))
    cores = training.sparkSession.sparkContext.defaultParallelism
    samples = samples.select("label", words.alias("text")).repartition(4 * cores).persist(StorageLevel.DISK_ONLY)
    if vocabulary == "exact":
        # A text's n-grams are those of its words, of which most are in many texts.
        texts = samples.coalesce(cores)
        each = texts.select("text").mapInArrow(terms.distinct_words, "word string").select(F.col("word").alias(_INPUT))
        vectorizer, listed = _vectorizer(tokenizer.transform(each.distinct()))
        size, blocks = len(listed), logistic.text_blocks(texts, _numbers(vectorizer, listed))
        del listed
        fitted = logistic.fit(blocks, size, max_iterations, tolerance)
    else:
        tokens = tokenizer.transform(samples.withColumnRenamed("text", _INPUT)).select("label", "tokens")
        vectorizer = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=HASHED_FEATURES)
        counts = vectorizer.transform(tokens).select("label", "counts")
        fitted = logistic.fit(*logistic.vector_blocks(counts), max_iterations, tolerance)
    samples.unpersist()
    scaler = ElementwiseProduct(
        scalingVec=Vectors.dense(fitted.weights), inputCol="counts", outputCol="weighted"
    )
    normalizer = Normalizer(p=2.0, inputCol="weighted", outputCol="features")
    regression = LogisticRegression(
        maxIter=max_iterations,
        tol=tolerance,
        regParam=1.0 / fitted.rows,
        elasticNetParam=0.0,
        standardization=False,
    )
    return PipelineModel([tokenizer, vectorizer, scaler, normalizer, _regression_model(regression, fitted)])


def _regression_model(regression: LogisticRegression, fitted: logistic.Fitted) -> LogisticRegressionModel:
    """Spark ML's model of given coefficients, with the settings of the estimator."""
    context = SparkSession.active().sparkContext
    coefficients = _py2java(context, Vectors.dense(fitted.coefficients))
    kind = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    return regression._copyValues(LogisticRegressionModel(kind(regression.uid, coefficients, fitted.intercept)))


# Names the version that counts, in the folder of a model's versions.
_CURRENT = "CURRENT"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def save_model(model: PipelineModel, path: str) -> str:
    """The model as a new version below a path; gives the version's own path.

    A version is written whole before the pointer to it is replaced, by an atomic rename: a crash at any point
    leaves the version before, and who reads one keeps reading it. Old versions stay until they are removed.
    """
    spark = SparkSession.active()
    version = f"{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}-{uuid.uuid4().hex[:8]}"
    model.write().save(f"{path}/versions/{version}")
    fresh, system = _place(spark, f"{path}/{_CURRENT}.{version}")
    stream = system.create(fresh, False)
    stream.write(bytearray(version.encode()))
    stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(fs.Options.Rename, "OVERWRITE")
    context.rename(context.makeQualified(fresh), context.makeQualified(_place(spark, f"{path}/{_CURRENT}")[0]), options)
    return f"{path}/versions/{version}"


def model_path(spark: SparkSession, path: str) -> str | None:
    """Where the current version of a stored model lies; null where none was ever finished. A model that was saved
    without versions is its own."""
    pointer, system = _place(spark, f"{path}/{_CURRENT}")
    if system.exists(pointer):
        return f"{path}/versions/{spark.read.text(str(pointer)).first()[0]}"
    return path if system.exists(_place(spark, f"{path}/metadata")[0]) else None


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    found = model_path(spark, path)
    if found is None:
        raise FileNotFoundError(f"no model at {path}")
    return PipelineModel.load(found)


def load_or_fit(
    path: str, training: DataFrame | None = None, **options
) -> PipelineModel:
    """The model at a path; where there is none it is trained on the samples and saved.

    A path without a finished version has none; a version that is there is never replaced, and any failure to
    load it is raised.
    """
    spark = SparkSession.active() if training is None else training.sparkSession
    if training is None or model_path(spark, path):
        return load_model(spark, path)
    model = fit(training, **options)
    save_model(model, path)
    return model


def retrain(path: str, samples: DataFrame, **options) -> tuple[PipelineModel, DataFrame]:
    """A new model of the training split, saved, and its metrics on the test split."""
    training, test = split(samples)
    model = fit(training, **options)
    save_model(model, path)
    return model, evaluate(model, test)


# --- scoring ---------------------------------------------------------------------------------


def score(rows: DataFrame, column: str, model: PipelineModel, name: str) -> DataFrame:
    """Add ``name``, the probability that the text in ``column`` is a secret.

    Row by row inside the stage that made the rows: nothing is shuffled. A pipeline as ``fit`` makes it with the exact
    vocabulary is applied to batches, which have each word's terms looked up once; any other by its own stages.
    """
    if not _by_words(model):
        return _score_by_stages(rows, column, model, name)
    numbers = _numbers(model.stages[1])
    weights = _sent(model, lambda: _weights(model))

    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(_probabilities(texts, numbers.value, *weights.value), pa.float64())

    probability, words = F.arrow_udf(scores, "double"), F.expr(tx.words_sql(_INPUT))
    scored = rows.withColumn(_INPUT, F.coalesce(F.col(column), F.lit(""))).withColumn(_INPUT, words)
    return scored.withColumn(name, probability(_INPUT)).drop(*_STAGE_COLUMNS)


def _score_by_stages(rows: DataFrame, column: str, model: PipelineModel, name: str) -> DataFrame:
    """The same by the stages of any pipeline, without Python."""
    scored = model.transform(rows.withColumn(_INPUT, F.coalesce(F.col(column), F.lit(""))))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(*_STAGE_COLUMNS)


def _by_words(model: PipelineModel) -> bool:
    """Whether a pipeline is one that ``fit`` makes with the exact vocabulary."""
    kinds = SQLTransformer, CountVectorizerModel, ElementwiseProduct, Normalizer, LogisticRegressionModel
    if len(model.stages) != len(kinds) or not all(map(isinstance, model.stages, kinds)):
        return False
    tokenizer, vectorizer, _, normalizer, regression = model.stages
    plain = not vectorizer.getBinary() and vectorizer.getMinTF() == 1.0 and normalizer.getP() == 2.0
    return plain and regression.numClasses == 2 and tokenizer.getStatement() == _TOKENS


def _weights(model: PipelineModel) -> tuple[np.ndarray, np.ndarray, float]:
    """The weights of the terms, their coefficients and the intercept."""
    regression = model.stages[-1]
    return model.stages[2].getScalingVec().toArray(), regression.coefficients.toArray(), regression.intercept


def _probabilities(
    texts: pa.Array, numbers: terms.Vocabulary, weights: np.ndarray, coefficients: np.ndarray, intercept: float
) -> np.ndarray:
    """The probabilities of texts, which are words between single spaces."""
    found = []
    for part in terms.pieces(texts):
        rows, words = terms.words_of(part)
        margins = np.zeros(len(part))
        for place, some in terms.merged(rows, numbers.of_words(words)):
            weighted = some._replace(counts=some.counts * weights[some.numbers])
            lengths = np.sqrt(weighted._replace(counts=weighted.counts**2).sums())
            margins[place] = weighted.times(coefficients) / np.where(lengths > 0, lengths, 1.0)
        found.append(margins + intercept)
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-np.concatenate(found or [np.empty(0)])))


def blend(p_secret: Column, p_context: Column) -> Column:
    """Weighted mean of both probabilities, or the first alone without a context."""
    both = (p_secret * settings.SECRET_WEIGHT + p_context * settings.CONTEXT_WEIGHT) / (
        settings.SECRET_WEIGHT + settings.CONTEXT_WEIGHT
    )
    return F.when(p_context.isNotNull(), both).otherwise(p_secret)


def rate(
    rows: DataFrame,
    p_secret: str = "p_secret",
    p_context: str = "p_context",
    threshold: float = settings.HIGH_THRESHOLD,
) -> DataFrame:
    """Confidence, severity and details of findings with given probabilities.

    The threshold sees the unrounded blend. Rows that stand for a line or file that was not listed
    always get 0.50 and Potential. Without a probability the confidence is 1.00 and an empty
    severity becomes High.
    """
    secret, context = F.col(p_secret), F.col(p_context)
    final = blend(secret, context)
    special = F.col("type").isin(list(settings.SPECIAL_TYPES))
    failed = secret.isNull()
    confidence = (
        F.when(failed, 1.0).when(special, 0.5).otherwise(F.bround(final, 2)).alias("confidence")
    )
    severity = (
        F.when(failed, F.when(F.coalesce("severity", F.lit("")) == "", "High").otherwise(
            F.col("severity")))
        .when(special, "Potential")
        .when(final > threshold, "High")
        .otherwise("Potential")
        .alias("severity")
    )
    replaced = (p_secret, p_context, "severity", "confidence")
    return rows.select(
        *[F.col(n) for n in rows.columns if n not in replaced],
        severity,
        confidence,
        F.bround(secret, 3).alias("secret_confidence"),
        (secret > 0.5).alias("secret_prediction"),
        F.when(~failed, F.bround(context, 3)).alias("context_confidence"),
        F.when(~failed, context > 0.5).alias("context_prediction"),
        (~failed & context.isNotNull()).alias("confidence_averaged"),
    )


def score_findings(findings: DataFrame, model: PipelineModel) -> DataFrame:
    """Scored findings: the secret and, unless blank, its context are both classified. Both are short and found in the
    JVM, and stay there."""
    scored = _score_by_stages(findings, "secret", model, "p_secret")
    scored = _score_by_stages(scored, "context", model, "p_context")
    blank = F.col("context").isNull() | tx.is_blank(F.col("context"))
    return rate(scored.withColumn("p_context", F.when(~blank, F.col("p_context"))))


def predict_pairs(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """The same for pairs (text, context) given by a user; blank texts are left out.

    ``is_secret`` follows the blend where there is a context and the text alone where not. Pairs may
    have a ``type``: those that stand for a line or file that was not listed get 0.50 and Potential.
    """
    special = F.lit(False)
    if "type" in pairs.columns:
        special = F.coalesce(F.col("type").isin(list(settings.SPECIAL_TYPES)), F.lit(False))
    filled = pairs.filter(F.col("text").isNotNull() & ~tx.is_blank(F.col("text")))
    scored = score(score(filled, "text", model, "p_text"), "context", model, "p_context")
    blank = F.col("context").isNull() | tx.is_blank(F.col("context"))
    scored = scored.withColumn("p_context", F.when(~blank, F.col("p_context")))
    final = blend(F.col("p_text"), F.col("p_context"))
    return scored.select(
        *pairs.columns,
        (final > 0.5).alias("is_secret"),
        F.when(special, 0.5).otherwise(F.bround(final, 3)).alias("confidence"),
        F.when(~special & (final > settings.HIGH_THRESHOLD), "High")
        .otherwise("Potential")
        .alias("severity"),
        F.bround("p_text", 3).alias("text_confidence"),
        (F.col("p_text") > 0.5).alias("text_prediction"),
        F.bround("p_context", 3).alias("context_confidence"),
        (F.col("p_context") > 0.5).alias("context_prediction"),
        F.col("p_context").isNotNull().alias("averaged_confidence"),
    )


# --- evaluation ------------------------------------------------------------------------------


def _confusion(label: str, prediction: str) -> list[Column]:
    actual, guess = F.col(label) == 1, F.col(prediction) == 1
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(actual).alias("secrets"),
        F.count_if(~actual).alias("non_secrets"),
        F.count_if(actual & guess).alias("true_positives"),
        F.count_if(~actual & guess).alias("false_positives"),
        F.count_if(actual & ~guess).alias("false_negatives"),
        F.count_if(~actual & ~guess).alias("true_negatives"),
    ]


def confusion_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction"):
    """Confusion counts and the metrics that follow from them, as one row."""
    return _metrics(rows.agg(*_confusion(label, prediction)))


def _metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    correct = tp + F.col("true_negatives")

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    return counts.select(
        "*",
        correct.alias("correct"),
        ratio(correct, F.col("total")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def write_evaluation(predicted: DataFrame, errors_path: str) -> DataFrame:
    """Writes the misclassified rows and gives the metrics of all rows, in one pass: Spark counts them as they
    flow by to the file."""
    seen = Observation()
    write_wrong_predictions(predicted.observe(seen, *_confusion("label", "prediction")), errors_path)
    counts = predicted.sparkSession.createDataFrame([seen.get], ", ".join(f"{name} bigint" for name in seen.get))
    return _metrics(counts)


def predict_samples(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """Samples with ``p_secret`` and ``prediction``."""
    return score(samples, "text", model, "p_secret").withColumn(
        "prediction", (F.col("p_secret") > 0.5).cast("int")
    )


def evaluate(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """Metrics of the model on labelled samples, as one row."""
    return confusion_metrics(predict_samples(model, samples))


def evaluate_timed(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """The metrics with the seconds they took and the rows scored per second."""
    start = time.perf_counter()
    row = evaluate(model, samples).first()
    seconds = time.perf_counter() - start
    values = {**row.asDict(), "seconds": seconds, "rows_per_second": row["total"] / seconds}
    return samples.sparkSession.createDataFrame([values])


def wrong_predictions(predicted: DataFrame) -> DataFrame:
    """Misclassified samples (secret, expected, prediction, confidence)."""
    names = F.when(F.col("label") == 1, "Secret").otherwise("NotSecret")
    expected = F.col("expected") if "expected" in predicted.columns else names
    return predicted.filter(F.col("label") != F.col("prediction")).select(
        F.col("text").alias("secret"),
        expected.alias("expected"),
        F.when(F.col("prediction") == 1, "Secret").otherwise("NotSecret").alias("prediction"),
        F.bround("p_secret", 3).alias("confidence"),
    )


def evaluate_csv(
    spark: SparkSession, model: PipelineModel, csv_path: str, errors_path: str | None = None
) -> DataFrame:
    """Metrics on an evaluation CSV; misclassified rows go to a CSV of their own."""
    from credsieve.sources.samples import read_evaluation_csv

    predicted = predict_samples(model, read_evaluation_csv(spark, csv_path))
    return write_evaluation(predicted, errors_path) if errors_path else confusion_metrics(predicted)


def write_wrong_predictions(predicted: DataFrame, path: str) -> None:
    wrong_predictions(predicted).write.mode("overwrite").option("header", True).csv(
        path, quote='"', escape='"'
    )


def model_info(
    model: PipelineModel, samples: DataFrame, path: str | None = None
) -> DataFrame:
    """Rows (name, value) on the samples, the model and, where saved, its size."""
    vectorizer, regression = model.stages[1], model.stages[-1]
    facts = {
        "model_type": type(regression).__name__,
        "max_iterations": regression.getMaxIter(),
        "regularisation": regression.getRegParam(),
        "vectorizer_type": type(vectorizer).__name__,
        "analyzer": "char_wb",
        "ngram_range": "3-5",
        "vocabulary_size": regression.numFeatures,
    }
    counts = samples.agg(
        F.count_if(F.col("label") == 1).alias("secrets_dataset_size"),
        F.count_if(F.col("label") == 0).alias("non_secrets_dataset_size"),
        F.count("*").alias("total_dataset_size"),
    )
    names = counts.columns
    rows = counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value"))
                    for n in names
                ],
                *[
                    F.struct(F.lit(n).alias("name"), F.lit(str(v)).alias("value"))
                    for n, v in facts.items()
                ],
            )
        )
    )
    if path:
        saved = (
            samples.sparkSession.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(model_path(samples.sparkSession, path) or path)
            .agg(F.round(F.sum("length") / (1 << 20), 2).cast("string").alias("value"))
        )
        rows = rows.unionByName(saved.select(F.lit("saved_mb").alias("name"), "value"))
    return rows
