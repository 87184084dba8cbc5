"""Text classification and what is read from its logits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.hashing import hash_uniform
from textlens.functions.text import tokenize
from textlens.functions.vector import sigmoid
from textlens.operators.sampling import sample_per_group, split_dataset
from textlens.operators.temporal import stance_by_bucket, weighted_mean
from textlens.session import materialise, scratch_path

# Class index to stance (anti, neutral, news, pro).
CLASSES = (-1, 0, 2, 1)


@dataclass(frozen=True)
class Classifier:
    """A fitted model, where it is stored, how many iterations it took and whether it met its tolerance by then."""

    model: PipelineModel
    path: str
    iterations: int
    converged: bool


def train_classifier(
    labelled: DataFrame,
    path: str | None = None,
    *,
    features: int = 1 << 16,
    iterations: int = 200,
    tolerance: float = 1e-5,
    penalty: float = 0.01,
) -> Classifier:
    """Multinomial logistic regression on weighted word counts of ``text``, trained on ``label`` until the objective
    changes by less than ``tolerance`` (relative), or for ``iterations``, which the result tells.

    The model is saved at ``path``, by default in the shared folder (where `release_scratch` removes it), and read back,
    which leaves the summary of its training, and the session that one holds, out of the tasks that apply it.
    """
    hashing = HashingTF(numFeatures=features, inputCol="words", outputCol="counts")
    learned = [
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(family="multinomial", maxIter=iterations, tol=tolerance, regParam=penalty, rawPredictionCol="raw"),
    ]
    path = path or scratch_path(labelled.sparkSession, "classifier")
    # Both stages pass over the counts, so texts are read and cut into words once.
    counted = materialise(hashing.transform(_worded(labelled)).select("counts", "label"), "counts")
    fitted = Pipeline(stages=learned).fit(counted)
    took = fitted.stages[-1].summary.totalIterations
    PipelineModel([hashing, *fitted.stages]).write().overwrite().save(path)
    return Classifier(load_classifier(path), path, took, took < iterations)


def load_classifier(path: str) -> PipelineModel:
    """A model that `train_classifier` has saved."""
    return PipelineModel.load(path)


def fit_classifier(labelled: DataFrame, features: int = 1 << 16, iterations: int = 200, penalty: float = 0.01) -> PipelineModel:
    """The model of `train_classifier`."""
    return train_classifier(labelled, features=features, iterations=iterations, penalty=penalty).model


def train_and_evaluate(
    labelled: DataFrame, keys: Sequence[str], seed: int, path: str | None = None, validation: float = 0.2, test: float = 0.2, **options: object
) -> tuple[Classifier, DataFrame]:
    """Split labelled texts by their keys, train on one part and measure all: ``part, texts, loss, accuracy``.

    The parts of validation and test have no share in the model; a row's part depends on its keys alone.
    """
    parts = materialise(split_dataset(labelled, keys, seed, validation, test).select(*keys, "text", "label", "part"), "parts")
    found = train_classifier(parts.filter("part = 'train'"), path, **options)
    return found, evaluate(classify(parts, found.model), by=["part"])


def _worded(texts: DataFrame) -> DataFrame:
    return texts.withColumn("words", tokenize(F.col("text")))


def classify(texts: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``logits``, one per class."""
    scored = model.transform(_worded(texts))
    return scored.withColumn("logits", vector_to_array("raw")).select(*texts.columns, "logits")


def classify_with(
    texts: DataFrame, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], text: str = "text"
) -> DataFrame:
    """Add ``logits`` from any scorer of text batches; ``load`` runs once per task and returns it."""

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for batch in batches:
            yield pd.Series([[float(x) for x in row] for row in scorer(batch.tolist())])

    return texts.withColumn("logits", logits(F.col(text)))


def best_class(logits: Column) -> Column:
    """Index of the largest logit, the first of equals."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def stance_from_logits(scored: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Add ``class``, its ``stance`` value and the ``confidence``, the largest sigmoid over the classes."""
    values = F.array(*[F.lit(int(c)) for c in classes])
    return (
        scored.withColumn("class", best_class(F.col("logits")))
        .withColumn("stance", F.get(values, F.col("class")))
        .withColumn("confidence", sigmoid(F.array_max("logits")))
    )


def probabilities(logits: Column) -> Column:
    """Softmax."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def sample_class(scored: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Add ``sampled``: a class drawn from the predicted distribution by the row's key."""
    drawn = scored.withColumn("_p", probabilities(F.col("logits"))).withColumn(
        "_u", hash_uniform(seed, *[F.col(key) for key in keys])
    )
    place = F.sequence(F.lit(1), F.size("_p"))
    upto = F.transform(place, lambda n: F.aggregate(F.slice("_p", F.lit(1), n), F.lit(0.0), lambda a, b: a + b))
    passed = F.size(F.filter(upto, lambda total: total <= F.col("_u")))
    return drawn.withColumn("sampled", F.least(passed, F.size("_p") - 1)).drop("_p", "_u")


def evaluate(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy ``loss`` and ``accuracy`` of ``logits`` against ``label``: one row, or one with the number of
    ``texts`` for each group of ``by``."""
    largest = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - largest))
    loss = F.log(total) + largest - F.get("logits", F.col("label").cast("int"))
    hit = (best_class(F.col("logits")) == F.col("label")).cast("double")
    measures = [F.avg(loss).alias("loss"), F.avg(hit).alias("accuracy")]
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("texts"), *measures) if by else scored.agg(*measures)


def stance_over_time(
    posts: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    *,
    size: int | None = 1000,
    proportion: float | None = None,
    seed: int = 0,
    key: str = "id",
    bucket: str = "bucket",
    classes: Sequence[int] = CLASSES,
    statistic: Callable[[Column, Column], Column] = weighted_mean,
) -> DataFrame:
    """Stance per bucket from a sample of its posts; ``score`` adds ``logits``."""
    sampled = posts
    if size is not None or proportion is not None:
        sampled = sample_per_group(posts, bucket, [key], seed, size=None if proportion else size, proportion=proportion)
    return stance_by_bucket(stance_from_logits(score(sampled), classes), statistic, bucket)
