"""Scores of message bodies by models with two heads.

A model is made once a task and takes lists of texts; it gives two logits a text, for a softmax over (harmless, toxic), and
one more, for a sigmoid. Texts reach it in batches of `BATCH`, whatever the sizes of the Arrow batches they come in, since a
transformer pads a batch to its longest text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as texts

#: Texts that a model gets at once.
BATCH = 128
Model = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sigmoid(logits: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -logits))


def body(text: Column) -> Column:
    """What is scored of a message: its own words, without quotes and signature; "" of none."""
    return texts.split_message(text)["body"]


def in_batches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows again, `size` at a time."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch = batch.slice(part.num_rows)
            waiting.append(part)
            n += part.num_rows
            if n == size:
                yield pa.Table.from_batches(waiting)
                waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting)


def score_bodies(messages: DataFrame, build: Callable[[], Model], batch: int = BATCH) -> DataFrame:
    """(id, classification array<double> of two, regression double): the attributes to store for each message's body.
    messages: (id, text). A null text is an empty body; repeated rows are scored each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for some in in_batches(batches, batch):
            model = model or build()
            pair, single = model(some.column(1).to_pylist())
            classes = pa.FixedSizeListArray.from_arrays(pa.array(softmax(np.asarray(pair, float)).ravel()), 2).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([some.column(0).combine_chunks(), classes, pa.array(sigmoid(np.asarray(single, float)))], names=["id", "classification", "regression"])

    return messages.select(F.col("id").cast("long").alias("id"), F.coalesce(body(F.col("text")), F.lit("")).alias("text")).mapInArrow(run, "id long, classification array<double>, regression double")


class LetterModel:
    """Fixed weights on counts of characters in a text, and biases: for tests, and as the shape of a model."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], bias: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.letters, self.weights, self.bias = list(weights), np.array(list(weights.values())), np.array(bias)

    def __call__(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.array([[t.count(c) for c in self.letters] for t in some], float)
        logits = counts @ self.weights + self.bias
        return logits[:, :2], logits[:, 2]


def train_heads(labelled: DataFrame, label: str = "toxic", buckets: int = 1 << 14) -> Callable[[DataFrame], DataFrame]:
    """A scorer fitted on rows (body, label), to be other rows than those it scores: hashed words, a logistic
    regression as the softmax head, and a linear one of the label's logit at one and nine tenths as the sigmoid head.
    Bodies should be a stored column: Spark would cut a text anew for each of the two heads."""
    cut = RegexTokenizer(inputCol="_body", outputCol="_words", pattern=r"\W+")
    tf = HashingTF(inputCol="_words", outputCol="_features", numFeatures=buckets, binary=True)
    prepare = lambda df: tf.transform(cut.transform(df.withColumn("_body", F.coalesce("body", F.lit("")))))
    edge = math.log(9)
    rows = prepare(labelled.filter(F.col(label).isNotNull())).withColumn("_logit", F.when(F.col(label) == 1, edge).otherwise(-edge)).select("_features", "_logit", F.col(label).cast("double").alias("_label")).persist()
    pair = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=20, regParam=1e-3, probabilityCol="_pair", rawPredictionCol="_raw", predictionCol="_class").fit(rows)
    single = LinearRegression(featuresCol="_features", labelCol="_logit", maxIter=20, regParam=1e-1, predictionCol="_single").fit(rows)
    rows.unpersist()

    def score(df: DataFrame) -> DataFrame:
        """df with classification and regression."""
        out = single.transform(pair.transform(prepare(df)))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], vector_to_array("_pair").alias("classification"), (1 / (1 + F.exp(-F.col("_single")))).alias("regression"))

    return score
