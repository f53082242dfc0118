"""Quality classifier: supervised subword embeddings with a softmax output, trained by numpy gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import arrow_map, picked, slices
from meshwork.llm.hashgrams import Words, blocks, char_grams

ORDERS = (2, 3)
BITS = 15
DIM = 10
#: Labelled documents to learn from, about; a hash of the id picks them where there are more.
TRAIN_ROWS = 3000
#: An embedding moves by its share of the document times the distinct features, up to so many.
REACH = 200
EPOCHS, RATE, SEED = 8, 0.5, 11


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, hashed feature) of all words, word pairs and character n-grams, block by block; where blocks end changes none."""
    words = Words()

    def of_words(owner: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for mine, x in ((owner, h), words.pairs(owner, h)):  # pairs by exclusive or: a word behind itself is one feature, whatever the word
            yield mine, (x >> np.uint64(64 - BITS)).astype(np.uint32)

    for codes, owner, live in blocks([t or "" for t in texts], max(ORDERS) - 1):
        for order in ORDERS:
            at, h = char_grams(codes, live, order, BITS)
            yield owner[at], h
        yield from of_words(*words.take(codes, owner, live))
    yield from of_words(*words.rest())


@dataclass(frozen=True)
class QualityModel:
    """The embedding table times the output layer: as the mean and the layer are linear, a feature's share of the margin."""

    margin: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1; that of a text without features is the bias alone."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, h in features(texts):
            total += np.bincount(owner, weights=self.margin[h], minlength=len(texts))
            count += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, distinct features, their counts) of each document."""
    for batch in slices(batches, 256):
        texts = batch.column(2).to_pylist()
        for k in range(len(texts)):
            h = np.concatenate([x for _, x in features([texts[k]])] or [np.zeros(0, np.uint32)])
            ids, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([n.astype(np.int32)], pa.list_(pa.int32()))], names=["id", "label", "ids", "n"])


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], *, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Stochastic gradient descent, one document a step, over (features, counts, label)."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim))
    layer, bias = np.zeros((dim, 2)), np.zeros(2)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, n, label = examples[k]
            lr, done = rate * (1 - done / steps), done + 1
            share = n / max(1, n.sum())
            mean = share @ table[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            table[ids] -= lr * np.outer(share * min(len(ids), REACH), back)
    return QualityModel((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Learns from the labels where ``learn`` (over the id) holds.

    Of more than ``train_rows`` such labels a hash of the id picks about that many,
    at any size. Of labels that clash over one id the smallest holds; an id that
    several documents have stands for the smallest of their texts (null counts as
    empty). Texts become feature counts on the executors; the driver gets at most
    2**15 counts for each picked id. Without labels of both kinds the model says
    their share for every text (a half without any).
    """
    known = labels.filter(learn & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("__label"))
    share = min(1.0, train_rows / max(1, known.count()))
    if share < 1:
        known = known.filter(picked(share, id_col))
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = named.join(known.withColumnRenamed(id_col, "id"), "id").groupBy("id").agg(F.min("__label").alias("label"), F.min("text").alias("text"))
    kind = dict(docs.dtypes)[id_col]
    found = arrow_map(rows, _sparse, f"id {kind}, label int, ids array<int>, n array<int>").toArrow().sort_by("id")
    examples = [(i.values.to_numpy(zero_copy_only=False), n.values.to_numpy(zero_copy_only=False).astype(np.float64), y) for i, n, y in zip(found["ids"], found["n"], found["label"].to_pylist(), strict=True)]
    if len({y for _, _, y in examples}) < 2:
        p = (sum(y for _, _, y in examples) + 1) / (len(examples) + 2)
        return QualityModel(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))
    return train(examples)


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row.

    Null counts as empty, and an empty text has the score of the bias alone. Texts
    are read whole, in blocks of bounded size. Equal texts get equal scores; an
    empty table gives no rows; other columns are ignored. The broadcast is 2**15
    floats.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    return arrow_map(docs.select(id_col, text_col), run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def accept(docs: DataFrame, model: QualityModel, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, with all their columns, in one pass.

    Null counts as empty. Rows that repeat stay or go together; an empty table
    gives no rows; columns of any name or type pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            yield batch.filter(pa.array(shared.value.score(batch.column(at).to_pylist()) >= least, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
