"""Toxicity by a classifier chain over the label categories.

Categories are predicted one after another.  Each has a linear (logistic) model on
the words that a text contains; it also gets the logits of the categories before it.
When a later model is fitted, the earlier probabilities of its training rows come from
models that did not see those rows (out-of-fold), as those of new texts do.

The chain is fitted on at most ``TRAIN_ROWS`` labelled rows, those of the smallest hashed
ids; scoring covers every row.  Words: ASCII letters lowered, ASCII punctuation is space.

Cases: null and empty texts have no words and get the models' base rates; a category with
one class only is predicted as that class; null labels count as 0; without labels nothing
is toxic; repeated rows get equal scores; where labels of one id differ, each category's
largest counts; where texts of one labelled id differ, the one whose sorted word hashes
come first is learnt; columns of docs with the names of results are replaced by them.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

#: The chain, in order; the last one decides.
CATEGORIES = ("quality", "toxic")
TRAIN_ROWS = 12_000
FOLDS = 3
STEPS = 60
#: Beginnings of words, in bytes, that count as features of their own.
PREFIXES = (7,)
#: A word needs so many training texts; at most so many words are kept.
LEAST_TEXTS = 3
VOCABULARY = 1 << 16
THRESHOLD = 0.5

_SPACES = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words(text: str | None) -> set[bytes]:
    """The words of a text and, marked by ^, the beginnings of longer ones."""
    found = set((text or "").encode().lower().translate(_SPACES).split())
    starts = [{w[:n] for w in found if len(w) > n} for n in PREFIXES]
    return found.union(*[{b"^" + p for p in part} for part in starts])


def features(text: str | None) -> np.ndarray:
    """The words as 32-bit hashes."""
    found = words(text)
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


class Rows:
    """Places in the vocabulary of each row's features, flattened; other features are left out."""

    def __init__(self, bags: list[np.ndarray], vocabulary: np.ndarray):
        self.n = len(bags)
        row = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in bags])
        feature = np.concatenate(bags) if bags else np.zeros(0, np.uint32)
        place = np.searchsorted(vocabulary, feature).astype(np.int32)
        known = place < len(vocabulary)
        known[known] = vocabulary[place[known]] == feature[known]
        self.row, self.word = row[known], place[known]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.word], self.n)

    def dot_rows(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.word, values[self.row], size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(rows: Rows, earlier: np.ndarray, y: np.ndarray, use: np.ndarray, size: int, steps: int = STEPS, penalty: float = 0.3) -> np.ndarray:
    """Weights of words (scaled by their log odds), earlier logits and the base, on rows ``use``."""
    w = use.astype(float)
    if len(set(y[use])) < 2:
        out = np.zeros(size + earlier.shape[1] + 1)
        out[-1] = 8.0 if use.any() and y[use][0] else -8.0
        return out
    there = rows.dot_rows(w * y, size) + 0.5
    absent = rows.dot_rows(w * (1 - y), size) + 0.5
    scale = np.log(there / (w @ y + 1)) - np.log(absent / (w @ (1 - y) + 1))
    theta = np.zeros(size + earlier.shape[1] + 1)
    theta[-1] = np.log(w @ y / (w @ (1 - y)))
    moment, spread = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = rows.dot(theta[:size] * scale) + earlier @ theta[size:-1] + theta[-1]
        error = w * (_sigmoid(z) - y)
        gradient = np.concatenate([scale * rows.dot_rows(error, size) + penalty * theta[:size], earlier.T @ error + penalty * theta[size:-1], [error.sum()]])
        moment = 0.9 * moment + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        theta -= 0.1 * (moment / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-8)
    theta[:size] *= scale
    return theta


class Chain:
    """Fitted models of all categories over one vocabulary."""

    def __init__(self, bags: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, hold_out_last: bool = False):
        found, counts = np.unique(np.concatenate([*bags, np.zeros(0, np.uint32)]), return_counts=True)
        frequent = np.argsort(-counts, kind="stable")[:VOCABULARY]
        self.vocabulary = np.sort(found[frequent[counts[frequent] >= LEAST_TEXTS]])
        size = len(self.vocabulary)
        rows = Rows(bags, self.vocabulary)
        earlier = np.zeros((len(bags), 0))
        self.models: list[np.ndarray] = []
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(float)
            self.models.append(fit_logistic(rows, earlier, y, np.ones(len(bags), bool), size))
            if k == labels.shape[1] - 1 and not hold_out_last:
                break
            held_out = np.zeros(len(bags))
            for f in range(FOLDS):
                model = fit_logistic(rows, earlier, y, folds != f, size)
                z = rows.dot(model[:size]) + earlier @ model[size:-1] + model[-1]
                held_out[folds == f] = z[folds == f]
            earlier = np.column_stack([earlier, np.clip(held_out, -8, 8)])
        #: out-of-fold probabilities of the training rows, by category
        self.held_out = _sigmoid(earlier)

    def predict(self, bags: list[np.ndarray]) -> np.ndarray:
        """A probability for each text and category."""
        size = len(self.vocabulary)
        rows = Rows(bags, self.vocabulary)
        earlier = np.zeros((len(bags), 0))
        for model in self.models:
            z = rows.dot(model[:size]) + earlier @ model[size:-1] + model[-1]
            earlier = np.column_stack([earlier, np.clip(z, -8, 8)])
        return _sigmoid(earlier)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, most: int = TRAIN_ROWS) -> Chain:
    """Fits the chain on at most ``most`` labelled rows; hashes of their words reach the driver."""
    marks = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in categories]
    chosen = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), *marks).groupBy("_id").agg(*[F.max(c).alias(c) for c in categories]).withColumn("_order", F.xxhash64("_id"))
    chosen = chosen.orderBy("_order", "_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(features(t.as_py())).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], ["bag", *batch.schema.names[1:]])

    joined = texts.join(F.broadcast(chosen), "_id").select("_text", "_id", *categories)  # at most TRAIN_ROWS ids
    found = joined.mapInArrow(bags, "bag binary, _id long, " + ", ".join(f"{c} int" for c in categories))
    rows = found.groupBy("_id", *categories).agg(F.min("bag").alias("bag")).toPandas().sort_values("_id")  # a row for each chosen id
    folds = (rows["_id"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % FOLDS
    return Chain([np.frombuffer(b, np.uint32) for b in rows["bag"]], rows[list(categories)].to_numpy(np.int64).reshape(-1, len(categories)), folds)


def score_documents(docs: DataFrame, chain: Chain, categories: tuple[str, ...] = CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a probability for each category (<category>_score) and the boolean is_toxic."""
    more = [*(f"{c}_score" for c in categories), "is_toxic"]
    docs = docs.drop(*more)
    text_at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            scores = np.concatenate([chain.predict([features(t.as_py()) for t in texts.slice(at, 500)]) for at in range(0, max(1, batch.num_rows), 500)])
            found = [*(pa.array(scores[:, k]) for k in range(len(categories))), pa.array(scores[:, -1] >= threshold)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *more])

    schema = StructType([*docs.schema, *(StructField(c, BooleanType() if c == "is_toxic" else DoubleType()) for c in more)])
    return docs.mapInArrow(score, schema)
