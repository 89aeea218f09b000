"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained by follow-the-regularised-leader with an elastic net, on a bounded sample of labelled texts
(``MAX_TRAIN``); inverse document frequencies come from all texts that may be learned from. A temperature fitted on a
part of the sample that the weights have not seen calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_in_arrow, table
from tidemark.llm.features import codes, collected, document_frequencies, grams, inverse_frequencies, mod_of_crc32, sampled_rows, sparse

BITS = 15
SIZE = 1 << BITS
#: Bound of the labelled texts that weights are trained on; a hash of doc_id chooses them when there are more.
MAX_TRAIN = 3000
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def ids(text: str) -> np.ndarray:
    """Buckets of the runs of one to three characters of the lower-cased text."""
    found = grams(codes(text.lower()), range(1, 4), BITS)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, passes: int = 3) -> np.ndarray:
    """Weights (classes, size + 1), the last column the bias, by per-coordinate FTRL-proximal steps."""
    z, n = np.zeros((classes, size + 1)), np.zeros((classes, size + 1))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[:, at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[:, at])) / alpha + l2))

    for _ in range(passes):
        for (at, v), own in zip(rows, y, strict=True):
            at, v = np.append(at, size), np.append(v, 1.0)
            w = weights(at)
            g = softmax(w @ v)
            g[own] -= 1
            step = g[:, None] * v
            squares = n[:, at] + step * step
            z[:, at] += step - (np.sqrt(squares) - np.sqrt(n[:, at])) / alpha * w
            n[:, at] = squares
    return weights(np.arange(size + 1)).astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, from a fixed grid."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        at, counts = sparse(ids(text), SIZE)
        p = softmax((self.weights[:, at] @ vector(at, counts, self.idf) + self.weights[:, -1]) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def fit(docs: DataFrame, most: int = MAX_TRAIN) -> Model:
    """A model from the rows of docs with a lang and a text. No such row gives a model that knows no language."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").alias("label"))
    seen, there = document_frequencies(learn, ids, SIZE)
    idf = inverse_frequencies(seen, there)
    ats, counts, labels = collected(sampled_rows(learn, most, there), ids, SIZE)
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, SIZE + 1), np.float32), idf, 1.0)
    rows = [(at, vector(at, c, idf)) for at, c in zip(ats, counts, strict=True)]
    y = np.array([languages.index(x) for x in labels])
    held = np.arange(len(y)) % 5 == 4
    weights = follow_the_leader([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(languages), SIZE)
    logits = np.array([weights[:, at] @ v + weights[:, -1] for (at, v), h in zip(rows, held, strict=True) if h]).reshape(-1, len(languages))
    return Model(languages, weights, idf, temperature(logits, y[held]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score; ``und`` and 0 for a null text and one without a letter."""
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # classes x SIZE weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *more], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept, text).transform(map_in_arrow, run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of documents.

    A row without an id is predicted, but isn't learned from and isn't held out. Null and empty texts and those without
    a letter are und with a score of 0, as all are without a language to learn. Of equally likely languages the first
    in order holds. Repeated rows stay repeated; an empty table gives an empty result; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    held = mod_of_crc32(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model)
