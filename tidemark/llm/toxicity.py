"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w x), with one weight vector for all ordered thresholds. Features are words and
their beginnings (told by 64-bit hashes) at their rate in the text, scaled to equal mean squares. Weights have an elastic-net
penalty, solved by accelerated proximal gradients. The severity is the expected grade.

Fitting takes a bounded sample of labelled rows (``MAX_LABELLED``); every whole text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import keep_rows, map_in_arrow, table
from tidemark.llm.features import labelled_rows, share_of

WORD = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)
#: Bound of the labelled documents that a model is fitted on; a hash of doc_id chooses them when there are more.
MAX_LABELLED = 5000
#: Rates are counts over the number of words plus this, so that one word makes no text.
SMOOTHING = 20
#: A feature must occur in so many sampled documents; in a small sample, in a hundredth of them and in 3 at least.
LEAST = 10
#: Words whose weight a worker remembers; beyond it forgets all. This bounds memory and changes no result.
REMEMBERED = 150_000


def features_of(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its beginnings that are shorter than it."""
    digest = xxhash.xxh64_intdigest
    return [digest(word.encode(), 1) >> 1, *(digest(word[:n].encode(), n) >> 1 for n in STARTS if len(word) > n)]


def sparse_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of a text, in order, and their rates."""
    words, values = Counter(WORD.findall(text.lower())), Counter()
    share = SMOOTHING / (words.total() + SMOOTHING)
    for word, n in words.items():
        for f in features_of(word):
            values[f] += n * share
    at = np.fromiter(values, dtype=np.int64, count=len(values))
    order = np.argsort(at)
    return at[order], np.fromiter(values.values(), dtype=np.float32, count=len(values))[order]


def least_of(rows: int) -> int:
    return min(LEAST, max(3, rows // 100))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def grade_probabilities(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """(n, thresholds + 1): the probability of each grade."""
    below = sigmoid(thresholds[None, :] - eta[:, None])
    edges = np.concatenate([np.zeros((len(eta), 1)), below, np.ones((len(eta), 1))], axis=1)
    return np.diff(edges, axis=1)


def cumulative_link(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, size: int, top: int, l1: float = 0.0015, l2: float = 1e-5, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds for grades 0 to top; rows are sparse (indices, values)."""
    n = len(rows)
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    v = np.concatenate([r[1] for r in rows]).astype(float)
    own = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    squares = np.bincount(at, weights=v * v, minlength=size) / n
    scale = 1 / np.sqrt(squares + 1e-4 * squares.max() + 1e-12)
    v = v * scale[at]
    apply = lambda w: np.bincount(own, weights=v * w[at], minlength=n)
    back = lambda g: np.bincount(at, weights=v * g[own], minlength=size)
    u = np.random.default_rng(3).standard_normal(size)
    for _ in range(12):
        u = back(apply(u / max(np.linalg.norm(u), 1e-12)))
    bound = 0.5 * np.linalg.norm(u) / n + l2
    shares = np.clip(np.array([(grades <= k).mean() for k in range(top)]), 1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(np.log(shares / (1 - shares)) + np.arange(top) * 1e-3)
    w = np.zeros(size)
    ahead, momentum = w, 1.0
    for k in range(steps):
        if k == steps // 4:  # from here on only features that have a weight
            held = w[at] != 0
            at, v, own = at[held], v[held], own[held]
        eta = apply(ahead)
        below = sigmoid(theta[None, :] - eta[:, None])
        edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = edges * (1 - edges)
        p = np.maximum(edges[np.arange(n), grades + 1] - edges[np.arange(n), grades], 1e-12)
        high, low = slope[np.arange(n), grades + 1] / p, slope[np.arange(n), grades] / p
        step = ahead - (back(high - low) / n + l2 * ahead) / bound
        new = np.sign(step) * np.maximum(np.abs(step) - l1 / bound, 0)
        grow = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / grow * (new - w), new, grow
        pull = np.array([(high[grades == k].sum() - low[grades == k + 1].sum()) / n for k in range(top)])
        theta = np.maximum.accumulate(theta + pull)  # the thresholds' own curvature is at most a quarter
    return w * scale, theta


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    thresholds: np.ndarray


class Weigher(dict):
    """Word to the sum of the weights of its features; fills itself."""

    def __init__(self, weights: dict[int, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return found

    def total(self, text: str) -> float:
        words = WORD.findall(text.lower())
        return sum(map(self.__getitem__, words)) * SMOOTHING / (len(words) + SMOOTHING)


def grades_of(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grade 0: not toxic; 1: toxic; 2: toxic, with at least the median share of marker features among toxic rows.

    Markers are features at least eight times as frequent in toxic rows as in the others. Labels have no grades of
    their own; a table that has them is fitted on those instead.
    """
    yes, no = [Counter(f for (at, _), t in zip(rows, toxic, strict=True) if t == k for f in at.tolist()) for k in (1, 0)]
    n_yes, n_no = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    markers = {f for f, n in yes.items() if n >= least_of(len(rows)) and n / n_yes >= 8 * (no[f] + 0.5) / n_no}
    share = np.array([sum(x for f, x in zip(at.tolist(), v.tolist(), strict=True) if f in markers) / max(1e-9, v.sum()) for at, v in rows])
    middle = np.median(share[toxic == 1]) if (toxic == 1).any() else 0.0
    return np.where(toxic == 0, 0, np.where(share >= middle, 2, 1)).astype(np.int64)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int) -> Model:
    """A model from sparse rows; without any row every severity is 0."""
    if not rows:
        return Model({}, np.full(top, 40.0))
    known, n = np.unique(np.concatenate([r[0] for r in rows]), return_counts=True)
    known = known[n >= least_of(len(rows))]
    found = []
    for at, v in rows:
        k = np.searchsorted(known, at)
        held = (k < len(known)) & (known[np.minimum(k, max(0, len(known) - 1))] == at) if len(known) else np.zeros(len(at), bool)
        found.append((k[held], v[held]))
    weights, thresholds = cumulative_link(found, grades, max(1, len(known)), top)
    return Model({int(f): float(w) for f, w in zip(known, weights, strict=False) if w}, thresholds)


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Sparse rows and labels of a bounded sample, in an order that doesn't depend on the partitions."""
    once = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sample = once.where(share_of(F.col("doc_id"), most, once.count()))
    chosen = labelled_rows(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, v = sparse_words(batch.column(0)[k].as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), batch.column(1).slice(k, 1)], names=["at", "v", "label"])

    table_ = chosen.select("text", "label").transform(map_in_arrow, run, "at binary, v binary, label int").toArrow()
    rows = sorted(table_.to_pylist(), key=lambda r: (r["at"], r["v"], r["label"]))
    return [(np.frombuffer(r["at"], np.int64), np.frombuffer(r["v"], np.float32)) for r in rows], np.array([r["label"] for r in rows], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, grade: str | None = None) -> Model:
    """A model from labels (doc_id, toxic), or from an integer column ``grade`` of them.

    Of several labels of a document the largest holds; null labels are ignored.
    """
    rows, found = sampled(docs, labels, grade or "toxic", most)
    if not rows:
        return fit_rows([], found, 2)
    grades = found if grade else grades_of(rows, (found > 0).astype(np.int64))
    return fit_rows(rows, grades, max(1, int(grades.max())))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with severity (expected grade), p_toxic (that of any grade but 0) and toxic (p_toxic of a half or more).

    A null text counts as empty, whose severity is that of no evidence. Columns of these names are replaced.
    """
    made = ("severity", "p_toxic", "toxic")
    kept = [c for c in docs.columns if c not in made and c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("severity", T.DoubleType(), False), T.StructField("p_toxic", T.DoubleType(), False), T.StructField("toxic", T.BooleanType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the features of MAX_LABELLED sampled texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher, thresholds = Weigher(shared.value.weights), shared.value.thresholds
        for batch in batches:
            eta = np.array([weigher.total(x.as_py() or "") for x in batch.column(batch.schema.get_field_index(text))], dtype=float)
            p = grade_probabilities(eta, thresholds)
            severity, any_grade = p @ np.arange(p.shape[1]), 1 - p[:, 0]
            more = [pa.array(severity), pa.array(any_grade), pa.array(any_grade >= 0.5)]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *more], names=[*kept, *made])

    return docs.select(*kept, text).transform(map_in_arrow, run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity (0 to 2), p_toxic and toxic for every row of documents.

    Null and empty texts and those without a letter have the severity of no evidence. Rows without an id are scored but
    not learned from; repeated rows stay repeated. Without labels no row is toxic; an empty table gives an empty result;
    other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not toxic, with the columns of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def made() -> Callable[[list[str | None]], list[bool]]:
        weigher, thresholds = Weigher(shared.value.weights), shared.value.thresholds
        return lambda texts: (grade_probabilities(np.fromiter((weigher.total(x or "") for x in texts), dtype=float), thresholds)[:, 0] > 0.5).tolist()

    return keep_rows(docs, "text", made)
