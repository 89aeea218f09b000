"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed character runs, hashed runs of character classes (so that shouting, tables and symbol junk share
terms in all languages) and counts of words seen for the first time or again. TF-IDF vectors are projected on the
leading right singular vectors of a bounded labelled sample (``MAX_LABELLED``), whose projections are broadcast. Each
document is compared exactly, in blocks, with all of them; the labels of the nearest are weighted by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_in_arrow, table
from tidemark.llm.features import codes, collected, document_frequencies, grams, inverse_frequencies, labelled_rows, mod_of_crc32, share_of, sparse

BITS = 12
#: Three families of terms: characters, classes of characters, words.
SIZE = 2 * (1 << BITS) + 16
#: Bound of the labelled documents that are broadcast; a hash of doc_id chooses them when there are more.
MAX_LABELLED = 4000
DIMENSIONS = 32
NEIGHBOURS = 25


def _classes() -> np.ndarray:
    """Class of each code point below 65,536: its own for symbols, else one for space, digits, upper and lower case."""
    found = np.arange(1 << 16, dtype=np.uint32)
    for k in range(1 << 16):
        c = chr(k)
        if k <= 32:
            found[k] = 32
        elif c.isdigit():
            found[k] = ord("0")
        elif c.isalpha():
            found[k] = ord("A") if c.isupper() else ord("a")
    return found


CLASSES = _classes()
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def repeats(c: np.ndarray) -> tuple[int, int, int]:
    """Words, words seen before in the text, and words equal to the one before; words are told by 64-bit hashes."""
    solid = np.concatenate(([False], c != 32, [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return 0, 0, 0
    powers = np.cumprod(np.full(len(c) + 1, ODD, dtype=np.uint64))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((c.astype(np.uint64) + np.uint64(7)) * powers[:-1], dtype=np.uint64)))
    back = np.cumprod(np.full(len(c) + 1, INVERSE, dtype=np.uint64))
    h = (sums[ends] - sums[starts]) * back[starts]
    return len(h), len(h) - len(np.unique(h)), int((h[1:] == h[:-1]).sum())


def ids(text: str) -> np.ndarray:
    c = codes(text)
    kind = CLASSES[np.minimum(c, (1 << 16) - 1)]
    kind = kind[np.concatenate(([True], kind[1:] != kind[:-1]))] if len(kind) else kind
    found = [*grams(c, range(1, 3), BITS), *(x + np.uint32(1 << BITS) for x in grams(kind, range(1, 4), BITS, 99))]
    words, again, same = repeats(c)
    share = [min(7, int(8 * again / max(1, words))), 8 + min(7, int(8 * same / max(1, words)))]
    found.append(np.array(share, dtype=np.uint32) + np.uint32(2 << BITS))
    return np.concatenate(found)


#: What each family weighs in a vector.
FAMILIES = ((slice(0, 1 << BITS), 0.3), (slice(1 << BITS, 2 << BITS), 0.6), (slice(2 << BITS, SIZE), 0.6))


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values, each family normalised and weighed on its own."""
    v = (1 + np.log(counts)) * idf[at]
    for family, weight in FAMILIES:
        own = slice(*np.searchsorted(at, (family.start, family.stop)))
        norm = np.sqrt(v[own] @ v[own])
        if norm:
            v[own] *= weight / norm
    return v


def singular_vectors(ats: list[np.ndarray], values: list[np.ndarray], size: int, rank: int, rounds: int = 3, seed: int = 5) -> np.ndarray:
    """(size, rank): leading right singular vectors of sparse rows by randomised subspace iteration, block by block."""

    def blocks() -> Iterator[np.ndarray]:
        for k in range(0, len(ats), 128):
            dense = np.zeros((len(ats[k : k + 128]), size), dtype=np.float32)
            for row, at, v in zip(dense, ats[k : k + 128], values[k : k + 128], strict=True):
                row[at] = v
            yield dense

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank + 8)).astype(np.float32))[0]
    gram = basis
    for _ in range(rounds):
        gram = sum((a.T @ (a @ basis) for a in blocks()), np.zeros_like(basis))
        basis = np.linalg.qr(gram)[0]
    small = sum(((p := a @ basis).T @ p for a in blocks()), np.zeros((basis.shape[1],) * 2, np.float32))
    values_, rotation = np.linalg.eigh(small.astype(float))
    order = np.argsort(values_)[::-1][:rank]
    return (basis @ rotation[:, order]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    basis: np.ndarray
    idf: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def latent(self, text: str | None) -> np.ndarray:
        at, counts = sparse(ids(text or ""), SIZE)
        v = weigh(at, counts, self.idf) @ self.basis[at]
        norm = np.sqrt(v @ v)
        return v / norm if norm else v

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Scores of a block of vectors: the similarity-weighted share of label 1 among the nearest."""
        if not len(self.labels):
            return np.full(len(vectors), self.prior)
        near = min(self.neighbours, len(self.labels))
        out = np.empty(len(vectors))
        for k in range(0, len(vectors), 256):
            cosines = vectors[k : k + 256] @ self.vectors.T
            at = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
            weights = np.maximum(np.take_along_axis(cosines, at, axis=1), 0) ** 4 + 1e-9
            out[k : k + 256] = (weights * self.labels[at]).sum(axis=1) / weights.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, rank: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model:
    """A model from labels (doc_id, quality); document frequencies count all of docs.

    Of several labels of a document the smallest holds; null labels are ignored. Without labels the score is 0.5.
    """
    seen, there = document_frequencies(docs, ids, SIZE)
    idf = inverse_frequencies(seen, there)
    once = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    sample = once.where(share_of(F.col("doc_id"), most, once.count()))
    chosen = labelled_rows(docs, sample)
    ats, counts, found = collected(chosen, ids, SIZE)
    values = [weigh(at, c, idf) for at, c in zip(ats, counts, strict=True)]
    basis = singular_vectors(ats, values, SIZE, rank) if ats else np.zeros((SIZE, rank), np.float32)
    vectors = np.array([v @ basis[at] for at, v in zip(ats, values, strict=True)], dtype=np.float32).reshape(-1, rank)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    y = (np.array(found, dtype=float) > 0).astype(float) if found else np.zeros(0)
    return Model(basis, idf, vectors, y, float(y.mean()) if len(y) else 0.5, neighbours)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with a score of 0 to 1. Null and empty texts are scored by the terms of an empty text."""
    kept = [c for c in docs.columns if c not in (text, "score")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LABELLED x DIMENSIONS and SIZE x DIMENSIONS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            vectors = [own.latent(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            found = own.vote(np.array(vectors, dtype=np.float32).reshape(len(vectors), own.basis.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(found, pa.float64())], names=[*kept, "score"])

    return docs.select(*kept, text).transform(map_in_arrow, run, schema)


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents.

    Labels of held-out ids are not learned from. A row without an id is scored, but isn't held out. Null and empty texts
    are scored by the terms of an empty text; repeated rows stay repeated; without labels every score is 0.5; of equally
    near neighbours any is taken. An empty table gives an empty result; other columns are not read.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = mod_of_crc32(F.col("doc_id"), 5) == 0
    model = fit(docs, labels.where(~held))
    found = score(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model)
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
