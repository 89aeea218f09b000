"""Hashed sparse text features, made with whole-array operations, and their corpus statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_in_arrow

Ids = Callable[[str], np.ndarray]
GOLDEN = np.uint32(2654435761)
STEP = np.uint32(16777619)


def codes(text: str) -> np.ndarray:
    """The code points; controls and space are all 32."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.where(c <= 32, np.uint32(32), c)


def grams(c: np.ndarray, sizes: range, bits: int, salt: int = 0) -> list[np.ndarray]:
    """Bucket numbers of all runs of the given sizes."""
    found, h = [], np.full(len(c), salt, dtype=np.uint32)
    for n in range(1, sizes.stop):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * STEP + c[n - 1 :] + np.uint32(n)
        if n in sizes:
            found.append(((h * GOLDEN) ^ (h >> np.uint32(15))) * GOLDEN >> np.uint32(32 - bits))
    return found


def sparse(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets in order, and how often each occurs."""
    counts = np.bincount(ids, minlength=size) if len(ids) else np.zeros(size, dtype=np.int64)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float32)


def mod_of_crc32(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key gives null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def share_of(key: Column, most: int, there: int) -> Column:
    """True for about ``most`` of ``there`` keys, chosen by a hash; for all if there are fewer."""
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_000)) < int(min(1.0, most / max(1, there)) * 1_000_000)


def sampled_rows(docs: DataFrame, most: int, there: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """About ``most`` of ``there`` rows of docs at most, chosen by a hash of id and text; rows of one hash count once.

    So neither rows without an id nor those of one hot id or text come in or stay out together, and the sample is
    bounded however often a row is repeated.
    """
    keyed = docs.withColumn("_sampled", F.xxhash64(F.col(doc_id), F.col(text)))
    return keyed.where(share_of(F.col("_sampled"), most, there)).dropDuplicates(["_sampled"]).drop("_sampled")


def labelled_rows(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the documents of a bounded sample of labels (doc_id, label), one row each.

    Of several texts of an id the one of the smallest hash is taken, by a combined aggregation, so the rows are as
    bounded as the labels are.
    """
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return chosen.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))


def document_frequencies(docs: DataFrame, ids: Ids, size: int, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are. Each partition sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                seen[sparse(ids(x.as_py() or ""), size)[0]] += 1
                n += 1
        at = np.flatnonzero(seen)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())], names=["bucket", "n"])

    parts = docs.select(text).transform(map_in_arrow, run, "bucket int, n long")
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # size + 1 rows at most
    found, at, n = np.zeros(size + 1, dtype=np.int64), rows["bucket"].to_numpy(), rows["n"].to_numpy()
    found[at] = n
    return found[:size], int(found[size])


def inverse_frequencies(seen: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)


def collected(sample: DataFrame, ids: Ids, size: int, text: str = "text", label: str = "label") -> tuple[list[np.ndarray], list[np.ndarray], list]:
    """Sparse features and labels of a bounded sample, on the driver, in an order that doesn't depend on the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                at, counts = sparse(ids(texts[k].as_py() or ""), size)
                arrays = [pa.array([at.tobytes()], pa.binary()), pa.array([counts.astype(np.float32).tobytes()], pa.binary()), labels.slice(k, 1)]
                yield pa.RecordBatch.from_arrays(arrays, names=["at", "counts", "label"])

    kind = dict(sample.dtypes)[label]
    rows = sample.select(text, label).transform(map_in_arrow, run, f"at binary, counts binary, label {kind}").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["at"], r["counts"], str(r["label"])))
    rng = np.random.default_rng(11)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    return [np.frombuffer(r["at"], dtype=np.int32) for r in rows], [np.frombuffer(r["counts"], dtype=np.float32) for r in rows], [r["label"] for r in rows]
