"""SimHash near-duplicates by covering locality-sensitive hashing.

Positions of the fingerprint are dealt evenly to the nonzero vectors of {0, 1}^(r + 1). Table v, one for each nonzero
vector v, keeps the positions whose vector has an odd product with v. For any r positions there is a nonzero v that is
orthogonal to all their vectors, so two fingerprints that differ there and nowhere else agree in what table v keeps:
each pair within the radius meets in a table, with certainty.

Equal fingerprints are one node. A table's bucket of two nodes is compared in place; a larger one yields a spanning
forest of its links and never its pairs. Buckets above ``BLOCK`` nodes are compared block against block, each pair of
blocks a group of its own, so no group is larger than about two blocks and no pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, map_in_arrow, shuffled, table
from tidemark.llm.components import components

BITS = 64
BLOCK = 1024
#: Rows of tables that a task makes, about.
TASK_ROWS = 1_000_000


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The positions that each table keeps, as masks."""
    vectors = [1 + p % (2 ** (radius + 1) - 1) for p in range(bits)]
    return [sum(1 << p for p, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: str | None, width: int) -> int:
    """The fingerprint of a text, unsigned."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 4, out: str = "fp") -> DataFrame:
    """df without its text, with the 64-bit fingerprint as a signed long. A null text counts as empty: zero."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(x.as_py(), width)) for x in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(found, pa.int64())], names=[*kept, out])

    return df.select(*kept, text).transform(map_in_arrow, run, schema)


def forest(nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) that connect what links of at most radius differing bits connect."""
    near = np.bitwise_count(nodes[:, None] ^ nodes[None, :]) <= radius
    free = np.ones(len(nodes), dtype=bool)
    roots, ends = [], []
    for k in range(len(nodes)):
        if not free[k]:
            continue
        free[k] = False
        edge = near[k] & free
        while edge.any():
            free &= ~edge
            ends.append(found := np.flatnonzero(edge))
            roots.append(np.full(len(found), k))
            edge = near[found].any(axis=0) & free
    if not roots:
        return nodes[:0], nodes[:0]
    return nodes[np.concatenate(roots)], nodes[np.concatenate(ends)]


def _forests(groups: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest(x.values.to_numpy().view(np.uint64), radius) for x in batch.column(0)]
            ends = [np.concatenate([x[k] for x in found] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["a", "b"])

    return groups.transform(map_in_arrow, run, "a long, b long")


def _dealt(nodes: DataFrame, fingerprints: tuple[str, ...], radius: int, more: tuple[str, ...] = ()) -> DataFrame:
    """nodes once for each table of each fingerprint, as (t, key, fp, more).

    Nodes are few bytes and become many rows, so they are first dealt to tasks by the rows they will make.
    """
    masks = covering_masks(radius)
    tables = [F.struct(F.lit(v * len(masks) + k).cast("short").alias("t"), F.col(c).bitwiseAND(F.lit(signed(m))).alias("key")) for v, c in enumerate(fingerprints) for k, m in enumerate(masks)]
    nodes = nodes.repartition(max(1, -(-nodes.count() * len(tables) // TASK_ROWS)), "fp")
    return nodes.select("fp", *more, F.explode(F.array(*tables)).alias("at")).select("at.t", "at.key", "fp", *more)


def _groups(dealt: DataFrame, counts: DataFrame, block: int, item: Column) -> DataFrame:
    """(items): the members of each bucket of more than two nodes, or of each pair of its blocks."""
    large = counts.where("n > 2").select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda d: F.least(own, d) * F.col("blocks") + F.greatest(own, d))
    return (
        dealt.join(shuffled(large), ["t", "key"])
        .withColumn("pair", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(met)))
        .groupBy("t", "key", "pair")
        .agg(F.collect_list(item).alias("items"))
        .select("items")
    )


def links(nodes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over the distinct longs in column fp that connect what lies within radius differing bits."""
    dealt = _dealt(nodes, ("fp",), radius)
    counts = cut(dealt.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    twos = counts.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    return twos.union(_forests(_groups(dealt, counts, block, F.col("fp")), radius))


def classes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (doc_id, fp, …) with component_id, the smallest doc_id that edges (a, b) over fp reach.

    A component without an id has a null one. A fingerprint of many rows is a hot key of the last join, whose sides are
    both shuffled, so that adaptive execution splits its rows.
    """
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = cut(nodes.join(shuffled(components(edges).withColumnRenamed("node", "fp")), "fp"))
    tops = linked.groupBy("component").agg(F.min("least").alias("top"))
    linked = cut(linked.join(shuffled(cut(tops)), "component").select("fp", "top"))
    found = cut(nodes.join(shuffled(linked), "fp", "left").select("fp", F.coalesce("top", "least").alias("component_id")))
    return rows.join(shuffled(found), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable over links.

    A link joins fingerprints with at most ``radius`` differing bits. Null and empty texts have fingerprint zero and
    are linked like any other. Rows with a null id link others and take the smallest id of their component, null if it
    has none. Repeated rows stay repeated; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width=width))
    return classes(rows, links(cut(rows.select("fp").distinct()), radius)).select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row of documents.

    Fingerprints of 4-word shingles, repeats included, link at 4 or fewer differing bits. Null and empty texts have a
    fingerprint of zero, texts of fewer words one shingle. Repeated rows stay repeated; a row without an id links others
    and takes the smallest id of its component; an empty table gives an empty result; other columns are not read.
    """
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
