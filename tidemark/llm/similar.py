"""Documents whose sets of shingles are similar, by covering tables of SimHash fingerprints and a check in each bucket.

Edits of a few words move many shingles but few words, so texts of a shingle similarity of 0.8 are about five bits apart
in a fingerprint of distinct words. Three such fingerprints meet in the covering tables of ``simhash``; texts of at most
``SHORT`` distinct words, where one word moves many bits, also meet by a prefix filter of their shingles: of n shingles,
two sets of similarity s or more share one of the first n - s n + 1 of each by any order. Shingles that are common in a
bounded sample of texts come last in it, so that a passage of many texts doesn't bring them all together; the sample
decides the order only, and any order loses nothing.

What decides is the similarity of the sets themselves, of 32-bit hashes: exact up to ``KEPT`` distinct shingles, and an
estimate from the least KEPT hashes beyond (error at 0.8: about 0.013). It is tested where texts meet: a bucket gives a
spanning forest of the links that pass, so no link is lost for a nearer pair that fails, and no pairs are emitted.

Shuffles carry no texts. Keys of buckets go first, to be counted; only members of buckets of two or more go again; of
buckets with the same members (a group of copies meets in many tables) one stays; and only its members' sets are
fetched. Buckets above ``BLOCK`` are cut into blocks: of at most ``AT_ONCE`` blocks each is compared with each; larger
ones get two deals of their own, which join most of what is alike in work in proportion to their size. Parts of such a bucket that are still apart meet by a prefix filter of their sets, which
loses nothing, and where even that leaves more than a block with more than one component, block is compared with block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, map_in_arrow, shuffled, written
from tidemark.llm.components import components
from tidemark.llm.simhash import BLOCK, TASK_ROWS, classes, covering_masks, signed

VIEWS = ("v0", "v1", "v2")
#: Distinct shingles of a text up to which similarities are exact.
KEPT = 1024
#: Distinct words up to which a text also meets others by the least of its shingles; above, fingerprints propose alone.
SHORT = 100
#: Blocks of a bucket up to which all pairs of blocks cost no more rows than two deals and prefixes.
AT_ONCE = 4
#: Texts, about, whose shingles tell which are common; in how many of them a common one is; how many are kept at most.
ORDER_TEXTS, COMMON, ORDER_SIZE = 20_000, 3, 32_768

#: Common hashes in ascending order, and in how many texts of the sample each is.
Order = tuple[np.ndarray, np.ndarray]
NO_ORDER: Order = (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))


def bits_of(hashes: np.ndarray) -> int:
    """The signed fingerprint of distinct 64-bit features."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefix_of(own: np.ndarray, similarity: float, order: Order = NO_ORDER, most: int = KEPT) -> np.ndarray:
    """Keys of a set of hashes, given in ascending order: two sets that are similar by similarity_of share a key.

    They are the first hashes by order, common ones last. Of a set of ``most`` hashes only the least are known, so what
    may be similar to one has the least hashes as keys too.
    """
    n = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
    keys = []
    if len(own) < most:
        hashes, counts = order
        rank = np.zeros(len(own), dtype=np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            rank = np.where(hashes[at] == own, counts[at], 0)
        keys.append(own[np.lexsort((own, rank))][:n].astype(np.int64))
    if len(own) >= similarity * most - 1e-9:
        keys.append(own[:n].astype(np.int64) + (1 << 32))
    return np.concatenate(keys)


def profile(text: str | None, width: int) -> tuple[int, list[int], bytes, bool]:
    """(hash of the words, a fingerprint of the distinct words for each view, set of shingles, whether it is short).

    The set is the KEPT least distinct 32-bit hashes of shingles, in order. A short text has at most SHORT distinct
    words. Fewer words than a shingle has are one shingle; no words have an empty set.
    """
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    kept = np.zeros(0, dtype="<u4")
    own = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    if words:
        n = max(1, len(words) - width + 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(min(width, len(words))):
            h = mixed(h + own[k : k + n], k + 1)
        kept = np.unique((h >> np.uint64(32)).astype("<u4"))
        own = np.unique(own)
    return signed(digest(b" ".join(words), 7)), [bits_of(mixed(own, v + 50)) for v in range(len(VIEWS))], kept[:KEPT].tobytes(), len(own) <= SHORT


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """docs without text, with fp, v0, v1, v2, kept and short of every row."""
    rest = [c for c in docs.columns if c != "text"]
    made = [*(T.StructField(c, T.LongType(), False) for c in ("fp", *VIEWS)), T.StructField("kept", T.BinaryType(), False), T.StructField("short", T.BooleanType(), False)]
    schema = T.StructType([*(docs.schema[c] for c in rest), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(x.as_py(), width) for x in batch.column(len(rest))]
            views = [pa.array([x[1][v] for x in found], pa.int64()) for v in range(len(VIEWS))]
            more = [pa.array([x[0] for x in found], pa.int64()), *views, pa.array([x[2] for x in found], pa.binary()), pa.array([x[3] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *more], names=schema.names)

    return docs.select(*rest, "text").transform(map_in_arrow, run, schema)


def sets_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4") for x in column]


def common_shingles(rows: DataFrame) -> Order:
    """The most common hashes of the sets (fp, kept) of about ORDER_TEXTS texts, chosen by fp, copies counting once."""
    share = int(min(1.0, ORDER_TEXTS / max(1, rows.count())) * (1 << 40))
    sample = rows.where(F.pmod(F.xxhash64("fp", F.lit(4)), F.lit(1 << 40)) < share).groupBy("fp").agg(F.first("kept").alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes, counts = np.unique(np.concatenate(sets_of(batch.column(0))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(counts)], names=["h", "n"])

    told = sample.select("kept").transform(map_in_arrow, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = sorted(told.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(ORDER_SIZE).collect())
    return np.array([r.h for r in found], dtype="<u4"), np.array([r.n for r in found], dtype=np.int64)


def _with_prefix(rows: DataFrame, similarity: float, order: Order) -> DataFrame:
    """(fp, views, prefix) of rows with kept and short; the prefix of a text that isn't short is empty."""
    none = np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *names, kept, short = batch.columns
            found = [prefix_of(own, similarity, order) if is_short.as_py() else none for own, is_short in zip(sets_of(kept), short, strict=True)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(found, pa.list_(pa.int64()))], names=["fp", *VIEWS, "prefix"])

    return rows.select("fp", *VIEWS, "kept", "short").transform(map_in_arrow, run, f"fp long, {' long, '.join(VIEWS)} long, prefix array<long>")


def similarity_of(a: np.ndarray, b: np.ndarray, most: int = KEPT) -> float:
    """The common part of two sets over their union, from their least hashes; 0 for empty ones."""
    ends = [x[-1] for x in (a, b) if len(x) >= most]
    if ends:  # beyond the least of these ends one of the sets is not known
        a, b = a[: np.searchsorted(a, min(ends), "right")], b[: np.searchsorted(b, min(ends), "right")]
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def accepted_forest(names: np.ndarray, tops: np.ndarray, sets: list[np.ndarray], similarity: float, most: int = KEPT) -> list[tuple[int, int]]:
    """Edges of similar sets that connect, with the components in tops, what all similar pairs of names would connect."""
    sizes = np.array([len(s) for s in sets])
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    tops, found = tops.copy(), []
    whole = sizes < most
    for k in range(len(names)):
        other = tops != tops[k]
        other[: k + 1] = False
        if not other.any() or not sizes[k]:
            continue
        begin, end = np.searchsorted(tokens, sets[k], "left"), np.searchsorted(tokens, sets[k], "right")
        lengths = end - begin
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        common = np.bincount(owners[at], minlength=len(names))
        held = common >= similarity * np.maximum(1, sizes + sizes[k] - common) - 1e-9
        unsure = ~(whole & whole[k]) & (common > 0)
        for m in np.flatnonzero(other & (held | unsure)).tolist():
            if tops[m] != tops[k] and (similarity_of(sets[k], sets[m], most) >= similarity - 1e-9 if unsure[m] else held[m]):
                found.append((int(names[k]), int(names[m])))
                tops[tops == tops[m]] = tops[k]
    return found


def _forests(members: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of the groups of members (gid, fp, top, kept), each group streamed through a task."""
    rows = members.select("gid", "fp", "top", "kept").repartition("gid").sortWithinPartitions("gid", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members_of() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)

        for _, group in groupby(members_of(), key=lambda r: r[0]):
            _, names, tops, kept = zip(*group, strict=True)
            if len(names) > 1 and (found := accepted_forest(np.array(names), np.array(tops), [np.frombuffer(x, "<u4") for x in kept], similarity)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return rows.transform(map_in_arrow, run, "a long, b long")


def _met(nodes: DataFrame, radius: int) -> DataFrame:
    """(h, fp): nodes (fp, views and perhaps prefix) once for each table that they are in, h telling table and key.

    Nodes are few bytes and become many rows, so they are first dealt to tasks by the rows they will make.
    """
    masks = covering_masks(radius)
    keys = [F.xxhash64(F.lit(v * len(masks) + k), F.col(c).bitwiseAND(F.lit(signed(m)))) for v, c in enumerate(VIEWS) for k, m in enumerate(masks)]
    nodes = nodes.repartition(max(1, -(-nodes.count() * len(keys) // TASK_ROWS)), "fp")
    every = F.array(*keys)
    if "prefix" in nodes.columns:
        every = F.concat(every, F.transform("prefix", lambda x: F.xxhash64(F.lit(-1), x)))
    return nodes.select(F.explode(every).alias("h"), "fp")


def _buckets(dealt: DataFrame) -> DataFrame:
    """(gid, fp, n): the members of each bucket of two nodes or more; of buckets with the same members, of one."""
    counts = dealt.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    rows = written(dealt.join(shuffled(written(counts, "bucket-keys")), "h", "left_semi"), "bucket-members")
    told = rows.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor("fp").alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(3))).alias("s"))
    once = written(told.groupBy("n", "x", "s").agg(F.min("h").alias("h")).select("h", "n"), "buckets")
    return rows.join(shuffled(once), "h").select(F.col("h").alias("gid"), "fp", "n")


def _in_blocks(members: DataFrame, block: int, salt: int) -> DataFrame:
    """members with gid of the block that they are dealt to; groups of a block's size at most stay whole."""
    blocks = F.ceil(F.col("n") / block).cast("long")
    own = F.pmod(F.xxhash64("fp", F.lit(salt)), blocks)
    return members.withColumn("gid", F.when(blocks == 1, F.col("gid")).otherwise(F.xxhash64("gid", own, F.lit(salt))))


def _prefixed(large: DataFrame, similarity: float, order: Order) -> DataFrame:
    """(gid, fp, top): members (gid, fp, top, kept) of large buckets, dealt by each hash of the prefix of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gids, fps, tops, kept = (batch.column(k).to_pylist() for k in range(4))
            for gid, fp, top, x in zip(gids, fps, tops, kept, strict=True):
                own = prefix_of(np.frombuffer(x, "<u4"), similarity, order).view(np.uint64)
                subs = mixed(own, gid & 0xFFFFFFFF).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(subs), pa.array([fp] * len(subs), pa.int64()), pa.array([top] * len(subs), pa.int64())], names=["gid", "fp", "top"])

    return large.select("gid", "fp", "top", "kept").transform(map_in_arrow, run, "gid long, fp long, top long")


def _apart(members: DataFrame) -> DataFrame:
    """(gid, fp, top, n) of members (gid, fp, top) in groups of more than one component."""
    told = members.groupBy("gid").agg(F.min("top").alias("low"), F.max("top").alias("high"), F.count("*").alias("n")).where("low <> high").select("gid", "n")
    return members.join(shuffled(told), "gid").select("gid", "fp", "top", "n")


def _pairs_of_blocks(members: DataFrame, block: int) -> DataFrame:
    """members (gid, fp, top, n), once for each pair of blocks of their group that holds theirs."""
    blocks = F.ceil(F.col("n") / block).cast("long")
    own = F.pmod(F.xxhash64("fp", F.lit(9)), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda d: F.xxhash64("gid", F.least(own, d), F.greatest(own, d)))
    return members.select(F.explode(F.when(blocks == 1, F.array("gid")).otherwise(pairs)).alias("gid"), "fp", "top")


def _with_tops(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (…, fp) with top, the component of fp by edges; fp itself if it has none."""
    tops = components(edges).select(F.col("node").alias("fp"), F.col("component").alias("top"))
    return rows.join(shuffled(tops), "fp", "left").withColumn("top", F.coalesce("top", "fp"))


def similar_links(nodes: DataFrame, sets: DataFrame, similarity: float, radius: int = 4, block: int = BLOCK, order: Order = NO_ORDER) -> DataFrame:
    """Edges (a, b) that connect all nodes (fp, views, perhaps prefix) that meet in a bucket and are similar.

    sets (fp, kept) has a row for each node. order is that of prefixes.
    """
    members = written(_buckets(_met(nodes, radius)), "members")
    known = written(members.select("fp").distinct(), "met")
    sets = written(sets.join(shuffled(known), "fp"), "sets")
    alone = members.withColumn("top", F.col("fp"))
    few, many = alone.where(F.col("n") <= AT_ONCE * block), alone.where(F.col("n") > AT_ONCE * block)
    deals = _pairs_of_blocks(few, block)
    for salt in (1, 2):
        deals = deals.union(_in_blocks(many, block, salt).select("gid", "fp", "top"))
    edges = cut(_forests(deals.join(shuffled(sets), "fp"), similarity))
    large = many.select("gid", "fp")
    if large.limit(1).count():
        rest = cut(_apart(_with_tops(large, edges)))
        if rest.limit(1).count():
            parts = _apart(_prefixed(rest.join(shuffled(sets), "fp"), similarity, order))
            edges = cut(edges.union(_forests(_pairs_of_blocks(parts, block).join(shuffled(sets), "fp"), similarity)))
    return edges


def _profiled(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows, edges): docs (…, text) without text and with fp, and the links of fp."""
    rows = written(profiles(docs, width), "profiles")
    order = common_shingles(rows)
    nodes = cut(_with_prefix(rows, similarity, order).groupBy("fp").agg(*[F.first(c).alias(c) for c in (*VIEWS, "prefix")]))
    sets = rows.groupBy("fp").agg(F.first("kept").alias("kept"))
    return rows.drop(*VIEWS, "kept", "short"), similar_links(nodes, sets, similarity, order=order)


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) for every row; links join texts whose sets of shingles are that similar.

    Equal word sequences (texts without a word among them, null ones too) are linked. fp is the hash of the word
    sequence. Rows with a null id link others; a component without an id has a null one. Repeated rows stay repeated;
    an empty table gives an empty result.
    """
    rows, edges = _profiled(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width, similarity)
    return classes(rows, edges).select("doc_id", "fp", "component_id")


def _row_key(docs: DataFrame) -> Column:
    """A hash of a row's columns, but for maps."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of similar documents, all its columns as they were.

    It is the row of the smallest id, rows without an id coming last; of several rows of that id the one of the smallest
    hash of its columns, so a retry chooses the same; of rows alike in all columns one. Texts without a word, null ones
    too, are one component. Ids may repeat: another text of an id is another document.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _row_key(docs).alias("key"))
    rows, edges = _profiled(keyed.select("doc_id", "key", "text"), width, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    best = _with_tops(rows.groupBy("fp").agg(F.min(order).alias("best")), edges)
    winners = written(best.groupBy("top").agg(F.min("best").alias("best")).select("best.doc_id", "best.key"), "winners")
    told = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    won = winners.withColumn("won", F.lit(True))
    judged = told.join(shuffled(won), same(told, won), "left").select(told["doc_id"], told["key"], "n", "won")
    judged = written(judged.where("won is null OR n > 1"), "verdicts")  # rows to drop, and rows that are there more than once
    plain = keyed.join(shuffled(judged), same(keyed, judged), "left_anti").select("row.*")
    twice = judged.where("won")
    if not twice.limit(1).count():
        return plain
    again = keyed.join(shuffled(twice), same(keyed, twice), "left_semi").groupBy("doc_id", "key").agg(F.first("row").alias("row")).select("row.*")
    return plain.union(again)
