"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``WINDOW`` words that overlap by half. Their TF-IDF vectors over the words of the benchmark are
projected on the right singular vectors of a matrix of the benchmark's items and the passages of all documents, cut
without overlap; the randomised SVD begins with the subspace of the items and runs its products with the passages on the
executors. Document frequencies count the same passages. Each passage of each whole text is compared in latent space
with all items of which enough words for a verdict are near it, a condition that loses nothing; these are checked, the
nearest in latent space first, by the longest common subsequence with the item and with its answer, until nothing better
can come (in ``clean``: until one is confirmed). So the cosine says what is checked and no leak is lost by it;
paraphrases that keep the order of most words are found and chance resemblance is not.

The corpus is read twice for each ``ITEM_BLOCK`` items: for the passages, whose known words are kept as numbers in
Parquet until the index is there, and for the search. An index is broadcast; it has some hundred bytes for each word of
its items, and singular vectors of ``BUCKETS`` words at most (words beyond share one by hash). Only for items of fewer
than ``FEW`` words, which need a cosine, can it matter which other items share their block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import keep_rows, map_in_arrow, removed, scratch, table

#: ASCII that isn't a letter or digit parts words; every other character is part of one.
PARTS_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WINDOW = 32
HALF = WINDOW // 2
#: Windows whose surroundings are looked over for words of items at once.
STRETCH = 16
ITEM_BLOCK = 50_000
BUCKETS = 1 << 16
RANK = 64
#: Times that all passages are multiplied with the basis.
ROUNDS = 2
#: Words that a task packs at once, entries of a matrix that it multiplies at once, and rows of the product in a message.
ROOM, ENTRIES, ROWS = 1 << 20, 1 << 15, 64
#: Bytes of texts that are split at once, rows that are gathered at once to be added up, and counts of items kept at once.
BYTES, GATHERED, COUNTS = 1 << 22, 1 << 11, 1 << 20
LCS, ANSWER = 0.7, 0.6
#: Items that a worker keeps unpacked; beyond it forgets all.
UNPACKED = 20_000
#: Candidates of a text that are ranked at once.
RANKED = 50_000
#: Items of fewer words than FEW, which chance alone brings, also need that cosine; of longer ones none is dropped by it.
COSINE, FEW = 0.5, 8
HIT = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("cosine", T.DoubleType()),
    T.StructField("lcs", T.DoubleType()),
    T.StructField("answer", T.DoubleType()),
    T.StructField("first_word", T.IntegerType()),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(PARTS_WORDS).split()


def numbers(words: list[bytes], get: Callable, unknown: int) -> np.ndarray:
    return np.fromiter(map(get, words, repeat(unknown)), dtype=np.int32, count=len(words))


def keys_of(vocabulary: dict[bytes, int]) -> pa.Array:
    """The words of a vocabulary whose numbers are 0, 1, ... in its order."""
    return pa.array([w.decode() for w in vocabulary], pa.string())


def numbered(texts: Iterable[str | None], vocabulary: dict[bytes, int], keys: pa.Array) -> Iterator[np.ndarray]:
    """numbers(words_of(x)) of each text; some BYTES of texts are split and looked up at once."""

    def found(some: list[bytes]) -> Iterator[np.ndarray]:
        ends = np.zeros(len(some) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in some], out=ends[1:])
        whole = pa.StringArray.from_buffers(len(some), pa.py_buffer(ends), pa.py_buffer(b"".join(some).translate(PARTS_WORDS)))
        lists = pc.ascii_split_whitespace(whole)
        words = lists.values
        empty = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)  # where a text begins or ends with a space
        if len(words) < len(keys):  # Arrow makes its hash table of the keys anew each time
            ids = numbers(words.cast(pa.binary()).to_pylist(), vocabulary.get, len(keys))
        else:
            ids = pc.index_in(words, keys).fill_null(len(keys)).to_numpy()
        edges = lists.offsets.to_numpy()
        ids, edges = np.delete(ids, empty), (edges - np.searchsorted(empty, edges)).tolist()
        return (ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))

    some, room = [], BYTES
    for x in texts:
        some.append((x or "").lower().encode())
        room -= len(some[-1])
        if room <= 0:
            yield from found(some)
            some, room = [], BYTES
    if some:
        yield from found(some)


def places(a: tuple[int, ...]) -> dict[int, int]:
    """Where each number occurs, as bits."""
    found: dict[int, int] = {}
    for k, x in enumerate(a):
        found[x] = found.get(x, 0) | 1 << k
    return found


def common_subsequence(at: dict[int, int], n: int, b: list[int]) -> int:
    """Length of the longest common subsequence of b and the n numbers whose places are given, by bits of one integer."""
    row = full = (1 << n) - 1
    for m in map(at.get, b):
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def least_of(distinct: int, words: int) -> int:
    """Of a subsequence of LCS of the words, at most the rest of the words are missing, so many distinct ones are not."""
    return distinct - int((1 - LCS) * words + 1e-9)


class Item:
    """An item of the benchmark; words and answer as numbers of the vocabulary."""

    def __init__(self, item_id: int, words: tuple[int, ...], answer: tuple[int, ...]) -> None:
        self.item_id, self.words, self.answer = item_id, words, answer
        self.at, self.answer_at = places(words), places(answer)
        self.least = least_of(len(self.at), len(words))

    def check(self, ids: list[int], first: int) -> tuple[float, float]:
        """The best shares of the item and of its answer, in order, in a stretch near the window that begins at first."""
        n = len(self.words)
        more = max(0, n - HALF)
        region = ids[max(0, first - more) : first + WINDOW + more]
        if len(self.at.keys() & set(region)) < self.least or common_subsequence(self.at, n, region) < LCS * n:
            return 0.0, 0.0
        width, best = max(n + 2, int(1.3 * n)), (0.0, 0.0)
        for k in range(0, max(1, len(region) - width + max(1, n // 8)), max(1, n // 8)):
            part = region[k : k + width]
            found = common_subsequence(self.at, n, part) / n
            if found >= LCS:
                best = max(best, (found, common_subsequence(self.answer_at, len(self.answer), part) / len(self.answer)))
        return best


class Items:
    """Items as two runs of word numbers, a few bytes a word; one is unpacked when it is looked at."""

    def __init__(self, ids: list[int], words: list[tuple[int, ...]], answers: list[tuple[int, ...]]) -> None:
        self.ids = ids
        self.words, self.ends = self._packed(words)
        self.answers, self.answer_ends = self._packed(answers)
        self._unpacked: dict[int, Item] = {}

    @staticmethod
    def _packed(rows: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([x for r in rows for x in r], dtype=np.int32), np.cumsum([0, *map(len, rows)])

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    def __getitem__(self, k: int) -> Item:
        if not 0 <= k < len(self):
            raise IndexError(k)
        if k not in self._unpacked:
            if len(self._unpacked) >= UNPACKED:
                self._unpacked.clear()
            words, answer = self.words[self.ends[k] : self.ends[k + 1]], self.answers[self.answer_ends[k] : self.answer_ends[k + 1]]
            self._unpacked[k] = Item(self.ids[k], tuple(words.tolist()), tuple(answer.tolist()))
        return self._unpacked[k]


@dataclass(frozen=True)
class Index:
    vocabulary: dict[bytes, int]
    weight: np.ndarray  # (words + 1,): inverse frequencies; the last one, of other words, is zero
    row: np.ndarray  # (words + 1,): the row of projection of each word
    projection: np.ndarray  # (buckets + 1, rank): singular vectors
    latent: np.ndarray  # (items, rank), of length 1
    items: Items

    @cached_property
    def keys(self) -> pa.Array:
        return keys_of(self.vocabulary)

    @cached_property
    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, items): each distinct word of each item, by word."""
        pairs = np.unique(np.repeat(np.arange(len(self.items), dtype=np.int64), self.items.sizes) + self.items.words.astype(np.int64) * max(1, len(self.items)))
        return np.divmod(pairs, max(1, len(self.items)))

    @cached_property
    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, items): the items that hold word w are items[starts[w] : starts[w + 1]]."""
        words, owners = self.held
        return np.searchsorted(words, np.arange(len(self.vocabulary) + 1)), owners

    @cached_property
    def rare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, items, least): postings of the rarest words of each item, and how many of its own each item needs.

        Of its distinct words an item can miss all but ``needed``; so of its rarest ones, that many and half of ``needed``
        more, this half has to be there.
        """
        words, owners = self.held
        distinct = np.bincount(owners, minlength=len(self.items))
        least = (self.needed + 1) // 2
        order = np.lexsort((words, -self.weight[words], owners))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(distinct) - distinct, distinct)
        chosen = rank < (distinct - self.needed + least)[owners]
        return np.searchsorted(words[chosen], np.arange(len(self.vocabulary) + 1)), owners[chosen], least

    @cached_property
    def needed(self) -> np.ndarray:
        distinct = np.bincount(self.postings[1], minlength=len(self.items))
        return np.array([least_of(int(d), int(n)) for d, n in zip(distinct, self.items.sizes, strict=True)])

    @cached_property
    def floor(self) -> np.ndarray:
        return np.where(self.items.sizes < FEW, COSINE, -np.inf)

    @cached_property
    def margin(self) -> int:
        return max(0, int(self.items.sizes.max()) - HALF)

    def present(self, ids: np.ndarray) -> np.ndarray:
        """The items of whose distinct words ids hold enough for a common subsequence of LCS."""
        starts, owners = self.postings
        own = np.unique(ids)
        own = own[own < len(self.vocabulary)]
        sizes = starts[own + 1] - starts[own]
        at = np.arange(sizes.sum()) + np.repeat(starts[own] - (np.cumsum(sizes) - sizes), sizes)
        return np.flatnonzero(np.bincount(owners[at], minlength=len(self.items)) >= self.needed)

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Latent vectors of the windows that begin at 0, HALF, ..., of length 1 (or 0)."""
        halves = np.add.reduceat(self.projection[self.row[ids]] * self.weight[ids][:, None], np.arange(0, len(ids), HALF), axis=0)
        found = halves[:-1] + halves[1:] if len(halves) > 1 else halves
        return found / np.maximum(np.sqrt(np.einsum("ij,ij->i", found, found)), 1e-12)[:, None]

    def near(self, ids: np.ndarray, chosen: np.ndarray | slice = slice(None)) -> Iterator[tuple[int, int, float]]:
        """(window, place in chosen, cosine), of items of FEW words or more whatever the cosine."""
        if len(ids) and len(self.items):
            cosines = self.windows(ids) @ self.latent[chosen].T
            for w, k in np.argwhere(cosines >= self.floor[chosen]).tolist():
                yield w, k, float(cosines[w, k])

    def stretches(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, first window) of the stretches with enough rare words for any item, of texts of those sizes in a row.

        Whatever ``present`` finds is in one of them, and most stretches hold too few of the rare words of any item.
        """
        many = -(-np.maximum(1, -(-sizes // HALF) - 1) // STRETCH)
        text = np.repeat(np.arange(len(sizes)), many)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
        starts, owners, least = self.rare
        if not len(self.items) or least.min() <= 0:  # an item that needs no word may be anywhere
            return text, first
        held = np.append(np.diff(starts), 0)
        at = np.flatnonzero((held > 0)[ids])
        words, begin = ids[at], (np.cumsum(sizes) - sizes)[text]
        lo = np.searchsorted(at, begin + np.maximum(0, first * HALF - self.margin))
        hi = np.searchsorted(at, begin + np.minimum(sizes[text], (first + STRETCH + 1) * HALF + self.margin))
        sums = np.append(0, np.cumsum(held[words]))
        cost = np.cumsum(sums[hi] - sums[lo] + len(self.items))
        found, k = [], 0
        while k < len(text):
            end = max(k + 1, int(np.searchsorted(cost, (cost[k - 1] if k else 0) + COUNTS, "right")))
            n = hi[k:end] - lo[k:end]
            own = words[np.arange(n.sum()) + np.repeat(lo[k:end] - (np.cumsum(n) - n), n)]
            which, own = np.divmod(np.unique(np.repeat(np.arange(end - k), n) * len(held) + own), len(held))
            more = held[own]
            items = owners[np.arange(more.sum()) + np.repeat(starts[own] - (np.cumsum(more) - more), more)]
            counts = np.bincount(np.repeat(which, more) * len(self.items) + items, minlength=(end - k) * len(self.items))
            found.append(k + np.flatnonzero((counts.reshape(end - k, -1) >= least).any(axis=1)))
            k = end
        chosen = np.concatenate([*found, np.zeros(0, np.int64)])
        return text[chosen], first[chosen]

    def candidates(self, ids: np.ndarray, firsts: list[int] | None = None) -> Iterator[tuple[int, int, float]]:
        """(window, item, cosine) of the items whose words are there; firsts are the stretches of ids, if known."""
        if firsts is None:
            firsts = self.stretches(ids, np.array([len(ids)]))[1].tolist()
        for first in firsts:
            a, b = first * HALF, (first + STRETCH + 1) * HALF
            chosen = self.present(ids[max(0, a - self.margin) : b + self.margin])
            if len(chosen):
                for w, k, cosine in self.near(ids[a:b], chosen):
                    yield first + w, int(chosen[k]), cosine

    def ranked(self, ids: np.ndarray, firsts: list[int]) -> Iterator[tuple[int, int, float]]:
        """The candidates, the nearest first; of a text with more than RANKED so for that many at a time."""
        rest = self.candidates(ids, firsts)
        while some := list(islice(rest, RANKED)):
            yield from sorted(some, key=lambda c: -c[2])

    def searched(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """The word numbers of each text, and its stretches that may hold an item; some ROOM words at once."""

        def found(some: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[int]]]:
            sizes = np.array([len(x) for x in some])
            text, first = self.stretches(np.concatenate(some) if len(some) > 1 else some[0], sizes)
            edges = np.searchsorted(text, np.arange(len(some) + 1)).tolist()
            return ((x, first[a:b].tolist()) for x, a, b in zip(some, edges[:-1], edges[1:], strict=True))

        some, room = [], ROOM
        for ids in numbered(texts, self.vocabulary, self.keys):
            some.append(ids)
            room -= len(ids)
            if room <= 0:
                yield from found(some)
                some, room = [], ROOM
        if some:
            yield from found(some)

    def accepted(self, ids: np.ndarray, firsts: list[int]) -> Iterator[tuple[int, tuple]]:
        """(item_id, (lcs, answer, cosine, first_word)) of what the checks accept, the nearest first.

        Once an item is there word for word, places that are less near can't be better and aren't checked.
        """
        if not firsts:
            return
        own, whole = ids.tolist(), {}
        for w, k, cosine in self.ranked(ids, firsts):
            item = self.items[k]
            if whole.get(item.item_id, -2.0) > cosine:
                continue
            lcs, answer = item.check(own, w * HALF)
            if lcs >= LCS and answer >= ANSWER:
                yield item.item_id, (lcs, answer, cosine, w * HALF)
                if lcs >= 1 and answer >= 1:
                    whole[item.item_id] = max(cosine, whole.get(item.item_id, cosine))

    def verdicts(self, texts: Iterable[str | None]) -> Iterator[bool]:
        """Whether each text gives any item away; the search of a text ends at the first that it does."""
        return (next(self.accepted(*x), None) is not None for x in self.searched(texts))

    def gives_away(self, text: str | None) -> bool:
        return next(self.verdicts([text]))

    def all_hits(self, texts: Iterable[str | None]) -> Iterator[list[tuple]]:
        """(item_id, cosine, lcs, answer, first_word) of each item that each text gives away, the best place of each."""
        for ids, firsts in self.searched(texts):
            best: dict[int, tuple] = {}
            for item_id, place in self.accepted(ids, firsts):
                best[item_id] = max(best.get(item_id, ()), place)
            yield [(item_id, cosine, lcs, answer, first) for item_id, (lcs, answer, cosine, first) in sorted(best.items(), key=str)]

    def hits(self, text: str | None) -> list[tuple]:
        return next(self.all_hits([text]))


Matrix = tuple[np.ndarray, np.ndarray, np.ndarray]
PACKED = "at binary, counts binary, sizes binary, passages long"


def packed(parts: list[np.ndarray], rows: list[np.ndarray], size: int, kind: type = np.int32) -> Matrix:
    """(words, their counts, how many of them each row has): the distinct known words of each row, of word numbers and their rows."""
    ids, row = np.concatenate([*parts, np.zeros(0, np.int32)]), np.concatenate([*rows, np.zeros(0, np.int64)])
    known = ids < size
    keys, counts = np.unique(row[known] * size + ids[known], return_counts=True)
    owner, at = np.divmod(keys, size)
    sizes = np.bincount(owner)
    return at.astype(np.int32), counts.astype(kind), sizes[sizes > 0].astype(np.int32)


def packed_passages(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text") -> DataFrame:
    """The passages (runs of WINDOW words) of all texts as rows of packed matrices, and the number of all of them."""
    size = len(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = keys_of(shared.value)

        def made(parts: list[np.ndarray], rows: list[np.ndarray], n: int) -> pa.RecordBatch:
            arrays = [pa.array([x.tobytes()], pa.binary()) for x in packed(parts, rows, size, np.uint8)]  # WINDOW is below 256
            return pa.RecordBatch.from_arrays([*arrays, pa.array([n], pa.int64())], names=["at", "counts", "sizes", "passages"])

        parts, rows, n, room = [], [], 0, ROOM
        for batch in batches:
            for ids in numbered((x.as_py() for x in batch.column(0)), shared.value, keys):
                for k in range(0, len(ids), ROOM):  # ROOM is a multiple of WINDOW
                    parts.append(ids[k : k + ROOM])
                    rows.append(n + np.arange(len(parts[-1])) // WINDOW)
                    n, room = int(rows[-1][-1]) + 1, room - len(parts[-1])
                    if room <= 0:
                        yield made(parts, rows, n)
                        parts, rows, n, room = [], [], 0, ROOM
        if n:
            yield made(parts, rows, n)

    return docs.select(text).transform(map_in_arrow, run, PACKED)


def unpacked(batch: pa.RecordBatch) -> Iterator[Matrix]:
    for at, counts, sizes in zip(*(batch.column(k) for k in range(3)), strict=True):
        yield np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.uint8), np.frombuffer(sizes.as_buffer(), np.int32)


def passage_frequencies(passages: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages each word occurs, and the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            seen[size] += sum(batch.column(3).to_pylist())
            for at, _, _ in unpacked(batch):
                seen[:size] += np.bincount(at, minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["word", "n"])

    rows = passages.transform(map_in_arrow, run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(size + 1, dtype=np.int64)
    found[rows["word"].to_numpy()] = rows["n"].to_numpy()
    return found[:size], int(found[size])


def run_sums(rows: np.ndarray, at: np.ndarray, v: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of v * rows[at] over each run of entries, of which starts[k] is the first and sizes[k] the number.

    Runs of the same size are multiplied together, some GATHERED rows at once, so that these stay in a core's cache.
    """
    out = np.empty((len(sizes), rows.shape[1]), dtype=np.float32)
    order = np.argsort(sizes, kind="stable")
    edges = [*np.flatnonzero(np.diff(sizes[order], prepend=-1)).tolist(), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        n = int(sizes[order[a]])
        step = max(1, GATHERED // n)
        for k in range(a, b, step):
            own = order[k : min(k + step, b)]
            cells = starts[own][:, None] + np.arange(n)
            out[own] = np.matmul(v[cells][:, None, :], rows.take(at[cells], axis=0))[:, 0]
    return out


def product(matrix: Matrix, idf: np.ndarray, bucket: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """Adds to out the Gram matrix of the unit TF-IDF vectors of the rows, times basis; some ENTRIES at once."""
    words, counts, sizes = matrix
    ends = np.cumsum(sizes, dtype=np.int64)
    first, begin = 0, 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, begin + ENTRIES, "right")))
        at, n, end = words[begin : ends[last - 1]], sizes[first:last], int(ends[last - 1])
        starts = ends[first:last] - n - begin
        v = (counts[begin:end] * idf[at]).astype(np.float32)
        v /= np.repeat(np.sqrt(np.add.reduceat(v * v, starts)), n)
        at = bucket[at]
        inner = run_sums(basis, at, v, starts, n)
        order = np.argsort(at.astype(np.min_scalar_type(len(out))), kind="stable")
        own, edges, runs = np.unique(at[order], return_index=True, return_counts=True)
        out[own] += run_sums(inner, np.repeat(np.arange(len(n)), n)[order], v[order], edges, runs)
        first, begin = last, end


def gram_times(passages: DataFrame, idf: np.ndarray, bucket: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The Gram matrix of all passages, times basis: a sum of one product a partition, made on the executors in parts."""
    context = passages.sparkSession.sparkContext
    shared = context.broadcast((idf, bucket, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, there = np.zeros(shared.value[2].shape), False
        for batch in batches:
            for matrix in unpacked(batch):
                product(matrix, *shared.value, out)
                there = True
        blocks = [out[k : k + ROWS].tobytes() for k in range(0, len(out), ROWS)] if there else []
        for k, x in enumerate(blocks):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x], pa.binary())], names=["k", "block"])

    def total(group: pa.Table) -> pa.Table:
        blocks = sorted(group["block"].to_pylist())  # sums don't depend on the order of arrival
        out = sum(np.frombuffer(x) for x in blocks)
        return pa.table({"k": group["k"][:1], "block": pa.array([out.tobytes()], pa.binary())})

    parts = passages.transform(map_in_arrow, run, "k int, block binary").groupBy("k").applyInArrow(total, "k int, block binary").toArrow()
    out = np.zeros(basis.shape)
    for k, x in zip(parts["k"].to_pylist(), parts["block"].to_pylist(), strict=True):
        out[k * ROWS : (k + 1) * ROWS] = np.frombuffer(x).reshape(-1, basis.shape[1])
    shared.destroy()
    return out


def singular_vectors(passages: DataFrame, there: int, items: list[np.ndarray], idf: np.ndarray, bucket: np.ndarray, rank: int, rounds: int = ROUNDS) -> np.ndarray:
    """(buckets, rank): right singular vectors of the unit TF-IDF vectors of all passages, ``there`` of them, and items.

    Subspace iteration: each round multiplies a basis by the Gram matrix; the first basis is that of the items alone.
    Items count as much in sum as the passages do, or else the corpus' common words would crowd theirs out.
    """
    size = int(bucket.max()) + 1
    own = packed(items, [np.full(len(x), k) for k, x in enumerate(items)], len(idf))
    basis = np.linalg.qr(np.random.default_rng(9).standard_normal((size, min(size, rank + 16))))[0].astype(np.float32)
    for k in range(2 + rounds):
        gram = np.zeros(basis.shape)
        product(own, idf, bucket, basis, gram)
        if k >= 2:
            gram = gram * max(1.0, there / max(1, len(items))) + gram_times(passages, idf, bucket, basis)
        else:  # some of the random basis is kept, for directions that no item has
            gram += 1e-3 * basis
        basis = np.linalg.svd(gram, full_matrices=False)[0].astype(np.float32)
    return basis[:, :rank]


def build(docs: DataFrame, items: list[tuple], rank: int = RANK) -> Index | None:
    """An index of items (item_id, text, answer or None); None if no item has a word."""
    split = [(item_id, words_of(text), words_of(answer)) for item_id, text, answer in items]
    split = [x for x in split if x[1]]
    if not split:
        return None
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws, answer in split for w in [*ws, *answer]}))}
    number = lambda ws: tuple(vocabulary[w] for w in ws)
    answers = [number(answer or ws[-max(3, len(ws) // 4) :]) for _, ws, answer in split]
    made = Items([item_id for item_id, _, _ in split], [number(ws) for _, ws, _ in split], answers)
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "passages")
    packed_passages(docs, vocabulary).write.option("compression", "zstd").parquet(path)
    passages = spark.read.schema(PACKED).parquet(path)
    seen, there = passage_frequencies(passages, len(vocabulary))
    idf = (np.log((1 + there) / (1 + seen)) + 0.1).astype(np.float32)
    if len(vocabulary) <= BUCKETS:
        bucket = np.arange(len(vocabulary))
    else:
        bucket = np.array([xxhash.xxh64_intdigest(w, 5) % BUCKETS for w in vocabulary])
    rows = np.split(made.words, made.ends[1:-1])
    vectors = singular_vectors(passages, there, rows, idf, bucket, rank)
    removed(spark, path)
    projection = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    row, weight = np.append(bucket, len(vectors)).astype(np.int32), np.append(idf, np.float32(0))
    latent = np.array([weight[ids] @ projection[row[ids]] for ids in rows])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Index(vocabulary, weight, row, projection, latent.astype(np.float32), made)


def annotate(docs: DataFrame, index: Index, text: str = "text", out: str = "leaks") -> DataFrame:
    """docs without the text and an array of what each whole text gives away; a null text gives away nothing."""
    kept = [c for c in docs.columns if c not in (text, out)]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.ArrayType(HIT), False)])
    shared = docs.sparkSession.sparkContext.broadcast(index)  # ITEM_BLOCK items at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = shared.value, HIT.names
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("first_word", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(names, h, strict=True)) for h in hits] for hits in own.all_hits(x.as_py() for x in batch.column(batch.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(found, kind)], names=[*kept, out])

    return docs.select(*kept, text).transform(map_in_arrow, run, schema)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items, ITEM_BLOCK at a time, each with its answer if the table has one."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select("item_id", "text", answer.alias("answer")).distinct()
    many = -(-rows.count() // ITEM_BLOCK)
    for k in range(many):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k) if many > 1 else rows
        found = sorted((tuple(r) for r in part.toLocalIterator()), key=str)
        for j in range(0, len(found), ITEM_BLOCK):
            yield found[j : j + ITEM_BLOCK]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, first_word): a row for each item that each row of docs gives away.

    Items without a word are never found. Empty tables give an empty result. Repeated rows of docs give repeated rows.
    """
    found = docs.sparkSession.createDataFrame([], T.StructType([docs.schema["doc_id"], *HIT.fields]))
    for items in blocks(benchmark):
        if index := build(docs.select("doc_id", "text"), items):
            more = annotate(docs.select("doc_id", "text"), index).select("doc_id", "leaks")
            found = found.union(more.select("doc_id", F.inline("leaks")))
    return found


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, first_word and contaminated (true): a row for each document and item that it gives away.

    Null and empty texts give nothing away, items without a word are never found. Repeated rows of documents give
    repeated rows, repeated items count once; rows without an id are searched too; of equally good places of an item the
    last holds. Empty tables give an empty result; other columns are not read, but for an answer of benchmark.
    """
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("contaminated", F.lit(True))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that give nothing away, with the columns of docs."""
    rest = docs
    for items in blocks(benchmark):
        if index := build(docs.select("doc_id", "text"), items):
            shared = docs.sparkSession.sparkContext.broadcast(index)
            rest = keep_rows(rest, "text", lambda shared=shared: lambda texts: [not x for x in shared.value.verdicts(texts)])
    return rest
