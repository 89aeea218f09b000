import random

import numpy as np

from tests.llm.test_simhash import BREAK, brute_components
from tidemark.llm import similar
from tidemark.llm.components import components


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def likeness(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def groups(of):
    return {frozenset(k for k, t in enumerate(of) if t == u) for u in set(of)}


def test_similar_documents_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(900)] + ["the", "of", "and"] * 40
    texts = [" ".join(rng.choices(words, k=rng.randint(60, 500))) for _ in range(60)]
    for k in range(200):
        w = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.choice([0, 1, len(w) // 100, len(w) // 50, len(w) // 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(rng.choice(BREAK).join(w))
    texts += [None, "", "  ", "a b", "A b", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    sets = [shingles(t) for t in texts]
    # sets are compared exactly, so nothing below the bound is joined; what meets in no table may be missed near it
    exact = brute_components(sets, lambda a, b: likeness(a, b) >= 0.8)
    sure = brute_components(sets, lambda a, b: likeness(a, b) >= 0.85)
    assert all(exact[k] == exact[t] for k, t in got.items()) and all(got[k] == got[t] for k, t in enumerate(sure))
    assert len(set(sure)) > 60 and len(set(exact)) < len(texts) - 100


def test_recall_by_band_of_similarity(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 7))) for _ in range(4000)]
    texts, bands = [], []
    for band in (0.80, 0.85, 0.90, 0.95):
        while sum(b == band for b in bands) < 60:
            own = rng.choices(words, k=rng.randint(120, 600))
            other = list(own)
            for _ in range(max(1, int(len(own) * (1 - band) / 11 * rng.uniform(0.8, 1.5)))):
                other[rng.randrange(len(other))] = rng.choice(words)
            s = likeness(shingles(" ".join(own)), shingles(" ".join(other)))
            if band <= s < band + 0.05:
                texts += [" ".join(own), " ".join(other)]
                bands.append(band)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    recall = {b: np.mean([got[2 * k] == got[2 * k + 1] for k, x in enumerate(bands) if x == b]) for b in set(bands)}
    assert recall[0.80] >= 0.9 and min(recall[b] for b in (0.85, 0.90, 0.95)) >= 0.97, recall


def test_links_in_a_bucket_of_texts_with_the_same_words(spark):
    # copies of a text with a part moved, among shuffles of its words: all in every table of one bucket
    rng, texts = random.Random(3), []
    for g in range(12):
        own = [f"w{g}x{k}" for k in range(300)]
        moved = own[:100] + own[110:200] + own[100:110] + own[200:]
        texts += [" ".join(own), " ".join(moved)] + [" ".join(rng.sample(own, len(own))) for _ in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    assert sum(got[17 * g] == got[17 * g + 1] for g in range(12)) == 12
    assert len(set(got.values())) == 12 * 16


def nodes_of(spark, sets, views):
    names = list(range(len(sets)))
    nodes = spark.createDataFrame([(k, *v) for k, v in zip(names, views, strict=True)], "fp long, v0 long, v1 long, v2 long")
    kept = spark.createDataFrame([(k, bytearray(np.array(sorted(s), "<u4").tobytes())) for k, s in zip(names, sets, strict=True)], "fp long, kept binary")
    return nodes, kept


def test_links_equal_all_pairs_of_a_bucket_in_blocks(spark):
    rng = np.random.default_rng(8)
    base = [set(rng.integers(0, 2**32, 60).tolist()) for _ in range(9)]
    sets = []
    for _ in range(150):
        own = list(base[rng.integers(9)])
        gone = int(rng.integers(0, 10))
        sets.append(set(own[gone:]) | set(rng.integers(0, 2**32, gone).tolist()))
    views = [[1 << int(rng.integers(0, 62)) for _ in range(3)] for _ in sets]
    want = groups(brute_components(sets, lambda a, b: likeness(a, b) >= 0.8))
    nodes, kept = nodes_of(spark, sets, views)
    for block in (16, 40, 1024):  # ten blocks, four, one
        found = {r.node: r.component for r in components(similar.similar_links(nodes, kept, 0.8, block=block)).collect()}
        assert groups([found.get(k, k) for k in range(150)]) == want


def test_accepted_forests_and_similarities_from_the_least_hashes():
    rng = np.random.default_rng(5)
    for most in (40, 10_000):
        for _ in range(20):
            base = [rng.choice(10**6, 120, replace=False) for _ in range(3)]
            sets = []
            for _ in range(30):
                own = base[rng.integers(3)].copy()
                n = int(rng.integers(0, 20))
                own[:n] = rng.integers(10**6, 2 * 10**6, n)
                sets.append(np.unique(own)[:most].astype("<u4"))
            like = lambda a, b: similar.similarity_of(sets[a], sets[b], most) >= 0.8 - 1e-9  # noqa: E731, B023
            edges = {frozenset(e) for e in similar.accepted_forest(np.arange(30), np.arange(30), sets, 0.8, most)}
            got = brute_components(range(30), lambda a, b: frozenset((a, b)) in edges)  # noqa: B023
            assert groups(got) == groups(brute_components(range(30), like)) and len(edges) <= 29
    a, b = np.arange(0, 5000, dtype="<u4"), np.arange(500, 5500, dtype="<u4")
    scatter = lambda x: np.sort((x.astype(np.uint64) * np.uint64(2654435761)) % np.uint64(2**32))[:1024].astype("<u4")
    assert abs(similar.similarity_of(scatter(a), scatter(b)) - 4500 / 5500) < 0.04


def test_short_texts_with_a_word_more_are_joined(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(5000)]
    texts = []
    for n in (10, 12, 15, 20, 25, 30):
        for _ in range(40):
            own = rng.sample(words, n)
            texts += [" ".join(own), " ".join([*own, "extra" + rng.choice(words)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    assert all(got[k] == got[k + 1] == k for k in range(0, len(texts), 2))


def test_prefixes_of_similar_sets_share_a_hash():
    rng = np.random.default_rng(12)
    for n in (1, 2, 5, 6, 10, 11, 40, 333):
        for _ in range(50):
            a = np.unique(rng.integers(0, 2**32, n, dtype=np.uint64))
            gone, more = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate([a[rng.permutation(n)[gone:]], rng.integers(0, 2**32, more, dtype=np.uint64)]))
            if n - gone >= 0.8 * (n + more):
                assert set(similar.prefix_of(a, 0.8).tolist()) & set(similar.prefix_of(b, 0.8).tolist())


def kept_rows(spark, rows, schema="doc_id long, text string, lang string"):
    got = similar.first_of_each(spark.createDataFrame(rows, schema))
    return sorted((tuple(r) for r in got.collect()), key=str), got.columns


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(4, text, "a"), (2, text + " more", "b"), (9, "something else", None), (9, "something else", None)]
    assert kept_rows(spark, rows) == ([(2, text + " more", "b"), (9, "something else", None)], ["doc_id", "text", "lang"])


def test_rows_are_chosen_and_not_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    got, _ = kept_rows(spark, [(3, a, None), (5, a, None), (5, b, None), (9, b, None)])
    assert got == [(3, a, None), (5, b, None)]
    got, _ = kept_rows(spark, [(None, a, "x"), (None, b, "y"), (7, b, "z"), (None, a, "x")])
    assert got == [(7, b, "z"), (None, a, "x")]
    got, _ = kept_rows(spark, [(1, a, "x"), (1, a, "y"), (2, None, None), (3, "", None), (None, None, None)])
    assert len(got) == 2 and got[0][:2] == (1, a) and got[1] == (2, None, None)
    got, names = kept_rows(spark, [(1, a, 1, 2, 3), (2, a + " q", 4, 5, 6)], "doc_id long, text string, key long, fp long, `a.row` long")
    assert got == [(1, a, 1, 2, 3)] and names == ["doc_id", "text", "key", "fp", "a.row"]
    assert kept_rows(spark, [])[0] == []


def test_prefixes_by_any_order_lose_no_similar_pair_of_whole_or_cut_sets():
    rng = np.random.default_rng(2)
    met = {True: 0, False: 0}
    for most in (40, 10_000):
        for _ in range(400):
            base = np.unique(rng.integers(0, 4000, int(rng.integers(1, 90))))
            common = np.unique(rng.choice(base, len(base) // 2))
            order = (common.astype("<u4"), rng.integers(3, 9, len(common)))
            a, b = (np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, 4)) :], rng.integers(0, 4000, int(rng.integers(0, 3)))]))[:most].astype("<u4") for _ in range(2))
            if similar.similarity_of(a, b, most) >= 0.8:
                met[len(a) == most] += 1
                assert set(similar.prefix_of(a, 0.8, order, most).tolist()) & set(similar.prefix_of(b, 0.8, order, most).tolist())
    assert min(met.values()) > 50


def test_a_passage_of_many_short_texts_brings_no_bucket_of_all(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    texts += [t + " more" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = similar.profiles(docs, 5)
    order = similar.common_shingles(rows)
    assert len(order[0]) >= 26 and max(order[1]) == 320
    nodes = similar._with_prefix(rows, 0.8, order)
    largest = lambda found: max(r["count"] for r in found.selectExpr("explode(prefix) AS h").groupBy("h").count().collect())
    assert largest(nodes) < 10 < 250 < largest(similar._with_prefix(rows, 0.8, similar.NO_ORDER))
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    assert all(got[300 + k] == got[k] == k for k in range(20)) and len(set(got.values())) == 300
