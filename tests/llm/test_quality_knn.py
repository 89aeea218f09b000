import math
import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.test_features import brute_grams, brute_points
from tidemark.llm import quality_knn as qk

WORDS = [a + b + c for a in "bdfgl" for b in "aeiou" for c in ("", "n", "r", "st")]


def clean(rng):
    return ". ".join(" ".join(rng.choices(WORDS, k=rng.randint(5, 12))).capitalize() for _ in range(rng.randint(2, 12))) + "."


def junk(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return clean(rng).upper().replace(" ", "!! ")
    if kind == 1:
        return clean(rng).replace(" ", "### ")
    return " ".join(w for _ in range(6) for w in [rng.choice(WORDS)] * 15)


def test_scores_tell_held_out_junk_from_clean_texts(spark):
    rng = random.Random(1)
    rows = [(k, junk(rng) if k % 5 == 0 else clean(rng)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 5 == 0 else 1) for k in range(250)] + [(None, 1), (3, None), (4, 1), (4, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in qk.score(docs, qk.fit(docs, labels)).collect()}
    held = range(250, 400)
    assert sum((got[k] >= 0.3) == (k % 5 > 0) for k in held) / len(held) > 0.95


def test_nulls_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (None, "", None), (3, "a b " * 40_000, 1.0), (3, "x", 2.0), (3, "x", 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = qk.score(docs, qk.fit(docs, none)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    one = qk.fit(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in qk.score(docs, one).collect())
    assert qk.score(docs.limit(0), qk.fit(docs.limit(0), none)).count() == 0


def test_repeats_equal_a_count():
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choices("ab é\n\t", k=rng.randint(0, 60)))
        words = text.split()
        assert qk.repeats(qk.codes(text)) == (len(words), len(words) - len(set(words)), sum(a == b for a, b in zip(words, words[1:])))


def test_singular_vectors_and_votes_equal_the_exact_ones():
    rng = np.random.default_rng(4)
    a = (rng.standard_normal((300, 6)) * [9, 7, 5, 4, 3, 2]) @ rng.standard_normal((6, 50))
    at = [np.arange(50, dtype=np.int32)] * 300
    basis = qk.singular_vectors(at, list(a.astype(np.float32)), 50, 4)
    exact = np.linalg.svd(a)[2][:4].T
    assert np.linalg.norm(exact @ exact.T - basis @ basis.T) < 0.05
    vectors = rng.standard_normal((500, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 500).astype(float)
    model = qk.Model(basis, None, vectors, labels, 0.5, 7)
    got = model.vote(vectors[:40] + np.float32(0.01))
    for row, score in zip(vectors[:40] + np.float32(0.01), got, strict=True):
        cosines = vectors @ row
        near = np.argsort(-cosines)[:7]
        w = np.maximum(cosines[near], 0) ** 4 + 1e-9
        assert abs(score - (w * labels[near]).sum() / w.sum()) < 1e-5


def brute_terms(text):
    """Buckets of the three families, from the definition."""
    points = brute_points(text)
    found = Counter(brute_grams(points, range(1, 3), qk.BITS))
    kind = []
    for p in points:
        c = chr(p)
        k = 32 if p == 32 else ord("0") if c.isdigit() else (ord("A") if c.isupper() else ord("a")) if c.isalpha() else p
        if not kind or kind[-1] != k:
            kind.append(k)
    found += Counter(b + (1 << qk.BITS) for b in brute_grams(kind, range(1, 4), qk.BITS, 99))
    words = "".join(map(chr, points)).split(" ")
    words = [w for w in words if w]
    again, same = len(words) - len(set(words)), sum(a == b for a, b in zip(words, words[1:]))
    n = max(1, len(words))
    return found + Counter([(2 << qk.BITS) + min(7, 8 * again // n), (2 << qk.BITS) + 8 + min(7, 8 * same // n)])


def test_terms_and_weights_equal_loops():
    rng = random.Random(5)
    for t in ["", "A a", *("".join(rng.choices("ab Éé\n#7漢", k=rng.randint(0, 80))) for _ in range(60))]:
        at, counts = qk.sparse(qk.ids(t), qk.SIZE)
        want = brute_terms(t)
        assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == dict(want)
        idf = np.arange(qk.SIZE, dtype=np.float32) % 7 + 1
        got = dict(zip(at.tolist(), qk.weigh(at, counts, idf).tolist(), strict=True))
        for low, high, share in ((0, 1 << qk.BITS, 0.3), (1 << qk.BITS, 2 << qk.BITS, 0.6), (2 << qk.BITS, qk.SIZE, 0.6)):
            v = {b: (1 + math.log(n)) * float(idf[b]) for b, n in want.items() if low <= b < high}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            assert all(abs(got[b] - share * x / norm) < 1e-5 for b, x in v.items())


def test_the_query_over_a_folder(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, junk(rng) if k % 5 == 0 else clean(rng), 1.0, "x") for k in range(300)] + [(None, "no id here", None, None), (400, None, None, None), (401, "", None, None), (7, "again", None, None), (402, "long text. " * 60_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(300)] + [(None, 1), (9, None)], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = qk.op9_quality_knn(spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and dict(found.dtypes)["predicted"] == "int"
    got = found.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    assert len(got) == len(rows) and all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) for r in got)
    # every vote against the definition: the nearest by exact cosines of the model's vectors, weighted by cosine
    model = qk.fit(docs, labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0"))
    want = []
    for d, t, *_ in rows:
        v = model.latent(t)
        cosines = sorted(((float(v @ x), y) for x, y in zip(model.vectors, model.labels, strict=True)), key=lambda p: -p[0])[: model.neighbours]
        weights = [max(c, 0) ** 4 + 1e-9 for c, _ in cosines]
        want.append((str(d), sum(w * y for w, (_, y) in zip(weights, cosines, strict=True)) / sum(weights)))
    for g, w in zip(sorted((str(r.doc_id), r.score) for r in got), sorted(want), strict=True):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 2e-3, (g, w)
    out = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(out) > 30 and np.mean([r.predicted == (r.doc_id % 5 > 0) for r in out]) > 0.9
