import random
import re

import numpy as np
import xxhash

from tidemark.llm import toxicity as tx

WORDS = [a + b + c for a in "bdfglm" for b in "aeiou" for c in ("n", "r", "st", "nde")]
BAD = ["zgrubel", "zgrubota", "kwatsch", "plompf"]


def text(rng, bad):
    words = rng.choices(WORDS, k=rng.randint(20, 200))
    for k in range(len(words)):
        if bad and rng.random() < 0.04 or bad and k == 3:
            words[k] = rng.choice(BAD)
    return " ".join(words).capitalize() + "."


def test_held_out_toxic_documents_are_caught_and_clean_ones_left(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, k % 6 == 0)) for k in range(700)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, toxic string, severity double")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(500)] + [(None, 1), (2, None), (6, 1), (6, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.score(docs, tx.fit(docs.select("doc_id", "text"), labels)).collect()}
    assert all(0 <= r.severity <= 2 and 0 <= r.p_toxic <= 1 for r in got.values())
    held = range(500, 700)
    assert not any(got[k].toxic for k in held if k % 6)
    assert sum(got[k].toxic for k in held if k % 6 == 0) >= 0.9 * sum(k % 6 == 0 for k in held)
    assert tx.kept(docs, labels).columns == ["doc_id", "text", "toxic", "severity"]


def test_nulls_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "bad"), (3, "ban " * 60_000), (3, "x"), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = tx.score(docs, tx.fit(docs, none)).collect()
    assert len(got) == 6 and not any(r.toxic for r in got) and all(r.severity < 1e-6 for r in got)
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), none)).count() == 0
    one = tx.fit(docs, spark.createDataFrame([(3, 0)], "doc_id long, toxic int"))
    assert not any(r.toxic for r in tx.score(docs, one).collect())


def test_shared_weights_order_three_grades():
    rng = np.random.default_rng(2)
    rows, grades = [], []
    for _ in range(600):
        level = rng.integers(0, 3)
        rows.append((np.array([0, 1 + rng.integers(0, 20)]), np.array([level + rng.normal(0, 0.3), rng.integers(0, 2)], dtype=np.float32)))
        grades.append(level)
    w, theta = tx.cumulative_link(rows, np.array(grades), 21, 2)
    p = tx.grade_probabilities(np.array([0.0, 1.0, 2.0]) * w[0], theta)
    assert w[0] > 0 and theta[0] < theta[1] and p.argmax(axis=1).tolist() == [0, 1, 2]
    assert np.allclose(p.sum(axis=1), 1) and (np.diff(p @ np.arange(3)) > 0).all()


def test_a_grade_column_is_fitted_as_given(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(WORDS, k=40) + ["kwatsch"] * (6 * (k % 3)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3) for k in range(300)], "doc_id long, grade int")
    got = tx.score(docs, tx.fit(docs, labels, grade="grade")).collect()
    means = [np.mean([r.severity for r in got if r.doc_id % 3 == g]) for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]


def plain_loss(w, theta, x, grades, l1, l2):
    eta = x @ w
    edges = np.concatenate([np.zeros((len(eta), 1)), 1 / (1 + np.exp(-(theta[None, :] - eta[:, None]))), np.ones((len(eta), 1))], axis=1)
    p = np.diff(edges, axis=1)[np.arange(len(eta)), grades]
    return -np.log(np.maximum(p, 1e-12)).mean() + l2 / 2 * (w @ w) + l1 * np.abs(w).sum()


def test_weights_reach_the_loss_of_a_plain_optimiser():
    rng = np.random.default_rng(2)
    x = (rng.random((300, 12)) < 0.3) * rng.random((300, 12))
    grades = np.clip(np.round(x[:, 0] * 3 - x[:, 1] + 0.3 * rng.standard_normal(300)), 0, 2).astype(int)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    w, theta = tx.cumulative_link(rows, grades, 12, 2, l1=0.002, l2=1e-4, steps=1500)
    # the penalties hold for weights of features of one mean square
    squares = (x * x).mean(axis=0)
    scale = 1 / np.sqrt(squares + 1e-4 * squares.max() + 1e-12)
    ours = plain_loss(w / scale, theta, x * scale, grades, 0.002, 1e-4)
    best, own, at = np.inf, np.zeros(12), np.array([0.0, 2.0])
    for k in range(6000):  # coordinate search with shrinking steps
        step = 0.5 * 0.999**k
        j = k % 14
        for sign in (1, -1):
            new_w, new_at = own.copy(), at.copy()
            if j < 12:
                new_w[j] += sign * step
            else:
                new_at[j - 12] += sign * step
            if new_at[0] <= new_at[1] and (loss := plain_loss(new_w, new_at, x * scale, grades, 0.002, 1e-4)) < best:
                best, own, at = loss, new_w, new_at
    assert ours <= best + 0.002, (ours, best)


def brute_scores(model, text):
    """Severity and the probability of any grade, from the definition: a weight for each word and beginning, at its rate."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    eta = 0.0
    for word in words:
        features = [(word, 1)] + [(word[:n], n) for n in (4, 5, 6) if len(word) > n]
        eta += sum(model.weights.get(xxhash.xxh64_intdigest(f.encode(), seed) >> 1, 0.0) for f, seed in features)
    eta *= 20 / (len(words) + 20)
    above = [1 - 1 / (1 + np.exp(-(t - eta))) for t in model.thresholds]
    return sum(above), above[0]


def test_the_query_equals_brute_force_over_a_folder(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for k in range(300):
        own = rng.choices(words, k=rng.randint(5, 80))
        if k % 4 == 0:
            own[::6] = rng.choices(BAD, k=len(own[::6]))
        docs.append((k, " ".join(own), "x", 1.0))
        labels.append((k, k % 4 == 0))
    docs += [(None, "no id", None, None), (400, None, None, None), (401, "", None, None), (5, docs[5][1], None, None), (402, "Ab1cd_ef " * 100_000, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, toxic string, severity double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(t)) for k, t in labels] + [(None, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = tx.op2_toxicity(spark, str(tmp_path))
    assert found.columns == ["doc_id", "severity", "p_toxic", "toxic"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    model = tx.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = sorted(((d, *brute_scores(model, t)) for d, t, *_ in docs), key=str)
    assert len(got) == len(want) and [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-6 and abs(g[2] - w[2]) < 1e-6 and g[3] == (g[2] >= 0.5) for g, w in zip(got, want, strict=True))
    right = {d: t for d, t in labels}
    assert np.mean([g[3] == right[g[0]] for g in got if g[0] in right]) > 0.95
