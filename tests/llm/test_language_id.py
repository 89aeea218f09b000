import math
import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.test_features import brute_grams, brute_points, brute_tf_idf
from tidemark.llm import language_id as li
from tidemark.llm.features import mod_of_crc32
from pyspark.sql import functions as F

PARTS = {"aa": "la na mi so re ti do".split(), "bb": "krz prt shk vlk dmn".split(), "cc": "日 本 語 文 字".split()}


def text(rng, lang):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))


def test_held_out_accuracy_and_scores(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, lang), lang) for k in range(300) for lang in [rng.choice(sorted(PARTS))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = mod_of_crc32(F.col("doc_id"), 4) == 2
    got = li.predict(docs.withColumn("held", held), li.fit(docs.where(~held))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held]
    assert len(out) > 40 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_unknown_and_unlabelled(spark):
    rng = random.Random(2)
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 !? \n", "bb"), (None, "la na", None), (5, "la " * 50_000, None), (5, "la na", None)]
    rows += [(10 + k, text(rng, lang), lang) for k, lang in enumerate(["aa", "bb"] * 30)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = li.predict(docs.select("doc_id", "text", "score"), li.fit(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [(by[k].lang_pred, by[k].score) for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert by[5].lang_pred == "aa"
    none = li.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in li.predict(docs.select("doc_id", "text"), none).collect()} == {("und", 0.0)}
    assert li.predict(docs.limit(0).select("doc_id", "text"), none).count() == 0


def test_elastic_net_leaves_rare_features_at_zero():
    rng = np.random.default_rng(3)
    rows, y = [], rng.integers(0, 2, 200)
    for own in y:
        rows.append((np.array([own, 5 + rng.integers(0, 95)], dtype=np.int32), np.array([0.9, 0.1])))
    w = li.follow_the_leader(rows, y, 2, 100, l1=0.5)
    assert (w[:, 5:100] == 0).mean() > 0.8 and w[0, 0] > 0 > w[1, 0]


def test_temperature_softens_overconfident_logits():
    y = np.array([0, 1] * 50)
    logits = np.where(np.arange(2) == y[:, None], 20.0, 0.0)
    logits[::5] = logits[::5, ::-1]
    assert li.temperature(logits, y) > 5 and li.temperature(logits[:0], y[:0]) == 1.0


def plain_follow_the_leader(rows, y, classes, size, alpha, beta, l1, l2, passes):
    """The same steps, coordinate by coordinate."""
    z, n = [[0.0] * (size + 1) for _ in range(classes)], [[0.0] * (size + 1) for _ in range(classes)]

    def weight(c, k):
        x = z[c][k]
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((beta + math.sqrt(n[c][k])) / alpha + l2)

    for _ in range(passes):
        for row, own in zip(rows, y):
            row = {**row, size: 1.0}
            w = [{k: weight(c, k) for k in row} for c in range(classes)]
            scores = [sum(w[c][k] * v for k, v in row.items()) for c in range(classes)]
            e = [math.exp(s - max(scores)) for s in scores]
            for c in range(classes):
                g = e[c] / sum(e) - (c == own)
                for k, v in row.items():
                    step = g * v
                    z[c][k] += step - (math.sqrt(n[c][k] + step * step) - math.sqrt(n[c][k])) / alpha * w[c][k]
                    n[c][k] += step * step
    return [[weight(c, k) for k in range(size + 1)] for c in range(classes)]


def test_follow_the_leader_equals_loops():
    rng = random.Random(3)
    rows = [{k: rng.random() for k in sorted(rng.sample(range(20), 5))} for _ in range(60)]
    y = [sum(r) % 3 for r in rows]
    sparse = [(np.array(list(r), np.int32), np.array(list(r.values()))) for r in rows]
    got = li.follow_the_leader(sparse, np.array(y), 3, 20, alpha=2.0, beta=1.0, l1=0.05, l2=0.02, passes=2)
    want = np.array(plain_follow_the_leader(rows, y, 3, 20, 2.0, 1.0, 0.05, 0.02, 2))
    assert np.abs(got - want).max() < 1e-5 and (want == 0).any() and (want != 0).any()


def test_the_query_equals_brute_force_over_a_folder(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, text(rng, lang), lang if rng.random() < 0.9 else None, "s") for k in range(400) for lang in [rng.choice(sorted(PARTS))]]
    rows += [(500, None, "aa", "s"), (501, "", "aa", "s"), (502, "12 !?", "bb", "s"), (None, "la na", "aa", "s"), (3, rows[3][1], rows[3][2], "s"), (503, "LA na \n" * 40_000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = li.op8_language_id(spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = sorted(map(tuple, found.collect()), key=str)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    learn = [r for r in rows if r[0] is not None and not held(r[0]) and r[1] is not None and r[2] is not None]
    buckets = {t: brute_grams(brute_points(t.lower()), range(1, 4), li.BITS) for t in {r[1] for r in rows if r[1]}}
    seen = Counter(b for r in learn for b in set(buckets.get(r[1], ())))
    idf = {b: math.log((1 + len(learn)) / (1 + n)) + 1 for b, n in seen.items()}
    rest = math.log(1 + len(learn)) + 1
    model = li.fit(docs.where(~(mod_of_crc32(F.col("doc_id"), 4) == 2)))
    want = []
    for d, t, _, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            want.append((d, held(d), "und", 0.0))
            continue
        v = brute_tf_idf(buckets[t], {b: idf.get(b, rest) for b in set(buckets[t])})
        logits = [(sum(float(w[b]) * x for b, x in v.items()) + float(w[-1])) / model.temperature for w in model.weights]
        e = [math.exp(x - max(logits)) for x in logits]
        k = max(range(len(e)), key=e.__getitem__)
        want.append((d, held(d), model.languages[k], e[k] / sum(e)))
    want.sort(key=str)
    order = lambda r: (str(r[0]), r[2])
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-4, (g, w)
