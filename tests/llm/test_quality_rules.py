import math
import random
import re
import unicodedata

from tidemark.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(5)}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    rng = random.Random(3)
    found = [None, "", " \n\t", "a", "a b c d e", "a b c d e f a b c d e", "x " * 40, "l1 a\nl1 a\n\n \nl1 a\r\nl1 a", "é b c 🙂|<>", "\x85a\x1cb"]
    for _ in range(150):
        words = rng.choices(["a", "b", "ça", "D&", "#", "e|f"], k=rng.randint(0, 80))
        found.append("".join(w + rng.choice(" \n\t\x0b  ") for w in words))
    return found


def test_statistics_equal_brute_force(spark):
    rows = [(k, t, 5) for k, t in enumerate(texts())] + [(None, "a b", None), (3, "r r", 1), (3, "r r", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted((str(r.doc_id), *(r[c] for c in q.BASE)) for r in q.with_stats(docs).collect())
    assert got == sorted((str(k), *brute(t)) for k, t, _ in rows)


def test_long_text(spark):
    text = " ".join(f"w{k % 9000}" for k in range(30_000))
    row = q.with_stats(spark.createDataFrame([(text,)], "text string")).first()
    assert row.n_words == row.n_repeat_words == 30_000


def test_a_learned_list_separates_and_keeps_clean_rows():
    rng = random.Random(1)
    rows = [(rng.random() * 0.1, 0.0, 0.0, 5.0, 0.02, 0.8, False) for _ in range(400)]
    rows += [(2 + rng.random(), 0.0, 0.0, 8.0, 0.02, 0.8, True) for _ in range(40)]
    rows += [(0.0, 0.0, 0.0, 5.0, 0.9 + rng.random() / 10, 0.8, True) for _ in range(40)]
    rng.shuffle(rows)
    rules = q.learn(rows)
    assert 2 <= len(rules) <= 8 and all(1 <= len(r) <= 3 for r in rules)


def test_learning_without_rows_or_classes():
    assert q.learn([]) == [] and q.learn([(0.0,) * 6 + (True,)] * 9) == [] and q.learn([(0.0,) * 6 + (False,)] * 9) == []


def test_verdicts(spark):
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(60))
    rows = [(k, clean() if k % 4 else clean().replace(" ", "&&& ")) for k in range(200)] + [(900, None), (901, "too short"), (902, "a b c d e f " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k % 4 else 0) for k in range(160)] + [(None, 1), (3, None), (5, 1), (5, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.judge(docs, q.fit(docs, labels)).collect()}
    assert all(got[k].kept == bool(k % 4) for k in range(200))
    assert not any(got[k].kept for k in (900, 901, 902)) and all(got[k].base_failed for k in (900, 901, 902))
    assert q.kept(docs.withColumn("kept", docs.doc_id), labels).columns == ["doc_id", "text", "kept"]
    empty = docs.limit(0)
    assert q.judge(empty, q.fit(empty, labels.limit(0))).count() == 0


def brute_features(text):
    """FEATURES of a text, from the definition."""
    n, chars, symbols, dup, repeat = brute(text)
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    upper = sum(unicodedata.category(c) == "Lu" for c in text or "")
    distinct = sum(len(set(words[k : k + 200])) for k in range(0, len(words), 200))
    many = max(1, n)
    return dict(zip(q.FEATURES, (symbols / many, dup / max(1, len(lines)), repeat / many, chars / many, upper / max(1, chars), distinct / many), strict=True))


def brute_learn(rows, most=8, longest=3, precision=0.9, least=3):
    """Sequential covering by trying every feature, side and threshold of every step; rows are (features, bad)."""
    rules, free = [], list(range(len(rows)))
    part = {k: k % 3 == 2 for k in free}
    holds = lambda c, x: x[c[0]] > c[2] if c[1] else x[c[0]] <= c[2]
    while len(rules) < most:
        grown = [rows[k] for k in free if not part[k]]
        if not any(b for _, b in grown) or all(b for _, b in grown):
            break
        rule, left = [], grown
        while len(rule) < longest and not all(b for _, b in left):
            p, n, best = sum(b for _, b in left), len(left), (1e-9, None)
            for f in q.FEATURES:
                values = sorted({x[f] for x, _ in left})
                found = {False: (0, None), True: (0, None)}
                for a, z in zip(values, values[1:]):
                    cut = (a + z) / 2
                    for above in (False, True):
                        hit = [b for x, b in left if (x[f] > a) == above]
                        gain = sum(hit) * (math.log2(sum(hit) / len(hit)) - math.log2(p / n)) if sum(hit) else 0
                        if gain > found[above][0] + 1e-12 or found[above][1] is None:
                            found[above] = (gain, (f, above, cut))
                for above in (False, True):
                    if found[above][1] and found[above][0] > best[0] + 1e-12:
                        best = found[above]
            if best[1] is None:
                break
            rule.append(best[1])
            left = [(x, b) for x, b in left if holds(best[1], x)]
        held_back = [rows[k] for k in free if part[k]]

        def worth(m):
            hit = [b for x, b in held_back if all(holds(c, x) for c in rule[:m])]
            return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

        if not rule:
            break
        rule = rule[: max(range(1, len(rule) + 1), key=lambda m: (worth(m), -m))]
        hit = [k for k in free if all(holds(c, rows[k][0]) for c in rule)]
        bad = sum(rows[k][1] for k in hit)
        if bad < least or bad / len(hit) < precision:
            break
        rules.append(rule)
        free = [k for k in free if k not in set(hit)]
    return rules, lambda x: any(all(holds(c, x) for c in rule) for rule in rules)


def test_the_query_equals_brute_force_over_a_folder(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(500))
    docs = []
    for k in range(240):
        words = [word() for _ in range(rng.randint(5, 120))]
        words = [w + "&&#" for w in words] if k % 5 == 0 else [w.upper() + "X" for w in words] if k % 7 == 0 else words
        docs.append((k, "\n".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9)), "x", 5))
    docs += [(None, docs[5][1], None, None), (300, None, None, None), (301, "", None, None), (3, docs[3][1], None, None), (302, "word É# " * 20_000, None, None)]
    labels = [(k, int(k % 5 and k % 7 > 0)) for k in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, kept string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 0), (1, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = q.op6_quality_rules(spark, str(tmp_path))
    assert found.columns == ["doc_id", *q.BASE, "base_failed", "kept"]
    stats = {t: (brute(t) if len(t or "") < 10_000 else (40_000, 120_000, 20_000, 0, 40_000), brute_features(t) if len(t or "") < 10_000 else None) for _, t, *_ in docs}
    failed = lambda t: stats[t][0][0] < 10 or 100 * stats[t][0][4] > 20 * stats[t][0][0]
    known = {}
    for d, t, *_ in docs:
        if d is not None and d < 200:
            known.setdefault(d, t)
    rows = sorted((d, *(stats[known[d]][1][f] for f in q.FEATURES), not good) for d, good in labels if not failed(known[d]))
    _, bad = brute_learn([(dict(zip(q.FEATURES, r[1:-1], strict=True)), r[-1]) for r in rows])
    want = sorted((str(d), *stats[t][0], failed(t), not failed(t) and not bad(stats[t][1])) for d, t, *_ in docs)
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in found.collect())
    assert [g for g in got if g[0] != "302"] == [w for w in want if w[0] != "302"]
    assert [g[1:] for g in got if g[0] == "302"] == [(40_000, 120_000, 20_000, 0, 40_000, True, False)]
    assert 20 < sum(g[-1] for g in got) < 200
