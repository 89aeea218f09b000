import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tidemark.llm import bpe
from tests.llm.test_decontaminate import prose
from tests.llm.test_toxicity import BAD


def planted(rng):
    """(documents, labels, benchmark, fate of each id): clean, toxic, junk, copy or leak."""
    items = [prose(rng, rng.randint(20, 50)) for _ in range(30)]
    rows, fate = [], {}

    def add(words, kind):
        fate[len(rows)] = kind
        rows.append((len(rows), " ".join(words), "en", f"s{len(rows) % 3}", 0))
        return len(rows) - 1

    for k in range(400):
        words = prose(rng, rng.randint(40, 150))
        kind = ["clean", "toxic", "junk", "leak"][0 if k % 8 > 2 else 1 + k % 8]
        if kind == "toxic":
            for at in range(0, len(words), 9):
                words[at] = rng.choice(BAD)
        elif kind == "junk":
            words = [w + "###" for w in words]
        elif kind == "leak":
            words[10:10] = rng.choice(items)
        add(words, kind)
    for k in range(40):
        original = rows[8 * k + 4][1].split()
        add(original + (["more"] if k % 2 else []), "copy")
    add([], "junk")
    labels = [(k, int(fate[k] != "junk"), int(fate[k] == "toxic")) for k in fate if fate[k] != "copy"]
    return rows, labels, [(k, " ".join(x)) for k, x in enumerate(items)], fate


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items, fate = planted(random.Random(8))
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, fate


def test_each_stage_drops_what_it_should_and_leaves_clean_documents(spark, tables):
    root, rows, fate = tables
    docs = spark.read.parquet(f"{root}/documents.parquet").cache()
    ids = set(fate)
    for (name, stage), kind in zip(corpus_pipeline.STAGES[:-1], ("toxic", "junk", "copy", "leak"), strict=True):
        out = stage(spark, docs, root).cache()
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {r.doc_id for r in out.collect()}
        gone = ids - left
        assert {fate[k] for k in gone} <= {kind}, name
        caught = [k for k in ids if fate[k] == kind and k in gone]
        assert len(caught) >= 0.9 * sum(fate[k] == kind for k in ids), name
        ids, docs = left, out


def test_run_equals_the_library_on_what_is_left(spark, tables):
    root, rows, _ = tables
    ranks = {token: rank for rank, token in enumerate(bpe.vocabulary(public_tokenizers.path(bpe.RANKS)))}
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, root).collect()
    assert len(got) > 150 and len({r.doc_id for r in got}) == len(got)
    for r in got:
        text = rows[r.doc_id][1]
        assert list(r.token_ids) == model.encode_ordinary(text) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_take_nulls_and_empty_tables(spark, tables):
    root, _, _ = tables
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (3, "word " * 20_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, root).collect()


def test_stages_keep_columns_whatever_their_names(spark, tables):
    root, _, _ = tables
    names = ["doc_id", "text", "lang", "source", "n_chars", "key", "fp", "row", "kept", "leaks", "severity", "n_words", "top", "best", "h", "prefix", "label", "toxic", "token_ids"]
    rows = [(k, f"clean words of document number {k} that go on for a while and say nothing much of note {k * 7}", "en", "s", 1, *[f"{n}{k}" for n in names[5:]]) for k in range(20)]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == names, name
        got = {tuple(r) for r in out.collect()}
        assert got <= set(rows) and (name != "simhash" or got), name
    # rows that share an id are documents of their own
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "pq")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.first_copies(spark, docs, root).collect())) == [(3, a), (5, b)]


def test_removed_deletes_what_was_written_aside(spark, tmp_path):
    from tidemark.llm import common

    df = common.written(spark.range(3), "probe")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert common.removed(spark, path) and not common.removed(spark, path)
