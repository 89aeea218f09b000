import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def model():
    ranks = {token: rank for rank, token in enumerate(bpe.vocabulary(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    chars = "aeiou tn\n\t\r '.,!0123éßñ漢字🙂‍▁́\x00\x85\xa0|<>endoftext"
    found = ["", " ", "  a", "a  ", "it's we'll I'D", "<|endoftext|>", "�￿", "x" * 5000, "ab " * 4000, "!" * 999, "\n\n \n"]
    return found + ["".join(rng.choices(chars, k=rng.randint(1, 60))) for _ in range(400)]


def test_encoder_equals_tiktoken(model):
    enc = bpe.Encoder(PATH)
    for text in texts():
        assert enc.encode(text).tolist() == model.encode_ordinary(text)


def test_query_over_nulls_repeats_and_extra_columns(spark, model):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, "a b", "y"), (7, "same", None), (7, "same", None), (9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bpe.digests(docs, PATH).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = model.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "é ab"), (2, None), (3, "")], "doc_id long, text string")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in rows] == ["é ab", "", ""]


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_pieces_of_the_model_invert_to_the_vocabulary():
    enc = bpe.Encoder(PATH)
    assert [x or b"" for x in enc.decoded] == bpe.vocabulary(PATH)
    assert bpe.unmapped(bpe.mapped(bytes(range(256)))) == bytes(range(256))


def test_the_query_over_a_folder(spark, tmp_path, model):
    rows = [(k, t, "x") for k, t in enumerate(texts()[:60])] + [(None, None, None), (7, "again", None), (7, "again", None), (8, "long é text\n" * 60_000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    found = bpe.op10_byte_bpe(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(found.dtypes)["n_tokens"] == "bigint"
    want = []
    for doc_id, text, _ in rows:
        ids = model.encode_ordinary(text or "")
        want.append((str(doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()) == sorted(want)
