"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Each byte is mapped to one character, so that white space and invalid sequences are ordinary symbols. A piece of the
model is a vocabulary entry in mapped form; its score is the negative rank, so sentencepiece's rule (merge the adjacent
pair whose union has the highest score, leftmost first) is the rule of the lowest rank. Normalisation is the identity.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as pb

from tidemark.llm.common import map_in_arrow, table

#: Byte b stands as this character of the string.
BYTE_CHARS = "".join(chr(0x100 + b) for b in range(256))
RANKS = "byte_bpe_50k.tiktoken"
#: Distinct pre-tokens that a worker remembers; beyond it forgets all. This bounds memory and changes no result.
REMEMBERED = 200_000


def mapped(data: bytes) -> str:
    return codecs.charmap_decode(data, "strict", BYTE_CHARS)[0]


def unmapped(piece: str) -> bytes:
    """The bytes that a piece's characters stand for."""
    return bytes(ord(c) - 0x100 for c in piece)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> list[bytes]:
    """Entries by rank; ranks without an entry are empty."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    entries = [b""] * (max(rank for rank, _ in pairs) + 1)
    for rank, token in pairs:
        entries[rank] = token
    return entries


def model_bytes(entries: list[bytes]) -> bytes:
    """The serialised model: piece 0 is unknown, piece rank + 1 is the entry of that rank."""
    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(entries) + 1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(entries):
        kind = pb.ModelProto.SentencePiece.NORMAL if token else pb.ModelProto.SentencePiece.UNUSED
        model.pieces.add(piece=mapped(token) if token else f"<unused{rank}>", score=-float(rank), type=kind)
    return model.SerializeToString()


class Encoder(dict):
    """Pre-token to the little-endian 32-bit ids of its tokens; fills itself."""

    def __init__(self, path: str) -> None:
        super().__init__()
        entries = vocabulary(path)
        self.whole = {token: rank for rank, token in enumerate(entries) if token}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(entries))
        #: The bytes of each id, by the inverse mapping of the model's own pieces.
        self.decoded = [unmapped(self.model.id_to_piece(k + 1)) if token else None for k, token in enumerate(entries)]
        self.split = regex.compile(public_tokenizers.PATTERN).findall

    def __missing__(self, token: str) -> bytes:
        data = token.encode()
        rank = self.whole.get(data)
        if rank is None:
            ids = np.asarray(self.model.encode(mapped(data), num_threads=1), dtype="<i4") - 1
        else:
            ids = np.asarray([rank], dtype="<i4")
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = found = ids.tobytes()
        return found

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for; an id without a piece is an error."""
        return b"".join(map(self.decoded.__getitem__, ids))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), dtype="<i4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about that many characters at most, one row at least."""
    begin = size = 0
    for k, length in enumerate(pc.binary_length(texts).to_pylist()):
        if k > begin and size + (length or 0) > most:
            yield begin, k
            begin, size = k, 0
        size += length or 0
    if len(texts) > begin:
        yield begin, len(texts)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df and a column with the token ids of each text; a null text counts as empty, an empty one has no ids.

    ``path`` is read on the executors, where the vocabulary is installed. A column named ``out`` is replaced.
    """
    base = df.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(column, 8_000_000):
                ids = [enc.encode(x or "") for x in column.slice(a, b - a).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])

    return base.transform(map_in_arrow, run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df and a binary column with the bytes that the ids stand for; null ids count as none.

    An id outside the vocabulary is an error.
    """
    base = df.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [enc.decode(x.as_py() or []) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out])

    return base.transform(map_in_arrow, run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df without its text, with token_ids and the decoded bytes, both made in one pass over the text."""
    base = df.drop("token_ids", "decoded")
    kept = [c for c in base.columns if c != text]
    fields = [base.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            rest = batch.select(kept)
            for a, b in slices(column, 8_000_000):
                ids = [enc.encode(x or "") for x in column.slice(a, b - a).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                texts = pa.array([enc.decode(x.tolist()) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, lists, texts], names=[*kept, "token_ids", "decoded"])

    return base.transform(map_in_arrow, run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    both = round_trip(docs.select("doc_id", "text"), path)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of documents.

    Null and empty texts have no tokens, and the digests of nothing. Rows without an id are encoded like any other,
    repeated rows stay repeated and are encoded alike; an empty table gives an empty result; other columns are not read.
    """
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
