"""Byte-level BPE encoding and decoding through a SentencePiece model built straight from a rank file.

The rank file (base64 token, rank) becomes a SentencePiece ``ModelProto`` of type BPE without any training: each
token's bytes are written as one printable character per byte, its score is the negative rank, so the best-scored
merge is the lowest-ranked one, and the normaliser is the identity. The proto is a megabyte or so, bounded by the
vocabulary, and is the only thing broadcast. Texts are cut by the caller's pattern; each pre-token is encoded by
itself, a pre-token that is a token as a whole becomes that token. Decoding maps ids back to bytes.

Defined results: a null or empty text has no ids; null ids decode to no bytes; an id outside the vocabulary raises.
Very long texts are encoded in whole. Rows are encoded one by one, so repeated rows agree; of equally ranked merges
none exist, as ranks are distinct; an empty table gives an empty result.
Columns other than the result pass through unchanged; a column with the result's name is replaced.
"""

from __future__ import annotations

import base64
import struct
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopweave.llm.common import read

#: Distinct pre-tokens that a worker remembers before it starts anew; bounds memory, never results.
CACHE_SIZE = 200_000


def byte_letters() -> list[str]:
    """A printable, non-blank character for each byte: itself where it is one, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """Token bytes by id, from a rank file that the driver can open."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    table = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(table) != list(range(len(table))):
        raise ValueError("ranks must be 0 .. n-1")
    return [table[i] for i in range(len(table))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _chunk(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_proto(tokens: list[bytes]) -> bytes:
    """The serialised SentencePiece model; ids equal ranks, the required unknown piece takes the id after them."""
    letters = byte_letters()
    normal, unknown = 1, 2
    pieces = [("".join(letters[b] for b in t), -float(i), normal) for i, t in enumerate(tokens)]
    pieces.append(("<unk>", -float(len(tokens)), unknown))
    out = bytearray()
    for piece, score, kind in pieces:
        out += _chunk(1, _chunk(1, piece.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    # trainer_spec: model_type BPE, vocab_size, unk_id, and no bos, eos or pad
    out += _chunk(2, _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(k, -1) for k in (41, 42, 43)))
    # normalizer_spec: the identity, no added prefix, white space kept as it is
    out += _chunk(3, _chunk(1, b"identity") + b"".join(_number(k, 0) for k in (3, 4, 5)))
    return bytes(out)


class _Pieces(dict):
    """Pre-token to ids, filled as pre-tokens come up."""

    def __init__(self, model: bytes, tokens: list[bytes]):
        import sentencepiece

        self.spm = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = {t: (i,) for i, t in enumerate(tokens)}
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = self.whole.get(raw) or tuple(self.spm.encode("".join(map(self.letters.__getitem__, raw))))
        self[piece] = ids
        return ids


def _with_column(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema if f.name != name] + [T.StructField(name, kind)])


def _replace(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [(f, c) for f, c in zip(batch.schema, batch.columns, strict=True) if f.name != name]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), values], schema=pa.schema([*(f for f, _ in kept), pa.field(name, values.type)]))


def encode(df: DataFrame, tokens: list[bytes], pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids (array<int>) of ``text_col``; no shuffle, one pass over the rows."""
    shared = df.sparkSession.sparkContext.broadcast((model_proto(tokens), tokens))

    def run(batches):
        import regex

        find, pieces = regex.compile(pattern).findall, _Pieces(*shared.value)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for text in batch.column(text_col):
                if text := text.as_py():
                    ids.extend(chain.from_iterable(map(pieces.__getitem__, find(text))))
                    if len(pieces) > CACHE_SIZE:
                        pieces.clear()
                ends.append(len(ids))
            yield _replace(batch, ids_col, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))

    return df.mapInArrow(run, _with_column(df.schema, ids_col, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, tokens: list[bytes], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes (binary) that ``ids_col`` stands for."""
    shared = df.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        table = shared.value
        for batch in batches:
            lists = (b"".join(map(table.__getitem__, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in batch.column(ids_col))
            yield _replace(batch, bytes_col, pa.array(lists, pa.binary()))

    return df.mapInArrow(run, _with_column(df.schema, bytes_col, T.BinaryType()))


def bpe_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: token count and the digests of its ids and of the bytes decoded from them."""
    tokens = read_ranks(documents.sparkSession, path)
    ids = encode(documents.select("doc_id", "text"), tokens, pattern).drop("text")
    both = decode(ids, tokens)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
