import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from stopweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(rows, tik):
    for r in rows:
        ids = tik.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_edge_texts_and_clashing_columns(spark, tik):
    texts = [None, "", " ", "\n\n  \t x", "a" * 50_000, "don't  STOP now é é \U0001f600\U0001f600 漢字 <|endoftext|>", "\x00\x01�", "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = bpe.bpe_digests(docs, PATH, public_tokenizers.PATTERN).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == len(texts) - 1
    same(rows, tik)
    assert bpe.bpe_digests(docs, PATH, public_tokenizers.PATTERN).count() == len(texts)


def test_whole_table(spark, sf_dir, tik):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = bpe.bpe_digests(docs, PATH, public_tokenizers.PATTERN).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    same(rows, tik)


def test_empty_table(spark):
    assert bpe.bpe_digests(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN).collect() == []
