"""Results must not rest on two scans of the same files dealing the rows alike."""

import hashlib
import random

from test_substring import brute

from stopweave.llm import common, minhash, substring

SCHEMA = "doc_id long, text string, lang string, n_chars long"


def shifting(spark, monkeypatch, module):
    """From now on every staged table is followed by another split size, as when cores come or go between scans."""
    calls = []

    def stage(df, folder=None):
        out = common.stage(df, folder)
        calls.append(1)
        spark.conf.set("spark.sql.files.minPartitionNum", str(1 + 15 * (len(calls) % 2)))
        return out

    monkeypatch.setattr(module, "stage", stage)


def landed(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(40):
        own = " ".join(word() for _ in range(80))
        rows += [(i, own + (" " + passage if i % 3 == 0 else ""), "l", 0)]
        if i % 4 == 1:
            rows.append((100 + i, own + " tail", "l", 0))
    rng.shuffle(rows)
    rows = [(i, t, x, len(t)) for i, t, x, _ in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(8).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs")), rows


def test_substring(spark, tmp_path, monkeypatch):
    docs, rows = landed(spark, tmp_path)
    shifting(spark, monkeypatch, substring)
    try:
        got = sorted((r["doc_id"], hashlib.sha256(" ".join(r["text"].split()).encode()).hexdigest()) for r in substring.drop_repeats(docs).collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == sorted((i, sha) for i, n, gone, sha in brute([r[:2] for r in rows]) if gone < n)


def test_minhash(spark, tmp_path, monkeypatch):
    docs, rows = landed(spark, tmp_path)
    shifting(spark, monkeypatch, minhash)
    try:
        got = sorted(r["doc_id"] for r in minhash.keep_one_of_each(docs).collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == [*range(40), 109, 121, 133]  # those three lack the passage of their originals
