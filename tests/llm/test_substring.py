import hashlib
import random
import re

import numpy as np
import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from stopweave.llm import substring
from stopweave.llm.common import stage
from stopweave.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, n_chars long, spans int, prefix string"


def brute(rows, size=50):
    key = lambda i: float("inf") if i is None else i
    least, words = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            least[x] = min(least.get(x, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for k in range(len(w) - size + 1) if least[tuple(w[k : k + size])] < key(i) for p in range(k, k + size)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def family(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 49, 80, 200, 60)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(0, 5)):
            text += [word() for _ in range(rng.randrange(0, 90))] + rng.choice(passages)[rng.randrange(0, 3) :]
        rows.append((i, (" " if i % 3 else "\n\t ").join(text)))
    rows += [(100 + k, "a b " * 200) for k in range(3)] + [(7, rows[3][1]), (200, rows[5][1]), (None, rows[5][1]), (None, None), (300, ""), (301, "few words"), (302, " ".join(passages[4] * 40))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group_rows", [8192, 3])
def test_against_brute_force(spark, group_rows, monkeypatch):
    rows = family(group_rows)
    docs = stage(spark.createDataFrame([(*r, "l", len(r[1] or ""), 0, "p") for r in rows], SCHEMA).repartition(3))
    plain = substring.repeats
    monkeypatch.setattr(substring, "repeats", lambda d: plain(d, group_rows))
    got = substring.substring_digests(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    kept = substring.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.where(F.col("n_chars") != F.length("text")).count() == 0


def test_deep_nodes_against_brute_force():
    rng = random.Random(9)
    for depth in (1, 3, 5):
        texts = [np.array([rng.randrange(3) for _ in range(rng.randrange(0, 30))], dtype=np.uint64) for _ in range(12)]
        got = substring.deep_nodes([t.tobytes() for t in texts], depth)
        heads = [[tuple(t[k : k + depth].tolist()) for k in range(max(0, len(t) - depth + 1))] for t in texts]
        flat, seen = [x for h in heads for x in h], {}
        for nodes, own in zip(got, heads, strict=True):
            assert len(nodes) == len(own)
            for node, head in zip(nodes.tolist(), own, strict=True):
                assert (node < 0) == (flat.count(head) == 1) and (node < 0 or seen.setdefault(node, head) == head)
        assert len(seen) == len({x for x in flat if flat.count(x) > 1})
    assert substring.deep_nodes([]) == []


def test_spans_are_maximal_repeats(spark):
    shared = [f"s{k}" for k in range(120)]
    rows = [(1, " ".join(["a"] + shared + ["b"])), (2, " ".join(["c", "d"] + shared[10:] + ["e"]))]
    found = substring.repeats(stage(spark.createDataFrame(rows, "id long, text string")))[2].collect()
    assert len(found) == 1 and substring._covered([x.asDict() for x in found[0]["spans"]]) == [(2, 112)]


def test_words_whose_hashes_share_half_their_bits(spark):
    same = [f"s{k}" for k in range(49)]
    docs = spark.createDataFrame([(1, " ".join([*same, "w18676"])), (2, " ".join([*same, "w34583"]))], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.substring_digests(docs).collect()] == [0, 0]


def test_oracle_and_empty(spark, sf_dir):
    assert same_rows(QUERIES["op6_substring"](spark, sf_dir), ORACLES["op6_substring"], sf_dir) == 200
    assert substring.substring_digests(spark.createDataFrame([], SCHEMA)).collect() == []
