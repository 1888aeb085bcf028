import random
import re

import numpy as np
from helpers import same_rows

from stopweave.llm import minhash
from stopweave.llm.common import ROW, stage
from stopweave.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, rep long, band int, component string"


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    key = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return [rows[min((k for k in range(len(rows)) if find(k) == find(i)), key=key)][0] for i in range(len(rows))]


def run(spark, rows):
    docs = stage(spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA))
    return docs, minhash.near_classes(docs.selectExpr("doc_id as id", "text")).collect()


def test_edges(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(9, base), (4, base.upper()), (7, base + " tail"), (2, None), (1, ""), (3, "a b"), (5, "A  b"), (6, "a b c"), (8, " \n"), (None, base), (10, "q " * 50_000), (11, "z"), (12, "a b c d e"), (12, "a b c d e")]
    docs, got = run(spark, rows)
    want = dict(zip((r[0] for r in rows), brute(rows), strict=True))
    assert {r["id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert {r["id"]: r["n_shingles"] for r in got} | {7: 57} == {r["id"]: r["n_shingles"] for r in got}
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 10, 11, 12]
    assert run(spark, [])[1] == []


def test_random_families_against_brute_force(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(25):
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((i := i + 1, " ".join(text)))
    rng.shuffle(rows)
    _, got = run(spark, rows)
    assert {r["id"]: r["component_id"] for r in got} == dict(zip((r[0] for r in rows), brute(rows), strict=True))


def test_chains_that_hubs_do_not_tie(spark, monkeypatch):
    """The first hubs find nothing here, so the links show at the second hub and where members meet."""
    rng = random.Random(8)
    text, rows = [f"c{k}" for k in range(100)], []
    for i in range(60):
        rows.append((1000 - i, " ".join(text)))
        text[(7 * i) % 100] = text[(7 * i + 50) % 100] = f"x{i}"
    rng.shuffle(rows)
    met, plain = [], minhash._may_link
    monkeypatch.setattr(minhash, "MEMBERS_TOGETHER", 3)
    monkeypatch.setattr(minhash, "_likely", lambda pairs, reps: minhash.stage(pairs.limit(0)))
    monkeypatch.setattr(minhash, "_may_link", lambda x, y: met.append(1) or plain(x, y))
    _, got = run(spark, rows)
    assert {r["id"]: r["component_id"] for r in got} == dict(zip((r[0] for r in rows), brute(rows), strict=True)) and len(met) == 2


def test_components_of_a_long_path(spark):
    nodes = list(range(300))
    random.Random(1).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)) + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash.components(edges).collect()}
    assert got == {n: 0 for n in nodes} | {1000: 1000, 1001: 1000}


def test_minima_follow_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = (minhash.minima(s, *minhash._coefficients()) for s in (x[:3500], x[500:]))
    assert abs((a == b).mean() - 0.75) < 0.1 and ROW


def test_oracle(spark, sf_dir):
    assert same_rows(QUERIES["op9_minhash"](spark, sf_dir), ORACLES["op9_minhash"], sf_dir) == 200
