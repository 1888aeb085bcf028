import hashlib
import re
from collections import defaultdict

import pytest
from helpers import same_rows

from stopweave.llm import exact
from stopweave.llm.queries import ORACLES, QUERIES

ROWS = [(5, "a b"), (3, "ab"), (4, " a b"), (2, None), (9, ""), (1, " \n"), (7, "x" * 100_000), (8, "x" * 50_000 + " " + "x" * 50_000), (None, "q"), (None, "q"), (6, "dup"), (6, "dup"), (10, "é"), (11, "é")]
SCHEMA = "doc_id long, text string, kept string, digest int, norm string, id long"


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    return {k: (min(g)[2] if not min(g)[1] else None, len(g)) for g in groups.values() for *_, k in g}


@pytest.mark.parametrize("files", [None, 1])
def test_edges(spark, files):
    docs = spark.createDataFrame([(*r, "c", 1, "n", 0) for r in ROWS], SCHEMA).repartition(3)
    got = exact.exact_dedup(exact.stage_texts(docs), files_per_batch=files).collect()
    want = brute(ROWS)
    assert sorted((r["id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in got) == sorted((ROWS[k][0] or -1, keep or -1, n) for k, (keep, n) in want.items())
    assert sum(r["kept"] for r in got) == len({re.sub(r"\s", "", t or "") for _, t in ROWS})
    by_id = {r["id"]: r for r in got}
    assert by_id[7]["digest"] == hashlib.sha256(b"x" * 100_000).hexdigest()
    kept = exact.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 6, 8, 10]


def test_digest_collisions_are_told_apart_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "b b"), (4, "cc")], "doc_id long, text string")
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: exact.F.length(c).cast("string"))
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(exact.stage_texts(docs)).collect()}
    assert got == {1: (1, 1, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True)}


def test_empty_table(spark):
    assert exact.dedup_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_oracle(spark, sf_dir):
    assert same_rows(QUERIES["op4_exact_dedup"](spark, sf_dir), ORACLES["op4_exact_dedup"], sf_dir) == 200
