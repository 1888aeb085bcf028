import hashlib
import zlib

import pytest
from helpers import same_rows

from stopweave.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """(root, proof pieces of each node as (before, after)) of a list of digests."""
    paths, at, here = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(here) > 1:
        for k, i in enumerate(at):
            run = here[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            at[k] = i // 16
        here = [h(*here[i : i + 16]) for i in range(0, len(here), 16)]
    return here[0], paths


def plain(docs):
    """The contract by hand for (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d: h(*map(field, d))
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append(d)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        groups[s].sort(key=lambda d: (d[0] is None, d[0] or 0, leaf(d)))
    trees = {s: climb([leaf(d) for d in groups[s]]) for s in sources}
    root, tops = climb([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for d, path in zip(groups[s], trees[s][1], strict=True):
            whole, at = path + top, leaf(d)
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                at = leaf((*d[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])))
            for before, after in whole:
                at = h(before, at, after)
            out.append((d[0], leaf(d), trees[s][0], root, h(*(x for p in whole for x in p)), at, at == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def check(spark, docs):
    got = merkle.verify(spark.createDataFrame(docs, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs)


def test_oracle(spark, sf_dir):
    assert same_rows(merkle.query(spark, sf_dir), merkle.SQL, sf_dir) > 0


def test_runs_of_all_sizes(spark):
    docs = [(1000 * i + i % 7, f"s{size}", "en", i, f"Text {i} Ü") for size in (1, 2, 15, 16, 17, 33, 256, 257, 300) for i in range(size)]
    check(spark, docs)


def test_nulls_repeats_negative_and_sparse_ids(spark):
    docs = [(None, None, None, None, None), (None, None, None, None, "B"), (5, None, "de", 1, ""), (5, None, "de", 1, ""), (5, None, "de", 2, "Other")]
    docs += [(-1, "ä", "fr", -3, "ABC"), (-64, "ä", "fr", 0, "x" * 100_000), (2**63 - 1, "ä", "fr", 1, "Q"), (-(2**63), "ä", None, 1, "Q"), (2**40, "ä", None, 1, "Q"), (63, "ä", None, 1, "Q"), (64, "ä", None, 1, "R")]
    docs += [(7, "", "", 0, "same")] * 40 + [(8, "Z", "", 0, "Alone")]
    check(spark, docs)


def test_many_sources(spark):
    check(spark, [(i, f"host{i % 40}", "en", i, f"T{i}") for i in range(90)])


def test_one_row_and_none(spark):
    check(spark, [(10, "s", "en", 3, "Abc")])
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.verify(empty).count() == 0 and merkle.build_manifest(empty).root is None


def test_clashing_columns_and_kept_nodes(spark):
    docs = [(i, f"s{i % 2}", "en", i, f"Text {i}") for i in range(40)]
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA + ", key string, index int, digest int")
    assert sorted(map(tuple, merkle.verify(df).collect()), key=str) == plain(docs)
    m = merkle.build_manifest(df)
    assert m.root == plain(docs)[0][3]
    assert m.nodes().groupBy("level").count().orderBy("level").collect() == [(1, 4), (2, 2)]


@pytest.mark.parametrize("change", ["drop", "swap"])
def test_root_tells_changes(spark, change):
    docs = [(i, "s", "en", i, f"Text {i}") for i in range(20)]
    other = docs[:-1] if change == "drop" else [*docs[2:], (0, "s", "en", 1, "Text 0"), (1, "s", "en", 0, "Text 1")]
    roots = {merkle.build_manifest(spark.createDataFrame(x, SCHEMA)).root for x in (docs, other, docs[::-1])}
    assert len(roots) == 2
