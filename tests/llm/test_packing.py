from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from stopweave.llm import packing
from stopweave.llm.common import stage

LENGTHS = (16, 32, 64)


def plain(sizes, lengths):
    """The same policy without sorted structures."""
    bins, placed = [], []
    for k, size in enumerate(sizes):
        open_bins = [(c - u, b) for b, (c, u) in enumerate(bins) if c - u >= size]
        if open_bins:
            b = min(open_bins)[1]
        else:
            rest = sum(sizes[k:])
            c = min((c for c in lengths if c >= size), key=lambda c: (packing.cost(c) / min(c, rest), c))
            bins.append((c, 0))
            b = len(bins) - 1
        bins[b] = (bins[b][0], bins[b][1] + size)
        placed.append(b)
    return placed, [min(c for c in lengths if c >= u) for _, u in bins]


@given(st.lists(st.integers(1, 64), max_size=60))
def test_pack_equals_the_plain_policy(sizes):
    sizes.sort(reverse=True)
    placed, offsets, capacity = packing.pack(sizes, LENGTHS)
    assert (placed, capacity) == plain(sizes, LENGTHS)
    used = defaultdict(int)
    for b, o, s in zip(placed, offsets, sizes, strict=True):
        assert o == used[b]
        used[b] += s
    assert all(used[b] <= c for b, c in enumerate(capacity))


def sound(rows, want, lengths):
    """Every byte of every document lies in one place, no bin overflows, every bin has the least length for it."""
    bins, seen = defaultdict(list), defaultdict(int)
    for r in rows:
        bins[r["bin"]].append((r["bin_offset"], r["size"], r["bin_length"]))
        seen[r["doc_id"]] += r["size"]
    assert dict(seen) == want
    for own in bins.values():
        own.sort()
        assert len({c for *_, c in own}) == 1 and [o for o, *_ in own] == [sum(s for _, s, _ in own[:k]) for k in range(len(own))]
        assert own[0][2] == min(c for c in lengths if c >= sum(s for _, s, _ in own))
    return sum(s for own in bins.values() for _, s, _ in own) / sum(own[0][2] for own in bins.values())


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "é" * 10), (4, "x" * 300), (5, "y" * 63), (6, "z" * 64), (None, "q"), (7, "same"), (7, "same")]
    docs = stage(spark.createDataFrame([(*r, 1, "b") for r in rows], "id long, text string, bin int, shard string"))
    got = packing.pack_documents(docs, LENGTHS, shard_rows=4).collect()
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len((t or "").encode()) + 1
    sound(got, dict(want), LENGTHS)
    assert sorted((r["piece"], r["start"], r["size"]) for r in got if r["doc_id"] == 4) == [(0, 0, 64), (1, 64, 64), (2, 128, 64), (3, 192, 64), (4, 256, 45)]
    assert packing.pack_documents(docs.limit(0), LENGTHS).collect() == []


def test_bins_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES_TOGETHER", 2)
    docs = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(200)] + [(7, "same")] * 9, "id long, text string")
    one, two = (sorted(map(tuple, packing.pack_documents(d, LENGTHS, shard_rows=16).collect()), key=str) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two and len(one) == 209


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: len(r["text"].encode()) + 1 for r in docs.collect()}
    filled = sound(packing.query(spark, sf_dir).collect(), want, packing.LENGTHS)
    assert filled > 0.95
