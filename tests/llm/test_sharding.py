import hashlib
import math
import zlib

import pytest
from helpers import same_rows

from pyspark.sql import functions as F

from stopweave.llm import sharding


def plain_shard(key, topology):
    """The descent by hand: at each level the child with the smallest -ln(u) / weight."""
    inner = [(r, f"{r}/{k}", f"{r}/{k}/{s}", w) for r, k, s, w in topology if w > 0]
    at = ""
    for level in range(3):
        weights = {}
        for x in inner:
            if level == 0 or x[level - 1] == at:
                weights[x[level]] = weights.get(x[level], 0) + x[3]
        u = lambda c: (int(hashlib.md5(f"{'' if key is None else key}:{c}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13
        at = min(weights, key=lambda c: -math.log(u(c)) / weights[c])
    return int(at.rpartition("/")[2])


def placed(spark, n, topology):
    rows = spark.range(n).select("id", sharding.shard_of(F.col("id"), topology).alias("shard")).collect()
    return {r.id: r.shard for r in rows}


def test_oracle(spark, sf_dir):
    assert same_rows(sharding.query(spark, sf_dir), sharding.SQL, sf_dir) > 0


def test_edge_cases_against_plain_rule(spark):
    docs = [(1, "a" * 300_000, "x", 0), (2, None, "y", 1), (2, None, "y", 1), (None, "z", "z", 2), (3, "", "z", 2), (-4, "Łódź", None, None), *[(9, "same", "s", 5)] * 50]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string, slot int").repartition(7)
    got = sharding.assign_shards(df).collect()
    assert len(got) == len(docs)
    more = sharding.grown(sharding.TOPOLOGY)
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_shard(d, sharding.TOPOLOGY), plain_shard(d, more)) for d, t, *_ in docs), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got), key=str) == want
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.assign_shards(df.limit(0)).count() == 0


def test_slots_do_not_depend_on_the_split(spark):
    docs = spark.range(500).select((F.col("id") % 170).alias("doc_id"), (F.col("id") % 3).cast("string").alias("text"))
    runs = [sorted(map(str, sharding.assign_shards(docs.repartition(n)).collect())) for n in (1, 9)]
    assert runs[0] == runs[1]


def test_a_new_shard_takes_rows_only_into_itself(spark):
    before, after = placed(spark, 20_000, sharding.TOPOLOGY), placed(spark, 20_000, sharding.grown(sharding.TOPOLOGY))
    moved = [k for k in before if before[k] != after[k]]
    assert {after[k] for k in moved} == {16}
    assert len(moved) == pytest.approx(20_000 / 17, rel=0.15)
    for n in (17, 18):  # and so does the next one
        here = [*sharding.TOPOLOGY]
        while len(here) < n:
            here = sharding.grown(here)
        a, b = placed(spark, 2000, here), placed(spark, 2000, sharding.grown(here))
        assert {b[k] for k in a if a[k] != b[k]} == {n}


def test_movement_stays_with_the_subtrees_whose_weights_change(spark):
    heavier = [(r, k, s, 3.0 if s == 5 else w) for r, k, s, w in sharding.TOPOLOGY]
    before, after = placed(spark, 20_000, sharding.TOPOLOGY), placed(spark, 20_000, heavier)
    for k in before:
        if before[k] != after[k]:
            assert after[k] // 8 == 0  # region 0 has grown: nothing leaves it
            if before[k] // 8 == 0:
                assert after[k] // 4 == 1  # its rack 1 has grown
                if before[k] // 4 == 1:
                    assert after[k] == 5
    gone = [x for x in sharding.TOPOLOGY if x[2] != 5]
    after = placed(spark, 20_000, gone)
    assert all(before[k] // 8 == 0 for k in before if before[k] != after[k])


def test_shares_follow_weights(spark):
    topology = [("a", "x", 0, 1.0), ("a", "x", 1, 3.0), ("a", "y", 2, 4.0), ("b", "x", 3, 8.0), ("b", "x", 4, 0.0)]
    got = list(placed(spark, 20_000, topology).values())
    for shard, weight in ((0, 1), (1, 3), (2, 4), (3, 8), (4, 0)):
        assert got.count(shard) == pytest.approx(20_000 * weight / 16, rel=0.1)


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(i % 40, f"text {i}", "clash") for i in range(300)] + [(None, None, None)], "doc_id long, text string, source string")
    sharding.write_shards(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert all(r.shard == plain_shard(r.doc_id, sharding.TOPOLOGY) for r in back.collect())
