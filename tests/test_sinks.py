"""Streams that are stopped, repeated or fed out of order lose and double nothing."""

import random

import pytest
from pyspark.errors import StreamingQueryException

from stopweave.sources import files
from stopweave.streaming import ttl

EVENTS = "event_id long, key string, ts timestamp, cacheable boolean"


def land(spark, rows, folder):
    df = spark.createDataFrame(rows, "event_id long, key string, ms long, cacheable boolean")
    df.selectExpr("event_id", "key", "timestamp_millis(ms) as ts", "cacheable").coalesce(1).write.mode("append").parquet(folder)


def by_hand(batches, ttl_ms, late):
    """{id: (hit, late)} with the watermark of the batches before, all that waits judged at the end."""
    told, waiting, latest = {}, [], None
    for rows in batches:
        for i, k, at, keeps in rows:
            if at is None:
                told[i] = (False, False)
            elif latest is not None and at < latest - late:
                told[i] = (None, True)
            else:
                waiting.append((at, i, k, keeps))
        latest = max([x for x in (latest, *(r[2] for r in rows)) if x is not None], default=None)
    anchors = {}
    for at, i, k, keeps in sorted(waiting):
        hit = k in anchors and at - anchors[k] < ttl_ms
        if keeps and not hit:
            anchors[k] = at
        told[i] = (hit, False)
    return told


@pytest.mark.parametrize("order", [1, -1])
def test_every_event_is_judged_or_late(spark, tmp_path, order):
    rng = random.Random(order)
    events = [(i, rng.choice(["hot", "hot", "b", "c"]), rng.randrange(300_000) if i % 40 else None, rng.random() < 0.8) for i in range(240)]
    events.sort(key=lambda e: e[2] or 0)
    batches = [[e for e in events[k * 60 : k * 60 + 80]][: 60 if k < 3 else 80] for k in range(4)]
    moved = [rows.pop() for rows in batches[:3] for _ in range(8)]  # what lands in the last batch, too late or just in time
    batches[3] += moved
    batches = batches[::order]
    for n, rows in enumerate(batches):
        land(spark, rows, str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ttl.stream_cache_hits(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "key", 9000, late="60 seconds").awaitTermination()
    rows = ttl.read_cache_hits(spark, str(tmp_path / "out"), 9000, ended=True).collect()
    want = by_hand(batches, 9000, 60_000)
    assert {r["id"]: (r["hit"], r["late"]) for r in rows} == want and len(rows) == len(want) == 240
    assert sum(late for _, late in want.values()) > 5 and sum(bool(hit) for hit, _ in want.values()) > 5


def test_a_stream_stopped_before_its_mark_gives_the_same_table(spark, tmp_path, monkeypatch):
    for k in range(3):
        rows = [(10 * k + i, f"2024-01-{1 + i % 3:02d} 10:00:00") for i in range(6)] + [(100 + k, None)]
        spark.createDataFrame(rows, "id long, at string").selectExpr("id", "cast(at as timestamp) as `when`").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def start():
        stream = spark.readStream.schema("id long, when timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return files.stream_board_files(stream, str(tmp_path / "days"), str(tmp_path / "cp"))

    real = files._commit

    def dies(spark, path, number):
        if number == 1:
            raise RuntimeError("killed between write and mark")
        real(spark, path, number)

    monkeypatch.setattr(files, "_commit", dies)
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    assert files.read_board_files(spark, str(tmp_path / "days")).count() == 7  # the batch without a mark is not seen
    monkeypatch.setattr(files, "_commit", real)
    start().awaitTermination()
    rows = files.read_board_files(spark, str(tmp_path / "days")).collect()
    assert sorted(r["id"] for r in rows) == sorted([*(10 * k + i for k in range(3) for i in range(6)), 100, 101, 102])
    assert {r["service_date"] is None for r in rows if r["id"] >= 100} == {True} and len({r["service_date"] for r in rows}) == 4
