import random

from oracle import TABLES, same_rows
from pyspark.sql import functions as F

from stopweave.operators import state
from stopweave.queries import ORACLES, QUERIES


def test_ttl_fold_holds_no_key_whole(spark):
    rng = random.Random(6)
    events, at = [], 0
    for i in range(3000):  # one key has most rows; gaps around the time to live, ties, and long breaks
        at += rng.choice([0, 0, 1, 7, 300, 999, 1000, 1001, 5000])
        events.append((i, rng.choice(["hot"] * 8 + ["b", None]), at, rng.choice([True, True, False, None])))
    events += [(-1, "b", None, True), (-2, None, None, False)]
    df = spark.createDataFrame(events, "event_id long, key string, ms long, cacheable boolean").withColumn("ts", F.timestamp_millis("ms"))
    hits = state.ttl_hits(df, "key", 1000)
    anchors, want = {}, {}
    for i, k, ms, keeps in sorted(events, key=lambda e: (-1 if e[2] is None else e[2], e[0])):
        want[i] = ms is not None and anchors.get(k) is not None and ms - anchors[k] < 1000
        if not want[i] and keeps:
            anchors[k] = ms
    rows = hits.collect()
    assert {r["event_id"]: r["hit"] for r in rows} == want and len(rows) == len(events)
    assert {r["event_id"]: r["key"] for r in rows} == {e[0]: e[1] for e in events}
    assert "collect_list" not in hits._jdf.queryExecution().toString()  # an array of all events of a key is one row in one task


def test_stream_equals_batch_in_any_order_of_batches(spark, tmp_path):
    from stopweave.streaming.ttl import stream_ttl_hits

    rng = random.Random(6)
    events = [(i, f"k{rng.randrange(4)}", rng.randrange(400_000), rng.random() < 0.8) for i in range(400)]
    schema = "event_id long, key string, ts timestamp, cacheable boolean"
    frame = lambda rows: spark.createDataFrame(rows, "event_id long, key string, ms long, cacheable boolean").selectExpr("event_id", "key", "timestamp_millis(ms) as ts", "cacheable")
    want = {r["event_id"]: r["hit"] for r in state.ttl_hits(frame(events), "key", 9000).collect()}
    for name, order in (("forth", 1), ("back", -1)):
        for part in [events[k::3] for k in range(3)][::order] + [[(-1, "end", 10**9, False)]]:
            frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        hits = stream_ttl_hits(stream, "key", 9000, late="1 hour")
        hits.writeStream.format("parquet").option("path", str(tmp_path / f"{name}_hits")).option("checkpointLocation", str(tmp_path / f"{name}_state")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(str(tmp_path / f"{name}_hits")).collect()
        assert {r["event_id"]: r["hit"] for r in rows} == want and len(rows) == len(events)


def test_stream_query_takes_a_landing_of_many_files_whole(spark, sf_dir, tmp_path):
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(12).write.parquet(str(tmp_path / "files"))
    (tmp_path / "events.parquet").mkdir()
    for n, x in enumerate(sorted((tmp_path / "files").glob("*.parquet"))):
        x.rename(tmp_path / "events.parquet" / f"{n}.parquet")
    sql = ORACLES["t1_stream_ttl_hits"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert same_rows(QUERIES["t1_stream_ttl_hits"](spark, str(tmp_path)), sql, sf_dir) == 1000
