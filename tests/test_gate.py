import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopweave.operators import status
from stopweave.streaming.gate import stream_gate


def fold(asks, age):
    rows, held = [], {}
    for number, key, at in sorted((a for a in asks if a[2] is not None), key=lambda a: (a[2], a[0])):
        if key in held and at - held[key][1] < age:
            rows.append((key, number, "served", held[key][0], at))
        else:
            held[key] = (number, at)
            rows += [(key, number, "check", number, at), (key, None, "due", number, at + age)]
    return sorted(rows, key=str)


def rows(df):
    return sorted(((r["key"], r["event_id"], r["kind"], r["snapshot_id"], r["at_ms"]) for r in df.collect()), key=str)


def frame(spark, asks):
    return spark.createDataFrame(asks, "event_id long, key string, ms long").select("event_id", "key", F.timestamp_millis("ms").alias("ts"))


def test_gate_is_the_fold(spark):
    rng = random.Random(3)
    asks = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([rng.randrange(200_000), 1000 * rng.randrange(200)])) for i in range(800)] + [(900, "a", None)]
    got = status.freshness_gate(frame(spark, asks).repartition(7), "key", 9000)
    assert rows(got) == fold(asks, 9000)
    edge = [(1, "k", 0), (2, "k", 8999), (3, "k", 9000), (4, "k", 9000), (5, "k", 18_000)]
    assert rows(status.freshness_gate(frame(spark, edge), "key", 9000)) == fold(edge, 9000)
    assert status.freshness_gate(frame(spark, []), "key", 9000).collect() == []


def test_stream_gate_in_any_order_of_landings(spark, tmp_path):
    rng = random.Random(4)
    asks = [(i, f"k{rng.randrange(3)}", rng.randrange(300_000)) for i in range(300)]
    for name, order in (("forth", 1), ("back", -1)):
        for part in [asks[k::3] for k in range(3)][::order] + [[(-1, "end", 10**9)]]:
            frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema("event_id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        out = str(tmp_path / f"{name}_gate")
        stream_gate(stream, "key", 9000, late="1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}_state")).trigger(availableNow=True).start().awaitTermination()
        assert rows(spark.read.parquet(out).where("key <> 'end'")) == fold(asks, 9000)


def test_what_waits_is_held_as_bytes_and_told_in_parts(spark, tmp_path, monkeypatch):
    from stopweave.streaming import gate

    monkeypatch.setattr(gate, "ROWS", 50)
    assert [f.dataType.simpleString() for f in T._parse_datatype_string(gate._STATE).fields] == ["bigint", "bigint", "binary", "binary"]
    rng = random.Random(5)
    asks = [(i, "k", rng.randrange(100_000)) for i in range(2000)]
    for part in (asks[::2], asks[1::2], [(None, "end", 10**9)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_gate(stream, "key", 9000, late="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).where("key <> 'end'")) == fold(asks, 9000)
