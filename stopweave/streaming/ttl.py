"""Cache analysis as a stream: the rule of ``operators.state.ttl_hits`` on events that arrive out of order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from stopweave.operators.state import cache_events, judged
from stopweave.plans.lineage import finished, folder

_STATE = "anchor long, at array<long>, id array<long>, keeps array<boolean>"


def stream_ttl_hits(events: DataFrame, key: str, ttl_ms: int, ts: str = "ts", id_col: str = "event_id", cacheable: str = "cacheable", late: str = "10 minutes") -> DataFrame:
    """A stream of (key, event_id, hit), the same rows as the batch form for events that come no later than ``late``.

    The state of a key is its anchor and the events that the watermark has not passed: an event is judged, in order of
    time and id, once nothing earlier can arrive. So a key holds no more than ``late`` of its events at a time. A key
    is forgotten when its events are judged and its anchor is too old to be hit. Events behind the watermark are
    dropped by Spark and events without a time are never judged; ``stream_cache_hits`` tells of both.
    """
    when = F.col(ts).cast("timestamp")
    known = events.select(F.col(key).alias("key"), when.alias("seen"), F.unix_millis(when).alias("at"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(cacheable), F.lit(False)).alias("keeps"))
    known = known.where("seen is not null").withWatermark("seen", late)

    def judge(group, frames, state: GroupState):
        anchor, *held = state.get if state.exists else (None, [], [], [])
        waiting = list(zip(*held, strict=True))
        for frame in frames:
            waiting += zip(frame["at"].tolist(), frame["id"].tolist(), frame["keeps"].tolist(), strict=True)
        waiting.sort()
        edge = state.getCurrentWatermarkMs()
        done, rows = 0, []
        for at, number, keeps in waiting:
            if at >= edge:
                break
            hit = anchor is not None and at - anchor < ttl_ms
            if keeps and not hit:
                anchor = at
            rows.append((group[0], number, hit))
            done += 1
        waiting = waiting[done:]
        if waiting or anchor is not None and anchor + ttl_ms > edge:
            state.update((anchor, *([x[k] for x in waiting] for k in range(3))))
            state.setTimeoutTimestamp(max(edge, waiting[0][0] if waiting else anchor + ttl_ms) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=[key, id_col, "hit"])

    out = StructType([StructField(key, known.schema["key"].dataType), StructField(id_col, LongType()), StructField("hit", BooleanType())])
    return known.groupBy("key").applyInPandasWithState(judge, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _state(spark: SparkSession, path: str, before: int | None = None):
    """(waiting, anchors, latest time seen) as of the last finished batch, below ``before`` if that is given; else Nones."""
    known = [v for v in finished(spark, f"{path}/state", "version") if before is None or v < before]
    if not known:
        return None, None, None
    at = f"{path}/state/version={known[-1]}"
    return spark.read.parquet(f"{at}/waiting"), spark.read.parquet(f"{at}/anchors"), spark.read.parquet(f"{at}/latest").first()[0]


def _with_anchors(events: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """Events with the anchors of their keys before them, as events without an id that keep."""
    if anchors is None:
        return events
    return events.unionByName(anchors.select("key", "at", F.lit(None).cast("long").alias("id"), F.lit(True).alias("keeps")))


def stream_cache_hits(events: DataFrame, path: str, checkpoint: str, key: str, ttl_ms: int, ts: str = "ts", id_col: str = "event_id", cacheable: str = "cacheable", late: str = "10 minutes"):
    """Start a stream that judges every event or says that it came too late; ``read_cache_hits`` has its rows.

    The stream owns its watermark: the latest time of all batches so far less ``late``. An event below the watermark of
    the batches before its own is late: it is put out as such and moves no anchor. All others wait until the watermark
    has passed them and are judged in the order of time by the batch operator, with each key's anchor before them; events
    without a time are judged at once and never hit. What waits and the anchors that can still be hit are put down as a
    version for each batch, so a repeated batch starts from the same state and replaces its own rows. The two newest
    versions are kept.
    """
    allowed = int(pd.Timedelta(late).total_seconds() * 1000)

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting, anchors, latest = _state(spark, path, number)
        known = cache_events(batch, key, ts, id_col, cacheable)
        passed = F.coalesce(F.col("at") < (latest - allowed), F.lit(False)) if latest is not None else F.lit(False)
        arrived = f"{path}/work/batch={number}"
        known.withColumn("late", passed).write.mode("overwrite").parquet(arrived)
        arrived = spark.read.parquet(arrived)
        newest = arrived.agg(F.max("at")).first()[0]
        latest = max((x for x in (latest, newest) if x is not None), default=None)
        fresh = arrived.where("not late").drop("late")
        waiting = fresh if waiting is None else waiting.unionByName(fresh)
        ready = F.col("at").isNull() | (F.col("at") < (latest - allowed)) if latest is not None else F.col("at").isNull()
        done = judged(_with_anchors(waiting.where(ready), anchors), ttl_ms).withColumn("late", F.lit(False))
        told = arrived.where("late").withColumn("hit", F.lit(None).cast("boolean"))
        done.unionByName(told).write.mode("overwrite").parquet(f"{path}/hits/batch={number}")
        done = spark.read.parquet(f"{path}/hits/batch={number}").where("not late and keeps and not hit and at is not null")
        at = f"{path}/state/version={number}"
        waiting.where(~ready).write.mode("overwrite").parquet(f"{at}/waiting")
        last = done.groupBy("key").agg(F.max("at").alias("at"))
        last.where(F.col("at") + ttl_ms > (latest - allowed if latest is not None else 0)).write.mode("overwrite").parquet(f"{at}/anchors")
        spark.createDataFrame([(latest,)], "latest long").write.mode("overwrite").parquet(f"{at}/latest")
        where, fs = folder(spark, f"{at}/_SUCCESS")
        fs.create(where, True).close()
        old = [f"state/version={v}" for v in finished(spark, f"{path}/state", "version") if v < number - 1]
        for name in [*old, f"work/batch={number}"]:
            where, fs = folder(spark, f"{path}/{name}")
            fs.delete(where, True)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def read_cache_hits(spark: SparkSession, path: str, ttl_ms: int, ended: bool = False) -> DataFrame:
    """(key, id, hit, late) of the finished batches; with ``ended`` also what still waits, judged as if nothing more came."""
    waiting, anchors, _ = _state(spark, path)
    batches = finished(spark, f"{path}/state", "version")
    rows = spark.read.parquet(f"{path}/hits").where((F.col("batch") <= (batches[-1] if batches else -1)) & (F.col("id").isNotNull() | F.col("late")))
    rows = rows.select("key", "id", "hit", "late")
    if ended and waiting is not None:
        rest = judged(_with_anchors(waiting, anchors), ttl_ms).where("id is not null")
        rows = rows.unionByName(rest.select("key", "id", "hit", F.lit(False).alias("late")))
    return rows
