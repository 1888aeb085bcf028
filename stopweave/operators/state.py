"""Cache analysis: which requests a cache with a time to live would have answered."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def _pieces(events: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """``events`` with ``cell``, the stretch of ``ttl_ms`` they lie in, and the number of their piece of the key.

    Pieces lie ``ttl_ms`` or more apart, so no event can hit an anchor of another piece. Inside a cell all gaps are
    smaller; only each cell's ends, combined within each task, meet in a window.
    """
    events = events.withColumn("cell", F.floor(F.col("at") / F.lit(max(ttl_ms, 1))))
    ends = events.groupBy(key, "cell").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    order = Window.partitionBy(key).orderBy("cell")
    far = F.coalesce(F.col("lo") - F.lag("hi").over(order) >= ttl_ms, F.lit(True))
    cut = ends.withColumn("far", far.cast("long")).withColumn("piece", F.sum("far").over(order))
    cut = cut.select(F.col(key).alias("of"), F.col("cell").alias("in"), "piece")
    return events.join(cut, F.col(key).eqNullSafe(F.col("of")) & F.col("cell").eqNullSafe(F.col("in"))).drop("of", "in")


def cache_events(events: DataFrame, key: str, ts: str = "ts", id_col: str = "event_id", cacheable: str = "cacheable") -> DataFrame:
    """(key, at, id, keeps) of raw events."""
    return events.select(F.col(key).alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(cacheable), F.lit(False)).alias("keeps"))


def judged(known: DataFrame, ttl_ms: int, anchors: bool = False) -> DataFrame:
    """``known`` (from ``cache_events``) with ``hit``, and with ``anchors`` the id and time of the anchor after each event.

    Pieces of keys are dealt to the tasks, sorted there and streamed with the anchor alone as state, so no key is ever
    held whole.
    """
    ordered = _pieces(known, "key", ttl_ms).repartition("key", "piece").sortWithinPartitions("key", "piece", "at", "id", "keeps")

    def run(batches):
        now, anchor, owner = None, None, None
        for batch in batches:
            hits, found = [], []
            for k, piece, at, number, keeps in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "at", "id", "keeps")), strict=True):
                if now != (k, piece):
                    now, anchor, owner = (k, piece), None, None
                hit = at is not None and anchor is not None and at - anchor < ttl_ms
                if keeps and not hit:
                    anchor, owner = at, number
                hits.append(hit)
                found.append((owner, anchor))
            more = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)] if anchors and found else [pa.array([], pa.int64())] * 2 if anchors else []
            columns = [*(batch.column(c) for c in ("key", "at", "id", "keeps")), pa.array(hits, pa.bool_()), *more]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "id", "keeps", "hit", *added])

    added = ["anchor_id", "anchor"] if anchors else []
    schema = StructType([*(StructField(f.name, f.dataType) for f in known.schema), StructField("hit", BooleanType()), *(StructField(c, LongType()) for c in added)])
    return ordered.select("key", "piece", "at", "id", "keeps").mapInArrow(run, schema)


def ttl_hits(events: DataFrame, key: str, ttl_ms: int, ts: str = "ts", id_col: str = "event_id", cacheable: str = "cacheable") -> DataFrame:
    """(key, event_id, hit) of each event in time order.

    An event hits while less than ``ttl_ms`` have passed since the anchor of its key; a hit leaves the anchor where
    it is; a miss sets it if the event is cacheable.
    """
    return judged(cache_events(events, key, ts, id_col, cacheable), ttl_ms).select(F.col("key").alias(key), F.col("id").alias(id_col), "hit")


def request_cache_report(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy(key).agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("long")).alias("hits"))
