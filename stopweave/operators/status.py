"""Service status from a log of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.functions.transit import age_label, check_status
from stopweave.operators.state import cache_events, judged

#: How long a snapshot answers.
FRESH_MS = 30 * 60 * 1000


def latest_status(checks: DataFrame) -> DataFrame:
    """(system_id, status, last_checked): the last check of each system; of equal times the failed one counts."""
    last = checks.groupBy("system_id").agg(F.max(F.struct(F.col("checked_at").cast("timestamp").alias("at"), (~F.col("ok")).alias("failed"))).alias("m"))
    return last.select("system_id", check_status(~F.col("m.failed")).alias("status"), F.col("m.at").alias("last_checked"))


def status_board(systems: DataFrame, checks: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """All systems, those of ``extra`` after them, with their status or ``unknown``."""
    every = systems if extra is None else systems.unionByName(extra)
    return every.join(latest_status(checks), "system_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def status_report(systems: DataFrame, checks: DataFrame, as_of, extra: DataFrame | None = None) -> DataFrame:
    board = status_board(systems, checks, extra)
    return board.select("system_id", "status", age_label(F.col("last_checked"), as_of).alias("age"))


def freshness_gate(asks: DataFrame, key: str, max_age_ms: int = FRESH_MS, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """(key, event_id, kind, snapshot_id, at_ms): what a gate in front of the checks does, in the order of time and id.

    An ask is ``served`` from the snapshot of its key while that is younger than ``max_age_ms``; else it runs a
    ``check``, whose result is the new snapshot and has the ask's id. Each snapshot falls ``due`` once, when its age is
    reached, whether anybody asks then or not; that row's id is null. Asks without a time are left out.
    """
    known = cache_events(asks.withColumn("__asks", F.lit(True)), key, ts, id_col, "__asks").where("at is not null")
    told = judged(known, max_age_ms, anchors=True)
    due = F.struct(F.lit(None).cast("long").alias("id"), F.lit("due").alias("kind"), (F.col("at") + max_age_ms).alias("at"))
    own = F.struct("id", F.when(F.col("hit"), "served").otherwise("check").alias("kind"), "at")
    each = told.select("key", "anchor_id", F.explode(F.when(F.col("hit"), F.array(own)).otherwise(F.array(own, due))).alias("x"))
    return each.select(F.col("key").alias(key), F.col("x.id").alias(id_col), F.col("x.kind").alias("kind"), F.col("anchor_id").alias("snapshot_id"), F.col("x.at").alias("at_ms"))
