"""Departures: normalisation, filters and boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopweave.functions.transit import RAIL_MODES, delay_minutes, detect_mode, falsy_coalesce
from stopweave.functions.text import request_key


def normalize_departures(raw: DataFrame, *keep: str) -> DataFrame:
    """Flat stop-times as departures; ``keep`` names columns that pass through.

    Without real-time data the scheduled time counts as the actual one, so the delay is 0 and not null. The scheduled
    platform wins over the actual one. The actual time is chosen before it is read, so one that is given but can't be
    parsed is null, and the delay with it; the scheduled time does not stand in for it.
    """
    time = lambda c: c.try_cast("timestamp")
    given = lambda c: falsy_coalesce(F.col(c)) if dict(raw.dtypes)[c] == "string" else F.col(c)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    mode = detect_mode(F.col("headsign"), F.col("route_short_name"), F.col("mode"))
    timed = raw.withColumns({"__planned": time(F.col("scheduled_departure")), "__when": time(F.coalesce(given("departure"), given("scheduled_departure")))})
    return timed.select(
        *keep,
        F.col("__when").alias("when"),
        F.col("__planned").alias("planned_when"),
        falsy_coalesce(F.col("scheduled_track"), F.col("track")).alias("platform"),
        text("headsign").alias("direction"),
        F.struct(text("route_short_name").alias("name"), mode.alias("product")).alias("line"),
        mode.alias("mode"),
        F.col("mode").alias("raw_mode"),
        text("agency_name").alias("agency_name"),
        (flag("cancelled") | flag("trip_cancelled")).alias("cancelled"),
        flag("real_time").alias("real_time"),
        delay_minutes(F.col("__planned"), F.col("__when")).alias("delay_minutes"),
    )


def perhaps_recent(raw: DataFrame, as_of, grace_s: int = 120) -> DataFrame:
    """Flat stop-times without those that ``recent_departures`` is bound to drop, in a form that reaches a Parquet scan.

    Whichever of its two times counts as the actual one, a recent row has one of them within the grace; row groups whose
    statistics have none are not read. Times that are still text can't be compared and stay.
    """
    kinds = dict(raw.dtypes)
    since = as_of - F.expr(f"interval {grace_s} seconds")
    if any(not kinds[c].startswith("timestamp") for c in ("departure", "scheduled_departure")):
        return raw
    later = lambda c: F.col(c) > since.cast(kinds[c])  # noqa: E731  the literal is cast, a cast column would not be pushed
    return raw.where(later("departure") | later("scheduled_departure"))


def recent_departures(df: DataFrame, as_of, grace_s: int = 120) -> DataFrame:
    """Departures later than ``as_of`` less the grace, strictly; rows without a time go."""
    return df.where(F.unix_millis("when") > F.unix_millis(as_of) - grace_s * 1000)


def filter_modes(df: DataFrame, modes=RAIL_MODES, mode_col: str = "mode") -> DataFrame:
    """By the feed's own mode, which reaches the scan as a pushed filter."""
    return df.where(F.col(mode_col).isin(list(modes)))


def flag_delayed(df: DataFrame, threshold: int = 0) -> DataFrame:
    return df.withColumn("delayed", F.coalesce(F.col("delay_minutes") > threshold, F.lit(False)))


def board_status(stops: DataFrame, board: DataFrame, key: str = "stop_id") -> DataFrame:
    """Each stop with its number of departures, or ``no departures``."""
    counts = board.groupBy(key).agg(F.count("*").alias("departures"))
    n = F.coalesce("departures", F.lit(0))
    return stops.join(counts, key, "left").select(key, n.alias("departures"), F.when(n == 0, "no departures").otherwise("ok").alias("status"))


def split_valid_requests(requests: DataFrame, action: str = "action") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by kind of request; an empty string is no value.

    A request for ``isochrones`` needs both coordinates, one for a ``plan`` is passed on as it is, and every other one
    (null, or no such column) asks for a board and needs a name, whatever its coordinates.
    """
    given = lambda c: falsy_coalesce(F.col(c)).isNotNull()
    kind = F.coalesce(F.col(action), F.lit("")) if action in requests.columns else F.lit("")
    ok = F.when(kind == "isochrones", given("lat") & given("lng")).when(kind == "plan", True).otherwise(given("name"))
    return requests.where(ok), requests.where(~ok)


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Requests with their key and with the departure time under either of its names."""
    names = [F.col(c) for c in ("departure_time", "time") if c in requests.columns]
    out = requests.withColumn("request_key", request_key(F.col("name"), F.col("lat"), F.col("lng")))
    return out.withColumn("depart_at", F.coalesce(falsy_coalesce(*names), F.lit(""))) if names else out


def top_departures(df: DataFrame, key: str | list[str] = "stop_id", n: int = 200, ties: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """The first n departures of each stop, or other ``key``, by time, then line and direction, then ``ties``; nulls come last."""
    order = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*map(F.asc_nulls_last, ("when", "line.name", "direction", *ties)))
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
