"""The live board: stop-time observations as they arrive, written as changes and compacted by slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopweave.functions.transit import delay_minutes
from stopweave.operators.departures import normalize_departures
from stopweave.plans.jobs import station_boards
from stopweave.plans.lineage import finished, folder

#: What tells one departure from another; feeds carry no trip id. The mode and the times may change between observations.
DEPARTURE_KEY = ["planned_when", "direction", "line_name", "agency_name", "lat", "lon"]
#: Of observations of one departure and moment the greatest by these counts; null is least.
_TIES = ["observed_at", "when", "platform", "mode", "cancelled", "real_time"]
_FIELDS = "observed_at timestamp, lat double, lon double, when timestamp, planned_when timestamp, platform string, direction string, line struct<name: string, product: string>, mode string, agency_name string, cancelled boolean, real_time boolean, delay_minutes long"
#: Slices of the table, by a hash of the key, that are compacted each by itself, and bytes of changes that are left as they are.
SLICES, SMALL_BYTES = 16, 1 << 20


def live_departures(observations: DataFrame) -> DataFrame:
    """Normalised departures with the slice of their key; exact repeats are left out where they are put down.

    ``observed_at`` is part of the repeat: a departure that changes and changes back is told again.
    """
    df = normalize_departures(observations, "observed_at", "lat", "lon").drop("raw_mode")
    names = [F.col("line.name") if c == "line_name" else F.col(c) for c in DEPARTURE_KEY]
    return df.withColumn("slice", F.pmod(F.xxhash64(*names), F.lit(SLICES)).cast("int"))


def latest_observations(df: DataFrame) -> DataFrame:
    """The last observation of each departure; of several at one time the greatest by its fields.

    Rows move once, by ``slice``, and can be written by slice without moving again; what follows from other fields does
    not move with them.
    """
    keyed = df.withColumn("line_name", F.col("line.name")).drop("line", "delay_minutes").repartition(SLICES, "slice")
    order = Window.partitionBy("slice", *DEPARTURE_KEY).orderBy(*map(F.desc, _TIES))
    last = keyed.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    line = F.struct(F.col("line_name").alias("name"), F.col("mode").alias("product"))
    return last.withColumns({"line": line, "delay_minutes": delay_minutes(F.col("planned_when"), F.col("when"))}).select(df.columns)


def _without_repeats(last: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of which ``held`` has no equal, told by 128 bits of hashes, so rows of ``held`` move as these."""
    columns = [c for c in last.columns if c != "slice"]
    told = ["slice", "__a", "__b"]
    hashed = lambda df: df.withColumns({"__a": F.xxhash64(*columns), "__b": F.xxhash64(F.lit(1), F.struct(*(F.col(c).isNull() for c in columns)), *reversed(columns))})
    return hashed(last).join(hashed(held).select(*told).repartition(SLICES, "slice"), told, "left_anti").drop("__a", "__b")


def _not_gone(df: DataFrame, now, late: str) -> DataFrame:
    """Without departures that have left, seen from ``now``, and that nothing within ``late`` can speak of any more."""
    gone = (F.unix_millis("when") <= F.unix_millis(now) - 120_000) & (F.col("observed_at") < now - F.expr(f"interval {late}"))
    return df.where(~F.coalesce(gone, F.lit(False)))


def _bytes(spark: SparkSession, path: str) -> int:
    where, fs = folder(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def _bases(spark: SparkSession, path: str) -> dict[int, list[int]]:
    return {s: finished(spark, f"{path}/base/slice={s}", "version") for s in range(SLICES)}


def _seen(spark: SparkSession, path: str, slices: list[int], upto: int | None = None) -> DataFrame:
    """What some slices hold: their bases and the changes since, with ``slice``."""
    newest = {s: max((v for v in versions if upto is None or v <= upto), default=-1) for s, versions in _bases(spark, path).items() if s in slices}
    batches = [b for b in finished(spark, f"{path}/changes", "batch") if (upto is None or b <= upto) and b > min(newest.values())]
    schema = f"{_FIELDS}, batch long, slice int"
    out = spark.createDataFrame([], schema)
    if batches:
        since = F.create_map(*(F.lit(x) for s, v in newest.items() for x in (s, v)))
        read = spark.read.schema(schema).option("basePath", f"{path}/changes").parquet(*(f"{path}/changes/batch={b}" for b in batches))
        out = out.unionByName(read.where(F.col("slice").isin(slices) & (F.col("batch") > F.try_element_at(since, F.col("slice")))))
    for s, v in newest.items():
        if v >= 0:
            out = out.unionByName(spark.read.schema(_FIELDS).parquet(f"{path}/base/slice={s}/version={v}").withColumns({"batch": F.lit(v).cast("long"), "slice": F.lit(s)}))
    return out.drop("batch")


def read_live(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """The last observation of each departure that ``stream_board`` holds and that is not gone, seen from the latest one."""
    seen = _seen(spark, path, list(range(SLICES)))
    now = F.broadcast(seen.agg(F.max("observed_at").alias("now")))  # one row
    return _not_gone(latest_observations(seen).join(now), F.col("now"), late).drop("now", "slice")


def compact(spark: SparkSession, path: str, slices: list[int], number: int, late: str = "10 minutes") -> None:
    """New bases of some slices as of batch ``number``, written as one job without what is gone.

    The newest base before stays for readers; older ones and changes that all slices have in their bases go.
    """
    seen = _seen(spark, path, slices, number)
    now = seen.agg(F.max("observed_at")).first()[0]
    kept = _not_gone(latest_observations(seen), F.lit(now).cast("timestamp"), late)
    work = f"{path}/compacting={number}"
    kept.write.mode("overwrite").partitionBy("slice").parquet(work)
    for s in slices:
        source, fs = folder(spark, f"{work}/slice={s}")
        target, _ = folder(spark, f"{path}/base/slice={s}/version={number}")
        fs.delete(target, True)
        fs.mkdirs(target.getParent())
        if not fs.exists(source):
            fs.mkdirs(source)
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(source, "_SUCCESS")).close()
        fs.rename(source, target)
        for v in [v for v in finished(spark, f"{path}/base/slice={s}", "version") if v < number][:-1]:
            fs.delete(folder(spark, f"{path}/base/slice={s}/version={v}")[0], True)
    where, fs = folder(spark, work)
    fs.delete(where, True)
    oldest = min(v[-2] if len(v) > 1 else -1 for v in _bases(spark, path).values())
    for b in finished(spark, f"{path}/changes", "batch"):
        if b <= oldest:
            fs.delete(folder(spark, f"{path}/changes/batch={b}")[0], True)


def stream_board(observations: DataFrame, path: str, checkpoint: str, late: str = "10 minutes"):
    """Start the stream; each batch adds its last observations under ``path``, by slice, and rewrites nothing.

    Which observation is a departure's last is decided when the table is read or compacted, by the time of observation,
    so the order of arrival does not matter and a batch costs what it holds. Exact repeats are looked for among what is
    held since the batch's first observation, so the stream keeps no state. A slice whose changes have outgrown its base,
    or its first changes, is compacted, so over time what is written follows what changes. A repeated batch replaces its
    own changes.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = latest_observations(batch)
        since = batch.agg(F.min("observed_at")).first()[0]
        if since and (_bytes(spark, f"{path}/changes") or _bytes(spark, f"{path}/base")):
            held = _seen(spark, path, list(range(SLICES)), number - 1).where(F.col("observed_at") >= F.lit(since))
            last = _without_repeats(last, held)
        last.write.mode("overwrite").partitionBy("slice").parquet(f"{path}/changes/batch={number}")
        batches, grown = finished(spark, f"{path}/changes", "batch"), []
        for s, versions in _bases(spark, path).items():
            base = max((v for v in versions if v < number), default=-1)
            sizes = [_bytes(spark, f"{path}/changes/batch={b}/slice={s}") for b in batches if base < b <= number]
            first = _bytes(spark, f"{path}/base/slice={s}/version={base}") if base >= 0 else sizes.pop(0)
            if sum(sizes) > max(SMALL_BYTES, first):
                grown.append(s)
        if grown:
            compact(spark, path, grown, number, late)

    return live_departures(observations).writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def live_boards(spark: SparkSession, path: str, stations: DataFrame, as_of, radius_m: float = 1500.0, n: int = 200, late: str = "10 minutes") -> DataFrame:
    """Boards of all stations from the live departures: departed ones dropped, the first ``n`` of each station by time."""
    live = read_live(spark, path, late).withColumns({"at_lat": F.col("lat"), "at_lon": F.col("lon")})
    board = station_boards(live, stations, as_of, radius_m, n, ("agency_name", "planned_when", "at_lat", "at_lon"))
    return board.select("stop_id", "position", *(c for c in live.columns if c not in ("lat", "lon", "at_lat", "at_lon")), F.col("at_lat").alias("lat"), F.col("at_lon").alias("lon"))


#: Keys that the running count is spread over.
COUNTERS = 16


def stream_journey_count(log: DataFrame) -> DataFrame:
    """A running count of searches in COUNTERS parts (part, journeys), for an output mode of complete or update.

    A search goes to a part by a hash of all its columns; each task adds up its parts before the shuffle.
    """
    part = F.pmod(F.xxhash64(*log.columns), F.lit(COUNTERS)).cast("int").alias("part")
    return log.groupBy(part).agg(F.count("*").alias("journeys"))


def count_journeys(log: DataFrame, path: str, checkpoint: str):
    """Start the count; each batch puts down the parts that changed, and a repeated batch replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream_journey_count(log).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def read_journey_count(spark: SparkSession, path: str) -> DataFrame:
    """One row with the number of journeys: the last count of each part."""
    done = finished(spark, path, "batch")
    schema = "part int, journeys long, batch long"
    rows = spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/batch={b}" for b in done)) if done else spark.createDataFrame([], schema)
    return rows.groupBy("part").agg(F.max_by("journeys", "batch").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("journeys"))
