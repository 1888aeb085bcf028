"""Landed files in, results out. Schemas are fixed, so a missing field is null; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopweave.plans.lineage import folder

STATIONS = "countries map<string, struct<counts: struct<total: bigint>>>"
PLACE = "scheduledDeparture: string, departure: string, scheduledTrack: string, track: string, cancelled: boolean, lat: double, lon: double"
STOP_TIMES = f"stopTimes array<struct<headsign: string, routeShortName: string, mode: string, agencyName: string, tripCancelled: boolean, realTime: boolean, place: struct<{PLACE}>>>"


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """One document in each file, or with ``lines`` one in each line, which splits over tasks."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_stations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(country, total); a country without counts has a null total."""
    return _json(spark, path, STATIONS, lines).select(F.explode("countries").alias("country", "v")).select("country", F.col("v.counts.total").alias("total"))


def _items(spark: SparkSession, path: str, field: str, item: str, lines: bool) -> DataFrame:
    return _json(spark, path, f"{field} array<struct<{item}>>", lines).select(F.explode(field).alias("x")).select("x.*")


def read_operators(spark: SparkSession, path: str, item: str = "id: string, name: string, country: string", lines: bool = False) -> DataFrame:
    return _items(spark, path, "operators", item, lines)


def read_ports(spark: SparkSession, path: str, item: str = "id: string, name: string, country: string", lines: bool = False) -> DataFrame:
    return _items(spark, path, "ports", item, lines)


def read_ferry_routes(spark: SparkSession, path: str, item: str = "id: string, name: string", lines: bool = False) -> DataFrame:
    return _items(spark, path, "routes", item, lines)


def read_stop_times(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Stop-times with flat, snake-case columns; a file without any gives no rows."""
    x = _json(spark, path, STOP_TIMES, lines).select(F.explode("stopTimes").alias("x")).where("x is not null")
    names = {"headsign": "headsign", "routeShortName": "route_short_name", "mode": "mode", "agencyName": "agency_name", "tripCancelled": "trip_cancelled", "realTime": "real_time", "place.scheduledDeparture": "scheduled_departure", "place.departure": "departure", "place.scheduledTrack": "scheduled_track", "place.track": "track", "place.cancelled": "cancelled", "place.lat": "lat", "place.lon": "lon"}
    return x.select(*(F.col(f"x.{a}").alias(b) for a, b in names.items()))


def read_status_checks(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema("system_id string, ok boolean, checked_at timestamp").parquet(path)


def read_search_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string, searched_at timestamp").parquet(path)


def write_board(board: DataFrame, path: str, form: str = "parquet") -> None:
    """Boards by the day of departure."""
    board.withColumn("service_date", F.to_date("when")).write.mode("overwrite").partitionBy("service_date").format(form).save(path)


def write_status(status: DataFrame, path: str) -> None:
    """The whole status table replaces the last one."""
    status.write.mode("overwrite").parquet(path)


def _commit(spark: SparkSession, path: str, number: int) -> None:
    where, fs = folder(spark, f"{path}/_commits/{number}")
    fs.create(where, True).close()


def _committed(spark: SparkSession, path: str) -> list[int]:
    where, fs = folder(spark, f"{path}/_commits")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(where)) if fs.exists(where) else []


def stream_board_files(rows: DataFrame, path: str, checkpoint: str):
    """Start a stream that writes rows with ``when`` by the day of departure; ``read_board_files`` has them, each once.

    A batch is a folder of its own in each day and counts once its mark is set, after all its files. A batch that was
    stopped anywhere before that is repeated by Spark and first removes what it left, so nothing is lost or doubled and
    no other batch's files are touched. Rows without a time are the day null.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where, fs = folder(spark, path)
        days = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith("service_date=")] if fs.exists(where) else []
        for day in days:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(day, f"batch={number}"), True)
        dated = batch.withColumns({"service_date": F.to_date("when"), "batch": F.lit(number)})
        dated.write.mode("append").partitionBy("service_date", "batch").parquet(path)
        _commit(spark, path, number)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def read_board_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished batches, with service_date and batch."""
    return spark.read.parquet(path).where(F.col("batch").isin(_committed(spark, path)))
