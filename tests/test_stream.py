from datetime import datetime, timedelta

import pytest
from oracle import same_rows

from stopweave.queries import ORACLES, QUERIES
from stopweave.streaming import board

NOW = datetime(2024, 1, 15)
SCHEMA = "observed_at timestamp, scheduled_departure timestamp, departure timestamp, scheduled_track string, track string, headsign string, route_short_name string, mode string, agency_name string, cancelled boolean, trip_cancelled boolean, real_time boolean, lat double, lon double"


def seen(minute, trip, leaves, track="1", mode="BUS"):
    at = lambda m: NOW + timedelta(minutes=m)
    return (at(minute), at(trip), at(leaves), track, None, "X", "R1", mode, "A", False, False, True, 50.0, 4.0)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_boards_do_not_depend_on_the_order_of_arrival(spark, tmp_path, order):
    landings = [[seen(0, 30, 30), seen(0, 40, 40)], [seen(5, 30, 33, "2", "TRAM"), seen(5, 50, 50)], [seen(9, 40, 8), seen(9, 30, 35, "3")]]
    for n in order:
        spark.createDataFrame(landings[n], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    board.stream_board(stream, str(tmp_path / "live"), str(tmp_path / "state")).awaitTermination()
    live = board.read_live(spark, str(tmp_path / "live"))
    assert sorted((r["planned_when"].minute, r["when"].minute, r["platform"]) for r in live.collect()) == [(30, 35, "3"), (40, 8, "1"), (50, 50, "1")]
    stations = spark.createDataFrame([(1, 50.001, 4.0), (2, 60.0, 4.0)], "stop_id long, lat double, lon double")
    rows = board.live_boards(spark, str(tmp_path / "live"), stations, board.F.lit(NOW + timedelta(minutes=20))).orderBy("position").collect()
    assert [(r["stop_id"], r["position"], r["when"].minute) for r in rows] == [(1, 1, 35), (1, 2, 50)]


def test_departed_rows_leave_the_table(spark, tmp_path):
    for n, rows in enumerate([[seen(0, 1, 1), seen(0, 90, 90)], [seen(30, 95, 95)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    board.stream_board(stream, str(tmp_path / "live"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["planned_when"].minute for r in board.read_live(spark, str(tmp_path / "live")).collect()) == [30, 35]
    assert board.read_live(spark, str(tmp_path / "none")).count() == 0


def test_board_where_keys_differ_in_mode_only(spark):
    sf = "/root/testdata/sf0.01"
    assert same_rows(QUERIES["t3_stream_board"](spark, sf), ORACLES["t3_stream_board"], sf) > 100


def test_what_changes_and_changes_back_is_told_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(board, "SMALL_BYTES", 0)  # every slice that changes is compacted
    landings = [[seen(0, 30, 30, "1"), seen(0, 40, 40)], [seen(1, 30, 30, "2"), seen(1, 50, 50), seen(0, 30, 30, "1")], [seen(2, 30, 30, "1")], [seen(2, 30, 30, "1"), seen(1, 30, 30, "9")]]
    written = []
    for rows in landings:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        board.stream_board(stream, str(tmp_path / "live"), str(tmp_path / "state")).awaitTermination()
        live = {r["planned_when"].minute: r["platform"] for r in board.read_live(spark, str(tmp_path / "live")).collect()}
        written.append(live)
    assert written == [{30: "1", 40: "1"}, {30: "2", 40: "1", 50: "1"}, {30: "1", 40: "1", 50: "1"}, {30: "1", 40: "1", 50: "1"}]


def test_a_batch_writes_its_changes_only(spark, tmp_path):
    many = [seen(0, 30 + i, 30 + i) for i in range(300)]
    for rows in (many, [seen(1, 30, 31)], [seen(1, 30, 31)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        board.stream_board(stream, str(tmp_path / "live"), str(tmp_path / "state")).awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "live" / "changes"))
    assert sorted(r["count"] for r in changes.groupBy("batch").count().collect()) == [1, 300]
    before = sorted(map(str, board.read_live(spark, str(tmp_path / "live")).collect()))
    board.compact(spark, str(tmp_path / "live"), list(range(board.SLICES)), 9)
    assert sorted(map(str, board.read_live(spark, str(tmp_path / "live")).collect())) == before and len(before) == 300


def test_a_stream_keeps_no_state_and_a_first_batch_is_written_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(board, "SMALL_BYTES", 0)
    many = [seen(0, 30 + i, 30 + i) for i in range(300)]
    spark.createDataFrame(many + many, SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    board.stream_board(stream, str(tmp_path / "live"), str(tmp_path / "checkpoint")).awaitTermination()
    assert not (tmp_path / "checkpoint" / "state").exists() and not (tmp_path / "live" / "base").exists()
    assert len(list((tmp_path / "live" / "changes").rglob("*.parquet"))) <= board.SLICES
    assert board.read_live(spark, str(tmp_path / "live")).count() == 300


def test_repeats_are_equal_in_nulls_too(spark):
    rows = lambda *x: spark.createDataFrame([(0, *r) for r in x], "slice int, a string, b string, c long")
    last = rows(("x", None, 1), (None, "x", 1), (None, None, 2), ("y", "y", None))
    held = rows(("x", None, 1), (None, None, 2), ("y", None, None))
    assert sorted(map(str, board._without_repeats(last, held).collect())) == sorted(map(str, rows((None, "x", 1), ("y", "y", None)).collect()))
