"""Golden cases of normalising and checking, and what reaches the scan."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stopweave.functions import transit as tr
from stopweave.operators import departures

NOW = datetime(2024, 1, 15, 12)
TEXT = "id int, scheduled_departure string, departure string, scheduled_track string, track string, headsign string, route_short_name string, mode string, agency_name string, cancelled boolean, trip_cancelled boolean, real_time boolean"


def test_a_time_that_is_none_does_not_fall_back(spark):
    at = "2024-01-15T12:00:00Z"
    times = [(at, "soon"), (at, ""), (at, None), (at, "2024-01-15T12:04:31Z"), ("soon", at), ("soon", "soon"), (None, None), ("", at)]
    raw = spark.createDataFrame([(i, a, b, *[None] * 9) for i, (a, b) in enumerate(times)], TEXT)
    known = departures.normalize_departures(raw, "id")
    got = {r["id"]: (r["when"] is not None, r["planned_when"] is not None, r["delay_minutes"]) for r in known.collect()}
    assert got == {0: (False, True, None), 1: (True, True, 0), 2: (True, True, 0), 3: (True, True, 5), 4: (True, False, None), 5: (False, False, None), 6: (False, False, None), 7: (True, False, None)}
    kept = departures.recent_departures(known, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 4, 7]


def test_services_are_told_by_any_white_space(spark):
    cases = [("IC Berlin", "INTERCITY"), ("NJ Wien", "INTERCITY"), ("re　Köln", "REGIONAL"), ("IC​Berlin", "BUS"), ("ICBerlin", "BUS"), ("rb﻿x", "REGIONAL"), ("ic\x0bx", "INTERCITY")]
    df = spark.createDataFrame([(h,) for h, _ in cases], "h string").withColumn("n", F.monotonically_increasing_id())
    assert [r[0] for r in df.orderBy("n").select(tr.detect_mode(F.col("h"), F.lit(None), F.lit("BUS"))).collect()] == [m for _, m in cases]


def test_requests_are_checked_by_their_kind(spark):
    rows = [(None, "50", "4", None), ("", "50", "4", "board"), ("A", None, None, None), ("A", "50", None, None), (None, "50", "4", "isochrones"), ("A", "50", "", "isochrones"), ("A", None, None, "isochrones"), (None, None, None, "plan")]
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, name string, lat string, lng string, action string")
    ok, bad = departures.split_valid_requests(requests)
    assert sorted(r["id"] for r in ok.collect()) == [2, 3, 4, 7] and sorted(r["id"] for r in bad.collect()) == [0, 1, 5, 6]
    assert sorted(r["id"] for r in departures.split_valid_requests(requests.drop("action"))[0].collect()) == [2, 3, 5, 6]


def test_the_scan_leaves_out_what_is_too_old(spark, tmp_path):
    rows = [(i, NOW + timedelta(seconds=30 * i - 3000), (NOW + timedelta(seconds=30 * i - 3000 + 60)) if i % 3 else None, *[None] * 9) for i in range(200)]
    schema = TEXT.replace("departure string", "departure timestamp")
    for kind in ("timestamp", "timestamp_ntz"):
        path = str(tmp_path / kind)
        df = spark.createDataFrame(rows, schema)
        df.withColumns({c: F.col(c).cast(kind) for c in ("departure", "scheduled_departure")}).sort("id").repartitionByRange(8, "id").write.parquet(path)
        as_of = F.lit(NOW).cast("timestamp")
        landed = departures.perhaps_recent(spark.read.parquet(path), as_of)
        plan = landed._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters:") :].split("]")[0]
        assert kind != "timestamp" or "Or(GreaterThan(departure" in pushed and "GreaterThan(scheduled_departure" in pushed, pushed
        exact = lambda df: {r["id"] for r in departures.recent_departures(departures.normalize_departures(df, "id"), as_of).collect()}
        assert exact(landed) == exact(spark.read.parquet(path)) and 0 < landed.count() < 200
    text = spark.createDataFrame([(1, "soon", "soon", *[None] * 9)], TEXT)
    assert departures.perhaps_recent(text, F.lit(NOW).cast("timestamp")).count() == 1
