"""Hot cubes and hot keys: dealt out, with the same result."""

import hashlib
import random

from pyspark.sql import functions as F
from test_operators import brute, plan

from stopweave.operators import catalogue, geo


def test_a_crowded_cube_is_dealt_out(spark):
    rng = random.Random(5)
    stops = [(i, 50 + rng.uniform(-0.03, 0.03), 4 + rng.uniform(-0.03, 0.03)) for i in range(60)]
    points = [(i, 50.0, 4.0) for i in range(400)] + [(400 + i, 50 + rng.uniform(-0.05, 0.05), 4 + rng.uniform(-0.05, 0.05)) for i in range(400)] + [(900, None, 4.0)]
    left = spark.createDataFrame(stops, "left_id long, left_lat double, left_lon double")
    right = spark.createDataFrame(points, "right_id long, right_lat double, right_lon double")
    want = set(brute(stops, points[:-1], 1500))
    for side in ("left", "right"):
        got = geo.radius_join(left, right, 1500, spread=side, crowded_rows=20)
        rows = [(r["left_id"], r["right_id"]) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want and "Cartesian" not in plan(got)
    placed = geo._placed(right, "right", 1500)
    own, each = geo._dealt(placed, geo._placed(left, "left", 1500), 20)
    groups = own.groupBy("cx", "cy", "cz", "deal").count()
    assert own.count() == 800 and groups.agg(F.max("count")).first()[0] < 50  # one place has 400 rows


def test_picks_by_key_are_those_of_the_least_hashes(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}" if i % 2 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "stop_id long, country string").repartition(6)
    for n in (1, 4):
        want = []
        for key in {k for _, k in rows}:
            want += sorted((i for i, k in rows if k == key), key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))[:n]
        assert sorted(r["stop_id"] for r in catalogue.surprise_each(df, "country", 3, n).collect()) == sorted(want)


def test_rows_of_one_place_are_joined_as_lists(spark, monkeypatch):
    monkeypatch.setattr(geo, "LIST_ROWS", 7)
    rng = random.Random(6)
    stops = [(i, 50.0 + i % 5 * 0.01, 4.0) for i in range(40)] + [(90, None, 4.0)]
    points = [(i, 50.0 + i % 3 * 0.01 + 0.001, 4.0) for i in range(900)] + [(1000 + i, 50 + rng.uniform(-0.05, 0.05), 4.0) for i in range(20)] + [(1900, 50.0, None)]
    left = spark.createDataFrame(stops, "left_id long, left_lat double, left_lon double")
    right = spark.createDataFrame(points, "right_id long, right_lat double, right_lon double")
    want = set(brute(stops[:-1], points[:-1], 1500))
    far = {(r["left_id"], r["right_id"]): r["distance_m"] for r in geo.radius_join(left, right, 1500).collect()}
    for side in ("left", "right"):
        got = geo.radius_join(left, right, 1500, spread=side, crowded_rows=100, digits=1)
        rows = [tuple(r) for r in got.collect()]
        assert got.columns == [*left.columns, *right.columns, "distance_m"] and len(rows) == len(want) and {(r[0], r[3]) for r in rows} == want
        assert all(abs(r[6] - far[r[0], r[3]]) < 0.0501 and round(r[6], 1) == r[6] for r in rows)
        text = plan(got)
        assert text.index("Generate inline") < text.index("ASIN")  # pairs are made after the distance
    lists = geo._listed(geo._placed(right, "right", 1500), "right").select(F.size("rows").alias("n"))
    assert lists.agg(F.sum("n"), F.max("n")).first()[:] == (920, 7) and lists.count() < 300


def test_rows_move_once_and_meet_only_cubes_in_reach(spark):
    rng = random.Random(7)
    for at, radius, apart in (((0.0, 0.0), 1500, 0.02), ((50.0, 4.0), 50, 0.0008), ((-33.0, 179.999), 1500, 0.03), ((89.999, 10.0), 1500, 0.02), ((10.0, -70.0), 3_000_000, 60.0)):
        near = lambda i: (i, max(-90.0, min(90.0, at[0] + rng.uniform(-apart, apart))), at[1] + rng.uniform(-apart, apart))  # noqa: B023, E731
        stops, points = [near(i) for i in range(40)], [near(i) for i in range(150)]
        left = spark.createDataFrame(stops, "left_id long, left_lat double, left_lon double")
        right = spark.createDataFrame(points, "right_id long, right_lat double, right_lon double")
        got = geo.radius_join(left, right, radius, spread="left", crowded_rows=20)
        rows = [(r["left_id"], r["right_id"]) for r in got.collect()]
        assert rows and len(rows) == len(set(rows)) and set(rows) == set(brute(stops, points, radius))
        assert geo._around(geo._placed(left, "left", radius), "left", radius).count() <= 16 * len(stops)  # of 27
    text = plan(geo.radius_join(left, right, 1500, spread="left"))
    assert "Window" not in text and text.count("REPARTITION_BY_NUM") == 1
    moved = [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "cx" in x and "deal" in x]
    assert len(moved) == 2  # both sides by cube and deal
