import json
import math
import random

from pyspark.sql import functions as F

from stopweave.functions.text import fuzzy_match_score
from stopweave.operators import departures, geo, routing, search, state
from stopweave.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_json_sources_and_sinks(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and str(tmp_path / name)
    stations = files.read_stations(spark, put("s.json", {"countries": {"de": {"counts": {"total": 5}}, "fr": {"counts": None}, "pl": {}}}))
    assert sorted((r["country"], r["total"]) for r in stations.collect()) == [("de", 5), ("fr", None), ("pl", None)]
    assert files.read_operators(spark, put("o.json", {"operators": [{"id": "a"}, {"id": "b", "name": "B"}]})).count() == 2
    assert files.read_ports(spark, put("p.json", {})).count() == 0 and files.read_ferry_routes(spark, put("r.json", {"routes": []})).count() == 0
    raw = files.read_stop_times(spark, put("t.json", {"stopTimes": [{"headsign": "IC X", "place": {"departure": "2024-01-01T10:05:00Z", "scheduledDeparture": "2024-01-01T10:00:00Z", "track": "3", "scheduledTrack": ""}}, {"place": {"scheduledDeparture": "soon"}}]}))
    a, b = departures.normalize_departures(raw).collect()
    assert (a["delay_minutes"], a["platform"], a["mode"], a["cancelled"]) == (5, "3", "INTERCITY", False) and b["when"] is None
    board = departures.normalize_departures(raw).where("when is not null")
    files.write_board(board, str(tmp_path / "board"))
    assert spark.read.parquet(str(tmp_path / "board")).count() == 1


def brute(left, right, radius):
    def hav(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))

    return {(i, j): d for i, a, b in left for j, c, e in right if (d := hav(a, b, c, e)) <= radius}


def test_radius_join_equals_brute_force_without_nested_loops(spark):
    rng = random.Random(1)
    near = lambda: rng.choice([(89.99, rng.uniform(-180, 180)), (rng.uniform(-0.05, 0.05), rng.choice([179.99, -179.99])), (rng.uniform(50, 50.1), rng.uniform(4, 4.1))])
    left, right = [[(i, *near()) for i in range(n)] for n in (150, 200)]
    a = spark.createDataFrame(left + [(-1, None, 1.0)], "left_id long, left_lat double, left_lon double")
    b = spark.createDataFrame(right, "right_id long, right_lat double, right_lon double")
    other = geo.radius_join(a, b, 1500, spread="left")
    assert {(r["left_id"], r["right_id"]) for r in other.collect()} == set(brute(left, right, 1500))
    got = geo.radius_join(a, b, 1500)
    assert {(r["left_id"], r["right_id"]) for r in got.collect()} == set(brute(left, right, 1500))
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    nearest = {r["left_id"]: r["right_id"] for r in geo.nearest_stop(a, b).collect()}
    all_pairs = brute(left, right, 1e9)
    assert nearest == {i: min((d, j) for (k, j), d in all_pairs.items() if k == i)[1] for i, *_ in left}


def test_blocked_fuzzy_join_loses_nothing(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7)))
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(1, 3)))) for i in range(60)] + [(99, "a"), (98, "")], "query_id long, query string")
    t = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(1, 4)))) for i in range(80)], "target_id long, target string")
    for least in (1, 40, 50, 80):
        got = search.fuzzy_join(q, t, least)
        want = q.crossJoin(t).withColumn("score", fuzzy_match_score(F.col("query"), F.col("target"))).where(F.col("score") >= least)
        rows = [{(r["query_id"], r["target_id"], r["score"]) for r in df.collect()} for df in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) > 5 and "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_ttl_fold(spark):
    rng = random.Random(2)
    events = [(i, f"k{rng.randrange(3)}", rng.randrange(100_000), rng.random() < 0.8) for i in range(300)]
    df = spark.createDataFrame(events, "event_id long, key string, ms long, cacheable boolean").withColumn("ts", F.timestamp_millis("ms"))
    got = {r["event_id"]: r["hit"] for r in state.ttl_hits(df, "key", 1000).collect()}
    anchors, want = {}, {}
    for i, k, ms, keeps in sorted(events, key=lambda e: (e[2], e[0])):
        want[i] = k in anchors and ms - anchors[k] < 1000
        if not want[i] and keeps:
            anchors[k] = ms
    assert got == want


def test_reach_equals_dijkstra_and_grows(spark):
    rng = random.Random(3)
    calls = []
    for trip in range(60):
        at = rng.randrange(480, 560)
        for seq, stop in enumerate(rng.sample(range(15), 4)):
            calls.append((trip, seq, stop, at, at + 1, "FERRY"))
            at += rng.randrange(3, 15)
    rides = routing.rides(spark.createDataFrame(calls, "trip_id long, seq int, stop_id long, arr_min long, dep_min long, mode string"))
    flat = [tuple(r) for r in rides.collect()]
    origins = spark.createDataFrame([(0,), (1,)], "stop_id long")
    for minutes in (60, 120):
        got = {(r["origin"], r["stop_id"]): r["arrival"] for r in routing.reach(rides, origins, 480, minutes).collect()}
        for o in (0, 1):
            best, grew = {o: 480}, True
            while grew:
                grew = False
                for _, board, dep, alight, arr in flat:
                    if board in best and dep >= best[board] and arr <= 480 + minutes and arr < best.get(alight, 10**9):
                        best[alight], grew = arr, True
            assert {s: a for (p, s), a in got.items() if p == o} == best
    od = spark.createDataFrame([(1, 0, 5, 480)], "od_id long, origin long, destination long, depart_at int")
    full = {r["stop_id"]: r["arrival"] for r in routing.reach(rides, origins, 480, 1000, max_rides=3).where("origin = 0").collect()}
    found = routing.journeys(rides, od).orderBy("rank").collect()
    assert (found[0]["arrival"] if found else None) == full.get(5)
    for r in found:
        legs = r["legs"]
        assert legs[0]["board"] == 0 and legs[-1]["alight"] == 5 and len(legs) == r["rides"] and all(x["alight"] == y["board"] and x["arr_min"] <= y["dep_min"] for x, y in zip(legs, legs[1:], strict=False))
