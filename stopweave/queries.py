"""The registered transit queries and their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stopweave.fixtures import view, with_views
from stopweave.functions import text as tx
from stopweave.functions import transit as tr
from stopweave.operators import catalogue, departures, geo, routing, search, state, status
from stopweave.plans.jobs import departures_board
from stopweave.plans.lineage import checkpoint_folder, put_down
from stopweave.sources import files

QUERIES, ORACLES = {}, {}
AS_OF = "2024-01-15 00:00:00"


def _query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _deps(spark, d):
    return departures.normalize_departures(view(spark, d, "departures_raw"), "event_id", "lat", "lon")


def _ms(c):
    return F.unix_millis(c)


# The normalised departure in DuckDB
_SAID = "lower(coalesce(headsign, '') || ' ' || coalesce(route_short_name, ''))"


def _said(patterns):
    """Whether one of the patterns occurs; DuckDB has no look-around, so the letter beside a word is matched too.

    White space is spelt out by code points.
    """
    spaces = "[" + re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", tx.SPACES) + "]"
    own = "|".join(patterns).replace(tr.SPACE, spaces).replace("(?<![a-z0-9_])", "(^|[^a-z0-9_])").replace("(?![a-z0-9_])", "($|[^a-z0-9_])")
    return f"regexp_matches({_SAID}, '{own}')"


_NORMAL = f"""n AS (SELECT event_id, lat, lon, scheduled_departure AS planned_when, coalesce(departure, scheduled_departure) AS when_,
  coalesce(nullif(scheduled_track, ''), nullif(track, '')) AS platform, coalesce(headsign, '') AS direction, coalesce(route_short_name, '') AS line_name,
  CASE WHEN {_said(tr.INTERCITY)} THEN 'INTERCITY' WHEN {_said(tr.REGIONAL)} THEN 'REGIONAL'
    WHEN mode IN ('LONG_DISTANCE', 'HIGHSPEED_RAIL', 'NIGHT_RAIL') THEN 'INTERCITY' WHEN mode = 'REGIONAL_RAIL' THEN 'REGIONAL' ELSE mode END AS mode,
  mode AS raw_mode, coalesce(agency_name, '') AS agency_name, coalesce(cancelled, false) OR coalesce(trip_cancelled, false) AS cancelled, coalesce(real_time, false) AS real_time,
  CAST(floor(((epoch_us(coalesce(departure, scheduled_departure)) // 1000) - (epoch_us(scheduled_departure) // 1000)) / 60000.0 + 0.5) AS BIGINT) AS delay_minutes FROM departures_raw)"""
_LIVE = f"(epoch_us(when_) // 1000) > (epoch_us(TIMESTAMP '{AS_OF}') // 1000) - 120000"
_HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin((radians({1}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin((radians({3}) - radians({2})) / 2), 2))))"


def _hav(a, b, c, d):
    return _HAV.format(a, b, c, d)


@_query(f"WITH {_NORMAL} SELECT event_id, (epoch_us(when_) // 1000) AS when_ms, (epoch_us(planned_when) // 1000) AS planned_ms, platform, direction, line_name, mode, agency_name, cancelled, real_time, delay_minutes FROM n", "departures_raw")
def p1_normalize_departures(spark, d):
    return _deps(spark, d).select("event_id", _ms("when").alias("when_ms"), _ms("planned_when").alias("planned_ms"), "platform", "direction", F.col("line.name").alias("line_name"), "mode", "agency_name", "cancelled", "real_time", "delay_minutes")


@_query(f"WITH {_NORMAL} SELECT event_id, (epoch_us(when_) // 1000) AS when_ms FROM n WHERE {_LIVE}", "departures_raw")
def p6_recent_departures(spark, d):
    """Landed stop-times; the scan leaves out row groups that are too old, the exact filter comes after."""
    path = f"{_shared(spark)}/stop_times"
    view(spark, d, "departures_raw").select("*", F.coalesce("departure", "scheduled_departure").alias("by")).sort("by").drop("by").write.parquet(path)
    landed = departures.perhaps_recent(spark.read.parquet(path), _as_of())
    known = departures.normalize_departures(landed, "event_id", "lat", "lon")
    return departures.recent_departures(known, _as_of()).select("event_id", _ms("when").alias("when_ms"))


_MODES = ", ".join(f"'{m}'" for m in tr.RAIL_MODES)


@_query(f"SELECT event_id, mode FROM departures_raw WHERE mode IN ({_MODES})", "departures_raw")
def p7_filter_modes(spark, d):
    return departures.filter_modes(view(spark, d, "departures_raw")).select("event_id", "mode")


@_query("SELECT event_id, event_id % 5 <> 1 AS known, event_id % 5 NOT IN (1, 3) AS known_strict FROM departures_raw", "departures_raw")
def p8_has_coords(spark, d):
    """Of five rows one has no latitude and one a longitude of zero."""
    lat = F.when(F.col("event_id") % 5 != 1, F.col("lat"))
    lon = F.when(F.col("event_id") % 5 == 3, F.lit(0.0)).otherwise(F.col("lon"))
    return view(spark, d, "departures_raw").select("event_id", tr.has_coords(lat, lon).alias("known"), tr.has_coords(lat, lon, strict_js=True).alias("known_strict"))


def _stops(spark, d, side="left"):
    return view(spark, d, "stations").select(F.col("stop_id").alias(f"{side}_id"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))


def _points(spark, d, side="left"):
    return view(spark, d, "departures_raw").select(F.col("event_id").alias(f"{side}_id"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))


_BOARD = f"""{_NORMAL}, b AS (SELECT stop_id, row_number() OVER (PARTITION BY stop_id ORDER BY when_, line_name, direction, event_id) AS position, n.* FROM stations s JOIN n
  ON {_hav('s.lat', 'n.lat', 's.lon', 'n.lon')} <= 1500 WHERE {_LIVE})"""


@_query(f"WITH {_BOARD}, c AS (SELECT stop_id, count(*) AS k FROM b WHERE position <= 200 GROUP BY stop_id) SELECT s.stop_id, coalesce(k, 0) AS departures, CASE WHEN k IS NULL THEN 'no departures' ELSE 'ok' END AS status FROM stations s LEFT JOIN c USING (stop_id)", "stations", "departures_raw")
def p9_board_status(spark, d):
    return departures.board_status(view(spark, d, "stations"), r0_board(spark, d))


_KINDS = """k AS (SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'isochrones' WHEN 1 THEN 'plan' WHEN 2 THEN '' END AS action,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' ELSE name END AS name, lat, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '' ELSE lng END AS lng FROM board_requests)"""


@_query(f"WITH {_KINDS} SELECT event_id, lower(coalesce(name, '') || '|' || coalesce(lat, '') || ',' || coalesce(lng, '')) AS request_key, CASE coalesce(action, '') WHEN 'isochrones' THEN coalesce(lat, '') <> '' AND coalesce(lng, '') <> '' WHEN 'plan' THEN true ELSE coalesce(name, '') <> '' END AS valid FROM k", "board_requests")
def p10_f8_requests(spark, d):
    """Requests of all kinds, with names and coordinates missing or empty."""
    n = F.col("event_id")
    kinds = F.when(n % 4 == 0, "isochrones").when(n % 4 == 1, "plan").when(n % 4 == 2, "")
    asked = view(spark, d, "board_requests").withColumns({"action": kinds, "name": F.when(n % 5 == 1, "").when(n % 5 > 1, F.col("name")), "lng": F.when(n % 3 == 0, "").otherwise(F.col("lng"))})
    ok, bad = departures.split_valid_requests(departures.normalize_requests(asked))
    return ok.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False))).select("event_id", "request_key", "valid")


@_query("SELECT p_partkey, p_name FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def p11_filter_by_kind(spark, d):
    """The directory of parts by its kind, the first one by name."""
    parts = spark.read.parquet(f"{d}/part.parquet").withColumnRenamed("p_type", "kind")
    return catalogue.filter_directory(parts, kind=parts.agg(F.min("kind")).first()[0]).select("p_partkey", "p_name")


@_query("SELECT stop_id, name FROM stations WHERE country = 'NATION_3'", "stations")
def p11_filter_directory(spark, d):
    return catalogue.filter_directory(view(spark, d, "stations"), "NATION_3").select("stop_id", "name")


@_query(f"WITH {_NORMAL} SELECT event_id, coalesce(delay_minutes > 5, false) AS delayed FROM n", "departures_raw")
def p12_flag_delayed(spark, d):
    return departures.flag_delayed(_deps(spark, d), 5).select("event_id", "delayed")


@_query("SELECT page_id, coalesce(regexp_matches(url, '(?i)example\\.(com|org)/.*\\d+') OR regexp_matches(url, '(?i)\\.html$'), false) AS hit FROM pages")
def p13_matches_any(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.matches_any(F.col("url"), [r"example\.(com|org)/.*\d+", r"\.html$"]).alias("hit"))


@_query(f"SELECT s.stop_id AS left_id, e.event_id AS right_id, round({_hav('s.lat', 'e.lat', 's.lon', 'e.lon')}, 2) AS distance FROM stations s JOIN departures_raw e ON {_hav('s.lat', 'e.lat', 's.lon', 'e.lon')} <= 1500", "stations", "departures_raw")
def j1_radius_join(spark, d):
    return geo.radius_join(_stops(spark, d), _points(spark, d, "right"), spread="left", digits=2).select("left_id", "right_id", F.col("distance_m").alias("distance"))


_NEAREST = f"n AS (SELECT event_id, lat, lon, stop_id, dist FROM (SELECT e.event_id, e.lat, e.lon, s.stop_id, {_hav('e.lat', 's.lat', 'e.lon', 's.lon')} AS dist, row_number() OVER (PARTITION BY e.event_id ORDER BY {_hav('e.lat', 's.lat', 'e.lon', 's.lon')}, s.stop_id) AS k FROM departures_raw e CROSS JOIN stations s) WHERE k = 1)"


@_query(f"WITH {_NEAREST} SELECT event_id AS left_id, stop_id AS right_id, round(dist, 2) AS distance FROM n", "stations", "departures_raw")
def j2_nearest_stop(spark, d):
    return geo.nearest_stop(_points(spark, d), _stops(spark, d, "right")).select("left_id", "right_id", F.round("distance_m", 2).alias("distance"))


@_query(f"WITH {_NEAREST} SELECT event_id AS left_id, CASE WHEN dist <= 2000 THEN stop_id END AS stop_id, dist <= 2000 AS resolved FROM n", "stations", "departures_raw")
def j3_resolve_origin(spark, d):
    out = geo.resolve_origin(_points(spark, d), _stops(spark, d, "right"))
    return out.select("left_id", F.when(F.col("resolved"), F.col("origin").cast("long")).alias("stop_id"), "resolved")


@_query(f"WITH {_NEAREST} SELECT event_id - event_id % 3 AS request_id, coalesce(string_agg(CAST(stop_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE dist <= 2000), '') AS vias FROM n GROUP BY 1", "stations", "departures_raw")
def j4_resolve_vias(spark, d):
    point = F.struct(F.col("event_id"), F.struct("lat", "lon").alias("p"))
    asked = view(spark, d, "departures_raw").groupBy((F.col("event_id") - F.col("event_id") % 3).alias("request_id")).agg(F.array_sort(F.collect_list(point)).alias("x")).select("request_id", F.col("x.p").alias("vias"))
    return geo.resolve_vias(asked, _stops(spark, d, "right")).select("request_id", F.array_join(F.transform("vias", lambda x: x.cast("string")), ",").alias("vias"))


def _names(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    return view(spark, d, "search_queries").select("query_id", tx.normalize_for_search(F.col("query")).alias("query")), parts.groupBy(tx.normalize_for_search(F.col("p_name")).alias("target")).agg(F.min("p_partkey").alias("target_id"))


_FUZZY = """q AS (SELECT query_id, lower(query) AS query FROM search_queries), t AS (SELECT lower(p_name) AS target, min(p_partkey) AS target_id FROM part GROUP BY 1),
u AS (SELECT DISTINCT query FROM q), uq AS (SELECT query, unnest(regexp_extract_all(query, '\\S\\S+')) AS w FROM u), ut AS (SELECT target, unnest(regexp_extract_all(target, '\\S+')) AS v FROM t),
p AS (SELECT query, target, max(CASE WHEN w = v THEN 70 WHEN starts_with(v, w) THEN 60 WHEN contains(v, w) THEN 50
  WHEN length(w) >= 3 AND length(v) >= 3 AND abs(length(w) - length(v)) <= 2 THEN CASE levenshtein(w, v) WHEN 1 THEN 40 WHEN 2 THEN 30 ELSE 0 END ELSE 0 END) AS best FROM uq CROSS JOIN ut GROUP BY ALL),
f AS (SELECT q.query_id, q.query, t.target_id, t.target, CAST(CASE WHEN q.query = '' OR t.target = '' THEN 0 WHEN q.query = t.target THEN 100 WHEN starts_with(t.target, q.query) THEN 90 WHEN contains(t.target, q.query) THEN 80 ELSE coalesce(best, 0) END AS INT) AS score
  FROM q CROSS JOIN t LEFT JOIN p ON p.query = q.query AND p.target = t.target)"""


@_query(f"WITH {_FUZZY} SELECT query_id, target_id, score FROM f WHERE score >= 30", "search_queries")
def j6_f3_a6_fuzzy_join(spark, d):
    return search.fuzzy_join(*_names(spark, d), 30).select("query_id", "target_id", "score")


@_query(f"WITH {_FUZZY} SELECT query_id, target_id, score FROM f WHERE score >= 40", "search_queries")
def j6_fuzzy_join_blocked(spark, d):
    return search.fuzzy_join(*_names(spark, d), 40).select("query_id", "target_id", "score")


_TOP = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(target), target_id) AS k FROM f WHERE score >= 1)"


@_query(f"WITH {_FUZZY}, {_TOP} SELECT q.query_id, target_id, coalesce(r.target, q.query) AS name FROM q LEFT JOIN r ON r.query_id = q.query_id AND k = 1", "search_queries")
def j5_geocode(spark, d):
    return search.geocode(*_names(spark, d)).select("query_id", "target_id", "name")


@_query(f"WITH {_FUZZY}, {_TOP} SELECT query_id, target_id, score FROM r WHERE k <= 5", "search_queries")
def r5_search_stations(spark, d):
    targets = spark.read.parquet(f"{d}/part.parquet").groupBy(F.lower("p_name").alias("target")).agg(F.min("p_partkey").alias("target_id"))
    return search.search_stations(view(spark, d, "search_queries"), targets).select("query_id", "target_id", "score")


_LATEST = "l AS (SELECT system_id, max(checked_at) AS seen, arg_max(NOT ok, (checked_at, NOT ok)) AS failed FROM status_checks GROUP BY system_id)"
_SYSTEMS = "s AS (SELECT DISTINCT event_type AS system_id FROM events UNION ALL SELECT 'storage')"


def _systems(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("system_id")).distinct(), spark.range(1).select(F.lit("storage").alias("system_id"))


@_query(f"WITH {_LATEST}, {_SYSTEMS} SELECT system_id, CASE WHEN failed IS NULL THEN 'unknown' WHEN failed THEN 'down' ELSE 'ok' END AS status, (epoch_us(seen) // 1000) AS at_ms FROM s LEFT JOIN l USING (system_id)", "status_checks")
def j7_a5_u1_f13_status_board(spark, d):
    systems, extra = _systems(spark, d)
    return status.status_board(systems, view(spark, d, "status_checks"), extra).select("system_id", "status", _ms("last_checked").alias("at_ms"))


_AGE = "CAST(floor(((epoch_us(TIMESTAMP '2024-02-15 00:00:00') // 1000) - (epoch_us(seen) // 1000)) / 1000.0 + 0.5) AS BIGINT)"


@_query(f"WITH {_LATEST}, {_SYSTEMS} SELECT system_id, CASE WHEN failed IS NULL THEN 'unknown' WHEN failed THEN 'down' ELSE 'ok' END AS status, CASE WHEN seen IS NULL THEN 'Not checked yet' WHEN {_AGE} < 60 THEN {_AGE} || 's ago' ELSE CAST(floor({_AGE} / 60.0 + 0.5) AS BIGINT) || 'm ago' END AS age FROM s LEFT JOIN l USING (system_id)", "status_checks")
def r4_f9_status_report(spark, d):
    systems, extra = _systems(spark, d)
    return status.status_report(systems, view(spark, d, "status_checks"), F.lit("2024-02-15 00:00:00").cast("timestamp"), extra)


@_query("SELECT event_id, (epoch_us(TIMESTAMP '2024-01-15 00:00:00') // 1000) - (epoch_us(checked_at) // 1000) < 1800000 AS fresh FROM status_checks", "status_checks")
def t2_freshness(spark, d):
    return view(spark, d, "status_checks").select("event_id", tr.is_fresh(F.col("checked_at").cast("timestamp"), _as_of()).alias("fresh"))


_GATE = """e AS (SELECT system_id, event_id, ok, (epoch_us(checked_at) // 1000) AS tms, row_number() OVER (PARTITION BY system_id ORDER BY epoch_us(checked_at) // 1000, event_id) AS k FROM status_checks WHERE checked_at IS NOT NULL),
g AS (SELECT system_id, event_id, tms, k, 'check' AS kind, event_id AS snapshot_id, tms AS taken, ok FROM e WHERE k = 1
  UNION ALL SELECT e.system_id, e.event_id, e.tms, e.k, CASE WHEN e.tms - g.taken < 1800000 THEN 'served' ELSE 'check' END, CASE WHEN e.tms - g.taken < 1800000 THEN g.snapshot_id ELSE e.event_id END,
    CASE WHEN e.tms - g.taken < 1800000 THEN g.taken ELSE e.tms END, CASE WHEN e.tms - g.taken < 1800000 THEN g.ok ELSE e.ok END FROM g JOIN e ON e.system_id = g.system_id AND e.k = g.k + 1)"""
_GATED = "SELECT system_id, event_id, kind, snapshot_id, tms AS at_ms FROM g UNION ALL SELECT system_id, NULL, 'due', snapshot_id, taken + 1800000 FROM g WHERE kind = 'check'"


@_query(f"WITH {_GATE}, a AS ({_GATED}) SELECT a.*, CASE WHEN c.ok THEN 'ok' ELSE 'down' END AS status FROM a JOIN status_checks c ON c.event_id = a.snapshot_id", "status_checks")
def t2_status_gate(spark, d):
    """Every check of the log as an ask: served with the status of a snapshot of at most half an hour, or checked anew."""
    checks = view(spark, d, "status_checks")
    gate = status.freshness_gate(checks, "system_id", ts="checked_at")
    return gate.join(checks.select(F.col("event_id").alias("snapshot_id"), tr.check_status(F.col("ok")).alias("status")), "snapshot_id")


@_query(f"WITH {_GATE} {_GATED}", "status_checks")
def t2_stream_gate(spark, d):
    """The same gate from a stream: a landing for each week, asks up to an hour in the wrong one, and an ask long after all."""
    from stopweave.streaming.gate import stream_gate

    base, week = _shared(spark), 7 * 24 * 3600 * 1000
    asks = view(spark, d, "status_checks").select("system_id", "event_id", F.col("checked_at").cast("timestamp").alias("ts"))
    landed = F.floor((F.unix_millis("ts") + (F.col("event_id") % 2) * 3_600_000) / week)
    first, last, newest = asks.agg(F.min(landed), F.max(landed), F.max("ts")).first()
    for n in range(first, last + 1):
        asks.where(landed == n).coalesce(1).write.mode("append").parquet(f"{base}/landed")
    spark.range(1).select(F.lit(None).cast("string").alias("system_id"), F.lit(None).cast("long").alias("event_id"), (F.lit(newest) + F.expr("interval 10 days")).alias("ts")).write.mode("append").parquet(f"{base}/landed")
    stream = spark.readStream.schema(asks.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed")
    gate = stream_gate(stream, "system_id", late="2 hours")
    gate.writeStream.format("parquet").option("path", f"{base}/gate").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/gate").where("system_id is not null")


@_query("SELECT stop_id, name, 1 AS source FROM stations WHERE stop_id % 2 = 0 UNION ALL SELECT stop_id, 'second ' || name, 2 FROM stations WHERE stop_id % 2 = 1", "stations")
def j8_merge_by_precedence(spark, d):
    s = view(spark, d, "stations").select("stop_id", "name")
    second = s.select("stop_id", F.concat(F.lit("second "), "name").alias("name"), F.lit(2).alias("source"))
    return catalogue.merge_by_precedence([s.where("stop_id % 2 = 0").withColumn("source", F.lit(1)), second], "stop_id")


@_query("SELECT stop_id, n_nationkey AS operator_id, n_name AS operator FROM stations JOIN nation ON n_nationkey IN (stop_id % 25, (stop_id + 7) % 25)", "stations")
def j9_station_operators(spark, d):
    s = view(spark, d, "stations").select("stop_id", F.array((F.col("stop_id") % 25).cast("int"), ((F.col("stop_id") + 7) % 25).cast("int")).alias("operator_ids"))
    operators = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("operator_id"), F.col("n_name").alias("operator"))
    return catalogue.station_operators(s, operators)


@_query("SELECT count(*) AS journeys FROM board_requests", "board_requests")
def a4_journey_count(spark, d):
    return catalogue.journey_count(view(spark, d, "board_requests"))


@_query("SELECT count(*) AS journeys FROM board_requests", "board_requests")
def a4_stream_journey_count(spark, d):
    """The same count from a stream that is stopped and started again between two landings."""
    from stopweave.streaming.board import count_journeys, read_journey_count

    base = _shared(spark)
    log = view(spark, d, "board_requests").select("event_id", "name")
    for half in (0, 1):
        log.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{base}/landed")
        landed = spark.readStream.schema(log.schema).parquet(f"{base}/landed")
        count_journeys(landed, f"{base}/count", f"{base}/checkpoint").awaitTermination()
    return read_journey_count(spark, f"{base}/count")


@_query("SELECT country, count(*) AS stations FROM stations GROUP BY country", "stations")
def a8_stations_by_country(spark, d):
    return catalogue.stations_by_country(view(spark, d, "stations"))


@_query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS stations, count(*) AS countries, (SELECT count(*) FROM supplier) AS operators, (SELECT count(*) FROM nation) AS ports, (SELECT count(*) FROM region) AS ferry_routes FROM (SELECT count(*) AS n FROM stations GROUP BY country)", "stations")
def r3_a1_a2_a3_catalogue_stats(spark, d):
    tables = [spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "nation", "region")]
    return catalogue.catalogue_stats(catalogue.stations_by_country(view(spark, d, "stations")).withColumnRenamed("stations", "total"), *tables)


@_query("SELECT * FROM stations ORDER BY md5('7:' || CAST(stop_id AS VARCHAR)), stop_id LIMIT 1", "stations")
def l4_surprise_me(spark, d):
    return catalogue.surprise_me(view(spark, d, "stations"), 7)


@_query("SELECT stop_id, name, country FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5('7:' || CAST(stop_id AS VARCHAR)), stop_id) AS k FROM stations) WHERE k = 1", "stations")
def l4_surprise_each_country(spark, d):
    return catalogue.surprise_each(view(spark, d, "stations"), "country", 7).select("stop_id", "name", "country")


@_query("SELECT event_id, system_id, ok FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY md5('7:' || CAST(event_id AS VARCHAR)), event_id) AS k FROM status_checks) WHERE k <= 5", "status_checks")
def l4_sample_of_checks(spark, d):
    """Five checks of each system."""
    return catalogue.surprise_each(view(spark, d, "status_checks"), "system_id", 7, 5, "event_id").select("event_id", "system_id", "ok")


_SPECIAL = [(a, b) for a, b in tx.SPECIAL_LETTERS.items()]


def _replaced(expr):
    for a, b in _SPECIAL:
        expr = f"replace({expr}, '{a}', '{b}')"
    return f"lower({expr})"


@_query(f"SELECT doc_id, sha256({_replaced('strip_accents(text)')}) AS normal FROM documents")
def f1_normalize_for_search(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(tx.normalize_for_search(F.col("text")), 256).alias("normal"))


def _cleaned():
    s, out = r"[\s\x{a0}]", "name"
    for e in tx.GLUED_ENDINGS:
        out = f"regexp_replace({out}, '(?i){e}$', '')"
    for ws in tx.SPACED_ENDINGS:
        out = f"regexp_replace({out}, '(?i){''.join(s + '+' + w for w in ws)}$', '')"
    for e in tx.EXACT_ENDINGS:
        out = f"regexp_replace({out}, '{e}$', '')"
    return f"trim(regexp_replace({out}, '{s}+', ' ', 'g'))"


@_query(f"SELECT stop_id, {_cleaned()} AS cleaned FROM stations", "stations")
def f4_clean_station_name(spark, d):
    return view(spark, d, "stations").select("stop_id", tx.clean_station_name(F.col("name")).alias("cleaned"))


@_query("SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM documents")
def f5_escape_html(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(tx.escape_html(F.col("text")), 256).alias("escaped"))


@_query("SELECT query_id, levenshtein(query, p_name) AS edits FROM search_queries JOIN part ON p_partkey = query_id", "search_queries")
def f2_levenshtein(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    return view(spark, d, "search_queries").join(parts, F.col("query_id") == F.col("p_partkey")).select("query_id", F.levenshtein("query", "p_name").cast("long").alias("edits"))


@_query("SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS shown, CAST(o_totalprice * 1.4 AS DOUBLE) AS metres FROM orders")
def f10_f14_format_and_walk(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", tx.format_count(F.floor("o_totalprice")).alias("shown"), tr.walk_radius_m(F.col("o_totalprice")).alias("metres"))


@_query("SELECT page_id, replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS encoded FROM pages")
def f11_uri_component(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.uri_component(F.col("url")).alias("encoded"))


def r0_board(spark, d):
    return departures_board(view(spark, d, "departures_raw"), view(spark, d, "stations"), _as_of())


@_query(f"WITH {_BOARD} SELECT stop_id, position, event_id, (epoch_us(when_) // 1000) AS when_ms, platform, direction, line_name, mode, agency_name, cancelled, real_time, delay_minutes FROM b WHERE position <= 200", "stations", "departures_raw")
def r0_departures_board(spark, d):
    return r0_board(spark, d).select("stop_id", F.col("position").cast("long").alias("position"), "event_id", _ms("when").alias("when_ms"), "platform", "direction", F.col("line.name").alias("line_name"), "mode", "agency_name", "cancelled", "real_time", "delay_minutes")


TTL_MS = 6 * 3600 * 1000
_TTL = f"""e AS (SELECT name, event_id, (epoch_us(ts) // 1000) AS tms, cacheable, row_number() OVER (PARTITION BY name ORDER BY ts, event_id) AS k FROM board_requests),
h AS (SELECT name, event_id, k, false AS hit, CASE WHEN cacheable THEN tms END AS anchor FROM e WHERE k = 1
  UNION ALL SELECT e.name, e.event_id, e.k, coalesce(e.tms - h.anchor < {TTL_MS}, false), CASE WHEN coalesce(e.tms - h.anchor < {TTL_MS}, false) THEN h.anchor WHEN e.cacheable THEN e.tms ELSE h.anchor END FROM h JOIN e ON e.name = h.name AND e.k = h.k + 1)"""


@_query(f"WITH {_TTL} SELECT name, event_id, hit FROM h", "board_requests")
def t1_ttl_hits(spark, d):
    return state.ttl_hits(view(spark, d, "board_requests"), "name", TTL_MS)


@_query(f"WITH {_TTL} SELECT name, count(*) AS requests, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM h GROUP BY name", "board_requests")
def r6_request_cache_report(spark, d):
    return state.request_cache_report(state.ttl_hits(view(spark, d, "board_requests"), "name", TTL_MS), "name")


@_query(f"WITH {_TTL} SELECT name, event_id, hit FROM h", "board_requests")
def t1_stream_ttl_hits(spark, d):
    """The same rows from a stream: a landing for each week, events up to an hour in the wrong one.

    The stream runs once for each landing and takes it whole, however many files it has: their order tells nothing of the
    time, so a batch of some of them would make the others late.
    """
    from stopweave.streaming.ttl import read_cache_hits, stream_cache_hits

    base, week = _shared(spark), 7 * 24 * 3600 * 1000
    events = view(spark, d, "board_requests").select("name", "event_id", F.col("ts").cast("timestamp").alias("ts"), "cacheable")
    landed = F.floor((F.unix_millis("ts") + (F.col("event_id") % 2) * 3_600_000) / week)
    first, last = events.agg(F.min(landed), F.max(landed)).first()
    for n in range(first, last + 1):
        events.where(landed == n).write.mode("append").parquet(f"{base}/landed")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/landed")
        stream_cache_hits(stream, f"{base}/cache", f"{base}/checkpoint", "name", TTL_MS, late="2 hours").awaitTermination()
    return read_cache_hits(spark, f"{base}/cache", TTL_MS, ended=True).select(F.col("key").alias("name"), F.col("id").alias("event_id"), "hit")


_RIDES = f"r AS (SELECT a.trip_id, a.stop_id AS board, a.dep_min, b.stop_id AS alight, b.arr_min FROM stop_calls a JOIN stop_calls b ON a.trip_id = b.trip_id AND a.seq < b.seq WHERE a.mode IN ({_MODES}))"
_LEVEL = "l{1} AS (SELECT origin, stop_id, min(arrival) AS arrival FROM (SELECT * FROM l{0} UNION ALL SELECT origin, alight, arr_min FROM l{0} JOIN r ON board = stop_id AND dep_min >= arrival AND arr_min <= 540) GROUP BY ALL)"
_REACH = f"{_RIDES}, l0 AS (SELECT stop_id AS origin, stop_id, CAST(480 AS BIGINT) AS arrival FROM stations), " + ", ".join(_LEVEL.format(k, k + 1) for k in range(3))


@_query(f"WITH {_REACH} SELECT origin, stop_id, arrival, arrival - 480 AS duration_min FROM l3", "stations", "stop_calls")
def r1_j10_a7_reach(spark, d):
    return routing.reach(routing.lines(view(spark, d, "stop_calls")), view(spark, d, "stations"), 480, 60, max_rides=3)


_EVERY = f"""{_RIDES}, u AS (SELECT DISTINCT board, dep_min, alight, arr_min FROM r WHERE dep_min >= 480 AND arr_min <= 540),
s AS (SELECT stop_id AS origin, stop_id, CAST(480 AS BIGINT) AS arrival FROM stations UNION SELECT origin, alight, arr_min FROM s JOIN u ON board = stop_id AND dep_min >= arrival)"""


@_query(f"WITH {_EVERY} SELECT origin, stop_id, min(arrival) AS arrival, min(arrival) - 480 AS duration_min FROM s GROUP BY ALL", "stations", "stop_calls")
def r1_reach_all_stations(spark, d):
    """R1 in whole: from every station, with as many rides as fit. The query above stops after three."""
    return routing.reach(routing.lines(view(spark, d, "stop_calls")), view(spark, d, "stations"), 480, 60)


@_query()
def r1_reach_on_foot_too(spark, d):
    """R1 in whole, with walks of up to a quarter of an hour between stops."""
    return routing.reach_on_foot(routing.lines(view(spark, d, "stop_calls")), view(spark, d, "stations"), 480, 60)


@_query()
def r2_journeys(spark, d):
    """From every station to every other one, over all rides and with any number of transfers.

    Where no line calls nothing begins or ends, so the pairs are those of stations with calls.
    """
    network = put_down(routing.lines(view(spark, d, "stop_calls")))
    od = routing.all_pairs(view(spark, d, "stations").select("stop_id").join(routing.called_at(network), "stop_id", "left_semi"), 480)
    return routing.journeys(network, od, max_transfers=None).drop("walked")


@_query()
def r2_journeys_on_foot_too(spark, d):
    """All pairs again, with walks of a quarter of an hour before, between and after rides, and straight ones of half an hour."""
    return routing.journeys_on_foot(routing.lines(view(spark, d, "stop_calls")), view(spark, d, "stations"), 480, max_transfers=2)


def _asked(spark, d):
    """A request for each supplier: two stops and both times."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("od_id"), (k % 97).alias("origin"), ((k * 7 + 1) % 99).alias("destination"), (480 + k % 3 * 30).alias("depart_at"), (720 + k % 3 * 30).alias("arrive_by"))


@_query()
def r2_journeys_with_vias(spark, d):
    """A request for each supplier along the stops of one trip, over one or two of them in order."""
    k = F.col("s_suppkey")
    stop = lambda n: (93 * k + n * 17 * (1 + 3 * k % 7)) % 100
    vias = F.when(k % 3 == 0, F.array(stop(2))).otherwise(F.array(stop(1), stop(3)))
    od = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("od_id"), stop(0).alias("origin"), stop(4).alias("destination"), vias.alias("vias"), (39 * k % 1200).alias("depart_at"))
    return routing.journeys(routing.lines(view(spark, d, "stop_calls")), od, max_transfers=4)


@_query()
def r2_journeys_arriving(spark, d):
    """The requests arriving by their time, with five minutes for each change and walks."""
    network, asked = put_down(routing.lines(view(spark, d, "stop_calls"))), _asked(spark, d)
    # walks between stops that no line and no request names lead nowhere
    named = routing.called_at(network).unionByName(asked.select(F.explode(F.array("origin", "destination")).alias("stop_id"))).distinct()
    walks = put_down(routing.walking_edges(view(spark, d, "stations").join(named, "stop_id", "left_semi")))
    return routing.journeys_arriving(network, asked, walks=walks, min_transfer_min=5)


# The same departures seen three times: all of them, then every second one on another track, then every third one later.
_SEEN = ["", "WHERE event_id % 2 = 0", "WHERE event_id % 3 = 0"]
_OBSERVED = f"""o AS (SELECT TIMESTAMP '{AS_OF}' - INTERVAL 20 MINUTE AS observed_at, event_id, 0 AS later, scheduled_track FROM departures_raw
  UNION ALL SELECT TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE, event_id, 0, 'T2' FROM departures_raw {_SEEN[1]}
  UNION ALL SELECT TIMESTAMP '{AS_OF}', event_id, 5, scheduled_track FROM departures_raw {_SEEN[2]})"""
_LAST = f"""{_NORMAL}, {_OBSERVED},
k AS (SELECT n.* REPLACE (when_ + to_minutes(later) AS when_, coalesce(nullif(o.scheduled_track, ''), platform) AS platform), delay_minutes + later AS shifted, observed_at, n.line_name AS route FROM n JOIN o USING (event_id)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY planned_when, direction, route, agency_name, lat, lon ORDER BY observed_at DESC, when_ DESC NULLS LAST, platform DESC NULLS LAST, mode DESC NULLS LAST, cancelled DESC, real_time DESC) AS nth FROM k) WHERE nth = 1),
b AS (SELECT stop_id, row_number() OVER (PARTITION BY stop_id ORDER BY when_, route, direction, agency_name, planned_when, l.lat, l.lon) AS position, l.* FROM stations s JOIN l ON {_hav('s.lat', 'l.lat', 's.lon', 'l.lon')} <= 1500 WHERE {_LIVE})"""


@_query(f"WITH {_LAST} SELECT stop_id, position, (epoch_us(when_) // 1000) AS when_ms, (epoch_us(planned_when) // 1000) AS planned_ms, platform, direction, route AS line_name, mode, agency_name, cancelled, real_time, shifted AS delay_minutes, (epoch_us(observed_at) // 1000) AS observed_ms FROM b WHERE position <= 200", "stations", "departures_raw")
def t3_stream_board(spark, d):
    """Three landings of observations, streamed into the table of live departures; the boards of all stations from it."""
    from stopweave.streaming.board import live_boards, stream_board

    base = _shared(spark)
    raw = view(spark, d, "departures_raw")  # feeds carry no trip id, it does not land
    later = F.lit(AS_OF).cast("timestamp_ntz")
    landings = [
        raw.withColumn("observed_at", later - F.expr("interval 20 minutes")),
        raw.where("event_id % 2 = 0").withColumns({"observed_at": later - F.expr("interval 10 minutes"), "scheduled_track": F.lit("T2")}),
        raw.where("event_id % 3 = 0").withColumns({"observed_at": later, "departure": F.coalesce("departure", "scheduled_departure") + F.expr("interval 5 minutes")}),
    ]
    for rows in landings:
        rows.withColumn("observed_at", F.col("observed_at").cast("timestamp")).drop("event_id").write.mode("append").parquet(f"{base}/landed")
    observed = spark.readStream.schema(spark.read.parquet(f"{base}/landed").schema).option("maxFilesPerTrigger", 8).parquet(f"{base}/landed")
    stream_board(observed, f"{base}/board", f"{base}/state", late="30 minutes").awaitTermination()
    board = live_boards(spark, f"{base}/board", view(spark, d, "stations"), _as_of(), late="30 minutes")
    return board.select("stop_id", F.col("position").cast("long").alias("position"), _ms("when").alias("when_ms"), _ms("planned_when").alias("planned_ms"), "platform", "direction", F.col("line.name").alias("line_name"), "mode", "agency_name", "cancelled", "real_time", "delay_minutes", _ms("observed_at").alias("observed_ms"))


@_query("SELECT country, CASE WHEN count(*) % 2 = 0 THEN count(*) END AS total FROM stations GROUP BY country", "stations")
def s1_read_stations(spark, d):
    """Landed documents, one for each country, some without counts, read back."""
    path = f"{_shared(spark)}/stations"
    counted = catalogue.stations_by_country(view(spark, d, "stations"))
    counts = F.struct(F.when(F.col("stations") % 2 == 0, F.struct(F.col("stations").alias("total"))).alias("counts"))
    counted.select(F.create_map("country", counts).alias("countries")).write.json(path)
    return files.read_stations(spark, path, lines=True)


def _landed(spark, rows, field):
    """Rows as landed documents with an array each, spread over many documents by a hash of their id."""
    path = f"{_shared(spark)}/{field}"
    bucket = F.xxhash64("id") % F.lit(1000)
    rows.groupBy(bucket.alias("b")).agg(F.collect_list(F.struct(*rows.columns)).alias(field)).drop("b").write.json(path)
    return path


@_query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def s2_read_operators(spark, d):
    supplier, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "nation"))
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"))
    return files.read_operators(spark, _landed(spark, rows, "operators"), lines=True)


@_query("SELECT CAST(stop_id AS VARCHAR) AS id, name, country FROM stations", "stations")
def s3_read_ports(spark, d):
    rows = view(spark, d, "stations").select(F.col("stop_id").cast("string").alias("id"), "name", "country")
    return files.read_ports(spark, _landed(spark, rows, "ports"), lines=True)


@_query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part")
def s4_read_ferry_routes(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    return files.read_ferry_routes(spark, _landed(spark, rows, "routes"), lines=True)


@_query(f"WITH {_NORMAL} SELECT CASE WHEN event_id % 13 <> 3 THEN (epoch_us(when_) // 1000) END AS when_ms, platform, direction, line_name, mode, agency_name, cancelled, real_time, CASE WHEN event_id % 13 <> 3 THEN delay_minutes END AS delay_minutes FROM n", "departures_raw")
def s5_read_stop_times(spark, d):
    """Landed stop-time documents read back and normalised; some have an actual time that is none, some an empty one."""
    raw = view(spark, d, "departures_raw")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    actual = F.when(F.col("event_id") % 13 == 3, "soon").otherwise(F.coalesce(at("departure"), F.lit("")))
    place = F.struct(at("scheduled_departure").alias("scheduledDeparture"), actual.alias("departure"), F.col("scheduled_track").alias("scheduledTrack"), "track", "cancelled", "lat", "lon")
    stop = F.struct("headsign", F.col("route_short_name").alias("routeShortName"), "mode", F.col("agency_name").alias("agencyName"), F.col("trip_cancelled").alias("tripCancelled"), F.col("real_time").alias("realTime"), place.alias("place"))
    path = f"{_shared(spark)}/stop_times"
    raw.groupBy((F.xxhash64("event_id") % 1000).alias("b")).agg(F.collect_list(stop).alias("stopTimes")).drop("b").write.json(path)
    known = departures.normalize_departures(files.read_stop_times(spark, path, lines=True))
    return known.select(_ms("when").alias("when_ms"), "platform", "direction", F.col("line.name").alias("line_name"), "mode", "agency_name", "cancelled", "real_time", "delay_minutes")


@_query(f"WITH {_LATEST} SELECT system_id, CASE WHEN failed THEN 'down' ELSE 'ok' END AS status, (epoch_us(seen) // 1000) AS at_ms FROM l", "status_checks")
def s6_k2_status_files(spark, d):
    """A check log landed and read back, its latest statuses written as the whole status table, twice, and read."""
    base = _shared(spark)
    view(spark, d, "status_checks").select("system_id", "ok", F.col("checked_at").cast("timestamp").alias("checked_at")).write.parquet(f"{base}/checks")
    latest = status.latest_status(files.read_status_checks(spark, f"{base}/checks"))
    for _ in range(2):
        files.write_status(latest, f"{base}/status")
    return spark.read.parquet(f"{base}/status").select("system_id", "status", _ms("last_checked").alias("at_ms"))


@_query("SELECT count(*) AS journeys FROM board_requests", "board_requests")
def s7_read_search_log(spark, d):
    path = f"{_shared(spark)}/searches"
    view(spark, d, "board_requests").select(F.col("name").alias("query"), F.col("ts").cast("timestamp").alias("searched_at")).write.parquet(path)
    return catalogue.journey_count(files.read_search_log(spark, path))


@_query(f"WITH {_BOARD} SELECT stop_id, position, event_id, CAST(CAST(when_ AS DATE) AS VARCHAR) AS service_date FROM b WHERE position <= 200", "stations", "departures_raw")
def k1_write_board(spark, d):
    """The boards of R0 written by day of departure and read back."""
    path = f"{_shared(spark)}/board"
    files.write_board(r0_board(spark, d), path)
    return spark.read.parquet(path).select("stop_id", F.col("position").cast("long").alias("position"), "event_id", F.col("service_date").cast("string").alias("service_date"))


@_query(f"WITH {_NORMAL} SELECT event_id, (epoch_us(when_) // 1000) AS when_ms, CAST(CAST(when_ AS DATE) AS VARCHAR) AS service_date FROM n", "departures_raw")
def k1_stream_board_files(spark, d):
    """Normalised departures from a stream of landed files, written by day of departure."""
    base = _shared(spark)
    raw = view(spark, d, "departures_raw")
    raw.write.parquet(f"{base}/landed")
    landed = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/landed")
    files.stream_board_files(departures.normalize_departures(landed, "event_id"), f"{base}/days", f"{base}/checkpoint").awaitTermination()
    return files.read_board_files(spark, f"{base}/days").select("event_id", _ms("when").alias("when_ms"), F.col("service_date").cast("string").alias("service_date"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 3 = 1 THEN 't' || event_id ELSE '' END AS depart_at FROM board_requests", "board_requests")
def f12_parameter_alias(spark, d):
    """The departure time under its two names: the first one that is not empty."""
    text = F.col("event_id").cast("string")
    asked = view(spark, d, "board_requests").withColumns({"departure_time": F.when(F.col("event_id") % 3 == 0, text).otherwise(""), "time": F.when(F.col("event_id") % 3 != 2, F.concat(F.lit("t"), text))})
    return departures.normalize_requests(asked).select("event_id", "depart_at")


def _shared(spark) -> str:
    import uuid

    return f"{checkpoint_folder(spark).rstrip('/')}/stopweave-{uuid.uuid4().hex}"
