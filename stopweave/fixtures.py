"""Transit views computed from the star-schema tables, as one SQL text for Spark and DuckDB (see FIXTURES.md)."""

from __future__ import annotations

SHIFT = {"spark": "timestampadd(SECOND, CAST(floor(value * 10) AS INT) - 600, ts)", "duckdb": "ts + to_seconds(CAST(floor(value * 10) AS INT) - 600)"}

VIEWS = {
    "stations": """
SELECT s_suppkey AS stop_id,
  CAST(s_suppkey AS STRING) || ' ' || CASE CAST(s_suppkey % 8 AS INT) WHEN 0 THEN 'München Hauptbahnhof' WHEN 1 THEN 'Gdańsk Główny'
    WHEN 2 THEN 'Århus Station' WHEN 3 THEN 'Amsterdam Treinstation' WHEN 4 THEN 'Roma Stazione'
    WHEN 5 THEN 'Lisboa Estação' WHEN 6 THEN 'London Railway Station' ELSE 'Łódź  Halt' END AS name,
  n_name AS country,
  50e0 + CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 1e3 * 2e-1 AS lat,
  4e0 + CAST((s_suppkey * 91) % 1000 AS DOUBLE) / 1e3 * 3e-1 AS lon
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""",
    "departures_raw": """
SELECT event_id,
  50e0 + CAST((event_id * 53) % 1000 AS DOUBLE) / 1e3 * 2e-1 AS lat,
  4e0 + CAST((event_id * 29) % 1000 AS DOUBLE) / 1e3 * 3e-1 AS lon,
  CASE WHEN event_id % 50 = 49 THEN NULL ELSE ts END AS scheduled_departure,
  CASE WHEN event_id % 5 = 0 OR event_id % 100 = 99 THEN NULL ELSE {SHIFT} END AS departure,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id % 12 AS STRING) END AS scheduled_track,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id % 9 AS STRING) END AS track,
  CASE CAST(event_id % 10 AS INT) WHEN 0 THEN 'IC Berlin' WHEN 1 THEN 'Sprinter Utrecht' WHEN 2 THEN 'Locality Park' WHEN 3 THEN 'éintercity'
    WHEN 4 THEN '' WHEN 5 THEN 'Paris Eurostar' WHEN 6 THEN 'RE Köln' WHEN 7 THEN 'Nightjet Wien' WHEN 8 THEN 'IC\u00a0Basel' ELSE 'Centrum' END AS headsign,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'IC 123' WHEN 1 THEN 'RB 7' WHEN 2 THEN NULL ELSE 'S1' END AS route_short_name,
  CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'HIGHSPEED_RAIL' WHEN 1 THEN 'LONG_DISTANCE' WHEN 2 THEN 'NIGHT_RAIL' WHEN 3 THEN 'REGIONAL_RAIL'
    WHEN 4 THEN 'SUBURBAN' WHEN 5 THEN 'FERRY' WHEN 6 THEN 'BUS' WHEN 7 THEN 'TRAM' ELSE NULL END AS mode,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS agency_name,
  CASE WHEN event_id % 7 = 0 THEN TRUE WHEN event_id % 7 = 1 THEN NULL ELSE FALSE END AS cancelled,
  event_id % 11 = 0 AS trip_cancelled,
  event_id % 5 <> 0 AS real_time
FROM events
""",
    "stop_calls": """
SELECT o_orderkey AS trip_id, k AS seq,
  (o_orderkey * 31 + k * 17 * (1 + o_orderkey % 7)) % 100 AS stop_id,
  (o_orderkey * 13) % 1200 + k * (8 + o_orderkey % 20) AS arr_min,
  (o_orderkey * 13) % 1200 + k * (8 + o_orderkey % 20) + 1 AS dep_min,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'REGIONAL_RAIL' WHEN 1 THEN 'FERRY' ELSE 'TRAM' END AS mode
FROM orders CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS s(k)
""",
    "search_queries": """
SELECT p_partkey AS query_id, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 2) || substr(p_name, 4)
  WHEN 2 THEN substr(p_name, 1, 3) ELSE 'zz ' || p_name END AS query FROM part
""",
    "status_checks": """
SELECT event_id, event_type AS system_id, value < 5e1 AS ok, ts AS checked_at FROM events
""",
    "board_requests": """
SELECT event_id, 'Stop ' || CAST(user_id AS STRING) AS name, CASE WHEN user_id % 2 = 0 THEN '50.1' END AS lat,
  CASE WHEN user_id % 2 = 0 THEN '4.2' END AS lng, ts, event_type <> 'error' AS cacheable FROM events
""",
}
SOURCES = {"stations": ["supplier", "nation"], "departures_raw": ["events"], "stop_calls": ["orders"], "search_queries": ["part"], "status_checks": ["events"], "board_requests": ["events"]}


def view(spark, sf_dir: str, name: str):
    """A fixture view as a DataFrame, its source tables bound by name."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES[name]}
    text = VIEWS[name].replace("{SHIFT}", SHIFT["spark"])
    for t in tables:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t}", "JOIN {" + t + "}")
    return spark.sql(text, **tables)


def with_views(sql: str, *names: str) -> str:
    """DuckDB text in which the views are common table expressions."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].replace('{SHIFT}', SHIFT['duckdb'])})" for n in names)
    return f"WITH RECURSIVE {ctes}{',' if sql.lstrip().startswith('WITH ') else ''}\n" + sql.lstrip().removeprefix("WITH ")
