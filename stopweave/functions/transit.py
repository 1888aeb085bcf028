"""Times, delays, modes and statuses as Column expressions. Durations are integers with the unit in their name."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopweave.functions.text import SPACES

#: One white space, as browsers know it.
SPACE = f"[{SPACES}]"
# Modes that reach and itinerary jobs ask for; buses replace trains.
RAIL_MODES = ["HIGHSPEED_RAIL", "LONG_DISTANCE", "NIGHT_RAIL", "REGIONAL_RAIL", "SUBURBAN", "FERRY", "BUS"]
# What in "headsign route", lower-cased, tells a class of service. Those with ^ see the headsign only.
INTERCITY = ["(?<![a-z0-9_])intercity(?![a-z0-9_])", f"^ic{SPACE}", f"^ice{SPACE}", f"^ec{SPACE}", "tgv", "eurostar", "thalys", "railjet", "nightjet", f"^rj{SPACE}", "supercity", f"^nj{SPACE}"]
REGIONAL = ["(?<![a-z0-9_])sprinter(?![a-z0-9_])", "regional", f"^re{SPACE}", f"^rb{SPACE}", f"^r{SPACE}", "stoptrein", "local"]


def falsy_coalesce(*cols):
    """The first that is neither null nor ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def js_round(x):
    """Halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def delay_minutes(scheduled, actual):
    return js_round((F.unix_millis(actual) - F.unix_millis(scheduled)) / F.lit(60000.0)).cast("long")


def detect_mode(headsign, route, mode):
    """INTERCITY or REGIONAL by the headsign and route, then by the mode; else the mode as it is."""
    said = F.lower(F.concat(F.coalesce(headsign, F.lit("")), F.lit(" "), F.coalesce(route, F.lit(""))))
    return (
        F.when(said.rlike("|".join(INTERCITY)), "INTERCITY")
        .when(said.rlike("|".join(REGIONAL)), "REGIONAL")
        .when(mode.isin("LONG_DISTANCE", "HIGHSPEED_RAIL", "NIGHT_RAIL"), "INTERCITY")
        .when(mode == "REGIONAL_RAIL", "REGIONAL")
        .otherwise(mode)
    )


def age_label(checked_at, as_of):
    """``Ns ago`` below a minute, else ``Nm ago``; null is ``Not checked yet``."""
    seconds = js_round((F.unix_millis(as_of) - F.unix_millis(checked_at)) / F.lit(1000.0)).cast("long")
    minutes = js_round(seconds / F.lit(60.0)).cast("long")
    return F.when(checked_at.isNull(), "Not checked yet").when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago"))).otherwise(F.concat(minutes.cast("string"), F.lit("m ago")))


def check_status(ok):
    return F.when(ok, "ok").otherwise("down")


def walk_radius_m(seconds, metres_per_s=1.4):
    return seconds * F.lit(metres_per_s)


def has_coords(lat, lon, strict_js: bool = False):
    """Both coordinates known; with ``strict_js`` a zero counts as unknown."""
    known = lat.isNotNull() & lon.isNotNull()
    return known & (lat != 0) & (lon != 0) if strict_js else known


def is_fresh(taken_at, as_of, max_age_ms: int = 30 * 60 * 1000):
    return F.coalesce(F.unix_millis(as_of) - F.unix_millis(taken_at) < max_age_ms, F.lit(False))
