"""Catalogues: counts, merges, directory filters and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a key's rows are dealt to while several of them are picked.
PICKERS = 64


def catalogue_stats(countries: DataFrame, operators: DataFrame, ports: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: stations (missing totals are 0), countries, operators, ports, ferry_routes."""
    size = lambda df, name: df.agg(F.count("*").alias(name))
    own = countries.agg(F.coalesce(F.sum(F.coalesce("total", F.lit(0))), F.lit(0)).alias("stations"), F.count("*").alias("countries"))
    return own.crossJoin(size(operators, "operators")).crossJoin(size(ports, "ports")).crossJoin(size(routes, "ferry_routes"))


def journey_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("journeys"))


def stations_by_country(stations: DataFrame) -> DataFrame:
    return stations.groupBy("country").agg(F.count("*").alias("stations"))


def merge_by_precedence(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source, then of each later one only where no earlier one has the key."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def station_operators(stations: DataFrame, operators: DataFrame) -> DataFrame:
    """(stop_id, operator_id, operator): a row for each operator of each station; stations without any have nulls."""
    each = stations.select("stop_id", F.explode_outer("operator_ids").alias("operator_id"))
    return each.join(operators, "operator_id", "left").select("stop_id", "operator_id", "operator")


def filter_directory(df: DataFrame, country: str | None = None, kind: str | None = None) -> DataFrame:
    """By country (a name, or a list that holds it) and by kind."""
    if country is not None:
        many = dict(df.dtypes)["country"].startswith("array")
        df = df.where(F.array_contains("country", country) if many else F.col("country") == country)
    return df if kind is None else df.where(F.col("kind") == kind)


def surprise_me(df: DataFrame, seed: int, id_col: str = "stop_id") -> DataFrame:
    """One row by a hash of seed and id: random to look at, the same for the same seed, in any engine that has MD5."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(1)


def surprise_each(df: DataFrame, key: str, seed: int, n: int = 1, id_col: str = "stop_id") -> DataFrame:
    """``n`` rows of each ``key`` by the same hash; fewer where the key has fewer.

    Picks are (hash, id) pairs. Each task keeps the least of what it has before the shuffle, and with ``n`` = 1 that is
    one pair for each key and task; a larger ``n`` first deals a key's rows to PICKERS by their hash, so no group is
    ever met whole.
    """
    draw = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("draw"), F.col(id_col).alias("id"))
    drawn = df.withColumn("__draw", draw)
    if n == 1:
        least = drawn.groupBy(key).agg(F.min("__draw").alias("__least"))
    else:
        deal = F.pmod(F.xxhash64("__draw"), F.lit(PICKERS))
        some = drawn.select(key, "__draw", deal.alias("__deal"))
        for by in ([key, "__deal"], [key]):
            order = Window.partitionBy(*by).orderBy("__draw")
            some = some.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")
        least = some.select(key, F.col("__draw").alias("__least"))
    same = F.col("o.__draw") == F.col("p.__least")
    picked = drawn.alias("o").join(least.alias("p"), F.col(f"o.{key}").eqNullSafe(F.col(f"p.{key}")) & same)
    return picked.select(*(F.col(f"o.{c}") for c in df.columns))
