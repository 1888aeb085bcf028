"""Fuzzy search joins and geocoding by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopweave.functions.text import clean_station_name, normalize_for_search, search_words, word_score

#: Segments of a word of which two edits leave one whole.
SEGMENTS = 3


def _grams(c, n):
    """All sequences of ``n`` letters; none where the text is shorter."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def _contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay) for distinct texts of which the second contains the first.

    Each needle is looked up by the one of its sequences of three letters (or by itself, where it is shorter) that the
    fewest hays have.
    """
    held = hays.select("hay", F.explode(F.array_distinct(F.concat(*(_grams(F.col("hay"), F.lit(n)) for n in (1, 2, 3))))).alias("gram"))
    known = held.groupBy("gram").agg(F.count("*").alias("n"))
    own = needles.select("needle", F.explode(F.array_distinct(_grams(F.col("needle"), F.least(F.length("needle"), F.lit(3))))).alias("gram"))
    rarest = own.join(known, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    rarest = rarest.where("m.n > 0").select("needle", F.col("m.gram").alias("gram"))
    return rarest.join(held, "gram").where(F.contains("hay", "needle")).select("needle", "hay")


def _edited(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay) for distinct words of three letters or more that may be two edits apart.

    A hay is cut into SEGMENTS parts. Two edits touch at most two, so the third stands in the needle, moved by two
    places at most: (length of the hay, number and letters of the part) is what they share.
    """
    n = F.length("hay")
    cut = lambda i: F.floor(n * i / SEGMENTS).cast("int")
    part = lambda i: F.struct(n.alias("size"), i.alias("part"), F.substring(F.col("hay"), cut(i) + 1, cut(i + 1) - cut(i)).alias("letters"))
    each = hays.where(n >= 3).select("hay", F.explode(F.array(*(part(F.lit(i)) for i in range(SEGMENTS)))).alias("key"))
    size = F.explode(F.sequence(F.greatest(F.length("needle") - 2, F.lit(3)), F.length("needle") + 2)).alias("size")
    own = needles.where(F.length("needle") >= 3).select("needle", size).select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("part"))
    own = own.select("*", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("moved"))
    lo, hi = (F.floor(F.col("size") * (F.col("part") + i) / SEGMENTS).cast("int") for i in (0, 1))
    start = lo + F.col("moved") + 1
    own = own.where((start >= 1) & (start + hi - lo - 1 <= F.length("needle")))
    own = own.select("needle", F.struct("size", "part", F.substring(F.col("needle"), start, hi - lo).alias("letters")).alias("key")).distinct()
    return own.join(each, "key").select("needle", "hay").distinct()


def _scored_texts(asked: DataFrame, known: DataFrame, min_score: int) -> DataFrame:
    """(query, target, score) of distinct texts: whole texts first, then the best pair of their words."""
    whole = _contained(asked.select(F.col("query").alias("needle")), known.select(F.col("target").alias("hay")))
    ladder = F.when(F.col("needle") == F.col("hay"), 100).when(F.startswith("hay", "needle"), 90).otherwise(80)
    scores = whole.select(F.col("needle").alias("query"), F.col("hay").alias("target"), ladder.alias("score"))
    if min_score <= 70:
        q = asked.select("query", F.explode(F.array_distinct(search_words(F.col("query"), 2))).alias("needle"))
        t = known.select("target", F.explode(F.array_distinct(search_words(F.col("target"), 1))).alias("hay"))
        needles, hays = q.select("needle").distinct(), t.select("hay").distinct()
        pairs = _contained(needles, hays)
        if min_score <= 40:
            pairs = pairs.unionByName(_edited(needles, hays)).distinct()
        pairs = pairs.withColumn("score", word_score(F.col("needle"), F.col("hay"))).where(F.col("score") >= max(1, min_score))
        scores = scores.unionByName(q.join(pairs, "needle").join(t, "hay").select("query", "target", "score"))
    return scores.groupBy("query", "target").agg(F.max("score").alias("score")).where(F.col("score") >= min_score)


def fuzzy_join(queries: DataFrame, targets: DataFrame, min_score: int = 1, top_k: int | None = None) -> DataFrame:
    """(query_id, target_id, target, score) for normalised (query_id, query) and (target_id, target), score >= min_score >= 1.

    Texts are compared once, however many rows have them: whole queries and words are looked up by their rarest three
    letters, words with typing errors by a part that is left whole. All are joins by equality, and no pair is scored
    that shares none of these. ``top_k`` keeps the best of each query: score, then shorter target, then id.
    """
    asked = queries.where("query <> ''").select("query").distinct()
    known = targets.where("target <> ''").select("target").distinct()
    scored = _scored_texts(asked, known, max(1, min_score)).join(targets, "target").select("query", "target_id", "target", "score")
    if top_k is not None:
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.length("target"), "target_id")
        scored = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("rank")
    return queries.select("query_id", "query").join(scored, "query").select("query_id", "target_id", "target", "score")


def geocode(names: DataFrame, stations: DataFrame) -> DataFrame:
    """(query_id, target_id, name): the best station for each name; the name itself where none scores."""
    best = fuzzy_join(names, stations, 1, 1)
    return names.join(best, "query_id", "left").select("query_id", "target_id", F.coalesce("target", "query").alias("name"))


def search_stations(queries: DataFrame, stations: DataFrame, top_k: int = 5, clean=clean_station_name) -> DataFrame:
    """Raw (query_id, query) against raw (target_id, target): cleaned and normalised on both sides, best ``top_k``."""
    q = queries.withColumn("query", normalize_for_search(clean(F.col("query"))))
    t = stations.withColumn("target", normalize_for_search(clean(F.col("target"))))
    return fuzzy_join(q, t, 1, top_k)
