import random
import sys
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from stopweave.functions import text as tx
from stopweave.functions import transit as tr


def values(spark, f, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(f(*map(F.col, df.columns)).alias("v")).collect()]


def test_normalize_for_search(spark):
    cases = {"München": "munchen", "Gdańsk": "gdansk", "Århus": "arhus", "İı": "ii", "ẞß": "ßss", "Þór Æ œ Łódź ĳ": "thor ae oe lodz ij", "": "", "é": "e"}
    assert values(spark, tx.normalize_for_search, [(k,) for k in cases], "t string") == list(cases.values())


def test_fuzzy_ladder(spark):
    cases = [("", "a", 0), (None, "a", 0), ("berlin", "berlin", 100), ("ber", "berlin", 90), ("e", "berlin", 80), ("zz berlin", "berlin ost", 70), ("zz ber", "berlin ost", 60), ("zz erl", "berlin ost", 50), ("berlyn", "berlin ost", 40), ("bexlyn", "berlin ost", 30), ("q x", "berlin", 0), ("ab", "cd", 0)]
    assert values(spark, tx.fuzzy_match_score, [c[:2] for c in cases], "q string, t string") == [c[2] for c in cases]


def test_clean_station_name(spark):
    cases = {"München Hauptbahnhof": "München", "Bonn HAUPTBAHNHOF": "Bonn", "London Railway Station": "London", "Madrid ESTACIÓN": "Madrid", "Lisboa Estação": "Lisboa", "X  Halt": "X", "北京火车站": "北京火车", "東京駅": "東京", "A  B ": "A B", "Bahnhof Hauptbahnhof": "Bahnhof", "Foo Train Station Gare": "Foo Train Station"}
    assert values(spark, tx.clean_station_name, [(k,) for k in cases], "t string") == list(cases.values())


def test_escape_uri_count_and_keys(spark):
    assert values(spark, tx.escape_html, [("<a href=\"x\">'&'",)], "t string") == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;"]
    assert values(spark, tx.uri_component, [("a b+c!'()*~é/",)], "t string") == ["a%20b%2Bc!'()*~%C3%A9%2F"]
    assert values(spark, tx.format_count, [(1234567,)], "n long") == ["1,234,567"]
    assert values(spark, tx.request_key, [("Bonn", None, "7")], "a string, b string, c string") == ["bonn|,7"]
    assert values(spark, lambda u: tx.matches_any(u, [r"\.PNG$"]), [("x.png",), (None,)], "u string") == [True, False]


def test_delays_round_halves_up(spark):
    f = lambda a, b: tr.delay_minutes(a.cast("timestamp"), b.cast("timestamp"))
    rows = [("2024-01-01 00:01:30", "2024-01-01 00:00:00"), ("2024-01-01 00:00:00", "2024-01-01 00:01:30"), (None, "2024-01-01 00:00:00")]
    assert values(spark, f, rows, "a string, b string") == [-1, 2, None]


def test_detect_mode(spark):
    cases = [("IC Berlin", None, "TRAM", "INTERCITY"), ("", "IC 1", "BUS", "BUS"), ("éintercity", "", None, "INTERCITY"), ("xintercity", "", None, None), ("Locality", "", "BUS", "REGIONAL"), ("RE 5", None, "BUS", "REGIONAL"), (None, None, "NIGHT_RAIL", "INTERCITY"), (None, None, "REGIONAL_RAIL", "REGIONAL"), (None, "tgv", "BUS", "INTERCITY"), (None, None, None, None)]
    assert values(spark, tr.detect_mode, [c[:3] for c in cases], "h string, r string, m string") == [c[3] for c in cases]


def test_age_label_freshness_and_walks(spark):
    f = lambda at: tr.age_label(at.cast("timestamp"), F.lit("2024-01-01 01:00:00").cast("timestamp"))
    rows = [("2024-01-01 00:59:01",), ("2024-01-01 00:58:30",), (None,)]
    assert values(spark, f, rows, "a string") == ["59s ago", "2m ago", "Not checked yet"]
    g = lambda at: tr.is_fresh(at.cast("timestamp"), F.lit("2024-01-01 01:00:00").cast("timestamp"))
    assert values(spark, g, [("2024-01-01 00:30:00",), ("2024-01-01 00:30:01",), (None,)], "a string") == [False, True, False]
    assert [round(x) for x in values(spark, tr.walk_radius_m, [(900,), (1800,)], "s int")] == [1260, 2520]
    assert values(spark, lambda a, b: tr.has_coords(a, b, True), [(0.0, 1.0), (1.0, 1.0), (None, 1.0)], "a double, b double") == [False, True, False]


def test_names_are_decomposed_in_full(spark):
    rng = random.Random(9)
    every = [chr(k) for k in range(1, sys.maxunicode + 1) if not 0xD800 <= k <= 0xDFFF]
    marks = [c for c in every if unicodedata.combining(c)]
    mixed = ["".join(rng.choice(["a", "é", "한", "آ", chr(rng.randrange(0x180, 0xD800)), *rng.choices(marks, k=4)]) for _ in range(12)) for _ in range(600)]
    every = [c for c in every if c not in tx.SPECIAL_LETTERS]
    alone = [c for c in every if c != unicodedata.normalize("NFD", c) or unicodedata.combining(c)]
    texts = [*alone, *("".join(every[k : k + 500]) for k in range(0, len(every), 500)), *mixed, "서울역", ""]
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) <= 0x36F)
    want = [bare(t) for t in texts]
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "t": texts})).repartition(8)
    got = {r["i"]: r["v"] for r in df.select("i", tx.decomposed(F.col("t")).alias("v")).collect()}
    assert [(texts[i], got[i]) for i, w in enumerate(want) if got[i] != w][:5] == []
    assert values(spark, tx.normalize_for_search, [("서울역",), ("ﬡÉ",), (None,)], "t string") == [bare("서울역"), bare("ﬡÉ").lower(), None]
