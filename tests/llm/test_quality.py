import re
from collections import Counter

from helpers import same_rows

from stopweave.llm import quality
from stopweave.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, source string, kept string, w int, lines int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_figures(spark):
    texts = [None, "", "   \n", "a", "a b", "a b c", "a b c a b c", "x x x x", "1 2 3 4 1 2 3 9 2 3 4", "q # * $\nq # * $\n\n \nq", "é\x0bü\x0cb\r\nc " * 30, "w " * 20_000, " ".join(map(str, range(30_000))), "same", "same"]
    docs = spark.createDataFrame([(i or None, t, None if i % 2 else "h", "k", 0, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"] or 0: r for r in quality.quality_verdicts(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), i
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])


def test_frequent_lines_deplete_documents(spark):
    own = lambda i: " ".join(f"{i}-{k}" for k in range(60)).translate(str.maketrans("0123456789", "abcdefghij"))
    common = "Terms of use 1999  apply to all of this " + "x" * 2000
    rows = [(i, f"{common if i < 5 else common.upper()}\n{own(i)}", "a") for i in range(10)]
    rows += [(20 + i, own(20 + i), "a") for i in range(5)] + [(40 + i, f"{common}\n{own(40 + i)}", "b") for i in range(3)]
    rows += [(60 + i, own(99), "a") for i in range(30)]
    docs = spark.createDataFrame([(*r, "k", 0, 0) for r in rows], SCHEMA)
    got = {r["id"]: r for r in quality.judge(docs, more_than=5).collect()}
    assert {i for i, r in got.items() if not r["kept"]} == set(range(10))
    text = docs.select("text").where("doc_id = 3").join(quality.judge(docs, more_than=5).where("id = 3").select("removed"))
    assert text.select(quality.without_lines(text["text"], text["removed"])).first()[0] == own(3)


def test_oracle_and_empty(spark, sf_dir):
    assert same_rows(QUERIES["op7_quality_rules"](spark, sf_dir), ORACLES["op7_quality_rules"], sf_dir) == 200
    assert quality.quality_verdicts(spark.createDataFrame([], SCHEMA)).collect() == []
