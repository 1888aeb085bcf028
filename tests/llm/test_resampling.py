import hashlib
import math
import re
import zlib
from collections import Counter

from helpers import same_rows

from stopweave.llm import resampling


def plain(docs, target):
    """The contract by hand for (doc_id, text)."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    toks = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    hashed = lambda t: [zlib.crc32(g.encode()) % 10000 for g in grams(toks(t))]
    s, t = Counter(b for _, x in docs for b in hashed(x)), Counter(b for x in target for b in hashed(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    rows = []
    for d, x in docs:
        own = hashed(x)
        u = (int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        w = sum(gain[b] for b in own)
        rows.append([d, len(own), w, w + math.floor(-1000 * math.log(-math.log(u))), None, len(toks(x))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def check(spark, docs, target, parts=5):
    df = spark.createDataFrame([(d, x, 1, "c") for d, x in docs], "doc_id long, text string, rank int, score string").repartition(parts)
    got = resampling.resample(df, spark.createDataFrame([(x,) for x in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target)
    return got


def test_oracle(spark, sf_dir):
    assert same_rows(resampling.query(spark, sf_dir), resampling.SQL, sf_dir) > 0


def test_against_plain_rule(spark):
    docs = [(i, " ".join(f"Word{(i * k) % 23}é-x" for k in range(1, 10 + i))) for i in range(60)]
    docs += [(None, None), (100, ""), (101, "—!?"), (102, "ÄÖ straße " * 5000), (103, "y" * 100_000), (7, docs[7][1]), (7, docs[7][1]), (None, "a b c " * 9), (104, "\x00\x7f\x1f")]
    check(spark, docs, ["word1é x word2é", None, "straße a b"])


def test_no_target_and_no_rows(spark):
    check(spark, [(i, "one two three four " * (i % 9)) for i in range(45)], [])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none.select("text")).count() == 0


def test_the_head_changes_no_result(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * k) % 37}" for k in range(40))) for i in range(80)]
    whole = sorted(map(str, check(spark, docs, ["w1 w2 w3"]).collect()))
    for name in ("HEAD", "HEAD_WORDS", "HEAD_PAIRS"):
        monkeypatch.setattr(resampling, name, 3)
    assert sorted(map(str, check(spark, docs, ["w1 w2 w3"]).collect())) == whole


def test_frequent_items_stay_in_bounded_counts(spark, monkeypatch):
    monkeypatch.setattr(resampling, "HEAD", 20)
    texts = spark.createDataFrame([("the cat " + " ".join(f"rare{i}x{k}" for k in range(8)),) for i in range(400)], "text string").repartition(3)
    head = resampling.frequent_features(texts)
    assert b"the" in head and (b"the", b"cat") in head


def test_states_are_those_of_the_bytes():
    tokens = [b"a", "é".encode(), b"abc", b"a", "é".encode()]
    grams = [b" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)]
    for head in (resampling.Head(), resampling.Head({b"a": zlib.crc32(b"a"), (b"a", "é".encode()): zlib.crc32("a é".encode())})):
        assert resampling.buckets_of(tokens, head).tolist() == [zlib.crc32(g) % 10000 for g in grams]
