from stopweave.llm import quality
from stopweave.llm.queries import QUERIES


def test_a_shared_line_goes_in_hosts_of_any_size(spark, tmp_path):
    line = "subscribe to our newsletter for more stories like this one " * 9
    letters = lambda n: "".join(chr(97 + int(x)) for x in str(n))  # digits would all be read as 0
    text = lambda host, i: " ".join(f"{host}-{letters(i)}-{letters(k)}" for k in range(60))
    rows = [(i, text("hot", i) + ("\n" + line if i < 25 else ""), "hot") for i in range(300)]
    rows += [(1000 + i, text("small", i) + ("\n" + line if i < 25 else ""), "small") for i in range(30)]
    rows += [(2000 + i, text("rare", i) + ("\n" + line if i < 20 else ""), "rare") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("op7_quality_rules", "op7_quality_rules_any_host"):
        got = {r["doc_id"]: r["removed_chars"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert {i for i, n in got.items() if n} == {*range(25), *range(1000, 1025)} and len(got) == 360
    plain = "read more about what we do with the data that you give us"  # the long line repeats itself, so the base rules reject it
    docs = spark.createDataFrame([(i, t.replace(line, plain), h) for i, t, h in rows], "doc_id long, text string, source string")
    left = quality.without_frequent_lines(docs)
    want = {i: t.split("\n")[0] + ("\n" + plain if h == "rare" and i < 2020 else "") for i, t, h in rows}
    assert left.columns == docs.columns and {r["doc_id"]: r["text"] for r in left.collect()} == want
