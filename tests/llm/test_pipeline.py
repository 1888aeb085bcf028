import re
from collections import Counter

from test_minhash import brute as near_classes
from test_substring import brute as substring_digests

from stopweave.llm import toxicity
from stopweave.llm.common import read, stage


def test_stages_hand_on_documents_and_cut_repeats(spark, sf_dir):
    import corpus_pipeline

    docs = read(spark, sf_dir, "documents")
    given = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(spark, docs, sf_dir))
        assert out.columns == docs.columns, name
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= given, name
        given, docs = set(ids), out
    windows = Counter()
    for r in docs.collect():
        w = (r["text"] or "").encode().split()
        windows.update({tuple(w[k : k + 50]) for k in range(len(w) - 49)})
    # a cut can join words into a window that was none in the input, so only nearly all are left in one document
    assert sum(n > 1 for n in windows.values()) <= len(windows) // 100
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in placed.select("doc_id").collect()} == given


ROWS = [
    (1, "plain words of the first kind " * 3, "en", "a"), (2, None, "en", "a"), (3, "", "en", None), (4, "plain words  of the first kind " * 3, None, "a"), (4, "plain words  of the first kind " * 3, None, "a"),
    (None, "a row without an id", "en", "a"), (5, " ".join(f"n{k}" for k in range(90)), "en", "b"), (6, " ".join(f"n{k}" for k in range(90)) + " tail", "en", "b"),
    (7, " ".join(f"p{k}" for k in range(30)) + " " + " ".join(f"s{k}" for k in range(60)), "en", "b"), (8, " ".join(f"q{k}" for k in range(99)) + " " + " ".join(f"s{k}" for k in range(60)), "en", "b"), (9, "long " * 60_000, "en", "c"),
]


def brute_force(rows):
    """(doc_id, text) after the stages of exact, near and substring deduplication, each by its plain rule."""
    best = {}
    for k, (i, t) in enumerate(rows):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, 0, 0, 0)), (-len(t or ""), i is None, i or 0, k))
    rows = [rows[k] for k in sorted(k for *_, k in best.values())]
    classes = near_classes(rows)
    rows = [r for r, c in zip(rows, classes, strict=True) if r[0] == c]
    cut = {i: (n, gone, sha) for i, n, gone, sha in substring_digests(rows)}
    return sorted(((i, cut[i][2]) for i, t in rows if not cut[i][1] or cut[i][0] > cut[i][1]), key=str)


def test_stages_against_brute_force_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    import hashlib

    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, score string, shard int, n long, id int, spans string, n_chars long"
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, "y", len(r[1] or "")) for r in ROWS], schema)
    spark.createDataFrame([(1, 0), (5, 0), (None, 1), (8, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = stage(docs.repartition(3))
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = stage(step(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns, name
    digest = lambda t: hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")).encode()).hexdigest()
    assert sorted(((r["doc_id"], digest(r["text"])) for r in kept.collect()), key=str) == brute_force([r[:2] for r in ROWS])
    assert all(r["n_chars"] == len(r["text"] or "") and r["shard"] == 1 for r in kept.collect())
    placed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert sum(r["size"] for r in placed) == sum(len((r["text"] or "").encode()) + 1 for r in kept.collect())


def test_tables_of_earlier_stages_go_unless_they_are_read(spark, tmp_path):
    import os

    import corpus_pipeline

    docs = stage(spark.createDataFrame([(k, f"text number {k // 2}") for k in range(20)], "doc_id long, text string"))
    lazy = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    folders = [f.removeprefix("file://") for f in corpus_pipeline._tables(str(tmp_path))[1].folders]
    twice = corpus_pipeline.drop_near_copies(spark, lazy, str(tmp_path))  # not written in between
    assert twice.count() == 10 and any(map(os.path.exists, folders))
    corpus_pipeline.drop_near_copies(spark, stage(twice), str(tmp_path))
    assert folders and not any(map(os.path.exists, folders))


def test_runs_on_two_tables_and_in_two_threads_leave_each_other_alone(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline

    made = {}
    for n in (3, 4):
        docs = spark.createDataFrame([(k, f"text number {k // n}") for k in range(24)], "doc_id long, text string")
        made[n] = (stage(docs), str(tmp_path / str(n)))
        docs.write.parquet(made[n][1] + "/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(made[n][1] + "/labels.parquet")
    lazy = {n: corpus_pipeline.drop_copies(spark, docs, where) for n, (docs, where) in made.items()}
    near = corpus_pipeline.drop_near_copies(spark, stage(lazy[4]), made[4][1])
    assert lazy[3].count() == 8 and near.count() == 6
    with ThreadPoolExecutor(2) as pool:
        counts = pool.map(lambda n: corpus_pipeline.run(spark, made[n][1]).count(), made)
    assert all(counts)


def test_run_on_an_empty_table_and_on_toxic_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, f"word{k} and more grimlous things" if k % 3 == 0 else f"word{k} and other plain things {k}") for k in range(90)]
    marks = [(k, int(k % 3 == 0)) for k in range(90)]
    for name, some, labels in (("none", [], []), ("some", rows, marks)):
        spark.createDataFrame(some, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect()}
    assert left and not any(i % 3 == 0 for i in left) and toxicity.K
