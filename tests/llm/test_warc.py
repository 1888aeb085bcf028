import gzip
import hashlib

from helpers import same_rows

from stopweave.llm import warc
from stopweave.llm.common import shared_folder
from stopweave.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string, digest string, shard int"
LONG = "<p>é</p>" * 40


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def test_edges(spark):
    rows = [(3, "http://a/x y", LONG), (1, None, LONG), (2, "http://b", None), (7, "http://c", ""), (5, "u", "short"), (6, "u", "short"), (8, "v", "z" * 200_000), (8, "v", "z" * 200_000), (None, "w", "z" * 200_000), (9, "crlf", "\r\n\r\n" + LONG)]
    got = warc.archive_report(pages(spark, rows), shared_folder(spark)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html[r["page_id"]]), hashlib.sha256(html[r["page_id"]]).hexdigest())
    assert [(by[k][0]["record_type"], by[k][0]["refers_to"]) for k in (1, 3, 2, 7, 5, 6, 9, None)] == [("response", None), ("revisit", 1), ("response", None), ("response", None), ("response", None), ("response", None), ("response", None), ("revisit", 8)]
    assert sorted(x["record_type"] for x in by[8]) == ["response", "revisit"]
    assert warc.archive_report(pages(spark, []), shared_folder(spark)).collect() == []


def test_files_are_deterministic_sorted_and_rolled(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    seen = []
    for frame in (table, table.repartition(7)):
        folder = shared_folder(spark)
        manifest = warc.write_archives(frame, folder, roll_bytes=20_000, shard_bytes=100_000).orderBy("file").collect()
        files = {r["file"]: open(f"{folder.removeprefix('file://')}/{r['file']}", "rb").read() for r in manifest}
        assert all(hashlib.sha256(files[r["file"]]).hexdigest() == r["sha256"] and len(files[r["file"]]) == r["bytes"] <= 20_000 + 30_000 for r in manifest)
        assert sum(r["records"] for r in manifest) == table.count() and len(files) > 3
        text = b"".join(gzip.decompress(files[k]) for k in sorted(files)).decode(errors="replace")
        ids = [int(x.split("\r\n")[0]) for x in text.split("X-Page-Id: ")[1:]]
        assert ids == sorted(ids)
        seen.append(files)
    assert seen[0] == seen[1]
    back = warc.read_archives(spark, folder, with_payload=True).where("record_type = 'response'").join(table, "page_id")
    assert back.where("decode(payload, 'utf-8') <> html").count() == 0 and back.count() > 0


def test_copies_of_one_page_and_outlying_ids(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES_TOGETHER", 3)
    rows = [(5, "u", LONG)] * 20 + [(5, "t", LONG)] * 2 + [(10**15, None, LONG)] + [(k, "v", f"page {k} " * 50) for k in range(100, 140)]
    folder = shared_folder(spark)
    manifest = warc.write_archives(pages(spark, rows).repartition(4), folder, shard_bytes=4000).collect()
    assert sum(r["records"] for r in manifest) == len(rows) and len({r["file"][:11] for r in manifest}) > 5
    got = warc.read_archives(spark, folder).collect()
    assert len({r["record_id"] for r in got}) == len(rows)
    five = [r for r in got if r["page_id"] == 5]
    assert [r["target_uri"] for r in five if r["record_type"] == "response"] == ["t"] and len(five) == 22
    assert {r["refers_id"] for r in got if r["record_type"] == "revisit"} == {r["record_id"] for r in five if r["record_type"] == "response"}


def test_oracle(spark, sf_dir):
    assert same_rows(QUERIES["op8_warc"](spark, sf_dir), ORACLES["op8_warc"], sf_dir) > 20
