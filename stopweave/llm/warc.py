"""A deterministic sharded WARC writer, and a reader for what it writes.

1. Pages of equal page_id, payload and url collapse into one row with their number, so a page that makes up a third of
   all rows costs one row a task. Of equal payloads of some size the smallest page_id becomes the response record and
   the others revisit it; this is decided on rows without payloads.
2. These narrow rows are sorted by range, and a running sum of their bytes in that order, exact over all ranges, gives
   each its shard: about SHARD_BYTES each, however the ids are spread. Shards depend on the data alone, so the same
   pages give the same files, whatever the cluster.
3. Payloads move, compressed, to their row's key and then to their shard's task, where they are sorted and streamed out as one gzip
   member a record, rolling to a new file once the compressed size reaches a limit. Shards are dealt to tasks by their
   number. Headers, lengths and digests are computed from the payload as it is written.
4. A task writes under a temporary name and renames a file when it is complete; because content and names are
   deterministic, a repeated task replaces a file by itself. Last, a manifest (file, records, bytes, SHA-256) is
   written; readers take only what the manifest lists.

The output folder must be one that executors and driver share; it is reached through ``pyarrow.fs``.

Defined results: null html is an empty payload; a null or empty url gives ``urn:page:<id>``; of rows with equal payload
and page_id the one with the smallest url is the response. A page_id may repeat or be null (nulls sort last and are
never preferred as the response). Very long payloads are one record each. An empty table writes an empty manifest and
no file. Other columns than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopweave.llm.common import read, shared_folder, stage

#: Payloads below this size are always written in full.
LEAST_REVISIT_BYTES = 100
ROLL_BYTES = 32 << 20
#: Bytes of records before compression that a shard holds, and what a record's headers count for.
SHARD_BYTES, HEADER_BYTES = 64 << 20, 400
#: Records of one repeated page that a row stands for at most.
COPIES_TOGETHER = 10_000
#: Tasks that shards are dealt to at most; a task writes its shards one after the other.
MOST_TASKS = 20_000
_KEY = ["unknown", "page", "digest", "address"]
DATE = "2020-01-01T00:00:00Z"
MANIFEST_SCHEMA = "file string, records long, bytes long, sha256 string"
_CRLF = b"\r\n"


def _record(page_id, url, payload: bytes, digest: str, refers: dict | None, date: str, n: int, size: int) -> bytes:
    """One WARC/1.1 record; every header and length is computed here, from the payload or, for a revisit, its size."""
    name = lambda key: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"
    uri = url or f"urn:page:{'' if page_id is None else page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (size if refers else len(payload))
    block = http if refers else http + payload
    head = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", name(f"{page_id}:{n}:{digest}")),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(uri.split())),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("WARC-Payload-Digest", "sha256:" + digest),
        ("Content-Length", str(len(block))),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if refers:
        head[5:5] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", name(f"{refers['page_id']}:0:{digest}")),
            ("X-Refers-To-Page-Id", "" if refers["page_id"] is None else str(refers["page_id"])),
        ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + _CRLF + block + _CRLF + _CRLF


def _gzip(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Shard:
    """The files of one shard, rolled by compressed size; temporary until closed."""

    def __init__(self, folder: str, shard: int, roll: int):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.part, self.done, self.out = shard, roll, 0, [], None

    def put(self, member: bytes) -> None:
        if self.out and self.size + len(member) > self.roll:
            self.close()
        if not self.out:
            self.name = f"part-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.temp = f"{self.folder}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.n += 1

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.fs.move(self.temp, f"{self.folder}/{self.name}")
            self.done.append({"file": self.name, "records": self.n, "bytes": self.size, "sha256": self.sha.hexdigest()})
            self.out, self.part = None, self.part + 1


def _sharded(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """For each key of ``rows`` and stretch of its copies: n, before (copies of the page ahead of it), refers, shared and shard."""
    keys = rows.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.max("size").alias("size"))
    ahead = Window.partitionBy("unknown", "page", "digest").orderBy("address").rowsBetween(Window.unboundedPreceding, -1)
    keys = stage(keys.withColumn("ahead", F.coalesce(F.sum("copies").over(ahead), F.lit(0))))
    first = F.min(F.struct("unknown", "page")).alias("first")
    groups = keys.where(F.col("size") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(first, F.sum("copies").alias("all")).where("all > 1")
    groups = groups.select("digest", F.col("first.unknown").alias("none"), F.col("first.page").alias("refers"))
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_TOGETHER))).alias("stretch")
    cut = keys.select("*", stretch).withColumn("n", F.least(F.lit(COPIES_TOGETHER), F.col("copies") - F.col("stretch") * COPIES_TOGETHER))
    cut = cut.select(*_KEY, "size", "stretch", "n", (F.col("ahead") + F.col("stretch") * COPIES_TOGETHER).alias("before"))
    cut = cut.join(groups, "digest", "left").withColumn("shared", F.col("none").isNotNull())
    response = ~F.col("shared") | ((F.col("before") == 0) & (F.col("none") == F.col("unknown")) & (F.col("refers") == F.col("page")))
    full = F.when(~F.col("shared"), F.col("n") * F.col("size")).when(response, F.col("size")).otherwise(0)
    cut = cut.withColumns({"response": response, "bytes": F.col("n") * HEADER_BYTES + full})
    order = ["unknown", "page", "digest", "address", "stretch"]
    ordered = stage(cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    totals = ordered.groupBy("range").agg(F.sum("bytes").alias("bytes"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("offset"))
    running = F.coalesce(F.sum("bytes").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.withColumn("running", running).join(offsets, "range")
    return stage(placed.withColumn("shard", F.floor((F.col("offset") + F.col("running")) / shard_bytes)).drop("range", "running", "offset", "bytes"))


def _packed(rows: DataFrame) -> DataFrame:
    """The key columns and ``payload``, the html in UTF-8, compressed for its way through the shuffles."""
    schema = pa.schema([("unknown", pa.bool_()), ("page", pa.int64()), ("digest", pa.binary()), ("address", pa.string()), ("payload", pa.binary())])

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            payloads = pa.array([pack(x.as_buffer()) for x in batch.column("html").cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), payloads], schema=schema)

    return rows.mapInArrow(run, "unknown boolean, page long, digest binary, address string, payload binary")


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> DataFrame:
    """Write (page_id, url, html) below ``folder``, a URI on a shared file system; returns the committed manifest."""
    from pyarrow import fs

    datetime.strptime(date, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    page = F.col("page_id").cast("long")
    rows = pages.select(page.isNull().alias("unknown"), F.coalesce(page, F.lit(0)).alias("page"), F.coalesce("url", F.lit("")).alias("address"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2(F.encode("html", "utf-8"), 256)), "size": F.octet_length("html").cast("long")})
    sharded = _sharded(rows.drop("html"), shard_bytes)
    shards = (sharded.agg(F.max("shard")).first()[0] or 0) + 1
    payloads = _packed(rows.select(*_KEY, "html")).groupBy(*_KEY).agg(F.first("payload").alias("payload"))
    # a revisit's payload stays behind: its record has headers only
    placed = payloads.join(sharded, _KEY).withColumn("payload", F.when(F.col("response"), F.col("payload")))
    tasks = min(shards, MOST_TASKS)
    ordered = placed.withColumn("task", (F.col("shard") % tasks).cast("int")).repartitionById(tasks, "task").sortWithinPartitions("shard", *_KEY, "stretch")
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        import zstandard

        now, unpack = None, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for x in batch.select(["shard", "unknown", "page", "address", "payload", "size", "digest", "none", "refers", "shared", "response", "before", "n"]).to_pylist():
                if now is None or now.shard != x["shard"]:
                    if now:
                        now.close()
                        yield pa.RecordBatch.from_pylist(now.done, schema=schema)
                    now = _Shard(folder, x["shard"], roll_bytes)
                page = None if x["unknown"] else x["page"]
                data = unpack(x["payload"]) if x["response"] else bytes(0)
                digest = x["digest"].hex()
                if x["response"] and hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"page {page}: the payload does not match its digest")
                first = {"page_id": None if x["none"] else x["refers"]}
                for k in range(x["n"]):
                    refers = first if x["shared"] and (k or not x["response"]) else None
                    now.put(_gzip(_record(page, x["address"], data, digest, refers, date, x["before"] + k, x["size"])))
        if now:
            now.close()
            yield pa.RecordBatch.from_pylist(now.done, schema=schema)

    target, root = fs.FileSystem.from_uri(folder)
    target.create_dir(f"{root}/_temporary", recursive=True)
    manifest = ordered.mapInArrow(run, MANIFEST_SCHEMA)
    committed = stage(manifest.repartitionByRange(1, "file").sortWithinPartitions("file"), f"{folder}/_manifest")
    target.delete_dir(f"{root}/_temporary")
    return committed


def _records(stream):
    """(headers, block) of each record of a gzip WARC stream, one record in memory at a time."""
    z, held = zlib.decompressobj(31), bytearray()
    while True:
        data = z.unconsumed_tail or z.unused_data or stream.read(1 << 20)
        if not data:
            return
        if z.eof:
            z = zlib.decompressobj(31)
        held += z.decompress(data)
        if z.eof:
            head, _, rest = bytes(held).partition(_CRLF + _CRLF)
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            held = bytearray()
            if not z.unused_data:
                z = zlib.decompressobj(31)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the files in the manifest; digests are computed from the bytes read, and held against the headers."""
    fields = "page_id long, record_id string, record_type string, target_uri string, digest string, size long, refers_to long, refers_id string"
    kinds = [("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("refers_to", pa.int64()), ("refers_id", pa.string())]
    if with_payload:
        fields, kinds = fields + ", payload binary", [*kinds, ("payload", pa.binary())]
    schema = pa.schema(kinds)

    def run(batches):
        from pyarrow import fs

        source, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with source.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in _records(stream):
                        if head["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                            raise ValueError(f"{name}: a block does not match its digest")
                        body = block.partition(_CRLF + _CRLF)[2]
                        response = head["WARC-Type"] == "response"
                        number = lambda k, head=head: int(head[k]) if head.get(k) else None
                        rows.append({"page_id": number("X-Page-Id"), "record_id": head["WARC-Record-ID"], "record_type": head["WARC-Type"], "target_uri": head["WARC-Target-URI"], "digest": hashlib.sha256(body).hexdigest() if response else head["WARC-Payload-Digest"].removeprefix("sha256:"), "size": len(body) if response else None, "refers_to": number("X-Refers-To-Page-Id"), "refers_id": head.get("WARC-Refers-To")} | ({"payload": body if response else None} if with_payload else {}))
                        size += len(body)
                        if len(rows) >= 2000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/_manifest").select("file")
    tasks = min(max(1, manifest.count()), MOST_TASKS)
    number = F.row_number().over(Window.orderBy("file")) - 1  # a row for each file
    return manifest.withColumn("task", (number % tasks).cast("int")).repartitionById(tasks, "task").mapInArrow(run, fields)


def archive_report(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages, read the archives back, and resolve revisits against the responses they refer to."""
    write_archives(pages, folder)
    records = stage(read_archives(pages.sparkSession, folder))
    full = records.where("record_type = 'response'")
    wanted = records.where("record_type = 'revisit'")
    theirs = full.join(wanted.select(F.col("refers_id").alias("record_id")).distinct(), "record_id").select(F.col("record_id").alias("refers_id"), F.col("size").alias("full"), F.col("digest").alias("theirs"))
    resolved = wanted.join(theirs, "refers_id", "left").withColumns({"size": F.col("full"), "digest": F.when(F.col("theirs") == F.col("digest"), F.col("digest"))})
    columns = ["page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return full.select(*columns).unionByName(resolved.select(*columns))


def query(spark, sf_dir):
    return archive_report(read(spark, sf_dir, "pages"), shared_folder(spark))


SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN b >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""
