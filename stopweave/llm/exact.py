"""Exact deduplication as a stateful stream over content digests, with full bytes compared on every hit.

Rows are staged once with a row number, their normalised text and its digest. A Structured Streaming aggregation
(RocksDB state store, no watermark, so state never expires) reads the staged digests and keeps, for each digest: the
number of rows, the best row's rank key, its stable identifier (doc_id) and its content locator (the staged row).
Whatever the stream puts into one class is then held against the bytes that the locator points at; rows whose bytes
differ (a digest collision) are grouped again by the bytes themselves, so the result never rests on the digest.

Everything is DataFrame and SQL functions. The state holds about a hundred bytes a distinct text. The stream's
aggregation combines within each task first, so a text that makes up a third of all rows costs one row a task. Later
micro-batches find the digests of earlier ones in the state. For the comparison of bytes the copies of a large group
are dealt to as many keys as their number asks for.

Defined results: null texts count as empty; all empty texts are equal. Of equal texts the row with the most code
points in the original text stays, then the smallest doc_id (a null doc_id comes last), then the earliest staged row,
so of rows that are repeated in full exactly one stays. Every row, repeated ones too, gets a result row; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm.common import ROW, read, shared_folder, stage, stage_rows

#: The white space that equality ignores.
BLANKS = "\t\n\x0b\x0c\r "
LENGTH, DIGEST = "__sw_length", "__sw_digest"
#: Files of the staged table that a micro-batch takes for each core, and copies that are compared under one key.
FILES_PER_CORE, COPIES_TOGETHER = 4, 256
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def without_blanks(text):
    return F.translate(text, BLANKS, "")


def _best():
    """Rank key, identifier and locator in one struct: its maximum is the row that stays."""
    return F.struct(F.col("n"), F.col("id").isNotNull().alias("known"), (-F.coalesce("id", F.lit(0))).alias("order"), (-F.col(ROW)).alias("locator"))


def _stream_state(folder: str, schema, session, files_per_batch: int) -> DataFrame:
    """Feed the staged digests through keyed state; the last update of each digest is its state."""
    spark = session.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        spark.conf.set(k, session.conf.get(k))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "200")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores would each reserve megabytes
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(folder).groupBy("digest").agg(F.max(_best()).alias("best"), F.count("*").alias("group_size"))
    out = shared_folder(session)

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/updates/batch={number}")

    query = state.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/updates")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return session.createDataFrame([], state.schema)
    fields = "digest string, best struct<n: bigint, known: boolean, order: bigint, locator: bigint>, group_size bigint"
    updates = session.read.schema(fields + ", batch bigint").parquet(f"{out}/updates")
    return updates.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("last")).select("digest", "last.best", "last.group_size")


def stage_texts(docs: DataFrame, text_col: str = "text", normalise=without_blanks) -> DataFrame:
    """``docs`` in the shared folder, with ROW and the length and the digest of each row's text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return stage_rows(docs.withColumns({LENGTH: F.length(text).cast("long"), DIGEST: F.sha2(normalise(text), 256)}))


def exact_dedup(staged: DataFrame, text_col: str = "text", id_col: str = "doc_id", normalise=without_blanks, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of ``staged`` (from ``stage_texts``): ROW, id, digest, keep_id, keep_row, group_size and kept.

    ``files_per_batch`` bounds a micro-batch of the stream, by default FILES_PER_CORE for each core; the result does not
    depend on it.
    """
    session = staged.sparkSession
    files_per_batch = files_per_batch or FILES_PER_CORE * session.sparkContext.defaultParallelism
    folder = shared_folder(session)
    narrow = stage(staged.select(ROW, F.col(id_col).cast("long").alias("id"), F.col(LENGTH).alias("n"), F.col(DIGEST).alias("digest")), folder)
    state = stage(_decided(_stream_state(folder, narrow.schema, session, files_per_batch), "digest"))
    classes = narrow.select(ROW, "id", "digest").join(state, "digest")

    rows = staged.select(ROW, normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    # the copies of a large group are dealt to several keys, each with its own copy of the original
    deals = F.ceil(F.col("group_size") / COPIES_TOGETHER)
    copied = classes.where(f"group_size > 1 and {ROW} <> keep_row").select(ROW, "keep_row", "digest", F.pmod(F.xxhash64(ROW), deals).alias("deal"))
    members = rows.join(copied, ROW)
    firsts = state.where("group_size > 1").select(F.col("keep_row").alias(ROW), deals.alias("deals"))
    originals = rows.join(firsts, ROW).select(F.col(ROW).alias("keep_row"), F.col("norm").alias("original"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
    differing = stage(members.join(originals, ["keep_row", "deal"]).where("norm <> original").select("digest").distinct())
    if not differing.isEmpty():
        apart = narrow.join(differing, "digest", "left_semi").join(rows, ROW)
        groups = apart.groupBy("digest", "norm").agg(F.max(_best()).alias("best"), F.count("*").alias("group_size"))
        again = apart.select(ROW, "id", "digest", "norm").join(_decided(groups, "digest", "norm"), ["digest", "norm"]).drop("norm")
        classes = classes.join(differing, "digest", "left_anti").unionByName(again)
    return classes.withColumn("kept", F.col(ROW) == F.col("keep_row"))


def _decided(state: DataFrame, *keys: str) -> DataFrame:
    return state.select(*keys, F.when(F.col("best.known"), -F.col("best.order")).alias("keep_id"), (-F.col("best.locator")).alias("keep_row"), "group_size")


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, columns unchanged."""
    staged = stage_texts(docs)
    return staged.join(exact_dedup(staged).where("kept").select(ROW), ROW, "left_semi").select(docs.columns)


def dedup_classes(documents: DataFrame) -> DataFrame:
    """The digest view: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup(stage_texts(documents.select("doc_id", "text"))).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def query(spark, sf_dir):
    return dedup_classes(read(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, max(n) AS most FROM t GROUP BY norm),
k AS (SELECT t.norm, min(t.doc_id) AS keep_id FROM t JOIN g ON t.norm = g.norm AND t.n = g.most GROUP BY t.norm)
SELECT t.doc_id, k.keep_id, g.group_size, t.doc_id = k.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm JOIN k ON t.norm = k.norm
"""
