"""Importance resampling towards a target: hashed n-gram features, exact bucket totals, Gumbel draws.

Features are runs of one to three words; a feature's bucket is its CRC-32 modulo BUCKETS. Three passes:

1. Head. Each task sums up its words and pairs in a bounded table of counts (frequent items by decrement: whatever holds
   more than one part in HEAD of a task's items stays in); summed over the tasks, the HEAD_WORDS and HEAD_PAIRS highest
   are broadcast with their CRC states. Long words stay out, so the broadcast has a fixed bound in bytes. What is in the
   head decides how fast a bucket is found and never which bucket.
2. Buckets. Words and pairs of the head take their state from the broadcast table, all others take the CRC of their
   bytes; a run of three goes on from its pair's state. Buckets are put down by document as 16-bit numbers.
3. Totals and weights. Each task sums up the buckets it reads, in BUCKETS numbers, whatever the documents; those meet as
   at most one row for each task and bucket. The gains are BUCKETS rows, and a document's weight is their sum.

The draw is a distributed numbering (``ranks``) of the eligible documents by score, so no task or driver sees them all.

Defined results: a null or empty text has no words, no features, weight 0 and no draw below MIN_WORDS words; a null id
is hashed as the empty string and comes last among ties; rows that are repeated are documents of their own, and of rows
equal in score and id any may come first; very long texts and words count in whole; an empty table gives an empty
result, an empty target has no features; columns other than id and text are passed by, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm.common import CRC_TABLE_SQL, crc32_sql, read, stage
from stopweave.llm.ranks import running

BUCKETS = 10_000
MIN_WORDS, DRAWN_PERCENT, SEED = 20, 5, 42
#: Counts that a task keeps, entries that are broadcast, and bytes of the longest word among them.
HEAD, HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 65_536, 8_192, 32_768, 32

_IN_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Bytes of a word in lower case, all others as a space.
_BYTES = bytes(c if c in _IN_WORD else 32 for c in bytes(range(256)).lower())


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return text.translate(_BYTES).split()


class Head(dict):
    """CRC states of frequent words (by word) and pairs (by both words); what is missing takes its bytes' CRC."""

    def __missing__(self, item) -> int:
        return crc32(item) if isinstance(item, bytes) else crc32(b" " + item[1], crc32(item[0]))


def buckets_of(tokens: list[bytes], head: Head) -> np.ndarray:
    """The buckets of all features of a document."""
    one = map(head.__getitem__, tokens)
    two = list(map(head.__getitem__, zip(tokens, tokens[1:], strict=False)))
    three = map(crc32, (b" " + x for x in tokens[2:]), two)
    states = np.fromiter((x for part in (one, two, three) for x in part), np.uint32)
    return (states % BUCKETS).astype(np.uint16)


def _texts(batch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _thinned(counts: Counter, room: int) -> Counter:
    """The counts less what the one after the ``room`` highest has, so at most ``room`` stay."""
    if len(counts) <= room:
        return counts
    least = heapq.nlargest(room + 1, counts.values())[-1]
    return Counter({k: n - least for k, n in counts.items() if n > least})


def frequent_features(texts: DataFrame) -> Head:
    """The head of a table of ``text``: at most HEAD_WORDS words and HEAD_PAIRS pairs of HEAD_BYTES a word."""

    def count(batches):
        kinds = [Counter(), Counter()]
        for batch in batches:
            for text in _texts(batch):
                tokens = words(text)
                kinds[0].update(tokens)
                kinds[1].update(zip(tokens, tokens[1:], strict=False))
                for k in (0, 1):
                    if len(kinds[k]) > 4 * HEAD:
                        kinds[k] = _thinned(kinds[k], HEAD)
        rows = [(w, None, n) for w, n in _thinned(kinds[0], HEAD).items() if len(w) <= HEAD_BYTES]
        rows += [(v, w, n) for (v, w), n in _thinned(kinds[1], HEAD).items() if max(len(v), len(w)) <= HEAD_BYTES]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["first", "second", "n"])

    counts = stage(texts.select("text").mapInArrow(count, "first binary, second binary, n long").groupBy("first", "second").agg(F.sum("n").alias("n")))
    order = [F.desc("n"), "first", "second"]
    head = Head()
    for first, _, _ in counts.where("second is null").orderBy(*order).limit(HEAD_WORDS).collect():
        head[bytes(first)] = crc32(first)
    for first, second, _ in counts.where("second is not null").orderBy(*order).limit(HEAD_PAIRS).collect():
        head[bytes(first), bytes(second)] = crc32(b" " + second, crc32(first))
    return head


def featured(docs: DataFrame, head: Head) -> DataFrame:
    """``docs`` (doc_id, text) as staged (doc_id, n_words, buckets)."""
    held = docs.sparkSession.sparkContext.broadcast(dict(head))

    def run(batches):
        own = Head(held.value)
        for batch in batches:
            n, found = [], []
            for text in _texts(batch):
                tokens = words(text)
                n.append(len(tokens))
                found.append(buckets_of(tokens, own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_words", "buckets"])

    return stage(docs.mapInArrow(run, "doc_id long, n_words long, buckets binary"))


def bucket_totals(features: DataFrame) -> DataFrame:
    """(bucket, n) over all documents, without the buckets that have none."""

    def count(batches):
        totals = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for found in batch.column("buckets").to_pylist():
                totals += np.bincount(np.frombuffer(found, np.uint16), minlength=BUCKETS)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(totals[held], pa.int64())], names=["bucket", "n"])

    return features.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """The gain of each bucket from the totals of both sides; BUCKETS numbers."""
    spark = source.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    for df, name in ((source, "s"), (target, "t")):
        both = both.join(df.withColumnRenamed("n", name), "bucket", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("double"))
    rows = both.collect()
    s_all, t_all = (sum(r[k] for r in rows) for k in ("s", "t"))
    held = spark.createDataFrame([(r.bucket, r.s, r.t) for r in rows], "bucket int, s double, t double")
    ratio = (F.col("t") + 1) * F.lit(s_all + BUCKETS) / ((F.col("s") + 1) * F.lit(t_all + BUCKETS))
    out = held.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()
    return [r.gain for r in sorted(out)]


def weigh(features: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    held = features.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        own = np.array(held.value, np.int64)
        for batch in batches:
            found = [np.frombuffer(x, np.uint16) for x in batch.column("buckets").to_pylist()]
            sizes, sums = [len(x) for x in found], [int(own[x].sum()) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame) -> DataFrame:
    """Adds the score: the weight plus Gumbel noise from a hash of the id."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((number + 0.5) / 4294967296.0))).cast("long")
    return weighed.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_features, weight, score, and its rank where it is drawn.

    ``percent`` of the documents with MIN_WORDS words or more are drawn, by score. ``target`` has the text column too.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    aims = target.select(F.lit(None).cast("long").alias("doc_id"), text)
    head = frequent_features(docs)
    features = featured(docs, head)
    gain = gains(bucket_totals(features), bucket_totals(featured(aims, head)))
    rows = stage(scored(weigh(features, gain)).withColumn("__sw_tie", F.monotonically_increasing_id()))
    able = rows.where(F.col("n_words") >= MIN_WORDS)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("__sw_tie")]
    ranked = running(able.withColumn("__sw_all", F.lit(1)), ["__sw_all"], order, "place", few_keys=True).drop("__sw_all")
    out = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    out = out.unionByName(rows.where(F.col("n_words") < MIN_WORDS).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def query(spark, sf_dir):
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _sql_features(name: str, table: str, key: str) -> str:
    w = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = " UNION ALL ".join(f"SELECT r, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS f FROM {name}w" for n in (1, 2, 3))
    return f"""{name}w AS MATERIALIZED (SELECT row_number() OVER () AS r, {key} AS doc_id, {w} AS w FROM {table}),
{name}f AS MATERIALIZED (SELECT r, f, count(*) AS n FROM ({runs}) GROUP BY r, f)"""


SQL = f"""
WITH {CRC_TABLE_SQL},
{_sql_features("s", "documents", "doc_id")},
{_sql_features("t", "benchmark", "NULL")},
h AS MATERIALIZED (SELECT f, {crc32_sql("f")} % {BUCKETS} AS b FROM (SELECT f FROM sf UNION SELECT f FROM tf), crc),
sb AS (SELECT b, sum(n) AS s FROM sf JOIN h USING (f) GROUP BY b),
tb AS (SELECT b, sum(n) AS t FROM tf JOIN h USING (f) GROUP BY b),
g AS (SELECT range AS b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) + {BUCKETS} FROM sf) AS DOUBLE)
        / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) + {BUCKETS} FROM tf) AS DOUBLE)))) AS BIGINT) AS gain
      FROM range({BUCKETS}) LEFT JOIN sb ON sb.b = range LEFT JOIN tb ON tb.b = range),
o AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM sf JOIN h USING (f) JOIN g USING (b) GROUP BY r),
q AS (SELECT sw.r, sw.doc_id, len(sw.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(sw.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
      FROM sw LEFT JOIN o USING (r)),
e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM q WHERE words >= {MIN_WORDS})
SELECT q.doc_id, n_features, weight, score, CASE WHEN k <= {DRAWN_PERCENT} * n // 100 THEN k END AS rank FROM q LEFT JOIN e USING (r)
"""
