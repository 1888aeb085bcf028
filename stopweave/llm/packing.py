"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces that fit; nothing is dropped. Pieces are dealt to shards
of about SHARD_ROWS rows by a hash, so a shard is the same size whatever the data holds, and each shard is packed by
itself, longest piece first:

- a piece goes into the open bin that it fills best (least room left);
- where none has room, the bin length is opened whose cost for each token it can expect to hold is least: a length
  can hold no more than the piece and what is still to come;
- in the end each bin is downsized to the least permitted length that its contents fit.

A sequence of length n costs OVERHEAD + n + n^2 / QUADRATIC: a fixed part, which favours long bins, and attention,
which favours short ones. Only (id, hash of the text, length) is shuffled; bins are written as placements.

Defined results: lengths are UTF-8 bytes plus one end mark, so null and empty texts have length 1 and are packed like
others. A null id is kept. Rows that repeat in full are counted first and packed one by one; pieces of equal size go by
id, hash of the text, copy and place, so ties don't depend on the input's split. Very long texts give many pieces. Other
columns are ignored. An empty table gives no placements.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm.common import read, stage

#: Permitted sequence lengths.
LENGTHS = (1024, 2048, 4096, 8192, 16384)
OVERHEAD, QUADRATIC = 256, 65536
SHARD_ROWS = 4096
#: Repeated rows that are spread at a time.
COPIES_TOGETHER = 10_000


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / QUADRATIC


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """For each piece its bin and its offset in it, and for each bin its length.

    ``sizes`` are in the order of packing, longest first, none above the largest length.
    """
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    placed, offsets, used, capacity = [], [], [], []
    to_come = sum(sizes)
    for size in sizes:
        to_come -= size
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            fit = [c for c in lengths if c >= size]
            c = min(fit, key=lambda c: (cost(c) / min(c, size + to_come), c))
            left, b = c, len(used)
            used.append(0)
            capacity.append(c)
        placed.append(b)
        offsets.append(used[b])
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    return placed, offsets, [next(c for c in lengths if c >= u) for u in used]


def pieces(docs: DataFrame, length_col, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """A row for each piece: id, print (a hash of the text), copy (the number among rows equal in these), piece, start, size."""
    top = max(lengths)
    rows = docs.select("id", F.xxhash64("text").alias("print"), length_col.cast("long").alias("n"))
    alike = rows.groupBy("id", "print", "n").agg(F.count("*").alias("rows"))
    last = F.floor((F.col("rows") - 1) / COPIES_TOGETHER)
    alike = alike.select("id", "print", "n", "rows", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("stretch"))
    lo = F.col("stretch") * COPIES_TOGETHER
    alike = alike.select("id", "print", "n", F.explode(F.sequence(lo, F.least(lo + COPIES_TOGETHER, F.col("rows")) - 1)).alias("copy"))
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top).cast("int"), F.lit(1)) - 1)
    out = alike.select("id", "print", "copy", "n", F.explode(cut).alias("piece"))
    start = F.col("piece").cast("long") * top
    return out.select("id", "print", "copy", "piece", start.alias("start"), F.least(F.lit(top), F.col("n") - start).cast("int").alias("size"))


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, length_col=None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Placements of ``docs`` (id, text): doc_id, piece, start, size, bin, bin_length, bin_offset.

    ``length_col`` is the length of each document in tokens, at least 1 and by default bytes and an end mark. ``bin``
    is unique over all shards. The same rows give the same bins, however they are split into files or partitions.
    """
    lengths = tuple(sorted(lengths))
    n = length_col if length_col is not None else F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    parts = stage(pieces(docs, n, lengths))
    shards = max(1, math.ceil(parts.count() / shard_rows))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("id", "print", "copy", "piece"), F.lit(shards)))
    fields = "doc_id long, piece int, start long, size int, bin long, bin_length int, bin_offset int"
    names = ["doc_id", "piece", "start", "size", "bin", "bin_length", "bin_offset"]

    def run(table):
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("print", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        placed, offsets, capacity = pack(table.column("size").to_pylist(), lengths)
        first = table.column("shard")[0].as_py() << 32
        new = [pa.array([first + b for b in placed], pa.int64()), pa.array([capacity[b] for b in placed], pa.int32()), pa.array(offsets, pa.int32())]
        return pa.table([table.column("id"), table.column("piece"), table.column("start"), table.column("size"), *new], names=names)

    return dealt.groupBy("shard").applyInArrow(run, fields)


def query(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text"))
