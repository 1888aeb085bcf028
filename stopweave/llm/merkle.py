"""Merkle manifest of a dataset: leaf coordinates from bitmap ranks, levels from slot arrays, proofs from the top down.

A row's leaf is the SHA-256 of its fields. Leaves of one source ascend by doc_id; every 16 consecutive nodes make the
next one, up to the source's subroot; the subroots, ordered by source, make the root in the same way.

- Coordinates. Ids are merged into bitmaps of 64 per (source, word); words without ids are not stored, which is the
  compression. Each task merges what it has before the shuffle, so a hot source costs a row a word and task. Popcounts
  are summed by chunks of 1,024 words, the chunks get running sums (``ranks``), and words running sums inside their
  chunk: that is the directory. A leaf's index is its word's sum plus the set bits below its own; no leaf is sorted.
  Only where a word holds more rows than bits (an id repeated in a source, or null) its rows are numbered in order.
- Levels. Nodes meet by (source, index div 16) in an array of at most 16 slots, are hashed into the parent and put
  down. The loop over levels is as long as the logarithm of the largest source.
- Proofs. From the top down each node gets its path: for each level the digests before it and after it in its run, as
  text. Nodes share their run's path, so what moves is one path for 16 leaves; a leaf's proof and its fold are computed
  where the run is spread out.

Sources number as they may: subroots are ranked by ``running`` and take the same road as leaves.

Defined results: null fields are `-`; a null source is a source of its own and comes first; null ids come last in their
source; rows with one id in one source are ordered by their leaf, and rows that are equal throughout get neighbouring
leaves; a source of one row has that leaf as subroot, a single source its subroot as root, and both an empty proof; an
empty table has no root and gives an empty result; very long texts count in whole; columns other than the five fields
are passed by, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopweave.llm.common import CRC_TABLE_SQL, crc32_sql, read, stage
from stopweave.llm.ranks import running

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FANOUT = 16
#: Words of 64 ids in a chunk of the directory, as a power of two; the word and the chunk of null ids, behind all others.
CHUNK_BITS, NULL_WORD = 10, 1 << 57
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before: string, after: string>>"


def leaf_digest(**instead):
    """The leaf of a row as 32 bytes; ``instead`` replaces columns by name."""

    def field(name):
        value = instead.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.unhex(F.sha2(F.concat(*map(field, FIELDS)), 256))


def _hex(digest):
    return F.lower(F.hex(digest))


def _digests(nodes):
    """The digests of an array of nodes as one text."""
    return F.array_join(F.transform(nodes, lambda c: _hex(c["digest"])), "")


def leaf_indexes(leaves: DataFrame) -> DataFrame:
    """``leaves`` (key, doc_id, digest and others) with ``index`` in the key and ``of``, the key's number of leaves."""
    low = F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0)).cast("int")
    leaves = leaves.withColumn("word", F.coalesce(F.shiftright("doc_id", 6), F.lit(NULL_WORD)))
    bit = F.when(F.col("doc_id").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), low)).otherwise(F.lit(0))
    words = stage(leaves.groupBy("key", "word").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")))
    words = words.withColumn("chunk", F.shiftright("word", CHUNK_BITS))
    chunks = running(words.groupBy("key", "chunk").agg(F.sum("n").alias("rows")), ["key"], [F.col("chunk")], "start", "rows").drop("rows")
    totals = words.groupBy("key").agg(F.sum("n").alias("of"))
    inside = Window.partitionBy("key", "chunk").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    directory = words.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(chunks, ["key", "chunk"]).join(totals, "key")
    directory = directory.select("key", "word", "bits", (F.col("start") + F.col("inside")).alias("start"), "of", (F.col("n") > F.bit_count("bits")).alias("repeats"))
    found = leaves.join(directory, ["key", "word"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), low))))
    single = found.where("not repeats").withColumn("index", F.col("start") + below)
    columns = [*(c for c in leaves.columns if c != "word"), "of", "index"]
    if not words.where(F.col("n") > F.bit_count("bits")).isEmpty():
        again = stage(found.where("repeats").withColumn("__sw_tie", F.monotonically_increasing_id()))
        again = running(again, ["key", "word"], [F.asc_nulls_last("doc_id"), F.col("digest"), F.col("__sw_tie")], "own")
        return single.select(columns).unionByName(again.withColumn("index", F.col("start") + F.col("own")).select(columns))
    return single.select(columns)


def build_levels(nodes: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) of (key, index, of, digest); columns in ``carried`` stay with the first level's nodes.

    A level is a table of runs: key, run, of, the node's slots as ``nodes`` and the ``digest`` they make; roots are (key, digest),
    one for each key.
    """
    most, levels = nodes.agg(F.max("of")).first()[0] or 0, []
    roots = nodes.where("of = 1").select("key", "digest")
    while most > 1:
        slot = F.struct((F.col("index") % FANOUT).alias("slot"), "digest", *(carried if not levels else ()))
        run = F.shiftright("index", 4).alias("run")
        runs = nodes.where("of > 1").groupBy("key", "of", run).agg(F.array_sort(F.collect_list(slot)).alias("nodes"))
        runs = stage(runs.withColumn("digest", F.unhex(F.sha2(_digests(F.col("nodes")), 256))))
        levels.append(runs)
        nodes = runs.select("key", F.col("run").alias("index"), F.ceil(F.col("of") / FANOUT).alias("of"), "digest")
        roots = roots.unionByName(nodes.where("of = 1").select("key", "digest"))
        most = -(-most // FANOUT)
    return levels, roots


def _spread(runs: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of the runs with their path: own siblings, then the path of the run's node, from ``above`` (key, index, path)."""
    side = lambda i, n: _digests(F.slice("nodes", i, n))
    own = F.struct(side(F.lit(1), F.col("at")).alias("before"), side(F.col("at") + 2, F.lit(FANOUT)).alias("after"))
    each = runs.withColumnRenamed("run", "index").join(above, ["key", "index"])
    each = each.select("key", "index", "path", "nodes", F.posexplode("nodes").alias("at", "node"))
    return each.select("key", (F.col("index") * FANOUT + F.col("at")).alias("index"), "node", F.concat(F.array(own), "path").alias("path"))


def node_paths(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(key, index, path) of the nodes above the first level's runs; ``roots`` are (key, path)."""
    paths = roots.select("key", F.lit(0).cast("long").alias("index"), "path")
    ends = [runs.select("key", "of").distinct() for runs in levels]
    for k in range(len(levels) - 1, 0, -1):
        # keys whose root is a node of this level begin here, the others come from the level above
        here = levels[k].select("key", "run", "nodes")
        paths = paths.join(ends[k].select("key"), "key", "left_anti").unionByName(_spread(here, paths).select("key", "index", "path"))
    return paths


@dataclass
class Manifest:
    """``leaves``: key, source, doc_id, digest, index, of; ``levels`` and ``top``: runs by level; ``subroots``: key, digest, index; the root in hex."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None

    def nodes(self) -> DataFrame:
        """(key, level, run, digest) of all nodes above the leaves and below the subroots' tree, for keeping beside the dataset."""
        spark = self.leaves.sparkSession
        out = spark.createDataFrame([], "key string, level int, run long, digest binary")
        for k, runs in enumerate(self.levels):
            out = out.unionByName(runs.select("key", F.lit(k + 1).alias("level"), "run", "digest"))
        return out


def build_manifest(docs: DataFrame, tampered=None) -> Manifest:
    """The manifest of ``docs``; ``tampered`` is a column of other leaves (or null) that are carried along to be verified."""
    other = F.lit(None).cast("binary") if tampered is None else tampered
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null first, then bytewise, and never null itself
    leaves = stage(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), other.alias("tampered")))
    leaves = stage(leaf_indexes(leaves))
    levels, roots = build_levels(leaves, "doc_id", "tampered")
    ranked = running(roots.withColumn("all", F.lit(1)), ["all"], [F.col("key")], "index", few_keys=True).drop("all")
    subroots = stage(ranked)
    n = subroots.count()
    top, root = build_levels(subroots.select(F.lit("").alias("key"), "index", F.lit(n).cast("long").alias("of"), "digest", F.col("key").alias("source")), "source")
    first = root.first()
    return Manifest(leaves, levels, subroots, top, first["digest"].hex() if first else None)


def prove(m: Manifest) -> DataFrame:
    """A row for each leaf: doc_id, digest, tampered, key and its whole path up to the root."""
    start = m.subroots.select("key", F.lit(0).cast("long").alias("index"), F.array().cast(_PATH).alias("path"))
    if m.top:
        root = m.subroots.select(F.lit("").alias("key"), F.array().cast(_PATH).alias("path")).limit(1)
        start = _spread(m.top[0], node_paths(m.top, root)).select(F.col("node.source").alias("key"), F.lit(0).cast("long").alias("index"), "path")
    start = stage(start)
    alone = m.leaves.where("of = 1").join(start, "key").select("key", "doc_id", "digest", "tampered", "path")
    if not m.levels:
        return alone
    many = _spread(m.levels[0], stage(node_paths(m.levels, start))).select("key", "node.doc_id", "node.digest", "node.tampered", "path")
    return many.unionByName(alone)


def fold(leaf, path):
    """The root (hex) that a leaf (hex) and a path make."""
    return F.aggregate(path, leaf, lambda at, p: F.sha2(F.concat(p["before"], at, p["after"]), 256))


def proof_digest(path):
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def verify(documents: DataFrame) -> DataFrame:
    """The digest view: leaf, subroot, root, proof and the fold of each row, with every fifth checksum's text tampered."""
    changed = leaf_digest(text=F.translate("text", UPPER, LOWER))
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    m = build_manifest(documents, F.when(picked, changed))
    subroots = m.subroots.select("key", _hex("digest").alias("subroot"))
    each = prove(m).join(subroots, "key")
    leaf = F.coalesce(_hex("tampered"), _hex("digest"))
    out = each.select("doc_id", _hex("digest").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), fold(leaf, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir):
    return verify(read(spark, sf_dir, "documents"))


def _sql_tree(name: str, depth: int) -> str:
    """Levels of ``{name}_0`` (k, i, of_, h): runs, parents, and each first node's siblings and ancestors up to its root."""
    parts = []
    for d in range(depth):
        up = f"SELECT k, i // 16 AS i, CAST(ceil(of_ / 16.0) AS BIGINT) AS of_, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}_{d} WHERE of_ > 1 GROUP BY k, i // 16, of_"
        parts.append(f"{name}_{d + 1} AS ({up} UNION ALL SELECT k, i, of_, h FROM {name}_{d} WHERE of_ = 1)")
        parts.append(
            f"{name}_{d}s AS (SELECT a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after, "
            f"bool_or(a.of_ > 1) AS hashed FROM {name}_{d} a JOIN {name}_{d} b ON a.k = b.k AND a.i // 16 = b.i // 16 GROUP BY a.k, a.i)"
        )
    return ",\n".join(parts)


def _sql_fold(table: str, depth: int, names: list[tuple[str, str, str]]) -> str:
    """Chained folds: ``names`` are (tree, key, index) of the node in each tree, one after the other."""
    parts, now = [], table
    for tree, key, index in names:
        for d in range(depth):
            s, new = f"{tree}_{d}s", f"{table}_{tree}{d}"
            step = f"CASE WHEN s.hashed THEN sha256(s.before || x.at_ || s.after) ELSE x.at_ END"
            parts.append(f"{new} AS (SELECT x.* REPLACE ({step} AS at_, x.proof || CASE WHEN s.hashed THEN s.before || s.after ELSE '' END AS proof) FROM {now} x JOIN {s} s ON s.k = x.{key} AND s.i = x.{index} // {16**d})")
            now = new
    parts.append(f"{table}_end AS (SELECT * FROM {now})")
    return ",\n".join(parts)


def _sql_leaf(text: str) -> str:
    values = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


#: Up to 16^5 rows in a source and 16^5 sources.
_DEPTH = 5
SQL = f"""
WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS k, {_sql_leaf("text")} AS leaf,
        CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents, crc),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY k) AS of_ FROM d),
a_0 AS (SELECT k, i, of_, leaf AS h FROM n),
{_sql_tree("a", _DEPTH)},
sub AS (SELECT k AS source, row_number() OVER (ORDER BY k) - 1 AS i, h FROM a_{_DEPTH}),
b_0 AS (SELECT '' AS k, i, count(*) OVER () AS of_, h FROM sub),
{_sql_tree("b", _DEPTH)},
top AS (SELECT h AS root FROM b_{_DEPTH}),
x AS (SELECT n.doc_id, n.leaf, sub.h AS subroot, n.k AS k, n.i AS i, '' AS all_, sub.i AS j, coalesce(tampered, leaf) AS at_, '' AS proof FROM n JOIN sub ON sub.source = n.k),
{_sql_fold("x", _DEPTH, [("a", "k", "i"), ("b", "all_", "j")])}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, at_ AS folded_root, at_ = root AS verified FROM x_end, top
"""
