"""Shards by a hierarchical weighted hash tree: region, then rack, then shard.

Each level is a weighted draw: a child of weight w draws -ln(u) / w, with u from a hash of the row's key and the child's
name, and the smallest draw takes the row. A child's draws depend on nothing but the key, its name and its weight. So
where weights change, rows move only from, to or inside the subtrees with changed weights: all other children keep the
rows that they had. A shard that joins as a region of its own takes rows only into itself.

The tree is a literal map from a node to its children, so the plan has one draw for each level, whatever the size of the
tree, and a row costs as many hashes as the nodes on its path have children. Nothing but column functions is used.

Slots number the rows of a shard from 0 without gaps, by id, size and checksum, in a distributed order (``ranks``), so
a shard of any size and an id that is repeated any number of times meet in no single task.

Defined results: a null id is hashed as the empty string and comes last in its shard; a null text has no bytes, so size 1
and checksum 0; rows that are repeated get a slot each, all in the same shard; an empty table gives an empty result; very
long texts count in whole; columns other than id and text are passed by, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm.common import CRC_TABLE_SQL, crc32_sql, read, stage
from stopweave.llm.ranks import running

#: (region, rack, shard, weight) of 16 equal shards.
TOPOLOGY = [(f"region{s // 8}", f"rack{s // 4 % 2}", s, 1.0) for s in range(16)]
#: Hexadecimal digits of a hash that make a draw: 52 bits, exact in a double.
DIGITS = 13


def grown(topology: list[tuple], weight: float = 1.0) -> list[tuple]:
    """The topology with one more shard, in a region of its own."""
    n = 1 + max((shard for *_, shard, _ in topology), default=-1)
    return [*topology, (f"region-of-{n}", "rack0", n, weight)]


def tree(topology: list[tuple]) -> dict[str, dict[str, float]]:
    """Each node's children with their weights; an inner node weighs what its shards weigh. The root is ''."""
    children: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for region, rack, shard, weight in topology:
        if weight > 0:
            path = [region, f"{region}/{rack}", f"{region}/{rack}/{shard}"]
            for parent, child in zip(["", *path], path, strict=False):
                children[parent][child] += weight
    return children


def shard_of(key, topology: list[tuple]):
    """The shard (int) of a key column, as a column."""
    entry = lambda kids: F.array(*(F.struct(F.lit(c).alias("node"), F.lit(float(w)).alias("weight")) for c, w in kids.items()))
    children = F.create_map(*(x for parent, kids in tree(topology).items() for x in (F.lit(parent), entry(kids))))
    text = F.coalesce(key.cast("string"), F.lit(""))

    def draw(child):
        number = F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), child["node"])), 1, DIGITS), 16, 10).cast("double")
        return F.struct((-F.log((number + 0.5) / F.lit(16.0**DIGITS)) / child["weight"]).alias("draw"), child["node"].alias("node"))

    node = F.lit("")
    for _ in range(3):
        node = F.array_min(F.transform(F.try_element_at(children, node), draw))["node"]
    return F.substring_index(node, "/", -1).cast("int")


def assign_shards(docs: DataFrame, topology: list[tuple] = TOPOLOGY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: the id, size, text_crc32, shard, slot, and grown_shard, where it lies with one shard more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(key, topology).alias("shard"),
        shard_of(key, grown(topology)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("__sw_tie"),
    )
    order = [F.asc_nulls_last("doc_id"), F.col("size"), F.col("text_crc32"), F.col("__sw_tie")]
    return running(stage(rows), ["shard"], order, "slot", few_keys=True).drop("__sw_tie")


def write_shards(docs: DataFrame, path: str, topology: list[tuple] = TOPOLOGY, id_col: str = "doc_id", shard_col: str = "shard") -> None:
    """The rows in whole, as Parquet under ``path/shard=N``; a large shard is several files, in the order of ids.

    Where the rows have a column ``shard_col`` of their own, the shard's name gets underscores until it is free.
    """
    while shard_col in docs.columns:
        shard_col += "_"
    placed = docs.withColumns({shard_col: shard_of(F.col(id_col), topology), "__sw_tie": F.monotonically_increasing_id()})
    order = [F.col(shard_col), F.asc_nulls_last(id_col), F.col("__sw_tie")]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__sw_tie").write.mode("overwrite").partitionBy(shard_col).parquet(path)


def query(spark, sf_dir):
    placed = assign_shards(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _descent(name: str, topology: list[tuple]) -> str:
    """Common table expressions that end in ``name``: (r, node) at the leaves."""
    values = ", ".join(f"('{p}', '{c}', {w:.1f})" for p, kids in tree(topology).items() for c, w in kids.items())
    draw = f"-ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || child), 1, {DIGITS}) AS BIGINT) + 0.5) / {16.0**DIGITS:.1f}) / weight"
    parts = [f"{name}_tree(parent, child, weight) AS (VALUES {values})", f"{name}_0 AS (SELECT r, doc_id, '' AS node FROM d)"]
    for k in range(3):
        parts.append(f"{name}_{k + 1} AS (SELECT r, doc_id, arg_min(child, {draw}) AS node FROM {name}_{k} JOIN {name}_tree ON parent = node GROUP BY r, doc_id)")
    return ",\n".join(parts)


SQL = f"""
WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT r, doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, {crc32_sql("text")} AS text_crc32 FROM d, crc),
{_descent("a", TOPOLOGY)},
{_descent("g", grown(TOPOLOGY))},
s AS (SELECT b.*, CAST(string_split(a_3.node, '/')[3] AS INT) AS shard, CAST(string_split(g_3.node, '/')[3] AS INT) AS grown_shard FROM b JOIN a_3 USING (r) JOIN g_3 USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS slot, grown_shard FROM s
"""
