"""Near-duplicate classes: MinHash with banding, signature verification, exact confirmation, large-star / small-star.

1. Each text becomes the set of its five-word shingles (64-bit hashes). Texts with equal sets collapse into one
   representative, so thousands of copies cost one row from here on.
2. Each set gets BANDS x ROWS minima of universal hashes (multiply-add modulo 2^32, odd multipliers). Representatives
   that agree in all ROWS minima of a band share a bucket. At a similarity of 0.75 a pair shares no bucket with
   probability (1 - 0.75^ROWS)^BANDS, about 5e-6, and far less for more similar ones.
3. In each bucket every member is paired with one hub, drawn by a hash that differs between bands: as many pairs as
   members, never all pairs of a bucket, and yet a class is tied together by several hubs.
4. A pair's signatures are compared first (eight bits of each minimum; the bar is several standard deviations below
   the threshold), then the full sets decide: 100 * intersection >= 75 * union.
5. Components of the confirmed links by alternating large-star and small-star, until nothing changes.
6. A hub may miss a link between two members. So buckets whose members ended in different components are looked at
   again. Of their members' shingles, those that no other of these members has are counted: they are in no
   intersection, which bounds a member's similarity to all others. Members whose bound is below the threshold are
   done. The others are first paired with a second hub of their bucket, the member with the least share of such
   shingles (the text that others were edited from, or close to it), and components are formed once more.
7. In buckets that are still not settled every member meets the members of other components. The join keeps a pair
   only if three tests pass: the bound of step 6, a bound from the differing bits of two bitmaps of the sets (each
   differing bit needs a shingle that one set lacks), and the signatures' test of step 4. A large bucket is dealt to as
   many keys as its number of members asks for, so no task holds it alone. Kept pairs go to the full sets. Pairs inside one component can change nothing and are never made.

Nothing is collected to the driver but counts; every stage's table lies in the shared folder. The documents are
numbered once, in a staged table, and that is read again for the sets of likely pairs instead of keeping all sets; a
row whose set has changed raises.

Defined results: words are maximal runs of other characters than white space, A-Z lower-cased; a text with one to
four words has its whole sequence as its only shingle; null, empty and blank texts have no shingle, are linked with
nothing and stay. Equal rows and repeated ids are linked like any equal texts. A null id counts as the largest one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm.common import ROW, read, stage, stage_rows, with_rows
from stopweave.llm.hashing import WordHashes, gram_hashes

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Different hubs that a class can have: bands that are equal modulo this number draw alike.
DRAWS = 6
SEED = 20240117
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Of BANDS * ROWS one-byte minima this share must agree for a pair to reach the full sets: five deviations below 0.75.
SKETCH_SHARE = 0.55
#: Members of an unsettled bucket that one key holds on one side of the last join.
MEMBERS_TOGETHER = 512
#: Edges of a round that one task of ``components`` writes and reads together.
EDGES_TOGETHER = 1_000_000
#: Bits of a set's bitmap; sets of up to about as many shingles are told apart by it.
BITS = 1024


def shingle_hashes(text: bytes | None, cache: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole UTF-8 text.

    Both ``lower`` and ``split`` of bytes know ASCII alone: A-Z, and the white space of the word rule.
    """
    words = (text or b"").lower().split()
    return np.unique(gram_hashes(cache.of(words), min(size, len(words)))) if words else np.empty(0, dtype=np.uint64)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32)
    return (draw() * np.uint32(2) + np.uint32(1))[:, None], draw()[:, None]


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash (a * x + b modulo 2^32) over a set; long sets are taken in blocks."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (a * x[None, at : at + 1024] + b).min(axis=1), out=out)
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """(ROW, id, text) of ``docs`` (id, text), staged with ROW unless they have it."""
    return with_rows(docs).select(ROW, F.col("id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))


def _profiles(docs: DataFrame) -> DataFrame:
    """ROW, id, n_shingles, a 128-bit key of the shingle set, band keys, and a sketch of one byte for each minimum."""
    schema = pa.schema([(ROW, pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches):
        import xxhash

        cache, (a, b) = WordHashes(), _coefficients()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for text in batch.column("text"):
                s = shingle_hashes(text.as_py(), cache)
                low = minima(s, a, b)
                bands = [xxhash.xxh3_64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)] if len(s) else []
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bands, (low >> np.uint32(8)).astype(np.uint8).tobytes()))
            cols = [batch.column(ROW), batch.column("id"), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.mapInArrow(run, f"{ROW} long, id long, n long, set_key binary, bands array<long>, sketch binary")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the rows in ``wanted`` (rep, set_key), from their texts; a row whose set is another one now raises."""
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        import xxhash

        cache = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, cache).tobytes() for t in batch.column("text").to_pylist()]
            if [xxhash.xxh3_128_digest(x) for x in sets] != batch.column("set_key").to_pylist():
                raise ValueError("the documents changed between two scans")
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], schema=schema)

    found = docs.select(F.col(ROW).alias("rep"), "text").join(wanted, "rep")
    return stage(found.select("rep", "text", "set_key").mapInArrow(run, "rep long, shingles binary"))


def _side(df: DataFrame, x: str, *cols: str) -> DataFrame:
    return df.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of (a, b), a < b: those whose sizes and signatures agree."""
    close = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    drawn = pairs.join(_side(reps, "a", "n", "sketch"), "a").join(_side(reps, "b", "n", "sketch"), "b").where(close)

    def alike(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS) for c in ("sketch_a", "sketch_b"))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= SKETCH_SHARE)).select(["a", "b"])

    return stage(drawn.select("a", "b", "sketch_a", "sketch_b").mapInArrow(alike, "a long, b long"))


def _confirmed(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b): those whose full sets agree; ``sets`` has the sets of all of them."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    full = likely.join(_side(sets, "a", "shingles"), "a").join(_side(sets, "b", "shingles"), "b")
    return stage(full.select("a", "b", "shingles_a", "shingles_b").mapInArrow(run, "a long, b long"))


def _outlines(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, n, c, b0 .., k0 ..) of the rows in ``sets`` that may be linked with another one of them.

    ``c`` counts the shingles that another row has too; b0 .. is a bitmap in which each shingle flips one of BITS
    bits; k0 .. is the sketch, eight minima in a number.
    """
    schema = pa.schema([("rep", pa.int64()), *((f"b{i}", pa.int64()) for i in range(BITS // 64)), *((f"k{i}", pa.int64()) for i in range(BANDS * ROWS // 8))])

    def each(batches):
        for batch in batches:
            held = [np.frombuffer(x, dtype=np.int64) for x in batch.column("shingles").to_pylist()]
            owner = np.repeat(batch.column("rep").to_numpy(), [len(x) for x in held])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(held) if held else [], pa.int64())], names=["rep", "shingle"])

    def drawn(batches):
        for batch in batches:
            bits = [np.bincount((np.frombuffer(x, dtype=np.uint64) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1 for x in batch.column("shingles").to_pylist()]
            bits = np.packbits(np.array(bits, dtype=np.uint8).reshape(-1, BITS), axis=1).view(np.int64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.int64).reshape(-1, BANDS * ROWS // 8)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), *(pa.array(np.ascontiguousarray(c)) for c in (*bits.T, *sketch.T))], schema=schema)

    own = sets.mapInArrow(each, "rep long, shingle long").groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("hi")).where("rep = hi")
    own = own.groupBy("rep").agg(F.count("*").alias("own"))
    known = reps.select("rep", "n", "sketch").join(sets.select("rep"), "rep").join(own, "rep", "left")
    standing = stage(known.select("rep", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c"), "sketch").where(100 * F.col("c") >= PERCENT * F.col("n")))
    lines = sets.join(standing.select("rep", "sketch"), "rep").select("rep", "shingles", "sketch").mapInArrow(drawn, ", ".join(f"{f.name} long" for f in schema))
    return stage(standing.drop("sketch").join(lines, "rep"))


def _may_link(x: str, y: str):
    """Whether two outlines, of which ``x`` and ``y`` are the aliases, leave a link possible."""
    sizes = F.col(f"{x}.n") + F.col(f"{y}.n")
    both = F.least(f"{x}.c", f"{y}.c")
    xor = lambda c: F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
    total = lambda terms: reduce(lambda p, q: p + q, terms)
    differ = total(F.bit_count(xor(f"b{i}")) for i in range(BITS // 64))

    def unequal_bytes(c):
        v = c
        for by in (4, 2, 1):
            v = v.bitwiseOR(F.shiftrightunsigned(v, by))
        return F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101)))

    minima_apart = total(unequal_bytes(xor(f"k{i}")) for i in range(BANDS * ROWS // 8))
    return ((100 + PERCENT) * both >= PERCENT * sizes) & ((100 + PERCENT) * (sizes - differ) >= 2 * PERCENT * sizes) & (minima_apart <= int((1 - SKETCH_SHARE) * BANDS * ROWS))


def _unsettled(placed: DataFrame) -> DataFrame:
    """Rows of (key, component, ..) whose bucket holds two components or more."""
    keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return placed.join(stage(keys), "key")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node of an edge list: the component is its smallest node.

    Alternating large-star (each node ties its larger neighbours to its smallest one) and small-star (each node ties
    its smaller neighbours and itself to its smallest one), until a round leaves the edges as they were. Rounds are
    written in as many parts as their edges ask for: most have few, and hundreds of all but empty tasks a table would
    take longer than the work.
    """
    edges = stage(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct())
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = None
    while (now := print_of(edges)) != last:
        last = now
        put = lambda df: stage(df.coalesce(1 + now[0] // EDGES_TOGETHER))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = put(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")))
        large = put(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = put(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        edges = put(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    nodes = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stage(nodes.select(F.col("u").alias("node"), "component").unionByName(nodes.select(F.col("component").alias("node"), "component").distinct()))


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, rep, component) for (key, rep)."""
    return stage(members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")))


def near_dups(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (id, text, and ROW if they are staged with it): ROW, id, n_shingles and component, one of its rows' numbers.

    What many rows share (a bucket, a hub, a copied set) is joined from a table of its own, so that adaptive
    execution can split the side that holds the many rows.
    """
    docs = _numbered(docs)
    profiles = stage(_profiles(docs))
    filled = profiles.where("n > 0").select(ROW, "id", "set_key")
    copies = stage(filled.groupBy("set_key").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", ROW)).alias("first")))
    member = stage(filled.select(ROW, "set_key").join(copies, "set_key").select(ROW, F.col(f"first.{ROW}").alias("rep")))
    reps = profiles.join(copies.select(F.col(f"first.{ROW}").alias(ROW)), ROW).select(F.col(ROW).alias("rep"), "n", "set_key", "sketch", "bands")
    reps = stage(reps)
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    draw = F.struct(F.xxhash64("rep", F.col("band") % DRAWS).alias("draw"), F.col("rep").alias("hub"))
    hubs = banded.groupBy("key").agg(F.min(draw).alias("m"), F.count("*").alias("size")).where("size > 1").select("key", F.col("m.hub").alias("hub"))
    shared = stage(banded.drop("band").join(stage(hubs), "key").select("key", "rep", "hub"))
    pairs = shared.where("rep <> hub").select(*_ordered(F.col("rep"), F.col("hub"))).distinct()
    likely = _likely(pairs, reps)
    ends = likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    links = _confirmed(likely, _full_sets(docs, reps.select("rep", "set_key").join(ends, "rep")))
    found = components(links)
    left = stage(_unsettled(_placed(shared.select("key", "rep"), found)))
    if not left.isEmpty():
        sets = _full_sets(docs, reps.select("rep", "set_key").join(left.select("rep").distinct(), "rep"))
        lines = _outlines(sets, reps)
        left = stage(left.join(lines.select("rep", "n", "c"), "rep"))
        central = F.struct((F.col("c") / F.col("n")).alias("share"), "n", "rep")
        hubs = stage(left.groupBy("key").agg(F.max_by(F.struct(F.col("rep").alias("hub"), F.col("component").alias("apart")), central).alias("m")).select("key", "m.*"))
        near = left.select("key", "rep", "component").join(hubs, "key").where("component <> apart").select(*_ordered(F.col("rep"), F.col("hub"))).distinct()
        tried = near.join(lines.alias("x"), F.col("a") == F.col("x.rep")).join(lines.alias("y"), F.col("b") == F.col("y.rep")).where(_may_link("x", "y")).select("a", "b")
        links = links.unionByName(_confirmed(stage(tried), sets))
        found = components(links)
        left = _unsettled(_placed(left.select("key", "rep"), found))
        left = stage(left.join(lines, "rep"))
        deals = stage(left.groupBy("key").agg(F.ceil(F.count("*") / MEMBERS_TOGETHER).alias("deals")))
        left = left.join(deals, "key")
        x = left.withColumn("deal", F.pmod(F.xxhash64("rep"), "deals")).alias("x")
        y = left.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).alias("y")
        meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.deal") == F.col("y.deal"))
        across = x.join(y, meet & (F.col("x.component") < F.col("y.component")) & _may_link("x", "y"))
        more = _confirmed(stage(across.select(*_ordered(F.col("x.rep"), F.col("y.rep"))).distinct()), sets)
        if not more.isEmpty():
            found = components(links.unionByName(more))
    return profiles.select(ROW, "id", F.col("n").alias("n_shingles")).join(member, ROW, "left").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(ROW, "id", "n_shingles", F.coalesce("component", "rep", ROW).alias("component"))


def near_classes(docs: DataFrame) -> DataFrame:
    """ROW, id, n_shingles, keep_row and component_id (the class's smallest id) for the rows of ``near_dups``."""
    found = stage(near_dups(docs))
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", ROW)).alias("first")
    least = found.groupBy("component").agg(first).select("component", F.col("first.id").alias("component_id"), F.col(f"first.{ROW}").alias("keep_row"))
    return found.join(stage(least), "component").drop("component")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, the one with the smallest doc_id; columns unchanged."""
    staged = stage_rows(docs)
    classes = near_classes(staged.select(ROW, F.col("doc_id").alias("id"), "text"))
    return staged.join(classes.where(f"{ROW} = keep_row").select(ROW), ROW, "left_semi").select(docs.columns)


def query(spark, sf_dir):
    """One row per row; ``kept`` tells rows of the class's smallest id, repeated ones too."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return near_classes(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT root, b FROM reach JOIN link ON node = a),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n USING (doc_id)
"""
