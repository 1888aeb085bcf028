"""Substring deduplication with prefix-partitioned, sparse generalised suffix trees.

A window of WINDOW words that starts in a document with a smaller id too is a repeat; every word it covers goes.

1. Texts of equal word sequence collapse: the smallest id stands for all; where a larger id has the same sequence,
   all of its windows are repeats, so it needs no tree.
2. Suffixes are taken at content-defined places only: of every stretch of WINDOW words the first place whose
   ANCHOR-word prefix has the least hash. Each window belongs to that one place of it, equal windows to the same, so
   no repeat is missed or looked at twice, and about one suffix in twenty is left. Prefixes that occur in one document
   alone are pruned by a count that combines within each task. Places of a document that agree in prefix or surroundings (a line said over and over) travel as one row.
3. The prefixes that remain partition the suffixes. Tasks take them in prefix order and hold as many whole prefix
   groups at a time as fit a row limit. A prefix with more suffixes than that is lengthened by half a window to the
   right, and to the left, and pruned again, so a common line before different words falls apart. What is too large
   even then is a passage that very many documents share: suffixes that agree in all surrounding words differ in
   their document only and combine to the smallest id, and what is left meets window by window in an aggregation
   (both combine within each task first).
4. Every suffix carries the words that the windows of its place cover. The subtree of the groups that a task holds is
   built as a suffix array with the common prefixes of neighbours. Its internal nodes at depth WINDOW or below are the
   repeats: all suffixes below such a node but those of its smallest document are repeated; adjoining ones make up the
   maximal repeats, which leave as spans.

Prefixes are 64-bit hashes; around a place each word is held as 64 bits, so two stretches are only taken for equal
wrongly if every word that differs between them collides; surroundings are told apart by 128 bits. Texts move once, for the documents that share a prefix;
rows are numbered once, in a staged table from which every later pass reads number, id and text.

Defined results: null and empty texts have no words; a text shorter than WINDOW words is untouched; repeats within
one document do not count, nor between rows of equal id. A null id counts as larger than all others. Kept words are
joined by one space. Very long texts are read in whole; a passage said often in one document travels as one row.
Repeated rows, which agree in id, cut nothing from each other. Columns of any other name pass through ``drop_repeats``.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm.common import ROW, read, stage, stage_rows, with_rows
from stopweave.llm.hashing import WordHashes, gram_hashes

WINDOW = 50
ANCHOR = 8
#: Suffixes that a task holds at a time, and the size above which a prefix is lengthened.
GROUP_ROWS = 8192
#: The id that stands for null.
LAST_ID = (1 << 63) - 1


def anchors(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, prefix hashes, and first and number of the windows whose first place of least prefix hash each place is.

    Every window belongs to one place, and equal windows to the same place in them.
    """
    if len(h) < window:
        return (np.empty(0, dtype=np.int64),) * 4
    p = gram_hashes(h, ANCHOR)
    span = window - ANCHOR + 1
    least, done = np.arange(len(p)), 1
    while done < span:
        step = min(done, span - done)
        left, right = least[:-step], least[step:]
        least = np.where(p[right] < p[left], right, left)
        done += step
    at, first, count = np.unique(least, return_index=True, return_counts=True)
    return at, p[at].view(np.int64), first, count


#: A place, and the first and the number of the windows that belong to it.
_PLACES = pa.list_(pa.struct([("place", pa.int32()), ("first", pa.int32()), ("windows", pa.int32())]))
_PLACES_SQL = "array<struct<place:int,first:int,windows:int>>"
_SUFFIXES = [("prefix", pa.int64()), ("at", _PLACES)]


def _by_prefix(found) -> list[dict]:
    """(prefix, place, first, windows) of a document as one entry for each prefix."""
    places: dict[int, list[dict]] = {}
    for prefix, place, first, windows in found:
        places.setdefault(prefix, []).append({"place": place, "first": first, "windows": windows})
    return [{"prefix": k, "at": v} for k, v in places.items()]


def _distinct_contexts(h: np.ndarray, at: list[dict]) -> dict[tuple[int, bytes], list[int]]:
    """(place in it, context) to the words where it starts; a context is what a place's windows cover."""
    firsts: dict[tuple[int, bytes], list[int]] = {}
    for x in at:
        lo = x["first"]
        firsts.setdefault((x["place"] - lo, h[lo : lo + x["windows"] + WINDOW - 1].tobytes()), []).append(lo)
    return firsts


def _profiles(docs: DataFrame) -> DataFrame:
    """ROW, id, words, the digest of the words joined by spaces, and the anchor prefixes with their places."""
    schema = pa.schema([(ROW, pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("sequence", pa.string()), ("suffixes", pa.list_(pa.struct(_SUFFIXES)))])

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            n, sha, suffixes = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or b"").split()  # splits at ASCII white space, as the word rule does
                at, prefix, first, count = anchors(cache.of(words))
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                suffixes.append(_by_prefix(zip(*(x.tolist() for x in (prefix, at, first, count)), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(suffixes, schema.field("suffixes").type)], schema=schema)

    return docs.mapInArrow(run, f"{ROW} long, id long, n_words long, sequence string, suffixes array<struct<prefix:bigint,at:{_PLACES_SQL}>>")


def _contexts(texts: DataFrame, over: bool, group_rows: int) -> DataFrame:
    """A row for each document and context of the prefixes with more (``over``) or at most ``group_rows`` suffixes.

    ``firsts`` has the words where the context starts. ``around`` hashes the whole context with the place in it: rows of a prefix that agree in it differ in their document only.
    """
    schema = pa.schema([("prefix", pa.int64()), ("around", pa.binary()), ("id", pa.int64()), (ROW, pa.int64()), ("firsts", pa.list_(pa.int32())), ("context", pa.binary())])

    def run(batches):
        import xxhash

        cache = WordHashes()
        for batch in batches:
            for part in batch.to_pylist():
                h = cache.of((part["text"] or b"").split())
                rows = []
                for x in part["x"]:
                    if (x["suffixes"] > group_rows) != over:
                        continue
                    for (offset, context), at in _distinct_contexts(h, x["at"]).items():
                        rows.append((x["prefix"], xxhash.xxh3_128_digest(context, seed=offset), part["id"], part[ROW], at, context))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.mapInArrow(run, f"prefix long, around binary, id long, {ROW} long, firsts array<int>, context binary")


def deep_nodes(contexts: list[bytes], depth: int = WINDOW) -> list[np.ndarray]:
    """The suffix tree over some texts, cut at ``depth``: for each text the nodes of its suffixes of that length or more.

    The tree is held as its suffix array and the common prefixes of neighbours in it. Ranks of prefixes of 1, 2, 4 ..
    words sort the suffixes; the same ranks, from long to short, measure the common prefixes. A stretch of neighbours
    that share ``depth`` words is an internal node at that depth or below, and gets a number; other suffixes get -1.
    """
    texts = [np.frombuffer(c, dtype=np.uint64) for c in contexts]
    starts = np.cumsum([0, *map(len, texts)])
    whole = np.concatenate(texts) if texts else np.empty(0, dtype=np.uint64)
    n, room = len(whole), np.repeat(starts[1:], np.diff(starts)) - np.arange(starts[-1])  # words from here to the end of the text
    ranks, step = [np.unique(whole, return_inverse=True)[1].astype(np.int64)], 1
    while step < max(map(len, texts), default=0):
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = np.where(room[: n - step] > step, ranks[-1][step:] + 1, 0)
        ranks.append(np.unique(ranks[-1] * np.int64(n + 1) + after, return_inverse=True)[1])
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    left, right, shared = order[:-1], order[1:], np.zeros(max(0, n - 1), dtype=np.int64)
    for rank in reversed(ranks):
        size = step
        a, b = np.minimum(left + shared, n - 1), np.minimum(right + shared, n - 1)
        same = (rank[a] == rank[b]) & (np.minimum(room[left], room[right]) >= shared + size)
        shared += np.where(same, size, 0)
        step //= 2
    together = shared >= depth
    number = np.concatenate([[0], np.cumsum(~together)]) if n else np.empty(0, dtype=np.int64)
    inner = np.zeros(n, dtype=bool)
    inner[:-1] |= together
    inner[1:] |= together
    nodes = np.full(n, -1, dtype=np.int64)
    nodes[order[inner]] = number[inner]
    return [nodes[a : max(a, b - depth + 1)] for a, b in zip(starts, starts[1:], strict=False)]


def _window_keys(context: bytes, count: int) -> list[bytes]:
    """128-bit names of a context's windows that hold in any group; for groups that are cut into blocks."""
    import xxhash

    return [xxhash.xxh3_128_digest(context[8 * k : 8 * (k + WINDOW)]) for k in range(count)]


def _spans(flags: np.ndarray, firsts: list[int]) -> list[tuple[int, int]]:
    """[start, end) word spans that the windows starting at first + k cover, for each set flag k and each first; merged."""
    hits = np.flatnonzero(flags)
    if not len(hits):
        return []
    starts = np.unique((np.asarray(firsts, dtype=np.int64)[:, None] + hits).ravel())
    cut = np.flatnonzero(np.diff(starts) > WINDOW)
    lo, hi = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
    return [(int(a), int(b + WINDOW)) for a, b in zip(lo, hi, strict=True)]


_SPAN_SCHEMA = f"{ROW} long, start int, end int"


def _tree_spans(table: pa.Table) -> pa.RecordBatch:
    """The repeats of some prefix groups that are held whole: below each deep node all but its smallest document's suffixes."""
    ids, rows = (table.column(c).to_numpy() for c in ("id", ROW))
    firsts = table.column("firsts").to_pylist()
    nodes = deep_nodes(table.column("context").to_pylist())
    flat = np.concatenate(nodes)
    least = np.full(int(flat.max(initial=-1)) + 2, LAST_ID, dtype=np.int64)  # the last one stands for -1
    np.minimum.at(least, flat, np.repeat(ids, [len(x) for x in nodes]))
    return _batch((int(r), a, b) for r, i, own, x in zip(rows, ids, firsts, nodes, strict=True) for a, b in _spans((x >= 0) & (least[x] < i), own))


def _batch(spans) -> pa.RecordBatch:
    cols = list(zip(*spans, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=[ROW, "start", "end"])


def _small_groups(suffixes: DataFrame, group_rows: int) -> DataFrame:
    """Prefix groups in prefix order, as many whole ones at a time as ``group_rows`` holds."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            if held.num_rows >= group_rows:
                prefix = held.column("prefix").to_numpy()
                whole = int(np.searchsorted(prefix, prefix[-1]))
                if whole:
                    yield _tree_spans(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield _tree_spans(held)

    ordered = suffixes.select("prefix", "id", ROW, "firsts", "context").repartition("prefix").sortWithinPartitions("prefix")
    return ordered.mapInArrow(run, _SPAN_SCHEMA)


def _numbered(docs: DataFrame) -> DataFrame:
    """(ROW, id, text) of ``docs`` (id, text), staged with ROW unless they have it."""
    ids = F.coalesce(F.col("id").cast("long"), F.lit(LAST_ID)).alias("id")
    return with_rows(docs).select(ROW, ids, F.col("text").cast("binary").alias("text"))


def _placed(own: DataFrame) -> DataFrame:
    """(ROW, x) from (ROW, id, prefix, at, n), with ``n`` contexts or more of the document: the places whose prefix stands in two documents, with its suffixes."""
    own = stage(own)
    counts = own.groupBy("prefix").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("n").alias("suffixes")).where("lo < hi")
    counts = stage(counts.select("prefix", "suffixes"))
    return own.join(counts, "prefix").groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("prefix", "at", "suffixes"))).alias("x"))


def _lengthened(texts: DataFrame, group_rows: int) -> DataFrame:
    """(ROW, id, prefix, at) of suffixes in too large groups, each with two longer prefixes in place of its own.

    A window has at least half of its words beside the ANCHOR words of its place to their right, and then shares the
    prefix that is longer by that half to the right with equal windows, or else more than half to their left.
    """
    schema = pa.schema([(ROW, pa.int64()), ("id", pa.int64()), *_SUFFIXES, ("n", pa.int64())])
    half = (WINDOW - ANCHOR) // 2

    def run(batches):
        import xxhash

        cache = WordHashes()
        for batch in batches:
            for part in batch.to_pylist():
                places = [p for x in part["x"] if x["suffixes"] > group_rows for p in x["at"]]
                h = cache.of((part["text"] or b"").split()) if places else None
                keys = []
                for x in places:
                    p, first, end = x["place"], x["first"], x["first"] + x["windows"]
                    if end > (cut := max(first, p - half)):
                        keys.append((xxhash.xxh3_64_intdigest(h[p : p + ANCHOR + half].tobytes(), seed=1) - (1 << 63), p, cut, end - cut))
                    if first < (cut := min(end, p - half)):
                        keys.append((xxhash.xxh3_64_intdigest(h[p - half : p + ANCHOR].tobytes(), seed=2) - (1 << 63), p, first, cut - first))
                if own := _by_prefix(keys):
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([part[ROW]] * n, pa.int64()), pa.array([part["id"]] * n, pa.int64()), pa.array([x["prefix"] for x in own], pa.int64()), pa.array([x["at"] for x in own], _PLACES), pa.array([len(_distinct_contexts(h, x["at"])) for x in own], pa.int64())], schema=schema)

    return texts.where(F.exists("x", lambda v: v["suffixes"] > group_rows)).mapInArrow(run, f"{ROW} long, id long, prefix long, at {_PLACES_SQL}, n long")


def repeats(docs: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, copies, spanned) of ``docs`` (id, text, and ROW if they are staged with it).

    copies has the rows whose whole word sequence stands in a row of a smaller id; spanned has the other rows with
    repeats, their text as bytes and their word spans [start, end), which may overlap.
    """
    docs = _numbered(docs)
    profiles = stage(_profiles(docs))
    long = profiles.where(F.col("n_words") >= WINDOW)
    first = stage(long.groupBy("sequence").agg(F.min(F.struct("id", ROW)).alias("first")).select("sequence", F.col("first.id").alias("first_id"), F.col(f"first.{ROW}").alias("first_row")))
    copies = stage(long.select(ROW, "id", "sequence").join(first, "sequence").select(ROW, (F.col("first_id") < F.col("id")).alias("copied")))
    copied = copies.where("copied").select(ROW)
    # rows of equal sequence and equal smallest id are all kept as they are but for what smaller ids hold
    own = profiles.join(copies.where("not copied").select(ROW), ROW).select(ROW, "id", F.explode("suffixes").alias("x")).select(ROW, "id", "x.prefix", "x.at", F.size("x.at").alias("n"))
    texts = stage(docs.join(_placed(own), ROW))
    spans = _small_groups(_contexts(texts, False, group_rows), group_rows)
    longer = stage(texts.select(ROW, "id", "text").join(_placed(_lengthened(texts, group_rows)), ROW))
    spans = spans.unionByName(_small_groups(_contexts(longer, False, group_rows), group_rows)).unionByName(_large_groups(_contexts(longer, True, group_rows)))
    merged = spans.groupBy(ROW).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return profiles, copied, texts.select(ROW, "text").join(merged, ROW)


def _large_groups(large: DataFrame) -> DataFrame:
    """Groups too large for one task: windows by name, least document by window, and back to the suffixes.

    Rows of equal surroundings are combined first, so a passage that very many documents share gives one row of
    windows, not one for each document.
    """

    def names(batches):
        schema = pa.schema([("around", pa.binary()), ("window", pa.binary()), ("k", pa.int32()), ("id", pa.int64())])
        for batch in batches:
            for around, context, i in zip(*(batch.column(c).to_pylist() for c in ("around", "context", "id")), strict=True):
                n = len(context) // 8 - WINDOW + 1
                if n > 0:
                    yield pa.RecordBatch.from_arrays([pa.array([around] * n, pa.binary()), pa.array(_window_keys(context, n), pa.binary()), pa.array(range(n), pa.int32()), pa.array([i] * n, pa.int64())], schema=schema)

    def spans(batches):
        for batch in batches:
            out = []
            for row, i, firsts, windows in zip(*(batch.column(c).to_pylist() for c in (ROW, "id", "firsts", "windows")), strict=True):
                flags = np.zeros(WINDOW + 1, dtype=bool)
                flags[[w["k"] for w in windows if w["least"] < i]] = True
                out += [(row, a, b) for a, b in _spans(flags, firsts)]
            yield _batch(out)

    alike = large.groupBy("around").agg(F.min("id").alias("id"), F.min("context").alias("context"))
    windows = stage(alike.mapInArrow(names, "around binary, window binary, k int, id long"))
    least = stage(windows.groupBy("window").agg(F.min("id").alias("least")))
    known = stage(windows.join(least, "window").groupBy("around").agg(F.collect_list(F.struct("k", "least")).alias("windows")))
    back = large.select(ROW, "id", "firsts", "around").join(known, "around")
    return back.select(ROW, "id", "firsts", "windows").mapInArrow(spans, _SPAN_SCHEMA)


def _covered(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def cut_texts(spanned: DataFrame) -> DataFrame:
    """ROW, n_removed and kept_text from the third table of ``repeats``."""
    schema = pa.schema([(ROW, pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        for batch in batches:
            n, kept = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, left, at, gone = (text or b"").split(), [], 0, 0
                for a, b in _covered(own):
                    left += words[at:a]
                    at, gone = b, gone + b - a
                n.append(gone)
                kept.append(b" ".join(left + words[at:]).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(n, pa.int64()), pa.array(kept)], schema=schema)

    return spanned.select(ROW, "text", "spans").mapInArrow(run, f"{ROW} long, n_removed long, kept_text string")


def substring_digests(documents: DataFrame) -> DataFrame:
    """One row per document: words, removed words, and the digest of the kept ones."""
    profiles, copied, spanned = repeats(documents.select(F.col("doc_id").alias("id"), "text"))
    cut = cut_texts(spanned).select(ROW, "n_removed", F.sha2("kept_text", 256).alias("cut"))
    whole = copied.select(ROW, F.lit(-1).cast("long").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("cut"))
    out = profiles.select(ROW, "id", "n_words", "sequence").join(cut.unionByName(whole), ROW, "left")
    removed = F.when(F.col("n_removed") < 0, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select(F.when(F.col("id") < LAST_ID, F.col("id")).alias("doc_id"), "n_words", removed.alias("n_removed"), F.coalesce("cut", "sequence").alias("kept_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from the texts; texts without repeats stay as they are, white space included.

    Rows that lose all their words go. Columns are those of ``docs``; n_chars, where present, follows the text.
    """
    staged = stage_rows(docs)
    _, copied, spanned = repeats(staged.select(ROW, F.col("doc_id").alias("id"), "text"))
    cut = cut_texts(spanned).select(ROW, "kept_text").unionByName(copied.select(ROW, F.lit("").alias("kept_text")))
    own = F.struct(*docs.columns).alias("own")  # callers' names can't clash with kept_text
    out = staged.select(ROW, own).join(cut, ROW, "left").where("kept_text is null or kept_text <> ''")
    fields = {c: F.col("own")[c] for c in docs.columns}
    fields["text"] = F.coalesce("kept_text", fields["text"])
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return out.select(*(v.alias(k) for k, v in fields.items()))


def query(spark, sf_dir):
    return substring_digests(read(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least USING (k) WHERE m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(0, 50) AS r(j)),
each AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
