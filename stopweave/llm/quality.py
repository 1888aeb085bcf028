"""Quality rules on single documents and on lines that many documents of one host share.

Each document gives a few figures of its own (words, symbols, repeated lines, words inside repeated three-word
windows) and the hashes of its normalised lines. Those are staged without the texts. Then, by host: count the
distinct documents of each line, call a line frequent if that count is above an absolute limit and above a share of
the host's distinct documents, remove frequent lines, and reject documents that lose more than a given share of
their characters. Copies of one text count as one document, so a text is not rejected for having copies.

Everything is DataFrame and SQL functions. A repeated window is found by sorting the window hashes within the row
(n log n), never by comparing all pairs. The frequency count first collapses (host, line, document), then (host,
line) within each task, so a very common line or host costs a row a task.

Defined results: a null or empty text has no words and fails the base rules; a null host is the host ''. Rows that
are repeated are judged alike; lines that are equal after normalising are one line, and a line counts once in a
document. Very long texts and lines are read in whole. Columns other than the id, the text and the host are passed by,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm.common import ROW, SPACE, read, stage, stage_rows, words

BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: A line is frequent in a host in more distinct documents than this.
MORE_THAN_DOCUMENTS = 20
#: A document is depleted if frequent lines hold more than this share of its characters.
DEPLETED_SHARE = 0.50


def normal_line(line):
    """Lower case, digits as 0, runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE + "+", " "))


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the word array ``w``; drops ``w``.

    Window hashes are sorted with their places; places of equal neighbours, sorted again, are swept once.
    """
    df = df.withColumn("n", F.size("w")).withColumn(
        "h", F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    ).drop("w")
    df = df.withColumn("s", F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("s", lambda x, k: (F.get("s", k - 1)["h"] == x["h"]) | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("free"))
    swept = F.aggregate(places, start, lambda a, i: F.struct((a["covered"] + i + 3 - F.greatest(a["free"], i)).alias("covered"), (i + 3).alias("free")))
    return df.withColumn("n_repeat_words", F.coalesce(swept["covered"], F.lit(0)).cast("long")).drop("h", "s")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """A row for each row: id, host, the base figures, a content hash and the lines as (hash, characters)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), text.alias("text"), *(keep or []))
    solid = lambda c: F.length(F.translate(c, BLANKS, ""))
    df = df.select(
        *(keep or []),
        "id",
        "host",
        F.xxhash64("text").alias("content"),
        words(F.col("text")).alias("w"),
        solid(F.col("text")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), solid(x).alias("chars"))), lambda x: x["chars"] > 0).alias("found"),
    )
    df = df.withColumn("n_dup_lines", (F.size("found") - F.size(F.array_distinct("found.line"))).cast("long"))
    df = df.withColumn("lines", F.transform("found", lambda x: F.struct(F.unhex(F.md5(normal_line(x["line"]))).alias("line"), x["chars"].alias("chars")))).drop("found")
    return _repeated_words(df).withColumn("n", F.col("n").cast("long")).withColumnRenamed("n", "n_words")


def frequent_lines(rows: DataFrame, more_than: int = MORE_THAN_DOCUMENTS) -> DataFrame:
    """(host, line, documents): lines in more than that many distinct documents, counted over all rows of ``measures``."""
    lines = rows.select("host", "content", F.explode("lines.line").alias("line"))
    return lines.groupBy("host", "line").agg(F.count_distinct("content").alias("documents")).where(F.col("documents") > more_than)


def judge(docs: DataFrame, depleted: float = DEPLETED_SHARE, with_lines: bool = True, **limits) -> DataFrame:
    """A row for each row: id, the figures, removed_chars, base_failed and kept, and the removed line hashes ``with_lines``.

    Of ``docs`` that are numbered already (``stage_rows``) the numbers stay.
    """
    numbered = ROW in docs.columns
    rows = stage(measures(docs, keep=[ROW])) if numbered else stage_rows(measures(docs))
    frequent = frequent_lines(rows, **limits)
    hit = rows.select(ROW, "host", F.explode("lines").alias("x")).select(ROW, "host", "x.line", "x.chars").join(frequent.select("host", "line"), ["host", "line"])
    lost = hit.groupBy(ROW).agg(F.sum("chars").alias("removed_chars"), *([F.collect_set("line").alias("removed")] if with_lines else []))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.coalesce("removed_chars", F.lit(0))
    return (
        rows.drop("lines", "content")
        .join(lost, ROW, "left")
        .withColumn("removed_chars", gone)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("removed_chars") <= F.lit(depleted) * F.col("word_chars")))
    )


def without_lines(text, removed):
    """A text without the lines whose normalised hash is in ``removed``."""
    left = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains(removed, F.unhex(F.md5(normal_line(x)))), F.lit(False)))
    return F.array_join(left, "\n")


def without_frequent_lines(documents: DataFrame, **limits) -> DataFrame:
    """The documents that stay, without the lines that are frequent in their host; columns unchanged but for the text."""
    numbered = stage_rows(documents)
    kept = judge(numbered, **limits).where("kept").select(ROW, F.col("removed").alias("__sw_removed"))
    none = F.array().cast("array<binary>")
    cut = numbered.join(kept, ROW).withColumn("text", without_lines(F.col("text"), F.coalesce("__sw_removed", none)))
    return cut.select(documents.columns)


def quality_verdicts(documents: DataFrame, **limits) -> DataFrame:
    """The figures and the verdict of each document."""
    return judge(documents, with_lines=False, **limits).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("removed_chars").cast("long").alias("removed_chars"))


def query(spark, sf_dir):
    return quality_verdicts(read(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
l AS (SELECT r, host, text, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
        trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
      FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM t)),
solid AS (SELECT * FROM l WHERE chars > 0),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM solid GROUP BY r),
freq AS (SELECT host, norm FROM solid GROUP BY host, norm HAVING count(DISTINCT text) > 20),
lost AS (SELECT r, sum(chars) AS n FROM solid JOIN freq USING (host, norm) GROUP BY r),
f AS (SELECT t.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(lines.n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_chars
      FROM t JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_chars <= 0.50 * word_chars AS kept FROM f
"""
