"""Shared folder, staging and row identity for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the row identity that ``stage_rows`` adds; callers' columns never start like this.
ROW = "__sw_row"
#: A class of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and the session is local (tests) a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="stopweave-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/stopweave-{uuid.uuid4().hex}"


#: Where ``stage`` notes the folders that it chooses, in the thread at hand.
_noting: ContextVar[list[str] | None] = ContextVar("noting", default=None)


class Scratch:
    """The folders that ``stage`` chooses in this thread while this records them, to be deleted when nothing rests on them any more."""

    def __init__(self):
        self.folders: list[str] = []

    @contextmanager
    def recording(self):
        token = _noting.set(self.folders)
        try:
            yield
        finally:
            _noting.reset(token)

    def clear(self, spark: SparkSession, still_read: DataFrame) -> None:
        """Delete the folders recorded so far, but for those that ``still_read`` reads from."""
        files = still_read.inputFiles()
        held = [f for f in self.folders if any(f.rpartition("/")[2] in x for x in files)]
        for folder in set(self.folders) - set(held):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders[:] = held


def stage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows rereads files that every executor sees, so a lost executor costs a
    reread and never a recomputation with other row numbers.
    """
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    if not folder and (noted := _noting.get()) is not None:
        noted.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_rows(df: DataFrame) -> DataFrame:
    """``stage`` with a column ROW that tells rows apart, even rows that are equal in all columns."""
    return stage(df.withColumn(ROW, F.monotonically_increasing_id()))


def with_rows(df: DataFrame) -> DataFrame:
    """``df`` itself if its rows are numbered, else ``stage_rows``.

    A number is drawn once: a second scan of the same files may split them otherwise, as the split size follows the
    cores registered at that moment.
    """
    return df if ROW in df.columns else stage_rows(df)


def words(col):
    """The words of a text, unchanged: maximal runs of other characters than SPACE; null has none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE + "+"), lambda w: w != "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The 256 values of the byte-wise CRC-32, by its rule, as a DuckDB table ``crc`` of one row with the list ``t``.
CRC_TABLE_SQL = (
    "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"
)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, in a query that CRC_TABLE_SQL's table is joined to."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"
