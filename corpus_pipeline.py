"""The corpus pipeline: toxicity, exact, near and substring deduplication, and packing, over ``documents``.

Each stage takes what its predecessor kept, written as Parquet in the shared folder and read again, and returns the
columns of ``documents``, whatever other columns these are; the last one returns placements in training sequences. As a
stage's input is written by then, it starts by deleting the tables that earlier stages of the same thread put down for
themselves over the same ``sf_dir``, but for those that its input still reads; what stages give elsewhere, in other
threads or in ``run`` is not touched. ``run`` keeps the table of its result and nothing else.

Defined results, by stage. Toxicity drops rows that score 0.5 or more; null and empty texts score the calibrated prior.
Exact deduplication keeps one row of equal texts (null counts as empty), the longest original, then the smallest
doc_id, so of empty texts one stays. Near deduplication keeps the row with the smallest doc_id of each class; texts
without words are classes of their own. Substring deduplication cuts words and drops rows that lose all of them; other
texts stay as they are, and n_chars follows the text. Packing places every byte of every text, and one end mark for
each row. Null ids come last in every order. Very long texts and repeated rows are read in whole; an empty table gives
empty results throughout.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopweave.llm import exact, minhash, packing, substring, toxicity
from stopweave.llm.common import Scratch, read, stage

_here = threading.local()


def _tables(sf_dir: str) -> dict[int, Scratch]:
    """What the stages of this thread have put down over ``sf_dir``, by their place in STAGES."""
    return _here.__dict__.setdefault("runs", {}).setdefault(sf_dir, {})


def _stage(place: int):
    def known(work):
        @wraps(work)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            tables = _tables(sf_dir)
            for earlier in [k for k in tables if k < place]:
                tables[earlier].clear(spark, docs)
            with tables.setdefault(place, Scratch()).recording():
                return work(spark, docs, sf_dir)

        return run_stage

    return known


@_stage(0)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


@_stage(1)
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first_copies(docs)


@_stage(2)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_of_each(docs)


@_stage(3)
def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(docs)


@_stage(4)
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select(F.col("doc_id").cast("long").alias("id"), "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("packing", pack),
]

#: Nearest neighbours and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, _here.runs = _here.__dict__.get("runs", {}), {}
    try:
        docs, handed = read(spark, sf_dir, "documents"), Scratch()
        for _, step in STAGES:
            with handed.recording():
                docs = stage(step(spark, docs, sf_dir))
            handed.clear(spark, docs)
        for own in _tables(sf_dir).values():
            own.clear(spark, docs)
        return docs
    finally:
        _here.runs = before
