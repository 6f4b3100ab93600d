"""Corpus pipeline: toxicity, quality rules, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents, whatever others there are beside them; the last returns the pieces of packed sequences. Empty tables give
empty results; repeated rows are documents like others until one of each near copy is kept.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.llm import curve_packing, host_quality, line_dedup, ngram_join, toxicity
from leafgrove.llm._shared import at_exit, collected, read, release, shared_dir, small_batches


class _Scratch(threading.local):
    """Tables of the stage that this thread ran last."""

    def __init__(self) -> None:
        self.tables: list = []


_scratch = _Scratch()


def _stage(work):
    """Tables that the stage before wrote for itself go once the next one starts: its result has been written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_scratch.tables)
        with collected() as tables:
            out = work(spark, docs, sf_dir)
        _scratch.tables.extend(tables)
        return out

    run.__doc__ = work.__doc__
    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, scores below 0.5; null and empty texts have no toxic passage and stay."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of their own and of their host; null, empty and very short texts fail, a null source is a host of its own."""
    return host_quality.keep_good(docs)


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are similar to an earlier line; of texts whose lines all go the empty text stays, null ids come first."""
    return line_dedup.dedup_lines(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a Jaccard similarity of 0.8 or more, on five-word shingles, hold together.

    Of repeated rows of an id one stays; documents without words or without an id stay, as they link with nothing.
    """
    return ngram_join.keep_one(docs, n=5, per_cent=80)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a null or empty text is its end token alone."""
    return curve_packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_quality), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("packing", pack)]

#: Scores of a fitted model and tokens of a vocabulary file are beyond SQL; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages leave of documents. A stage's table goes when the next one has been written, the last with the process."""
    docs, before = read(spark, sf_dir, "documents"), []
    base = f"{shared_dir(spark)}/leafgrove/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        # Workers of earlier stages stay beside those of a later one, so none may hold much.
        with small_batches(spark, 2000):
            stage(spark, docs, sf_dir).write.parquet(path)
        release(before)
        before.append((spark, path))
        docs = spark.read.parquet(path)
    release(_scratch.tables)
    at_exit(before)
    return docs
