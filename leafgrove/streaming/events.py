"""The event log, batch and streaming: idempotent append, windows with late data, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["document_id", "event_id"]
#: Names of the events that stages emit.
NAMES = ["AcquisitionStarted", "AcquisitionCompleted", "SourceFingerprintComputed", "PageNativeParsed", "PageProfiled", "UnresolvedRegionEmitted", "ProjectionCreated", "NodeCommitted", "HierarchySynthesisCompleted", "TreeBuildCompleted", "NodeSummarized", "RetrievalCorpusBuildStarted", "RetrievalCorpusBuildCompleted", "RetrievalSearchStarted", "RetrievalSearchCompleted", "RetrievalQAStarted", "RetrievalQACompleted", "TreeSearchStarted", "TreeSearchStepSelected", "TreeSearchCompleted"]


def events(df: DataFrame, name: str, document: str, *details: str) -> DataFrame:
    """A log row for each row of df; its id is a digest of what it says, so a repeated run logs nothing twice."""
    body = F.to_json(F.struct(*details)) if details else F.lit("{}")
    return df.select(F.col(document).cast("string").alias("document_id"), F.sha2(F.concat_ws("|", F.lit(name), F.col(document).cast("string"), body), 256).alias("event_id"), F.lit(name).alias("name"), F.lit("info").alias("severity"), body.alias("details"), F.current_timestamp().alias("occurred_at"))


def dedupe(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One row for each key; on a stream within the watermark, so that state stays bounded."""
    return log.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(KEY) if log.isStreaming else log.dropDuplicates(KEY)


def counts(log: DataFrame, by: str = "name", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by window and name; late ones are waited for up to delay."""
    own = log.withWatermark("occurred_at", delay) if log.isStreaming else log
    return own.groupBy(F.window("occurred_at", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(log: DataFrame, who: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    own = log.withWatermark("occurred_at", delay) if log.isStreaming else log
    return own.groupBy(F.session_window("occurred_at", gap).alias("w"), who).agg(F.count("*").alias("n")).select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def append_log(log: DataFrame, path: str, checkpoint: str):
    """Write a stream to JSON lines, all that is there by now."""
    return log.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_log(log: DataFrame, sink, checkpoint: str):
    """Hand each micro-batch, without repeats, to sink(batch, epoch): for stores that upsert by key."""
    return log.writeStream.foreachBatch(lambda batch, epoch: sink(batch.dropDuplicates(KEY), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
