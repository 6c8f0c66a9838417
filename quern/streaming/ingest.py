"""Streams, an extension beyond batch ingestion: files as they arrive, and percentiles of a log by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.chunking import chunk
from ..plans.library import Library, _documents
from ..sources.files import documents, extract, source_id


def _arriving(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)


def ingest_stream(spark: SparkSession, root: str, out: str, checkpoint: str, cfg: Config = Config()):
    """Each new file below root becomes chunks in out; a batch is written to a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        docs = documents(extract(batch.select("path", "content")))
        chunk(docs.select("document_id", "text", "file_type"), cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _arriving(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def library_stream(library: Library, root: str, checkpoint: str, name: str = "stream", workspace_id: str = "default"):
    """New files below root go into the library, each batch once: a batch that is run again after a restart is known by the mark of its head.

    Files whose content the library holds are left out. Changed and vanished files are the task of Library.sync.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", "content", "length", F.col("modificationTime").alias("modified"), source_id(F.col("path")).alias("document_id"), F.sha2("content", 256).alias("sha"))
        known = library.read("documents").select("document_id", F.col("content_sha").alias("sha"))
        fresh = rows.join(known, ["document_id", "sha"], "left_anti")
        docs = library.save(_documents(fresh, fresh, workspace_id))
        library.change(docs.where("text is not null").drop("error_stage"), mark=(name, number))

    return _arriving(library.spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_by_hour(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(hour, event_type, n, p95) of a stream or table of (ts, event_type, value); approximate, as state must stay bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", 0.95).alias("p95"))
