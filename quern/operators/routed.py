"""Searches with a filter for each question: workspace, source types, documents.

Chunks are stored in partitions by workspace and source type; a batch of questions reads the partitions that its filters name. Questions
with equal filters share a scope, and the statistics of keyword search (n, avgdl, df) are those of the scope.
A filter that is null or an empty list lets all pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written
from . import retrieval
from .vectors import sent

_NONE = "array<string>"


def store(chunks: DataFrame, path: str) -> None:
    """Chunks (workspace_id, source_type, document_id, chunk_id, ...) in partitions of their own."""
    chunks.write.partitionBy("workspace_id", "source_type").mode("errorifexists").parquet(path)


def stored(spark: SparkSession, path: str, chunks_schema=None) -> DataFrame:
    """The stored chunks; partition values stay strings."""
    reader = spark.read.option("basePath", path)
    return (reader.schema(chunks_schema) if chunks_schema is not None else reader).parquet(path)


def scoped(questions: DataFrame) -> DataFrame:
    """questions (query_id, query[, workspace_id][, source_types][, document_ids]) with ``scope``, equal for equal filters whatever their order."""
    has = lambda c, kind: F.col(c).cast(kind) if c in questions.columns else F.lit(None).cast(kind)
    some = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(has(c, _NONE), F.array().cast(_NONE)), lambda x: x.isNotNull())))
    out = questions.withColumns({"workspace_id": F.nullif(has("workspace_id", "string"), F.lit("")), "source_types": some("source_types"), "document_ids": some("document_ids")})
    return out.withColumn("scope", F.xxhash64("workspace_id", "source_types", "document_ids"))


def in_scope(chunks: DataFrame, scopes: DataFrame) -> DataFrame:
    """Chunks with ``scope``, once for each scope they are in. scopes: (scope, workspace_id, source_types, document_ids).

    Workspaces and source types that no scope names are partition filters of the scan: their files are not opened.
    """
    parts = written(chunks.select("workspace_id", "source_type").distinct().withColumnsRenamed({"workspace_id": "~w", "source_type": "~s"}))  # as many rows as partitions
    fits = (F.col("workspace_id").isNull() | (F.col("~w") == F.col("workspace_id"))) & ((F.size("source_types") == 0) | F.array_contains("source_types", F.col("~s")))
    want = written(scopes.join(sent(parts), fits).select("scope", F.col("~w").alias("workspace_id"), F.col("~s").alias("source_type"), "document_ids"))
    names = want.agg(F.collect_set("workspace_id").alias("w"), F.collect_set("source_type").alias("s")).first()  # no more than there are partitions
    met = chunks.where(F.col("workspace_id").isin(names.w) & F.col("source_type").isin(names.s)).join(sent(want), ["workspace_id", "source_type"])
    return met.where((F.size("document_ids") == 0) | F.array_contains("document_ids", F.col("document_id"))).drop("document_ids")


def bm25_top_k(questions: DataFrame, chunks: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, chunk_id, score, rank) as retrieval.bm25_top_k over the chunks of each question's scope."""
    asked = written(scoped(questions))
    scopes = asked.select("scope", "workspace_id", "source_types", "document_ids").distinct()
    held = retrieval.indexed(chunks).select("workspace_id", "source_type", "document_id", "chunk_id", *retrieval.INDEXED)  # tokenised once, whatever scopes a chunk is in
    return retrieval.ranked(retrieval.bm25_scores(asked, in_scope(held, scopes), k, scope="scope"), k, k)
