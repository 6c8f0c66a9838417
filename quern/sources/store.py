"""Keyed tables of documents, chunks and vectors: upserts, replacement, deletion with cascade, lookups, counts, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, created: str | None = "created_at", updated: str | None = "updated_at", now=None) -> DataFrame:
    """New rows win; a known key keeps its creation time, and every written row gets the time of writing."""
    put = new
    now = F.current_timestamp() if now is None else now
    if updated and updated in old.columns:
        put = put.withColumn(updated, now)
    if created and created in old.columns:
        known = old.select(key, F.col(created).alias("__created"))
        put = put.drop(created).join(known, key, "left").withColumn(created, F.coalesce("__created", now)).drop("__created")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(put.select(*old.columns))


def replace_chunks(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All chunks of the new documents take the place of their old ones; no stale tail stays."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def delete(table: DataFrame, ids: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """The table without the ids, and (deleted) how many rows went. Give dependent tables the same ids: that is the cascade."""
    gone = ids.select(key).distinct()
    return table.join(gone, key, "left_anti"), table.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def lookup(table: DataFrame, ids: list[str], key: str) -> DataFrame:
    return table.where(F.col(key).isin(ids))


def info(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("documents")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def append_log(rows: DataFrame, path: str) -> None:
    """Evaluation log as JSON lines."""
    rows.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)


def read_golden(spark, path: str) -> DataFrame:
    """Golden items from JSON lines: blank and # lines are skipped, names in either case style are taken, bad lines carry an error."""
    schema = "id string, query string, workspaceId string, workspace_id string, expectedSourceIds array<string>, expected_source_ids array<string>, expectedSubstrings array<string>, expected_substrings array<string>, tags array<string>, notes string, _bad string"
    lines = spark.read.text(path).where("trim(value) <> '' and trim(value) not like '#%'")
    x = lines.select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    none = F.array().cast("array<string>")
    pick = lambda a, b, d: F.coalesce(F.col(f"x.{a}"), F.col(f"x.{b}"), d)
    return x.select(
        F.col("x.id").alias("id"),
        F.col("x.query").alias("query"),
        pick("workspaceId", "workspace_id", F.lit("default")).alias("workspace_id"),
        pick("expectedSourceIds", "expected_source_ids", none).alias("expected_ids"),
        pick("expectedSubstrings", "expected_substrings", none).alias("expected_substrings"),
        F.coalesce("x.tags", none).alias("tags"),
        F.when(F.col("x.id").isNull() | F.col("x.query").isNull(), F.concat(F.lit("not a golden item: "), "value")).alias("error"),
    )
