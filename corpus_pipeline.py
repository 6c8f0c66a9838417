"""A corpus pipeline over documents: toxicity, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, jaccard_dedup, line_dedup, toxicity
from quern.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("toxic_predicted = 0").select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the aligned lines that an earlier document has; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of texts linked by a Jaccard similarity of 0.8 or more over five-word shingles.

    SimHash balls (op8's method) give the first candidates; pairs outside them come from an exact similarity join.

    A row is known by its doc_id and text; of rows that agree in both, one stays. Null doc_ids come after all others.
    """
    row = F.xxhash64("doc_id", "text").alias("row")
    groups = jaccard_dedup.near_duplicates(docs.select(row, "text"), words=5, least=0.8)
    named = docs.select(row, "doc_id").join(groups.select("row", "component").distinct(), "row")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return docs.withColumn("row", row).join(first, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. A row is known by its doc_id and text, null or repeated ids included."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    found = decontaminate.leaks(rows, items, id_col="row").select(F.col("doc_id").alias("row")).distinct()
    return rows.join(found, "row", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.encode_decode(docs, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("decontaminate", drop_leaks),
    ("bpe", encode),
]

#: The stages train a model, align and encode: SQL cannot express them. tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result but the last is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
