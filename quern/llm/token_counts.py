"""Token counts by separator scan over flat, unindexed token files.

A token file is ids of fixed width one after the other; a separator id ends each document and nothing says where
documents begin. Blocks of a file are scanned independently for the separator; each yields the lengths of the
documents that lie inside it and the loose ends before its first and after its last separator. A two-level prefix
scan over the separator counts of the blocks gives the ordinal of each block's first document, and loose ends of
the same ordinal are summed, so a document may span any number of blocks and a file any number of machines.

Counts leave the separator out. Two separators in a row, or one at the start, make a document of no tokens; ids
after the last separator are a document of their own; an empty file has no documents. A trailing partial id is
an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import codec
from .common import materialise, slices, small_batches

BLOCK_BYTES = 1 << 20
SUPER = 1024


def blocks_of_files(spark: SparkSession, uris: list[str], *, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(shard, block, tokens) of token files that pyarrow's file systems reach; only sizes are looked up on the driver."""
    from pyarrow import fs

    block_bytes -= block_bytes % width
    rows = []
    for shard, uri in enumerate(uris):
        store, path = fs.FileSystem.from_uri(uri)
        rows += [(shard, b, uri) for b in range(-(-store.get_file_info(path).size // block_bytes))]

    def read(batches):
        for batch in batches:
            for shard, block, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    data = f.read_at(block_bytes, block * block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["shard", "block", "tokens"])

    ranges = spark.createDataFrame(rows, "shard int, block int, uri string")
    return ranges.repartition(max(1, min(len(rows), 4096))).mapInArrow(read, "shard int, block int, tokens binary")


def write_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", separator: int = 50256, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Encode the texts of each input partition into one flat stream of 16-bit ids, each text ended by the separator.

    Returns the stream's blocks (shard, block, tokens), cut without regard to documents, and beside them which row
    went where (shard, ordinal, doc_id); both are tables in the shared folder. Strings of special tokens in a text
    are encoded as ordinary text, so that only real ends are separators. Nulls are texts of no tokens.
    """

    def of(batches):
        c, shard, block, base = codec(plain=True), TaskContext.get().partitionId(), 0, 0
        if separator > 65535 or len(c.bytes) > 65536:
            raise ValueError("16 bits do not hold all ids")
        loose: list[bytes] = []
        held = 0
        for b in batches:
            for s in slices(b):
                for t in s.column(1).to_pylist():
                    x = np.append(c.encode(t), np.uint32(separator)).astype("<u2").tobytes()
                    loose.append(x)
                    held += len(x)
                yield row(shard, base, None, s.column(0))
                base += s.num_rows
                data = b"".join(loose)
                while held >= block_bytes:
                    yield row(shard, block, data[:block_bytes], None)
                    data, held, block = data[block_bytes:], held - block_bytes, block + 1
                loose = [data]
        if held:
            yield row(shard, block, b"".join(loose), None)

    def row(shard, block, tokens, ids):
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) if ids is not None else pa.array([None], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([tokens], pa.binary()), lists], names=["shard", "block", "tokens", "ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = materialise(rows.mapInArrow(of, "shard int, block int, tokens binary, ids array<long>"), "tokens")
    where = both.where("tokens is null").select("shard", F.col("block").cast("long").alias("base"), F.posexplode("ids").alias("i", "doc_id"))
    return both.where("tokens is not null").select("shard", "block", "tokens"), where.select("shard", (F.col("base") + F.col("i")).alias("ordinal"), "doc_id")


def count_tokens(blocks: DataFrame, *, separator: int = 50256, width: int = 2) -> DataFrame:
    """(shard, ordinal, n_tokens) for each document of the token files whose blocks are (shard, block, tokens)."""

    def scan(batches):
        for batch in batches:
            n, head, tail, inner = [], [], [], []
            for data in batch.column(2):
                raw = data.as_buffer()
                if len(raw) % width:
                    raise ValueError(f"a block of {len(raw)} bytes does not hold whole ids of {width} bytes")
                ids = np.frombuffer(raw, f"<u{width}")
                at = np.flatnonzero(ids == separator)
                n.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else 0)
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], names=["shard", "block", "n", "head", "tail", "inner"]
            )

    found = materialise(blocks.select(F.col("shard").cast("int"), F.col("block").cast("int"), "tokens").mapInArrow(scan, "shard int, block int, n long, head long, tail long, inner array<long>"), "scan")
    part = found.withColumn("super", F.floor(F.col("block") / SUPER))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    over = part.groupBy("shard", "super").agg(F.sum("n").alias("all"))
    over = over.select("shard", "super", F.coalesce(F.sum("all").over(before.partitionBy("shard").orderBy("super")), F.lit(0)).alias("start"))
    put = part.withColumn("ahead", F.coalesce(F.sum("n").over(before.partitionBy("shard", "super").orderBy("block")), F.lit(0)))
    put = put.join(over, ["shard", "super"]).withColumn("base", F.col("start") + F.col("ahead"))
    ends = F.array(
        F.struct(F.col("base").alias("ordinal"), F.col("head").alias("k"), (F.col("n") > 0).cast("int").alias("closed")),
        F.struct((F.col("base") + F.col("n")).alias("ordinal"), F.when(F.col("n") > 0, F.col("tail")).otherwise(0).alias("k"), F.lit(0).alias("closed")),
    )
    loose = put.select("shard", F.explode(ends).alias("e")).groupBy("shard", F.col("e.ordinal").alias("ordinal")).agg(F.sum("e.k").alias("n_tokens"), F.max("e.closed").alias("closed"))
    loose = loose.where("n_tokens > 0 or closed = 1").select("shard", "ordinal", "n_tokens")
    whole = put.where("n > 1").select("shard", "base", F.posexplode("inner").alias("i", "n_tokens")).select("shard", (F.col("base") + 1 + F.col("i")).alias("ordinal"), "n_tokens")
    return whole.unionByName(loose)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """op4 over the whole of documents, written as token files: doc_id, shard, ordinal, n_tokens."""
    blocks, where = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return where.join(count_tokens(blocks), ["shard", "ordinal"]).select("doc_id", "shard", "ordinal", "n_tokens")
