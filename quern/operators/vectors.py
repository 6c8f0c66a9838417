"""Vectors: the deterministic hashed bag of words, and exact top-k by cosine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import spaced
from ..functions.text import squeeze
from ..sources.tables import written

DIM = 64
#: Rows that go to all executors at once; more are joined without a hint.
MOST_SENT = 50_000
#: Bytes of query vectors that go to all executors at once; more are taken in blocks.
QUERY_BYTES = 32 << 20
#: Words whose hashes a task keeps, about; frequent words come early.
KNOWN = 200_000
#: Vectors and queries of one matrix product: 32 MB of scores.
BLOCK = 2048


def with_hash_vector(df: DataFrame, text: str, out: str = "vec", dim: int = DIM) -> DataFrame:
    """Adds counts of the SHA-1 buckets of the lower-cased words, as a unit vector; zero for blank texts. dim: a power of two to 256.

    For short texts, as of queries and sentences; each step is a column, so that none is computed again for every component.
    """
    b, c, n = f"__{out}_b", f"__{out}_c", f"__{out}_n"
    words = F.filter(F.split(squeeze(F.lower(F.coalesce(F.col(text), F.lit("")))), " "), lambda w: w != "")
    x = df.withColumn(b, F.transform(words, lambda w: (F.conv(F.right(F.sha1(w), F.lit(2)), 16, 10).cast("int") % dim).cast("int")))
    x = x.withColumn(c, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(F.col(b), lambda v: v == i)).cast("double")))
    x = x.withColumn(n, F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda a, v: a + v * v)))
    return x.withColumn(out, F.transform(F.col(c), lambda v: F.when(F.col(n) > 0, v / F.col(n)).otherwise(0.0))).drop(b, c, n)


def _buckets(words: pa.Array, known: dict[bytes, int]) -> np.ndarray:
    """The last byte of each distinct word's SHA-1; known: those of the batches before, until they are many."""
    own = words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    at = np.array(list(map(known.get, own, repeat(-1))), np.int64)
    new = np.flatnonzero(at < 0)
    at[new] = found = [hashlib.sha1(own[i]).digest()[-1] for i in new.tolist()]
    if len(known) < KNOWN:
        known.update(zip((own[i] for i in new.tolist()), found))
    return at


def batch_vectors(texts: pa.Array, dim: int, known: dict[bytes, int]) -> np.ndarray:
    """A unit vector for each of the lower-cased texts, zero for blank ones: the words are counted at once, each distinct one hashed once."""
    split = spaced(texts)
    words = split.values.dictionary_encode()
    bucket = _buckets(words.dictionary, known)[words.indices.to_numpy()] % dim
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    c = np.bincount(row * dim + bucket, minlength=len(texts) * dim).reshape(-1, dim).astype(float)
    norm = np.sqrt((c * c).sum(axis=1))[:, None]
    return c / np.where(norm > 0, norm, 1.0)


def hash_vectors(rows: DataFrame, key: str | list[str], text: str, dim: int = DIM) -> DataFrame:
    """(key, vec) for a corpus: the words of a batch are counted at once, and nothing is shuffled."""
    keys = [key] if isinstance(key, str) else key
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    size = BLOCK

    def of(batches):
        known: dict[bytes, int] = {}  # words that this task has met
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                c = batch_vectors(part.column(len(keys)), dim, known)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim), pa.array(c.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], vec], names=schema.names)

    return rows.select(*keys, F.lower(text).alias("text")).mapInArrow(of, schema)


def sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df marked for broadcast if it has no more than ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def query_matrix(queries: pa.Table, dim: int) -> np.ndarray:
    """The vectors qv of queries as columns."""
    flat = queries.column("qv").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.ascontiguousarray(flat.reshape(-1, dim).T)


def _block_scores(queries: pa.Table, vectors: DataFrame, most: int, dim: int) -> DataFrame:
    """(chunk_id, q, score): of each batch of vectors those that may be among the best ``most`` of query row q.

    A matrix product for each tile of BLOCK vectors and BLOCK queries; what is within 2e-9 of the least of a tile's best
    stays, so that ties after rounding to nine places are all there.
    """
    matrix = query_matrix(queries, dim)
    key = vectors.schema["chunk_id"]
    schema = T.StructType([key, T.StructField("q", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                for first in range(0, matrix.shape[1], BLOCK):
                    score = own @ matrix[:, first : first + BLOCK]
                    keep = np.ones(score.shape, bool)
                    if len(own) > most:
                        keep = score >= np.partition(score, len(own) - most, axis=0)[len(own) - most] - 2e-9
                    row, col = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array((col + first).astype(np.int32)), pa.array(score[row, col])], names=["chunk_id", "q", "score"])

    return vectors.select("chunk_id", "vec").where(_sound("vec", dim)).mapInArrow(of, schema)


def _sound(vec: str, dim: int) -> Column:
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))


def query_blocks(queries: DataFrame, vec: str, dim: int, limit: int = QUERY_BYTES) -> Iterator[pa.Table]:
    """The rows of queries, one block after the other, each of about ``limit`` bytes of vectors; made as they are asked for."""
    n = max(1, -(-queries.count() * dim * 8 // limit))
    if n == 1:
        yield queries.toArrow()
        return
    for b in range(n):
        yield queries.where(F.pmod(F.xxhash64(vec, *(c for c in queries.columns if c != vec)), F.lit(n)) == b).toArrow()


def top_k(queries: DataFrame, vectors: DataFrame, k: Column | int, most: int, dim: int = DIM, save=written, limit: int = QUERY_BYTES) -> DataFrame:
    """queries (query_id, variant, vec[, k]) against vectors (chunk_id, vec): the best k chunks of each query, best variant first.

    Unit vectors; zero vectors score 0; vectors that are null, of another length or hold nulls or NaN are not searched for nor found.
    A stated set of queries meets all rows: blocks of ``limit`` bytes of queries go to all executors one after the other.
    """
    q = queries.where(_sound("vec", dim)).select("query_id", "variant", F.col("vec").alias("qv"), *(["k"] if "k" in queries.columns else []))
    parts = [named(_block_scores(block, vectors, most, dim), block, q.schema) for block in query_blocks(q, "qv", dim, limit)]
    scored = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, [save(p) for p in parts])
    return ranked(scored, F.col("k") if "k" in queries.columns else F.lit(k), most)


def named(scores: DataFrame, block: pa.Table, kinds: T.StructType) -> DataFrame:
    """q as what the block of queries says of it, scores to nine places. kinds: the block's columns."""
    kinds = T.StructType([*(f for f in kinds if f.name != "qv"), T.StructField("q", T.IntegerType())])
    names = scores.sparkSession.createDataFrame(block.drop_columns("qv").append_column("q", pa.array(np.arange(block.num_rows, dtype=np.int32))), kinds)
    return scores.join(F.broadcast(names), "q").drop("q").withColumn("score", F.round("score", 9))


def ranked(scored: DataFrame, lim: Column, most: int) -> DataFrame:
    """The best chunks of each query, best variant first, of (query_id, variant, chunk_id, score)."""
    per = Win.partitionBy("query_id", "variant").orderBy(F.desc("score"), "chunk_id")
    cut = scored.withColumn("r", F.row_number().over(per)).where((F.col("r") <= most) & (F.col("r") <= lim))
    best = cut.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max_by("variant", F.struct(F.col("score"), -F.col("variant"))).alias("variant"))
    over = Win.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(over))
