"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits share a variant that differs from either in at most one bit.
So each distinct fingerprint emits its 65 variants, the shuffle is on variants, and the fingerprints that meet
at one variant (65 at most, all within two bits of each other) are linked to the least of them after a check of
the distance. Copies are one fingerprint, so hot groups are gone before variants are made.

Defined cases: null or empty texts, or texts of white space, have fingerprint zero and link like any other;
texts of fewer than three words have their whole word sequence as only shingle; rows that share a doc_id each
get a row; null doc_ids are kept and never name a component unless nothing else is in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches, text_buffers, word_spans
from .components import connected_components

BITS = 64


def _fold_case(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each run h[at[i] : at[i + 1]] the bits that are set in over half its hashes; zero for empty runs."""
    k = np.diff(at)
    out, some = np.zeros(len(k), np.uint64), np.flatnonzero(k)
    if len(some):
        for bit in range(BITS):
            ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int64), at[:-1][some])
            out[some] |= (2 * ones > k[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints_of(col, words: int = 3) -> np.ndarray:
    """Fingerprints (unsigned) of a string column."""
    data, off = text_buffers(col)
    data = _fold_case(data)
    starts, ends, first = word_spans(data, off)
    if not len(starts):
        return np.zeros(len(off) - 1, np.uint64)
    lens = ends - starts
    # all words joined by one space: a shingle is one run of these bytes
    put = np.concatenate([[0], np.cumsum(lens + 1)])
    inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    flat = np.full(int(put[-1]), 32, np.uint8)
    flat[inner + np.repeat(put[:-1], lens)] = data[inner + np.repeat(starts, lens)]
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    count = np.diff(first)
    full = count >= words
    k = np.where(full, count - words + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), k)
    begin = first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k))
    last = np.where(full[doc], begin + words, first[1:][doc]) - 1
    h = np.fromiter((digest(raw[a:b], 42) for a, b in zip(put[begin].tolist(), (put[last] + lens[last]).tolist(), strict=True)), np.uint64, len(doc))
    return majority(h, np.concatenate([[0], np.cumsum(k)]))


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), fp being the fingerprint as a signed long."""

    def of(batches):
        for b in batches:
            for s in slices(b):
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(fingerprints_of(s.column(1), words).view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)))
    return fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))


def near_links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all distinct fp values within two bits, each between two values that are so close."""
    met = _variants(fps).groupBy("variant").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.collect_list("fp").alias("all"))
    pairs = met.where("low < high").select("low", F.explode("all").alias("fp")).where("fp <> low")
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= 2).select(F.col("fp").alias("u"), F.col("low").alias("v"))


def near_duplicates(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    own = materialise(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(near_links(classes.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.bitwise_not("fp"))))
    named = classes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # a partial minimum, then back to each fingerprint by a key of its own, which Spark can split where a component is large
    apart = F.bitwise_not(F.col("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id")).select(apart.alias("k"), "component_id")
    label = named.select("fp", apart.alias("k")).join(least, "k").select("fp", "component_id")
    return own.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """op8 over the whole of documents: doc_id, fingerprint, component_id."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
