"""Ranked lexical search: a hierarchical max tree over document ranges for each term, searched best first.

1. Each task packs its documents, as they come, into shards of bounded size: postings (document, occurrences) by term,
   and the documents' lengths. No text is shuffled, and the table of shards serves any set of questions.
2. Questions are taken in blocks of bounded bytes. The documents that hold their terms are counted from the shards' term
   lists alone.
3. A task goes through its shards. In each, a term's highest score of any document is kept for leaves of LEAF documents and,
   FAN to one, up to the whole shard. A question opens the node with the highest sum of its terms' bounds first; inner
   nodes yield their children, leaves the exact scores of their documents. It ends where a bound is below the
   K-th best score so far; nodes whose bound equals it are opened, as they may hold an equal score with a smaller
   doc_id. What a task knows from one shard cuts the search of the next.
4. The best of all tasks are ranked by question.

Terms are known by 64-bit hashes: a question's term meets another one of a corpus of 10^10 distinct terms with a chance of about
10^-9. Scores are 64-bit integers.

Defined cases: null or empty texts have no terms; such documents are found by nothing, such items find nothing. A null
doc_id comes after all others of an equal score; rows that share a doc_id are documents of their own. Items of one text, or of one
item_id, are ranked each for itself. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BREAK, SLICE_BYTES, materialise, slices, span_hashes, text_buffers, word_spans

K = 50
#: Most documents and bytes of text of a shard (one document at least).
SHARD_DOCS, SHARD_BYTES = 4096, 8 << 20
#: Documents of a leaf, and children of a node.
LEAF, FAN = 16, 16
#: Leaves that are opened at once, at most.
WIDEST = 32
#: Bytes of questions that are searched for in one pass; bounds what is sent to the tasks.
BLOCK_BYTES = 128 << 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHARD = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, starts binary, docs binary, counts binary"
_NULL = -(1 << 63)


@contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most for what is run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def term_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a string column, only A-Z lower-cased, and how many each text has. Long texts are taken piece by piece."""
    data, off = text_buffers(col)
    if len(off) > 2 or len(data) <= 4 * SLICE_BYTES:
        data = _LOWER[data]
        starts, ends, first = word_spans(data, off, BREAK)
        return span_hashes(data, starts, ends), np.diff(first)
    out, at = [], 0
    while at < len(data):
        to = min(at + SLICE_BYTES, len(data))
        while to < len(data) and not len(found := np.flatnonzero(BREAK[data[to : to + SLICE_BYTES]])):
            to = min(to + SLICE_BYTES, len(data))
        to = to if to == len(data) else to + int(found[0])
        part = _LOWER[data[at:to]]
        starts, ends, _ = word_spans(part, np.array([0, len(part)]), BREAK)
        out.append(span_hashes(part, starts, ends))
        at = to
    h = np.concatenate(out)
    return h, np.array([len(h)])


def _narrow(a: np.ndarray) -> bytes:
    """Unsigned numbers in the least of 1, 2, 4 or 8 bytes."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0)))).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _shard(ids: list[np.ndarray], lengths: list[np.ndarray], hashes: list[np.ndarray]) -> dict:
    length, h = np.concatenate(lengths), np.concatenate(hashes)
    doc = np.repeat(np.arange(len(length), dtype=np.int64), length)
    order = np.argsort(h, kind="stable")  # documents ascend within a term
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return {
        "n_docs": int((length > 0).sum()), "n_terms": int(length.sum()), "ids": np.concatenate(ids).tobytes(), "lengths": _narrow(length),
        "terms": h[first].tobytes(), "starts": np.append(first, len(h)).astype("<u4").tobytes(), "docs": _narrow(doc), "counts": _narrow(count),
    }


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The table of shards of all documents; a row is a shard."""

    def of(batches):
        ids, lengths, hashes, held, size = [], [], [], 0, 0
        for batch in batches:
            for part in slices(batch, limit=min(SLICE_BYTES, shard_bytes)):
                if held and (held + part.num_rows > shard_docs or size + part.column(1).nbytes > shard_bytes):
                    yield pa.RecordBatch.from_pylist([_shard(ids, lengths, hashes)], schema=schema)
                    ids, lengths, hashes, held, size = [], [], [], 0, 0
                for at in range(0, part.num_rows, shard_docs):
                    some = part.slice(at, shard_docs)
                    if held + some.num_rows > shard_docs:
                        yield pa.RecordBatch.from_pylist([_shard(ids, lengths, hashes)], schema=schema)
                        ids, lengths, hashes, held, size = [], [], [], 0, 0
                    h, n = term_hashes(some.column(1))
                    ids.append(some.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False).astype("<i8"))
                    lengths.append(n)
                    hashes.append(h)
                    held, size = held + some.num_rows, size + some.column(1).nbytes
        if held:
            yield pa.RecordBatch.from_pylist([_shard(ids, lengths, hashes)], schema=schema)

    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in _SHARD.split(", ")])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with _batches_of(docs.sparkSession, 1000):
        return materialise(rows.mapInArrow(of, _SHARD), "shards")


class Shard:
    """The postings of the wanted terms in one shard, their scores, and the trees over them."""

    def __init__(self, row: dict, wanted: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        size = len(self.ids)
        terms, starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<u4").astype(np.int64)
        at = np.searchsorted(terms, wanted)
        there = at < len(terms)
        there[there] = terms[at[there]] == wanted[there]
        there &= weight > 0
        #: the tree of each wanted term, -1 for none
        self.row = np.full(len(wanted), -1, np.int64)
        self.row[there] = np.arange(int(there.sum()))
        at = at[there]
        many = starts[at + 1] - starts[at]
        n = int(starts[-1]) if len(starts) else 0
        take = np.repeat(starts[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        doc, tf = _wide(row["docs"], n)[take], _wide(row["counts"], n)[take]
        length = _wide(row["lengths"], size)
        if 50 * int(length.max(initial=0)) * n_docs < 1 << 62:
            m = 50 + 50 * length * n_docs // max(1, n_terms)
        else:
            m = np.array([50 + 50 * x * n_docs // n_terms for x in length.tolist()], np.int64)
        self.score = np.repeat(weight[there], many) * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        self.doc = doc
        leaves = -(-size // LEAF)
        self.leaves = leaves
        #: term and leaf of each posting, ascending
        self.key = np.repeat(np.arange(len(at)), many) * leaves + doc // LEAF
        level = np.zeros((len(at), leaves), np.int64)
        if len(self.key):
            first = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]]))
            level.reshape(-1)[self.key[first]] = np.maximum.reduceat(self.score, first)
        self.levels = [level]
        while level.shape[1] > 1:
            full = -(-level.shape[1] // FAN) * FAN
            level = np.pad(level, ((0, 0), (0, full - level.shape[1]))).reshape(len(level), full // FAN, FAN).max(axis=2)
            self.levels.append(level)

    def exact(self, rows: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of these leaves that hold any of the terms, and their scores."""
        keys = (rows[:, None] * self.leaves + leaves[None, :]).reshape(-1)
        start, stop = np.searchsorted(self.key, keys), np.searchsorted(self.key, keys, "right")
        many = stop - start
        take = np.repeat(start - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        doc, back = np.unique(self.doc[take], return_inverse=True)
        total = np.zeros(len(doc), np.int64)
        np.add.at(total, back, self.score[take])
        return doc, total

    def search(self, terms: np.ndarray, best: list[tuple[int, int, int]], k: int) -> None:
        """Brings this shard's documents into ``best``, a heap of (score, doc_id is known, -doc_id) with the worst first."""
        rows = self.row[terms]
        rows = rows[rows >= 0]
        if not len(rows):
            return
        least = lambda: best[0][0] if len(best) == k else 1
        top = len(self.levels) - 1
        open_ = [(-int(self.levels[top][rows, 0].sum()), top, 0)]
        width = 1
        while open_ and -open_[0][0] >= least():
            found: list[int] = []
            while open_ and len(found) < width and -open_[0][0] >= least():
                _, level, node = heapq.heappop(open_)
                if level == 0:
                    found.append(node)
                    continue
                below = self.levels[level - 1][rows, node * FAN : (node + 1) * FAN].sum(axis=0)
                for i in np.flatnonzero(below >= least()).tolist():
                    heapq.heappush(open_, (-int(below[i]), level - 1, node * FAN + i))
            if not found:
                break
            width = min(2 * width, WIDEST)
            doc, total = self.exact(rows, np.array(found))
            near = np.flatnonzero(total >= least())
            for d, s in zip(self.ids[doc[near]].tolist(), total[near].tolist(), strict=True):
                entry = (s, 0 if d == _NULL else 1, 0 if d == _NULL else -d)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _counted(shards: DataFrame, wanted) -> np.ndarray:
    """In how many documents each wanted term stands. wanted: a broadcast array."""

    def of(batches):
        terms = wanted.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, starts = np.frombuffer(own, "<u8"), np.frombuffer(starts, "<u4").astype(np.int64)
                at = np.searchsorted(own, terms)
                hit = np.flatnonzero(at < len(own))
                hit = hit[own[at[hit]] == terms[hit]]
                total[hit] += starts[at[hit] + 1] - starts[at[hit]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["i", "df"])

    parts = shards.select("terms", "starts").mapInArrow(of, "i int, df long").groupBy("i").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(wanted.value), np.int64)
    out[parts.column("i").to_numpy()] = parts.column("df").to_numpy()
    return out


def search(shards: DataFrame, items: DataFrame, *, k: int = K, item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, equal scores by doc_id."""
    spark = shards.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    asked = asked.select("item_id", "text", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("key2"))
    texts = asked.select("key", "key2", "text").distinct()
    n_blocks = max(1, -(-(texts.agg(F.sum(F.octet_length("text") + 24)).first()[0] or 0) // block_bytes))
    n_docs, n_terms = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    made = "key long, key2 long, doc_id long, score long"
    parts = []
    for b in range(n_blocks):
        block = texts.where(F.pmod("key", F.lit(n_blocks)) == b).orderBy("key", "key2").toArrow()
        h, count = term_hashes(block.column("text"))
        wanted, place = np.unique(h, return_inverse=True)
        asks = [np.unique(x) for x in np.split(place, np.cumsum(count)[:-1])][: len(count)]
        with _batches_of(spark, 2):  # a row is a shard
            terms = spark.sparkContext.broadcast(wanted)
            df = _counted(shards, terms)
            weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
            shared = spark.sparkContext.broadcast((wanted, asks, weight, block.column("key").to_numpy(), block.column("key2").to_numpy()))

            def of(batches, shared=shared):
                wanted, asks, weight, key, key2 = shared.value
                best: list[list] = [[] for _ in asks]
                for batch in batches:
                    for row in batch.to_pylist():
                        shard = Shard(row, wanted, weight, n_docs, n_terms)
                        for terms, heap in zip(asks, best, strict=True):
                            shard.search(terms, heap, k)
                q = np.repeat(np.arange(len(best)), np.array([len(x) for x in best], np.int64))
                flat = [e for heap in best for e in heap]
                ids = pa.array([-e[2] if e[1] else None for e in flat], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key[q], pa.int64()), pa.array(key2[q], pa.int64()), ids, pa.array([e[0] for e in flat], pa.int64())], names=["key", "key2", "doc_id", "score"])

            parts.append(materialise(shards.mapInArrow(of, made), "found"))
            terms.unpersist()
            shared.unpersist()
    over = W.partitionBy("key", "key2").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
    return asked.select("item_id", "key", "key2").join(best, ["key", "key2"]).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over the whole of documents and benchmark: the 50 best documents of each item."""
    return search(build(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
