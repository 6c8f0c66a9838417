"""Substring dedup with fixed-block anchors.

A window is ``window`` consecutive words. Every word covered by a window whose word sequence also starts
earlier (smaller doc_id, or same document and earlier start) goes. Any window covers one whole block of
``(window + 1) // 2`` words of each document that holds it, so the index has only non-overlapping blocks:

1. Documents are dealt into chunks of ascending doc_id. Each chunk sends, per hash bucket, its distinct rolling
   block hashes (44 bits, delta coded), marked where one is a block of the index and where it repeats.
2. A bucket finds the anchors - index blocks that some other place repeats - and answers each chunk with one
   bit for each hash the chunk sent.
3. Hits are extended: windows that hold an anchor are hashed in full (96 bits) and sent the same way; the first
   chunk that sent a hash owns it, the others learn by one bit that it starts earlier.
4. Chunks join the covering windows to maximal repeats and cut them.

A sequence is sent once for each chunk, however often it occurs, so no key is hotter than the number of
chunks, and only bits come back. Documents are shuffled once, by chunk.

Defined cases: null or empty texts have no words; null doc_ids count as smaller than any other; rows that share
a doc_id are one document's rows: of equal starts neither is earlier. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack_sorted, rolling, slices, span_hashes, text_buffers, unpack_sorted, word_spans

#: Bytes of text in a chunk: CHUNK_BYTES, or the root of NOTE_BYTES times the corpus where that is more. With as many
#: buckets as chunks, the notes between them keep their size and neither chunks nor buckets outgrow a worker (256 MB of text at 100 TB).
CHUNK_BYTES = 6 << 20
NOTE_BYTES = 655
_LEAST = -(1 << 63)
_NOTE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("mask", pa.binary()), ("n", pa.int32())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed_spans", pa.list_(pa.list_(pa.int32())))])


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, least: int = 48) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) with chunks that ascend by doc_id, and their number."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = base.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    k = max(least, -(-total // max(chunk_bytes, math.isqrt(NOTE_BYTES * total))))
    cuts = base.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k).alias("c")).first()["c"] or []
    cuts = sorted({float(c) for c in cuts})
    if not cuts:
        return base.select(F.lit(0).alias("chunk"), "doc_id", "text"), 1
    splits = [float("-inf"), *cuts, float("inf")]
    put = Bucketizer(splits=splits, inputCol="at", outputCol="part", handleInvalid="keep")
    dealt = put.transform(base.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308))))
    return dealt.select(F.col("part").cast("int").alias("chunk"), "doc_id", "text"), len(splits)


class _Chunk:
    """The words of a chunk in the order (doc_id, row), hashed."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").to_numpy(zero_copy_only=False) if not table.column("doc_id").null_count else np.array([_LEAST if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        order = np.argsort(ids.astype(np.int64), kind="stable")
        self.table, self.ids, self.window = table.take(pa.array(order)), ids.astype(np.int64)[order], window
        self.null = table.column("doc_id").is_null().to_numpy(zero_copy_only=False)[order]
        self.block = (window + 1) // 2
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in slices(self.table):
            data, off = text_buffers(part.column("text"))
            starts, ends, first = word_spans(data, off)
            hashes.append(span_hashes(data, starts, ends))
            counts.append(np.diff(first))
        self.words, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.pos = np.arange(len(self.words)) - np.repeat(self.first[:-1], self.counts)

    def starts(self, width: int) -> np.ndarray:
        """Marks the words at which ``width`` words of one document long enough for a window begin."""
        left = np.repeat(self.counts, self.counts) - self.pos
        return (left >= width) & (np.repeat(self.counts, self.counts) >= self.window)

    def blocks(self):
        """Word index of each rolling block, its 44-bit key, and whether it is a block of the index."""
        at = np.flatnonzero(self.starts(self.block))
        key = rolling(self.words, self.block, 0x5851F42D4C957F2D)[at] >> np.uint64(20) if len(at) else np.zeros(0, np.uint64)
        return at, key, self.pos[at] % self.block == 0

    def windows(self, hot: np.ndarray):
        """Word index and 96-bit hash of each window that holds an anchor; hot: marks words where an anchor begins."""
        ok, b = self.starts(self.window), self.window - self.block + 1
        seen = np.concatenate([[0], np.cumsum(hot)])
        n = len(self.words)
        at = np.flatnonzero(ok & (seen[np.minimum(np.arange(n) + b, n)] > seen[:-1])) if n else np.zeros(0, np.int64)
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return at, rolling(self.words, self.window, 0x2545F4914F6CDD1D)[at], (rolling(self.words, self.window, 0x14057B7EF767814F)[at] >> np.uint64(32)).astype(np.uint32)


def _bucket(key: np.ndarray, bits: int, n: int) -> np.ndarray:
    return ((key >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _runs(of: np.ndarray):
    cut = np.flatnonzero(np.diff(of)) + 1
    return zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(of)]]), strict=True) if len(of) else ()


def _distinct_blocks(c: _Chunk):
    at, key, index = c.blocks()
    uniq, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    marked = np.zeros(len(uniq), bool)
    marked[inverse[index]] = True
    return at, uniq, inverse, marked, count > 1


def _distinct_windows(c: _Chunk, hot: np.ndarray):
    """Also the inverse: which distinct window each window is."""
    at, h1, h2 = c.windows(hot)
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return at, a[new], b[new], inverse


def _masks(replies: pa.Table, n: int) -> np.ndarray:
    """The chunk's bits over all buckets, in the order of its sorted hashes."""
    out = [np.zeros(0, bool)]
    for _, mask, k in sorted(zip(*(replies.column(x).to_pylist() for x in ("bucket", "mask", "n")), strict=True)):
        out.append(np.unpackbits(np.frombuffer(mask, np.uint8), count=k).astype(bool))
    got = np.concatenate(out)
    if len(got) != n:
        raise RuntimeError(f"{len(got)} answers for {n} hashes")
    return got


def _answer(bucket: int, sizes: list[tuple[int, int]], flags: np.ndarray) -> pa.Table:
    rows, at = [], 0
    for c, n in sizes:
        rows.append((c, bucket, np.packbits(flags[at : at + n]).tobytes(), n))
        at += n
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _REPLY.types, strict=True)], schema=_REPLY)


def find_repeats(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, digest: bool = False) -> DataFrame:
    """One row per document: n_words, n_removed and the kept text with the removed word spans, or its digest."""
    if window < 2:
        raise ValueError("window must be 2 words at least")
    dealt, k = chunked(docs, id_col, text_col, chunk_bytes)
    n_buckets = max(32, k)

    def probes(table: pa.Table) -> pa.Table:
        c, chunk = _Chunk(table, window), table.column("chunk")[0].as_py()
        _, key, _, marked, many = _distinct_blocks(c)
        value = key << np.uint64(2) | marked.astype(np.uint64) << np.uint64(1) | many.astype(np.uint64)
        of = _bucket(key, 44, n_buckets)
        rows = [(int(of[a]), chunk, pack_sorted(value[a:b])) for a, b in _runs(of)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_NOTE.types)], schema=_NOTE)

    def anchors(table: pa.Table) -> pa.Table:
        parts = [unpack_sorted(b.as_py()) for b in table.column("blob")]
        value = np.concatenate(parts)
        key = value >> np.uint64(2)
        uniq, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, weights=1 + (value & np.uint64(1)).astype(float))
        index = np.zeros(len(uniq), bool)
        index[inverse[(value & np.uint64(2)) > 0]] = True
        hot = (index & (total >= 2))[inverse]
        return _answer(table.column("bucket")[0].as_py(), list(zip(table.column("chunk").to_pylist(), map(len, parts), strict=True)), hot)

    def hot_words(c: _Chunk, replies: pa.Table) -> np.ndarray:
        at, uniq, inverse, _, _ = _distinct_blocks(c)
        hot = np.zeros(len(c.words), bool)
        hot[at] = _masks(replies, len(uniq))[inverse]
        return hot

    def extend(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _NOTE.empty_table()
        c, chunk = _Chunk(table, window), table.column("chunk")[0].as_py()
        _, h1, h2, _ = _distinct_windows(c, hot_words(c, replies))
        of = _bucket(h1, 64, n_buckets)
        rows = [(int(of[a]), chunk, h1[a:b].tobytes() + h2[a:b].tobytes()) for a, b in _runs(of)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_NOTE.types)], schema=_NOTE)

    def owners(table: pa.Table) -> pa.Table:
        blobs, chunks = [b.as_py() for b in table.column("blob")], table.column("chunk").to_pylist()
        sizes = [len(b) // 12 for b in blobs]
        h1 = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blobs, sizes, strict=True)])
        h2 = np.concatenate([np.frombuffer(b, np.uint32, n, 8 * n) for b, n in zip(blobs, sizes, strict=True)])
        chunk = np.repeat(np.array(chunks), sizes)
        order = np.lexsort((chunk, h2, h1))
        a, b = h1[order], h2[order]
        later = np.zeros(len(a), bool)
        later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        flags = np.zeros(len(a), bool)
        flags[order] = later
        return _answer(table.column("bucket")[0].as_py(), list(zip(chunks, sizes, strict=True)), flags)

    def cut(table: pa.Table, replies: pa.Table, earlier: pa.Table) -> pa.Table:
        c = _Chunk(table, window)
        at, h1, _, inverse = _distinct_windows(c, hot_words(c, replies))
        drop = _masks(earlier, len(h1))[inverse] if len(at) else np.zeros(0, bool)
        if len(at):
            place = np.lexsort((c.pos[at], c.ids[c.doc[at]], inverse))
            lead = np.ones(len(at), bool)
            lead[1:] = np.diff(inverse[place]) > 0
            leader = place[lead]  # the earliest start of each distinct window of the chunk
            same = (c.ids[c.doc[at]] == c.ids[c.doc[at[leader[inverse]]]]) & (c.pos[at] == c.pos[at[leader[inverse]]])
            drop |= ~same
        change = np.zeros(len(c.words) + 1, np.int64)
        np.add.at(change, at[drop], 1)
        np.add.at(change, at[drop] + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        return (_digests if digest else _texts)(c, gone)

    by = dealt.groupBy("chunk")
    note, reply = "bucket int, chunk int, blob binary", "chunk int, bucket int, mask binary, n int"
    hits = by.applyInArrow(probes, note).groupBy("bucket").applyInArrow(anchors, reply)
    later = by.cogroup(hits.groupBy("chunk")).applyInArrow(extend, note).groupBy("bucket").applyInArrow(owners, reply)
    both = hits.select("chunk", F.lit(0).alias("kind"), "bucket", "mask", "n").unionByName(later.select("chunk", F.lit(1).alias("kind"), "bucket", "mask", "n"))

    def last(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return (_RESULT if digest else _SPANS).empty_table()
        kind = replies.column("kind").to_numpy()
        return cut(table, replies.filter(pa.array(kind == 0)), replies.filter(pa.array(kind == 1)))

    out = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept_text string, removed_spans array<array<int>>")
    return by.cogroup(both.groupBy("chunk")).applyInArrow(last, out)


def _kept(c: _Chunk, gone: np.ndarray):
    """The kept words of each document, in order, joined by one space, as bytes."""
    row = 0
    for part in slices(c.table):
        data, off = text_buffers(part.column("text"))
        starts, ends, first = word_spans(data, off)
        raw, base = data.tobytes(), c.first[row]
        for i in range(part.num_rows):
            a, b = first[i], first[i + 1]
            g = gone[base + a : base + b]
            keep = np.flatnonzero(~g) + a
            yield row + i, len(g), int(g.sum()), b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]), g
        row += part.num_rows


def _ids(c: _Chunk) -> pa.Array:
    return pa.array(c.ids, pa.int64(), mask=c.null)


def _digests(c: _Chunk, gone: np.ndarray) -> pa.Table:
    rows = [(n, k, hashlib.sha256(t).hexdigest()) for _, n, k, t, _ in _kept(c, gone)]
    return pa.Table.from_arrays([_ids(c), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_RESULT.types[1:]))], schema=_RESULT)


def _texts(c: _Chunk, gone: np.ndarray) -> pa.Table:
    rows = []
    for _, n, k, t, g in _kept(c, gone):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
        rows.append((n, k, t.decode("utf-8", "replace"), edge.reshape(-1, 2).astype(np.int32).tolist()))
    return pa.Table.from_arrays([_ids(c), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_SPANS.types[1:]))], schema=_SPANS)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """op1 over the whole of documents: doc_id, n_words, n_removed, kept_sha256."""
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
