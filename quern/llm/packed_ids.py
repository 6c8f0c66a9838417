"""Token ids in files of fixed-width bit packing.

Each id takes the fewest bits that hold every id of the vocabulary. Sixty-four ids make ``bits`` little-endian words of 64
bits, so numpy packs and unpacks the ids of one place in all groups at once. A file is a row of blocks and a footer:

    file    MAGIC, bits (uint32), blocks, footer
    block   n_docs, n_ids (uint64); doc_ids (int64); lengths (uint32); one byte for each document, 0 where its doc_id is null; filler to 8 bytes; groups
    footer  for each block, and for the end of them: byte offset, documents before, ids before (uint64 each); number of blocks (uint64), MAGIC

The footer's offsets give random access: a range of ids or one document costs the footer and the groups that hold it.

Documents are sorted by doc_id across files: one range exchange of texts, then each task encodes its rows and writes its file.
A file's name is its attempt's own, and only files named by tasks that ended are in the manifest, so a lost executor or
a second attempt leaves no trace. Files lie in the folder that spark.checkpoint.dir names, or in any that pyarrow's file systems reach.

Defined cases: a null text is an empty one and has the end id alone. Null doc_ids come last; rows of one doc_id follow by text.
An empty table has no files. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Codec, codec
from .common import materialise, shared_dir, slices, small_batches

MAGIC = b"IDS1"
GROUP = 64
#: A block ends with the document that fills it.
BLOCK_IDS = 1 << 18
_MANIFEST = "shard int, block int, file string, n_docs long, n_ids long"


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Groups of 64 ids as rows of ``bits`` 64-bit words; the last group is filled up with zeros."""
    groups = np.zeros((-(-len(ids) // GROUP), GROUP), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    if len(ids) and int(groups.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    out = np.zeros((len(groups), bits), "<u8")
    for i in range(GROUP):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= groups[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= groups[:, i] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, bits: int) -> np.ndarray:
    """All ids of whole groups as uint32, fillers included."""
    words = words.reshape(-1, bits)
    out, mask = np.empty((len(words), GROUP), np.uint32), np.uint64((1 << bits) - 1)
    for i in range(GROUP):
        word, shift = divmod(i * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = x & mask
    return out.reshape(-1)


def opened(uri: str):
    """(file system, path) of a URI as pyarrow has them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class Writer:
    """Writes documents to one file."""

    def __init__(self, uri: str, bits: int, block_ids: int = BLOCK_IDS):
        store, path = opened(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.bits, self.block_ids = store.open_output_stream(path), bits, block_ids
        self.out.write(MAGIC + np.uint32(bits).tobytes())
        self.at, self.docs, self.ids = 8, 0, 0
        self.table: list[tuple[int, int, int]] = []
        self.blocks: list[tuple[int, int]] = []
        self._clear()

    def _clear(self) -> None:
        self.names: list[int | None] = []
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.names.append(doc_id)
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.block_ids:
            self._flush()

    def _flush(self) -> None:
        if not self.names:
            return
        head = np.array([len(self.names), self.n], "<u8").tobytes() + np.array([x or 0 for x in self.names], "<i8").tobytes() + np.array([len(x) for x in self.held], "<u4").tobytes() + bytes(x is not None for x in self.names)
        data = head + b"\0" * (-len(head) % 8) + pack(np.concatenate(self.held), self.bits).tobytes()
        self.out.write(data)
        self.table.append((self.at, self.docs, self.ids))
        self.blocks.append((len(self.names), self.n))
        self.at, self.docs, self.ids = self.at + len(data), self.docs + len(self.names), self.ids + self.n
        self._clear()

    def close(self) -> list[tuple[int, int]]:
        """(documents, ids) of each block."""
        self._flush()
        table = np.array([*self.table, (self.at, self.docs, self.ids)], "<u8")
        self.out.write(table.tobytes() + np.uint64(len(self.blocks)).tobytes() + MAGIC)
        self.out.close()
        return self.blocks


class Reader:
    """Random access to one file: blocks, documents by their place, ranges of ids."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        head, tail = self._read(0, 8), self._read(size - 12, 12)
        if head[:4] != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no whole file of packed ids")
        self.bits, n = int(np.frombuffer(head, "<u4", 1, 4)[0]), int(np.frombuffer(tail, "<u8", 1)[0])
        self.table = np.frombuffer(self._read(size - 12 - 24 * (n + 1), 24 * (n + 1)), "<u8").reshape(-1, 3).astype(np.int64)
        self.n_docs, self.n_ids = (int(x) for x in self.table[-1, 1:])

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()

    def _groups_at(self, block: int) -> int:
        docs = int(self.table[block + 1, 1] - self.table[block, 1])
        return int(self.table[block, 0]) + -(-(16 + 13 * docs) // 8) * 8

    def index(self, block: int) -> tuple[list[int | None], np.ndarray]:
        """The doc_ids and lengths of a block's documents."""
        docs = int(self.table[block + 1, 1] - self.table[block, 1])
        raw = self._read(int(self.table[block, 0]) + 16, 13 * docs)
        names, there = np.frombuffer(raw, "<i8", docs).tolist(), raw[12 * docs :]
        return [x if t else None for x, t in zip(names, there, strict=True)], np.frombuffer(raw, "<u4", docs, 8 * docs).astype(np.int64)

    def _of_block(self, block: int, start: int, stop: int) -> np.ndarray:
        first, last, wide = start // GROUP, -(-stop // GROUP), 8 * self.bits
        words = np.frombuffer(self._read(self._groups_at(block) + first * wide, (last - first) * wide), "<u8")
        return unpack(words, self.bits)[start - first * GROUP : stop - first * GROUP]

    def block(self, block: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """doc_ids, lengths and all ids of a block."""
        return *self.index(block), self._of_block(block, 0, int(self.table[block + 1, 2] - self.table[block, 2]))

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the ``start``-th of the file on, fewer at its end."""
        stop, out = min(start + n, self.n_ids), []
        b = int(np.searchsorted(self.table[:, 2], start, "right")) - 1
        while start < stop:
            first, end = int(self.table[b, 2]), int(self.table[b + 1, 2])
            out.append(self._of_block(b, start - first, min(stop, end) - first))
            start, b = end, b + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of the file's ``i``-th document."""
        if not 0 <= i < self.n_docs:
            raise IndexError(i)
        b = int(np.searchsorted(self.table[:, 1], i, "right")) - 1
        names, lengths = self.index(b)
        k = i - int(self.table[b, 1])
        start = int(lengths[:k].sum())
        return names[k], self._of_block(b, start, start + int(lengths[k]))


def whole(c: Codec, text: str | None) -> np.ndarray:
    """Ids of a whole text, chunks not kept: texts of one pass are too different for that to save time."""
    if not text:
        return np.zeros(0, np.uint32)
    if c.cut is None or not c.cut.search(text):
        return c.direct(text)
    return np.concatenate([np.array([c.special[p]], np.uint32) if p in c.special else c.direct(p) for p in c.cut.split(text)])


def write_ids(docs: DataFrame, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end: int = 2, json_path: str | None = None, ranks_path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode all texts, each ended by ``end``, into files of ascending doc_id; the manifest (shard, block, file, n_docs, n_ids).

    Shards, and the blocks of each, follow one another. folder: where files go; a new one beside the tables in the shared folder by default.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    small_batches(spark)

    def of(batches):
        c, writer = codec(json_path, ranks_path), None
        last, bits = np.array([end], np.uint32), max(len(c.bytes) - 1, end).bit_length()
        shard, file = TaskContext.get().partitionId(), ""
        for batch in batches:
            for part in slices(batch):
                if writer is None and part.num_rows:
                    file = f"{folder}/{shard:07d}-{uuid.uuid4().hex}.ids"
                    writer = Writer(file, bits, block_ids)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    writer.add(doc_id, np.concatenate([whole(c, text), last]))
        blocks = writer.close() if writer else []
        n = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([file] * n, pa.string()), pa.array([b[0] for b in blocks], pa.int64()), pa.array([b[1] for b in blocks], pa.int64())], names=["shard", "block", "file", "n_docs", "n_ids"]
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = F.asc_nulls_last("doc_id")
    return materialise(rows.repartitionByRange(order).sortWithinPartitions(order, "text").mapInArrow(of, _MANIFEST), "manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids of all blocks before: sums within shards, then over shards' totals."""
    before = W.rowsBetween(W.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("all"))
    shards = shards.select("shard", F.coalesce(F.sum("all").over(before.orderBy("shard")), F.lit(0)).alias("ahead"))
    own = F.coalesce(F.sum("n_ids").over(before.partitionBy("shard").orderBy("block")), F.lit(0))
    return manifest.withColumn("own", own).join(shards, "shard").withColumn("start", F.col("own") + F.col("ahead")).drop("own", "ahead")


def _blocks(manifest: DataFrame, read, schema: str) -> DataFrame:
    """read(Reader, block number, start) for each block, blocks dealt evenly to the tasks."""
    spark = manifest.sparkSession
    shards = manifest.agg(F.count_distinct("shard")).first()[0]

    def of(batches):
        reader, name = None, None
        for batch in batches:
            for file, block, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if reader:
                        reader.close()
                    reader, name = Reader(file), file
                yield read(reader, block, start)
        if reader:
            reader.close()

    dealt = placed(manifest).select("file", "block", "start").repartition(max(shards, 3 * spark.sparkContext.defaultParallelism))
    return dealt.mapInArrow(of, schema)


def documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all documents, read from the files; start counts the ids of all documents before."""

    def read(reader: Reader, block: int, start: int) -> pa.RecordBatch:
        names, lengths, ids = reader.block(block)
        at = np.concatenate([[0], np.cumsum(lengths)])
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + at[:-1], pa.int64()), lists], names=["doc_id", "start", "ids"])

    return _blocks(manifest, read, "doc_id long, start long, ids array<int>")


def digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read from the files."""

    def read(reader: Reader, block: int, start: int) -> pa.RecordBatch:
        names, lengths, ids = reader.block(block)
        at = np.concatenate([[0], np.cumsum(lengths)])
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + at[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _blocks(manifest, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ranges(manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """(start, ids) for each (start, n) of ``ranges``: n ids from that place of the whole stream on, by random access.

    A range is split where blocks end and put together again. Places below 0 or beyond the stream hold nothing; null ranges are left out.
    """
    spark = manifest.sparkSession
    width = manifest.agg(F.max("n_ids")).first()[0] or 1
    blocks = placed(manifest).select("file", "block", "start", "n_ids")
    # a block is known by each of the width-sized slots that it touches, two at most
    slot = lambda c: F.floor(c / width).cast("long")
    known = blocks.select("file", F.col("start").alias("b"), (F.col("start") + F.col("n_ids")).alias("e"), F.explode(F.sequence(slot(F.col("start")), slot(F.col("start") + F.col("n_ids") - 1))).alias("slot"))
    want = ranges.select(F.greatest(F.col("start"), F.lit(0)).cast("long").alias("s"), (F.col("start") + F.col("n")).cast("long").alias("t"), F.col("start").cast("long").alias("start")).where("s < t").distinct()
    want = want.select("*", F.explode(F.sequence(slot(F.col("s")), slot(F.col("t") - 1))).alias("slot"))
    met = want.join(known, "slot").where("s < e and b < t").select("file", "start", F.greatest("s", "b").alias("from"), F.least("t", "e").alias("to"), F.col("t").alias("stop")).distinct()
    firsts = blocks.groupBy("file").agg(F.min("start").alias("base"))
    met = met.join(firsts, "file").select("file", "start", "stop", "from", (F.col("from") - F.col("base")).alias("at"), (F.col("to") - F.col("from")).alias("n"))

    def of(batches):
        reader, name = None, None
        for batch in batches:
            out = []
            for file, at, n in zip(*(batch.column(k).to_pylist() for k in ("file", "at", "n")), strict=True):
                if file != name:
                    if reader:
                        reader.close()
                    reader, name = Reader(file), file
                out.append(reader.ids(at, n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("stop"), batch.column("from"), pa.array(out, pa.list_(pa.int32()))], names=["start", "stop", "from", "ids"])
        if reader:
            reader.close()

    small_batches(spark)
    parts = met.repartition("file").sortWithinPartitions("file", "at").mapInArrow(of, "start long, stop long, from long, ids array<int>")
    joined = parts.groupBy("start", "stop").agg(F.array_sort(F.collect_list(F.struct("from", "ids"))).alias("x"))
    return joined.select("start", F.flatten(F.transform("x", lambda p: p["ids"])).alias("ids"))


def op13_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over the whole of documents, written as files and read back: doc_id, start, n_tokens, ids_crc32."""
    return digests(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet")))
