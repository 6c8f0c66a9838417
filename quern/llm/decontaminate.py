"""Benchmark decontamination by spaced-seed hashing.

Fixed masks hash only the marked positions, so a word replaced at another leaves the hash as it is. Seeds of the test items
meet seeds of every place of every document; around each hit the words are compared along the hit's diagonal, and the
best-scoring stretch (a match counts 1, a replaced word -2, the earliest of equals) must hold enough matches: four fifths of the item's words, MATCHES at most.

No overlap that would be accepted lacks a seed. A run of four matches holds the first mask. Without one, runs of three or
fewer are joined at a cost of two for each replaced word; two such neighbours gain nothing over the better one unless
both have two matches or more and one word between them, and this holds the second mask.

The test set is taken in blocks of bounded size; each block's index goes to all executors and the corpus is
scanned once for each block, so the corpus is never shuffled and a test set of any size works. With many blocks the
rows found for each are written before the next index is made.

Words are runs of letters and digits of the lower-cased text (bytes above 127 count as letters). Items of fewer than ``EXACT``
words match as a whole and exactly; items of fewer than ``least`` words are not looked for. Null texts have no words, null ids are
kept, repeated items and documents are each reported, no items or documents give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import letter_words, materialise, rolling, slices, small_batches

MASKS = ("1111", "11011")
#: Matches that the best stretch of a long item must hold.
MATCHES = 13
#: Items of fewer words must match exactly.
EXACT = 8
LEAST_WORDS = 5
BLOCK_BYTES = 8 << 20
#: Pairs of places, and cells of compared words, that a task holds at once.
PAIRS = 1 << 20
_MIX = 0x9E3779B97F4A7C15
_FILTER_BITS = 22


def _seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), salt, np.uint64)
    for i, m in enumerate(mask):
        if n > 0 and m == "1":
            out *= np.uint64(_MIX)
            out += h[i : i + n]
    return out ^ (out >> np.uint64(29))


class Index:
    """Seeds of a block of items, sorted, with a bit table before them."""

    def __init__(self, texts: list[str | None], least: int):
        self.h, self.first = letter_words(pa.array(texts, pa.string()))
        count = np.diff(self.first)
        seeds, place = [], []
        item = np.repeat(np.arange(len(count)), count)
        pos = np.arange(len(self.h)) - np.repeat(self.first[:-1], count)
        for k, mask in enumerate(MASKS):
            s = _seeds(self.h, mask, k + 1)
            ok = np.flatnonzero((count[item[: len(s)]] - pos[: len(s)] >= len(mask)) & (count[item[: len(s)]] >= EXACT))
            seeds.append(s[ok])
            place.append(ok)
        self.short = sorted({int(n) for n in count if least <= n < EXACT})
        for n in self.short:
            of = self.first[:-1][count == n]
            seeds.append(rolling(self.h, n, _MIX)[of])
            place.append(of)
        seed, at = np.concatenate(seeds), np.concatenate(place)
        order = np.argsort(seed, kind="stable")
        self.seed, self.at, self.item, self.pos = seed[order], at[order], item, pos
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.seed >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, seeds: np.ndarray, ok: np.ndarray):
        """Pairs (word of the corpus, word of the items) whose seeds agree, in parts of bounded size."""
        i = np.flatnonzero(ok & self.bits[seeds >> np.uint64(64 - _FILTER_BITS)])
        lo, hi = np.searchsorted(self.seed, seeds[i], "left"), np.searchsorted(self.seed, seeds[i], "right")
        i, lo, k = i[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        upto = np.cumsum(k)
        a = 0
        while a < len(i):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            n = k[a:b]
            yield np.repeat(i[a:b], n), self.at[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo[a:b], n)]
            a = b


def needed(n: int, matches: int = MATCHES) -> int:
    """Matches that an item of n words must have."""
    return n if n < EXACT else min(matches, -(-4 * n // 5))


def _best(match: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row start, end and matches of the stretch with the highest sum of 1 for a match and -2 otherwise."""
    rows, wide = np.arange(len(match)), np.zeros((len(match), match.shape[1] + 1), np.int32)
    np.cumsum(np.where(match, 1, -2), axis=1, out=wide[:, 1:])
    low = np.minimum.accumulate(wide, axis=1)
    end = np.argmax(wide - low, axis=1)
    start = np.argmax(wide == low[rows, end][:, None], axis=1)
    length = end - start
    return start, end, (wide[rows, end] - wide[rows, start] + 2 * length) // 3


def _scan(col, index: Index, matches: int):
    """(row, item, start, end, matches) of each item in each text: word offsets of the best stretch, at the least diagonal of those with as many matches."""
    h, first = letter_words(col)
    count = np.diff(first)
    left = np.repeat(first[1:], count) - np.arange(len(h))
    doc_of = np.repeat(np.arange(len(count)), count)
    probes = [(_seeds(h, mask, k + 1), len(mask)) for k, mask in enumerate(MASKS)] + [(rolling(h, n, _MIX), n) for n in index.short]
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for s, span in probes:
        for at, to in index.hits(s, left[: len(s)] >= span):
            lines = np.unique(np.stack([index.item[to], doc_of[at], at - index.pos[to]], 1), axis=0)
            for part in np.split(lines, np.flatnonzero(np.diff(lines[:, 0])) + 1):
                q = int(part[0, 0])
                own = index.h[index.first[q] : index.first[q + 1]]
                need, step = needed(len(own), matches), max(1, PAIRS // len(own))
                for i in range(0, len(part), step):
                    d, b = part[i : i + step, 1], part[i : i + step, 2]
                    place = b[:, None] + np.arange(len(own))
                    inside = (place >= first[d][:, None]) & (place < first[d + 1][:, None])
                    # beyond the text's ends nothing can match, and no best stretch reaches there
                    match = inside & (h[np.where(inside, place, 0)] == own)
                    start, end, m = _best(match)
                    for j in np.flatnonzero(m >= need).tolist():
                        x, y = int(d[j]), int(b[j])
                        if (-int(m[j]), y) < found.get((x, q), (0, 0, 0, 0))[:2]:
                            found[x, q] = (-int(m[j]), y, y + int(start[j]) - int(first[x]), y + int(end[j]) - int(first[x]))
    for (d, q), (m, _, start, end) in found.items():
        yield d, q, start, end, -m


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", matches: int = MATCHES, least: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, n_matched, n_item_words) for each item found in each document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    tests = tests.select("item_id", "text", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("key2"))
    texts = tests.select("key", "key2", "text").distinct()
    n_blocks = max(1, -(-(texts.agg(F.sum(F.octet_length("text") + 24)).first()[0] or 0) // block_bytes))
    made = "doc_id long, key long, key2 long, start_word int, end_word int, n_matched int, n_item_words int"
    parts = []
    for k in range(n_blocks):
        block = texts.where(F.pmod("key", F.lit(n_blocks)) == k).orderBy("key", "key2").toArrow()
        shared = spark.sparkContext.broadcast((Index(block.column("text").to_pylist(), least), block.column("key").to_numpy(), block.column("key2").to_numpy()))

        def of(batches, shared=shared):
            index, key, key2 = shared.value
            for b in batches:
                for s in slices(b):
                    got = list(_scan(s.column(1).fill_null(""), index, matches))
                    if got:
                        d, q, start, end, m = (np.array(x) for x in zip(*got, strict=True))
                        cols = [s.column(0).take(pa.array(d)), pa.array(key[q]), pa.array(key2[q]), *(pa.array(x.astype(np.int32)) for x in (start, end, m, np.diff(index.first)[q]))]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "key2", "start_word", "end_word", "n_matched", "n_item_words"])

        part = rows.mapInArrow(of, made)
        if n_blocks > 1:
            part = materialise(part, "leaks")
            shared.unpersist()
        parts.append(part)
    out = reduce(DataFrame.unionByName, parts)
    return out.join(tests.select("key", "key2", "item_id"), ["key", "key2"]).select("doc_id", "item_id", "start_word", "end_word", "n_matched", "n_item_words")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """op2 over the whole of documents and benchmark: one row for each leak."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
