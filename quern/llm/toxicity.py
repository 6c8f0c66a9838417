"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows (``max_examples``, in the order of a hash of their ids, and no more of them than ``max_terms`` distinct terms
in all) gives the examples, equal texts being one. All their terms span the vectors: a term weighs (1 + log of its count) times its inverse
document frequency over all documents, times its evidence, the distance of its log odds of label 1 from those of all
examples, smoothed by EVIDENCE examples of no evidence. (Without evidence random words outweigh those that matter: plain TF-IDF
neighbours found 0.21 of the held-out toxic texts of sf0.1.) Examples are sorted into blocks of like ones; a block-max inverted index
holds each term's largest weight in each block, so a search bounds all blocks, takes the K-th cosine of the best ones
and reads, exactly, only those blocks that can hold a nearer example.

The K nearest vote with weights that fall with the distance. A logistic curve over the vote and the greatest cosine, fitted by leaving each
example out of its own vote, turns votes into probabilities. Texts without any term of the examples get the share of label 1. Each
score comes with its nearest examples.

Labels of rows whose crc32(doc_id as text) mod 5 is 0 are never learned from; labels, source, lang and doc_id are never inputs of a
score; a null id counts as empty text. Null or empty texts have no terms. Without labels, or with one label only, all scores are the smoothed share of label 1.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import letter_words, materialise, pieces, slices, small_batches, summed

#: Bounds of the sample that is learned from.
MAX_EXAMPLES = 2_000
MAX_TERMS = 3_000_000
EVIDENCE = 50.0
K = 15
BLOCK = 128
#: Searches that a worker remembers, by a digest of their terms and counts.
KNOWN = 50_000


def _term_counts(h: np.ndarray, first: np.ndarray):
    """(row, term, count) of all distinct terms of each text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    d, t = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return d[at], t[at], np.diff(np.append(at, len(d)))


def _vocabulary_counts(col, vocab: np.ndarray):
    """(row, index of the term, count) of the terms of a sorted vocabulary, and the number of texts."""
    h, first = letter_words(col)
    i = np.searchsorted(vocab, h)
    i[i == len(vocab)] = 0
    hit = np.flatnonzero(vocab[i] == h) if len(vocab) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[hit]
    pair, n = np.unique(doc * max(len(vocab), 1) + i[hit], return_counts=True)
    return pair // max(len(vocab), 1), pair % max(len(vocab), 1), n, len(first) - 1


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges, and which range each is from."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - (np.cumsum(n) - n - start)[of], of


class Model:
    """Examples, their block-max index and the calibration; rows, terms and counts are those of the examples' distinct terms."""

    def __init__(self, vocab, weight, ids, labels, rows, terms, counts, share):
        self.vocab, self.weight, self.share = vocab, weight, share
        n = len(ids)
        w = (1 + np.log(counts)) * weight[terms]
        rows, terms, w = rows[w > 0], terms[w > 0], w[w > 0]
        norm = np.sqrt(np.bincount(rows, w * w, n))
        w = w / norm[rows]
        # examples with the same most common term (so of one language), then with the same heaviest terms, are neighbours
        common = np.bincount(terms, minlength=len(vocab))
        start = np.searchsorted(rows, np.arange(n))
        has = start < np.searchsorted(rows, np.arange(n), "right")

        def lead(*by, skip=0):
            at = np.lexsort((terms, *by, rows))
            return np.where(has, terms[at][np.minimum(start + skip, max(len(at) - 1, 0))], -1) if len(at) else np.full(n, -1)

        order = np.lexsort((np.arange(n), lead(-w, skip=1), lead(-w), lead(-common[terms])))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.labels = ids[order], labels[order]
        # postings by term and block, and for each term and block its range of postings and its largest weight
        p = np.lexsort((place[rows], terms))
        self.row, self.w, term = place[rows][p].astype(np.intp), w[p], terms[p]
        key = term * (n // BLOCK + 1) + self.row // BLOCK
        at = np.flatnonzero(np.diff(key, prepend=-1))
        self.entry = np.append(at, len(key))
        self.block = self.row[at] // BLOCK
        self.most = np.maximum.reduceat(self.w, at) if len(at) else np.zeros(0)
        self.term = np.searchsorted(term[at], np.arange(len(vocab) + 1))
        self.fit = None
        if n > 20 and 0 < labels.mean() < 1:
            cut = np.searchsorted(rows, np.arange(n + 1)) if (np.diff(rows) >= 0).all() else None
            some = np.flatnonzero(np.diff(cut))
            near = [self.nearest(terms[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]], leave=place[i]) for i in some]
            votes, tops = np.array([self.vote(*x) for x in near]), np.array([x[1][0] if len(x[1]) else 0.0 for x in near])
            self.fit = _logistic(self.features(votes, tops), labels[some], np.ones(len(some)))
        self.known = OrderedDict()

    def _cosines(self, e: np.ndarray, q: np.ndarray):
        """Rows of the entries' blocks that share a term, and their cosines; q: the query's weight of each entry."""
        i, of = _spread(self.entry[e], self.entry[e + 1])
        got = np.bincount(self.row[i], self.w[i] * q[of], len(self.ids))
        at = np.flatnonzero(got)
        return at, got[at]

    def nearest(self, terms: np.ndarray, q: np.ndarray, leave: int = -1):
        """Indices and exact cosines of the K nearest examples with any common term; q: unit weights of the terms; leave: an example left out.

        Of examples equally near, those of the lower number come first.
        """
        e, of = _spread(self.term[terms], self.term[terms + 1])
        q = q[of]
        bound = np.bincount(self.block[e], self.most[e] * q, len(self.ids) // BLOCK + 1)
        first = np.argsort(-bound, kind="stable")[: 1 + K // BLOCK + (leave >= 0)]
        lead = np.isin(self.block[e], first)
        at, s = self._cosines(e[lead], q[lead])
        at, s = at[at != leave], s[at != leave]
        worst = np.partition(s, len(s) - K)[len(s) - K] if len(s) >= K else 0.0
        more = ~lead & (bound >= worst - 1e-12)[self.block[e]]
        if more.any():
            at2, s2 = self._cosines(e[more], q[more])
            at, s = np.append(at, at2[at2 != leave]), np.append(s, s2[at2 != leave])
        keep = np.lexsort((at, -s))[:K]
        return at[keep], s[keep]

    def vote(self, at: np.ndarray, sims: np.ndarray) -> float:
        """The share of label 1 among neighbours, by weight."""
        w = 1 / (1.05 - np.minimum(sims, 1))
        return float((w @ self.labels[at] + 2 * self.share) / (w.sum() + 2))

    @staticmethod
    def features(votes, tops):
        v = np.clip(votes, 1e-4, 1 - 1e-4)
        return np.column_stack([np.ones(len(v)), np.log(v / (1 - v)), tops])

    def score(self, col):
        """Score, ids and cosines of the nearest examples, for each text of a column."""
        d, t, n, size = _vocabulary_counts(col, self.vocab)
        q = (1 + np.log(n)) * self.weight[t]
        d, t, n, q = d[q > 0], t[q > 0], n[q > 0], q[q > 0]
        score = np.full(size, self.share)
        ids: list[list[int]] = [[]] * size
        sims: list[list[float]] = [[]] * size
        cut = np.flatnonzero(np.diff(d)) + 1
        for a, b in zip([0, *cut], [*cut, len(d)], strict=True) if len(d) else ():
            key = hashlib.blake2b(t[a:b].tobytes() + n[a:b].tobytes(), digest_size=16).digest()
            got = self.known.get(key)
            if got is None:
                at, sim = self.nearest(t[a:b], q[a:b] / np.linalg.norm(q[a:b]))
                v = self.vote(at, sim)
                if self.fit is not None:
                    v = 1 / (1 + np.exp(-float((self.features(np.array([v]), sim[:1]) @ self.fit)[0])))
                got = self.known[key] = (v, self.ids[at[:3]].tolist(), sim[:3].tolist())
                if len(self.known) > KNOWN:
                    self.known.popitem(last=False)
            score[d[a]], ids[d[a]], sims[d[a]] = got
        return score, ids, sims


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (weight * (p - y)) + penalty * w * (np.arange(len(w)) > 0)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Model:
    """Learn from the labelled rows whose crc32(id as text) mod 5 is not 0; see the module for what is bounded."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.avg("y").alias("y"))
    known = known.join(docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).toArrow().to_pydict()
    label_of = dict(zip(picked["doc_id"], picked["y"], strict=True))
    wanted = spark.sparkContext.broadcast(label_of)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def examples(batches):
        of = wanted.value
        for b in batches:
            ids = b.column(0).to_pylist()
            at = [i for i, x in enumerate(ids) if x in of]
            part = b.take(pa.array(at, pa.int64()))
            for s in slices(part):
                h, first = letter_words(s.column(1).fill_null(""))
                d, t, n = _term_counts(h, first)
                cut = np.searchsorted(d, np.arange(s.num_rows + 1))
                terms = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(t.view(np.int64)))
                counts = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(n.astype(np.int64)))
                y = pa.array([of[x] for x in s.column(0).to_pylist()], pa.float64())
                key = [hash_of(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([s.column(0), y, pa.array(key, pa.int64()), terms, counts], names=["doc_id", "y", "key", "terms", "counts"])

    def hash_of(words: np.ndarray) -> int:
        v = np.uint64(len(words))
        if len(words):
            v = np.bitwise_xor.reduce(words * (np.arange(len(words), dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)))
        return int(np.int64(v.astype(np.uint64).view(np.int64)))

    seen = rows.mapInArrow(examples, "doc_id long, y double, key long, terms array<long>, counts array<long>")
    seen = materialise(seen.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.avg("y").alias("y"), F.first(F.struct("terms", "counts")).alias("v")), "examples")
    # max_examples rows at most, so one task can order them
    fit_in = seen.withColumn("upto", F.sum(F.size("v.terms")).over(Window.orderBy(F.xxhash64("doc_id"), "key"))).where(F.col("upto") <= max_terms)
    got = fit_in.orderBy("doc_id", "key").select("doc_id", "y", "v.terms", "v.counts").toArrow()
    ids, y = got.column("doc_id").to_numpy(), got.column("y").to_numpy().astype(float)
    lists = got.column("terms").combine_chunks()
    r = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    counts = got.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    vocab, t = np.unique(flat, return_inverse=True)
    words = spark.sparkContext.broadcast(vocab)

    def frequencies(batches):
        df = np.zeros(len(words.value) + 1, np.int64)
        for b in batches:
            for s in slices(b):
                _, t, _, k = _vocabulary_counts(s.column(1).fill_null(""), words.value)
                df += np.bincount(t, minlength=len(df))
                df[-1] += k
        i, x = pieces(df.astype("<i8"))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(x, pa.binary())], names=["piece", "x"])

    *df, all_docs = summed(rows.mapInArrow(frequencies, "piece int, x binary"), len(vocab) + 1, "<i8")
    idf = np.log((1 + all_docs) / (1 + np.array(df))) + 1
    share = (y.sum() + 1) / (len(y) + 2)
    rate = (np.bincount(t, y[r], len(vocab)) + EVIDENCE * share) / (np.bincount(t, minlength=len(vocab)) + EVIDENCE)
    odds = lambda x: np.log(x / (1 - x))
    return Model(vocab, idf * np.abs(odds(rate) - odds(share)), ids, y, r, t, counts, share)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with toxic_score, toxic_predicted (0 or 1), and the ids and cosines of the nearest examples.

    Columns of docs with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    made = T.StructType.fromDDL("toxic_score double, toxic_predicted int, nearest array<long>, similarity array<double>")
    docs = docs.drop(*made.names)
    at, schema = docs.columns.index(text_col), T.StructType([*docs.schema.fields, *made.fields])
    names = schema.names

    def of(batches):
        for b in batches:
            for s in slices(pa.RecordBatch.from_arrays(b.columns, names=[f"c{i}" for i in range(b.num_columns)]), f"c{at}"):
                p, ids, sims = shared.value.score(s.column(at).fill_null(""))
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))], names=names)

    return docs.mapInArrow(of, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """op7 over the whole of documents: doc_id, held_out, score, predicted, nearest, similarity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return score(docs, model).select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"), "nearest", "similarity")
