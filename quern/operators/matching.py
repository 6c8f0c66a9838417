"""Scores of chunks by the words they share with questions, without a row for each question, chunk and word.

A pass over the chunks keeps of each the places of the questions' words alone, as arrays; counts over the corpus are summed from these,
and a second pass scores tiles of chunks against a block of questions as sums over arrays. Of each task only rows go on that may be among the
best of their question, so what is shuffled grows with questions and tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import keywords, phrase
from ..sources.tables import written
from .vectors import batch_vectors

#: Scores of one tile: chunks times questions.
TILE = 1 << 20
#: Rows of one tile: about 8 MB of text.
ROWS = 2048
#: More than what rounding to nine places moves.
SLACK = 2e-9


@dataclass(frozen=True)
class Asked:
    """A block of questions as arrays: words of scopes (ids), and for each the questions that have it."""

    scopes: pa.Array
    terms: pa.Array
    keys: np.ndarray  # scope * number of terms + term of each id, ascending
    start: np.ndarray  # where an id's questions begin in ``of``
    of: np.ndarray
    need: np.ndarray  # how many words a question has
    phrases: list[str]
    quoted: list[list[str]]

    @staticmethod
    def read(block: pa.Table) -> Asked:
        """block: terms, phrase, quoted, scope."""
        lists = block.column("terms").combine_chunks()
        flat = lists.flatten()
        scope = block.column("scope").combine_chunks()
        scopes, terms = pc.unique(scope), pc.unique(flat)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        question = np.repeat(np.arange(block.num_rows), size)
        at = _places(scope, scopes)[question] * len(terms) + _places(flat, terms)
        order = np.argsort(at, kind="stable")
        keys, start = np.unique(at[order], return_index=True)
        return Asked(scopes, terms, keys, np.append(start, len(at)), question[order], size, block.column("phrase").to_pylist(), block.column("quoted").to_pylist())

    def ids(self, scope: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of the words (lists) that a question of the row's scope has, repeats included."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
        term = _places(words.flatten(), self.terms)
        row, term = row[term >= 0], term[term >= 0]
        at = scope[row] * len(self.terms) + term
        place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        fit = (self.keys[place] == at) & (scope[row] >= 0)
        return row[fit], place[fit]

    def met(self, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in ids one entry for each question that has it: (place, row * questions + question)."""
        n = self.start[ids + 1] - self.start[ids]
        place = np.repeat(np.arange(len(ids)), n)
        question = self.of[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[ids], n)]
        return place, row[place] * len(self.need) + question


def _places(values: pa.Array, among: pa.Array) -> np.ndarray:
    return pc.index_in(values, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """One list for each of n rows; row is ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def tiles(batches: Iterator[pa.RecordBatch], questions: int) -> Iterator[pa.RecordBatch]:
    """Slices with no more scores than TILE and no more rows than ROWS."""
    size = min(ROWS, max(1, TILE // max(questions, 1)))
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


#: What chunks hold of texts, and what an index knows of them instead.
TEXTS, INDEXED = ["title", "section_title", "text"], ["words", "title_terms", "section_terms", "said"]
POSTED = "g int, dl int, ids array<int>, tfs array<int>, more array<double>, whole array<int>, said array<int>"
#: Questions whose vectors are near a text's, and how near.
NEAR = "near array<int>, cosine array<double>"


def posted(chunks: DataFrame, asked: Asked, title: float, section: float, near: np.ndarray | None = None, most: int = 0) -> DataFrame:
    """chunks (chunk_id, scope, text, title and section_title; or words, title_terms, section_terms, said) with what they share with the questions, as POSTED names it.

    Texts are split here, a batch at once, so that no array of all words is made in between.
    ids, tfs, more: words of questions, how often they are there, what title and section add (nothing in a tile where they add nothing).
    whole: the questions all of whose words and quotes are there; said: those of them whose phrase is.
    near: vectors of questions as columns; the same pass then takes the hash vectors of the texts, and adds as NEAR names it the columns
    of which a text may be among the best ``most``.
    """
    schema = T.StructType([chunks.schema["chunk_id"], *T.StructType.fromDDL(POSTED if near is None else f"{POSTED}, {NEAR}").fields])
    split = "words" not in chunks.columns
    questions = max(len(asked.need), 0 if near is None else near.shape[1])

    def of(batches):
        known, best = {}, None if near is None else Least(near.shape[1], most)
        for part in tiles(batches, questions):
            scope = _places(part.column("scope"), asked.scopes)
            if split:
                text, heads = part.column("text").fill_null(""), [part.column(c).fill_null("") for c in ("title", "section_title")]
                words, headed = keywords(pc.binary_join_element_wise(*heads, text, " ")), [keywords(h) for h in heads]
            else:
                words, headed = part.column("words"), [part.column(c) for c in ("title_terms", "section_terms")]
            row, ids = asked.ids(scope, words)
            key, tf = np.unique(row * len(asked.keys) + ids, return_counts=True)
            row, ids = np.divmod(key, max(len(asked.keys), 1))
            more = np.zeros(len(key))
            for head, bonus in zip(headed, (title, section)):
                r, i = asked.ids(scope, head)
                more[np.searchsorted(key, r * len(asked.keys) + i)] += bonus
            have = np.bincount(asked.met(row, ids)[1], minlength=part.num_rows * len(asked.need)).reshape(part.num_rows, -1)
            whole, said, spoken = [], [], {}
            for r, q in np.argwhere(have == asked.need).tolist() if have.size else []:
                if r not in spoken:
                    spoken[r] = phrase(text[r].as_py()) if split else part.column("said")[r].as_py() or ""
                if all(x in spoken[r] for x in asked.quoted[q]):
                    whole.append((r, q))
                if asked.phrases[q] and asked.phrases[q] in spoken[r]:
                    said.append((r, q))
            pairs = [_lists(*np.array(x, np.int32).reshape(-1, 2).T, part.num_rows) for x in (whole, said)]
            dl = pc.list_value_length(words).cast(pa.int32())
            added = _lists(row, more, part.num_rows) if more.any() else _lists(row[:0], more[:0], part.num_rows)
            out = [part.column("chunk_id"), pa.array(scope.astype(np.int32)), dl, *(_lists(row, x.astype(np.int32), part.num_rows) for x in (ids, tf)), added, *pairs]
            if best is not None:
                cosine = batch_vectors(part.column("lower"), near.shape[0], known) @ near
                r, q = np.nonzero(best.keep(cosine))
                out += [_lists(r, q.astype(np.int32), part.num_rows), _lists(r, cosine[r, q], part.num_rows)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names).filter(pa.array(scope >= 0))

    lower = [] if near is None else [F.lower("text").alias("lower")]
    return chunks.select("chunk_id", "scope", *(TEXTS if split else INDEXED), *lower).mapInArrow(of, schema)


def counts(rows: DataFrame, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """df of each id, n and avgdl of each scope: as many numbers as the block of questions has words and scopes."""
    df, n, avgdl = np.zeros(len(asked.keys)), np.zeros(len(asked.scopes)), np.zeros(len(asked.scopes))
    each = rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("c")).toArrow()
    df[each.column("id").to_numpy()] = each.column("c").to_numpy()
    sums = rows.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.avg("dl").alias("m")).toArrow()
    n[sums.column("g").to_numpy()], avgdl[sums.column("g").to_numpy()] = sums.column("c").to_numpy(), sums.column("m").to_numpy()
    return df, n, avgdl


class Least:
    """The ``most`` highest scores of each question among the rows of a task that have been seen."""

    def __init__(self, questions: int, most: int):
        self.most, self.top = most, np.full((0, questions), -np.inf)

    def keep(self, score: np.ndarray) -> np.ndarray:
        """Which scores (rows by questions; -inf: none) may be among the best."""
        both = np.concatenate([self.top, score])
        if len(both) > self.most:
            both = np.partition(both, len(both) - self.most, axis=0)[len(both) - self.most :]
        self.top = both
        least = both.min(axis=0) if len(both) == self.most else -np.inf
        return (score > -np.inf) & (score >= least - SLACK)


def scored(rows: DataFrame, asked: Asked, weigh, most: int | None, all_terms: bool, phrase: float) -> DataFrame:
    """(chunk_id, q, score) of posted rows: the sum of weigh(ids, tf, dl, scope) and of what title, section and phrase add.

    All pairs that share a word, or have all words and quotes; with ``most``, those that may be among the best so many of a question.
    """
    schema = T.StructType([rows.schema["chunk_id"], T.StructField("q", T.IntegerType()), T.StructField("score", T.DoubleType())])
    questions = len(asked.need)

    def of(batches):
        best = Least(questions, most) if most else None
        for part in tiles(batches, questions):
            flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False)
            rows_of = lambda c: np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(c)).to_numpy(zero_copy_only=False))
            row, ids = rows_of("ids"), flat("ids")
            w = weigh(ids, flat("tfs").astype(float), part.column("dl").to_numpy(zero_copy_only=False).astype(float)[row], part.column("g").to_numpy(zero_copy_only=False)[row])
            place, pair = asked.met(row, ids)
            shape = (part.num_rows, questions)
            total = lambda x: np.bincount(pair, x[place], part.num_rows * questions).reshape(shape).astype(float)  # noqa: E731 (without pairs the counts are integers)
            s, more = total(w), np.zeros(len(ids))
            there = s > 0
            if len(added := flat("more")):
                some = pc.list_value_length(part.column("more")).to_numpy(zero_copy_only=False) > 0
                more[some[row]] = added
                s = s + total(more)
            if all_terms:
                there = np.zeros(shape, bool)
                there[rows_of("whole"), flat("whole")] = True
            s[rows_of("said"), flat("said")] += phrase
            s[~there] = -np.inf
            r, q = np.nonzero(best.keep(s) if best else there)
            yield pa.RecordBatch.from_arrays([part.column("chunk_id").take(pa.array(r)), pa.array(q.astype(np.int32)), pa.array(s[r, q])], names=schema.names)

    return rows.select("chunk_id", *T.StructType.fromDDL(POSTED).names).mapInArrow(of, schema)


def named(scores: DataFrame, block: pa.Table, kind: T.StructField) -> DataFrame:
    """q as the question's id, scores to nine places."""
    names = pa.table({kind.name: block.column(kind.name), "q": pa.array(np.arange(block.num_rows, dtype=np.int32))})
    put = scores.sparkSession.createDataFrame(names, T.StructType([kind, T.StructField("q", T.IntegerType())]))
    return scores.join(F.broadcast(put), "q").select(kind.name, "chunk_id", F.round("score", 9).alias("score"))


def union(parts: list[DataFrame], save=written) -> DataFrame:
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, [save(p) for p in parts])
