"""A stored keyword index: postings in blocks of chunks with what bounds their scores, kept up to date document by document.

Two keyed tables (see sources.keyed) lie beside each other:

    chunks     a row for each chunk, by document: how many terms it has, and the words of title, section and text as one string each
    postings   a row for each term and block of BLOCK chunks: how many chunks hold it, the greatest count and the least
               length among them, and the chunks

A block lies in the bucket of its documents, so new and deleted documents rewrite the postings of their buckets and no
others. Postings are made where the files of the chunks are read: their words are not stored twice and nothing is shuffled. Counts over the corpus (n, avgdl, df) are summed up when a question comes, so nothing stored grows stale.

A search bounds each block's score from the postings' heads alone, scores the k blocks with the highest bounds, and then
those others whose bound reaches the k-th best score: the rows of retrieval.bm25_top_k, without reading all postings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import keywords, phrases
from ..functions.scores import bm25
from ..functions.text import keyword_phrase
from ..sources.keyed import Change, KeyedTable
from ..sources.tables import setting, written
from . import retrieval
from .vectors import sent

#: Chunks of a block.
BLOCK = 32
#: Chunks whose postings are made at once, about: a whole number of blocks.
PART = 8192
#: Files of chunks that one task makes postings of: what it sorts should fit into memory.
TASK_BYTES = "8m"
#: Chunks whose words are found at once.
ROWS = 2048
_CHUNKS = "document_id string, chunk_id string, dl int, title string, section string, said string"
_POSTINGS = "home int, block long, term string, df int, tf_max int, dl_min int, titled boolean, sectioned boolean, postings array<struct<chunk_id:string,tf:int,dl:int,titled:boolean,sectioned:boolean>>"
#: More than the rounding of a sum of scores.
_SLACK = 1e-7


def counted(words: Column) -> Column:
    """Distinct words, ascending, with how often they are there: a batch is counted at once, in time that grows with its words."""

    @F.arrow_udf("array<struct<term:string,tf:int>>")
    def of(lists: pa.Array) -> pa.Array:
        return _counted(lists)

    return of(words)


def _counted(lists: pa.Array) -> pa.ListArray:
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    key, tf = np.unique(row * max(len(order), 1) + rank[coded.indices.to_numpy()], return_counts=True)
    row, at = np.divmod(key, max(len(order), 1))
    both = pa.StructArray.from_arrays([coded.dictionary.take(order).take(pa.array(at)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32)), both)


def counted_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (document_id, chunk_id, text[, title, section_title]) as rows of the table of chunks: the words of retrieval.indexed, found and counted a batch at once."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in chunks.columns else F.lit("")
    named = chunks.select(F.col("document_id").cast("string").alias("document_id"), "chunk_id", has("title").alias("title"), has("section_title").alias("section"), has("text").alias("text"))

    def of(batches):
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            heads = [part.column(c) for c in ("title", "section", "text")]
            dl = pc.list_value_length(keywords(pc.binary_join_element_wise(*heads, " "))).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("document_id"), part.column("chunk_id").cast(pa.string()), dl, *map(phrases, heads)], names=[f.name for f in schema])

    schema = T.StructType.fromDDL(_CHUNKS)
    return named.mapInArrow(of, schema)


def _posted(part: pa.Table, block: np.ndarray) -> pa.RecordBatch:
    """Postings of chunks (home, chunk_id, dl, title, section, said) by term and block; block: that of each, with the chunks of one block side by side."""
    put = {c: part.column(c).combine_chunks() for c in part.schema.names}
    home, dl, n = put["home"].to_numpy(), put["dl"].to_numpy().astype(np.int32), part.num_rows
    group = np.cumsum(np.append(0, block[1:] != block[:-1]))  # a number for each block
    words = keywords(pc.binary_join_element_wise(put["title"], put["section"], put["said"], " "))
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    terms = coded.dictionary.take(order)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at = lambda lists: np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    key, tf = np.unique(rank[coded.indices.to_numpy()] * n + at(words), return_counts=True)

    def held(heads: pa.Array) -> np.ndarray:
        lists, out = keywords(heads), np.zeros(len(key), bool)
        out[np.searchsorted(key, pc.index_in(lists.flatten(), value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64) * n + at(lists))] = True
        return out

    titled, sectioned = held(put["title"]), held(put["section"])
    code, row = np.divmod(key, n)
    mine = group[row]
    start = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (mine[1:] != mine[:-1]))) if len(key) else np.zeros(0, np.int64)
    each = pa.StructArray.from_arrays([put["chunk_id"].take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(dl[row]), pa.array(titled), pa.array(sectioned)], names=["chunk_id", "tf", "dl", "titled", "sectioned"])
    most = lambda f, x: f.reduceat(x, start) if len(start) else x
    first = row[start]
    out = [
        home[first], block[first], terms.take(pa.array(code[start])), np.diff(np.append(start, len(key))).astype(np.int32),
        most(np.maximum, tf).astype(np.int32), most(np.minimum, dl[row]), most(np.logical_or, titled), most(np.logical_or, sectioned),
    ]
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), each)
    return pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x) for x in out), lists], names=["home", "block", "term", "df", "tf_max", "dl_min", "titled", "sectioned", "postings"])


def posted(chunks: DataFrame, size: int) -> DataFrame:
    """Postings of chunks (home, ... as _posted takes them), by blocks of ``size`` chunks of one home that come one after the other in a task; blocks of a task are numbered on from its own first number."""
    least = -(-PART // size) * size

    def of(batches):
        rest, number, home, place = [], TaskContext.get().partitionId() << 32, None, 0  # the chunks whose postings are not made yet; the last one's block, home and place there
        for part in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            mine = part.column("home").to_numpy()
            edge = np.append(0, np.flatnonzero(mine[1:] != mine[:-1]) + 1)
            blocks = []
            for i, j in zip(edge, np.append(edge[1:], len(mine))):
                if mine[i] != home:
                    home, place, number = mine[i], 0, number + 1
                where = place + np.arange(j - i)
                blocks.append(number + where // size)
                number, place = int(number + (place + j - i) // size), (place + j - i) % size
            rest.append((part, np.concatenate(blocks)))
            if sum(p.num_rows for p, _ in rest) >= least:
                held, block = pa.Table.from_batches([p for p, _ in rest]), np.concatenate([b for _, b in rest])
                last = int(np.searchsorted(block, block[-1]))  # where the last block begins, which may go on
                if last:
                    yield _posted(held.slice(0, last), block[:last])
                rest = [(b, block[last:]) for b in held.slice(last).combine_chunks().to_batches()]
        if rest:
            yield _posted(pa.Table.from_batches([p for p, _ in rest]), np.concatenate([b for _, b in rest]))

    return chunks.mapInArrow(of, T.StructType.fromDDL(_POSTINGS))


@dataclass(frozen=True)
class Found:
    """rows: query_id, chunk_id, score, rank; reads: query_id, blocks that hold a term of the query, blocks that were scored."""

    rows: DataFrame
    reads: DataFrame


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, block: int = BLOCK, save=written, number: int | None = None):
        """Opens the index at path, or makes an empty one. number: the version to search and to build on, the newest by default."""
        self.spark, self.block, self.save, self.number = spark, block, save, number
        self.chunks = KeyedTable(spark, f"{path}/chunks", "document_id", _CHUNKS, buckets)
        self.postings = KeyedTable(spark, f"{path}/postings", "term", _POSTINGS, buckets)

    # --- documents in and out ---

    def upsert(self, chunks: DataFrame) -> Change:
        """All chunks (document_id, chunk_id, text[, title, section_title]) of these documents, in the place of their old ones."""
        return self.replace(chunks)

    def replace(self, chunks: DataFrame | None = None, gone: DataFrame | None = None) -> Change:
        """upsert and delete in one change: the postings are written once."""
        if chunks is None:
            return self.change(gone=gone)
        return self.change(counted_chunks(chunks), gone, chunks.select(F.col("document_id").cast("string").alias("document_id")))

    def delete(self, ids: DataFrame) -> Change:
        """Without the documents of ids (document_id)."""
        return self.change(gone=ids)

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None, keys: DataFrame | None = None) -> Change:
        """Merges rows of the table of chunks (keys: as KeyedTable.merge); then makes the postings of the buckets whose chunks are not those the postings were made from."""
        base, chunks = self._now()
        now = self.chunks.version(self.chunks.merge(rows, gone, base=chunks, keys=keys).version)
        seen = self.chunks.version(chunks)
        touched = sorted(b for b in {*seen.buckets, *now.buckets} if seen.buckets.get(b) != now.buckets.get(b))
        held = self.chunks.read(touched, now.number).select(self.chunks.bucket().alias("home"), "chunk_id", "dl", "title", "section", "said")
        rows = posted(held, self.block)
        with setting(self.spark, "spark.sql.files.maxPartitionBytes", TASK_BYTES):
            done = self.postings.replace_buckets(rows, touched, "home", base=base, mark=("chunks", now.number), dealt=True)
        self.number = done.version if self.number is not None else None
        return done

    def vacuum(self) -> int:
        """Deletes old versions; how many files went."""
        postings, chunks = self._now()
        return self.chunks.vacuum([chunks]) + self.postings.vacuum([postings])

    # --- search ---

    def _now(self) -> tuple[int, int]:
        """The versions that belong together: the postings, and the chunks they were made from."""
        v = self.postings.version(self.number)
        return v.number, v.marks.get("chunks", 0)

    def stats(self) -> DataFrame:
        """(n, avgdl), chunks without terms included."""
        return self.chunks.read(number=self._now()[1]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))

    def _bounds(self, terms: DataFrame, postings: int) -> tuple[DataFrame, DataFrame]:
        """(term, idf parts) of the queries' terms, and for each query and block an upper bound of its chunks' scores and how many terms it holds."""
        heads = self.postings.read(number=postings).select("home", "block", "term", "df", "tf_max", "dl_min", "titled", "sectioned")
        heads = self.save(heads.join(sent(terms.select("term").distinct()), "term", "left_semi"))
        df = heads.groupBy("term").agg(F.sum("df").alias("df_all"))
        known = self.save(df.crossJoin(F.broadcast(self.stats())))
        yes = lambda c, x: F.when(F.col(c), x).otherwise(0.0)
        most = bm25(F.col("tf_max"), F.col("df_all"), F.col("dl_min"), F.col("n"), F.col("avgdl")) + yes("titled", retrieval.TITLE_BONUS) + yes("sectioned", retrieval.SECTION_BONUS)
        part = heads.join(known, "term").select("home", "block", "term", most.alias("most")).join(sent(terms), "term")
        return known, part.groupBy("query_id", "home", "block").agg(F.sum("most").alias("bound"), F.count(F.lit(1)).alias("holds"))

    def _scores(self, pairs: DataFrame, terms: DataFrame, known: DataFrame, asked: DataFrame, versions: tuple[int, int], most: int | None = None, every: bool = False) -> DataFrame:
        """(query_id, chunk_id, have, score) of the chunks of the blocks in pairs (query_id, home, block) that share a term; only their buckets are read.

        most: chunks that can't be among a query's best ``most`` may be left out; they stay in the task that scores their block. every: only chunks with all terms.
        """
        homes = [r[0] for r in pairs.select("home").distinct().collect()]  # no more than there are buckets
        asking = pairs.groupBy("home", "block").agg(F.collect_list("query_id").alias("asking"))
        rows = self.postings.read(homes, versions[0]).select("home", "block", "term", "postings").join(sent(terms.select("term").distinct()), "term", "left_semi")
        whole = rows.repartition("home", "block").join(asking, ["home", "block"])  # a block is scored in one task, before its rows multiply by queries
        own = whole.join(sent(terms), "term").where(F.array_contains("asking", F.col("query_id"))).drop("asking").join(sent(known), "term")
        one = own.select("query_id", "home", "block", "df_all", "n", "avgdl", F.explode("postings").alias("p"))
        score = bm25(F.col("p.tf"), F.col("df_all"), F.col("p.dl"), F.col("n"), F.col("avgdl"))
        more = F.when(F.col("p.titled"), retrieval.TITLE_BONUS).otherwise(0.0) + F.when(F.col("p.sectioned"), retrieval.SECTION_BONUS).otherwise(0.0)
        base = one.groupBy("query_id", "home", "block", F.col("p.chunk_id").alias("chunk_id")).agg(F.sum(score).alias("s"), F.sum(more).alias("x"), F.count(F.lit(1)).alias("have"))
        base = base.join(sent(asked), "query_id")
        if every:
            base = base.where("have = need")
        if isinstance(most, int):  # chunks that may hold the phrase stay, each in a group of its own
            over = Win.partitionBy("query_id", "alone").orderBy(F.desc(F.round(F.col("s") + F.col("x"), 9)), "chunk_id")
            base = base.withColumn("alone", F.when(F.expr("have = need and phrase <> ''"), F.col("chunk_id")).otherwise("")).withColumn("place", F.row_number().over(over)).where(F.col("place") <= most)
        base = self.save(base.drop("block", "alone", "place"))
        full = base.where("have = need and phrase <> ''").select("query_id", "chunk_id", "home", "phrase")
        homes = [r[0] for r in full.select("home").distinct().collect()]
        said = self.chunks.read(homes, versions[1]).select("chunk_id", "said").join(sent(full), "chunk_id").where(F.contains("said", F.col("phrase"))).select("query_id", "chunk_id", F.lit(retrieval.PHRASE_BONUS).alias("p"))
        out = base.join(said, ["query_id", "chunk_id"], "left")
        return out.select("query_id", "chunk_id", "have", "need", F.round(F.col("s") + F.col("x") + F.coalesce("p", F.lit(0.0)), 9).alias("score"))

    def top_k(self, queries: DataFrame, k: Column | int = 30, most: int | None = None) -> Found:
        """The best k chunks of each query (query_id, query[, k]) by BM25 with its bonuses; most bounds k where that is a column of queries."""
        most = most or k
        terms = self.save(retrieval.query_terms(queries))
        own = queries.select("query_id", keyword_phrase(F.col("query")).alias("phrase"), *(["k"] if "k" in queries.columns else [F.lit(k).alias("k")]))
        asked = self.save(own.join(terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need")), "query_id"))
        versions = self._now()
        known, bounds = self._bounds(terms, versions[0])
        phrase = F.when((F.col("holds") == F.col("need")) & (F.col("phrase") != ""), retrieval.PHRASE_BONUS).otherwise(0.0)
        over = Win.partitionBy("query_id").orderBy(F.desc("bound"), "home", "block")
        bounds = bounds.join(sent(asked), "query_id").select("query_id", "home", "block", "k", (F.col("bound") + phrase).alias("bound"))
        bounds = self.save(bounds.withColumn("place", F.row_number().over(over)))
        first = bounds.where(F.col("place") <= F.col("k")).select("query_id", "home", "block")
        asked = asked.select("query_id", "phrase", "need", "k")
        best = self.save(self._scores(first, terms, known, asked.drop("k"), versions, most))
        kth = retrieval.ranked(best.join(sent(asked.select("query_id", "k")), "query_id"), F.col("k"), most).where("rank = k").select("query_id", F.col("score").alias("least"))
        rest = self.save(bounds.where("place > k").join(sent(kth), "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + _SLACK >= F.col("least"))).select("query_id", "home", "block"))
        others = self._scores(rest, terms, known, asked.drop("k"), versions, most)
        both = best.unionByName(others).join(sent(asked.select("query_id", "k")), "query_id")
        rows = retrieval.ranked(both, F.col("k"), most).select("query_id", "chunk_id", "score", "rank")
        scored = first.unionByName(rest).groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks_read"))
        return Found(rows, bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(scored, "query_id", "left"))

    def boolean(self, queries: DataFrame, k: int = 30) -> Found:
        """All terms, and quoted phrases in full, must be there: blocks that lack a term are not read."""
        terms = self.save(retrieval.query_terms(queries))
        asked = queries.select("query_id", keyword_phrase(F.col("query")).alias("phrase")).join(terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need")), "query_id")
        asked = self.save(asked)
        versions = self._now()
        known, bounds = self._bounds(terms, versions[0])
        bounds = self.save(bounds.join(sent(asked.select("query_id", "need")), "query_id"))
        whole = bounds.where("holds = need").select("query_id", "home", "block")
        fit = self.save(self._scores(whole, terms, known, asked, versions, every=True))
        quoted = queries.select("query_id", F.explode(F.regexp_extract_all("query", F.lit('"([^"]+)"'), F.lit(1))).alias("q"))
        bad = sent(self.save(fit.select("query_id", "chunk_id").join(sent(quoted), "query_id"))).join(self.chunks.read(number=versions[1]).select("chunk_id", "said"), "chunk_id").where(~F.contains("said", keyword_phrase(F.col("q")))).select("query_id", "chunk_id")
        rows = retrieval.ranked(fit.join(bad, ["query_id", "chunk_id"], "left_anti"), k, k).select("query_id", "chunk_id", "score", "rank")
        scored = whole.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks_read"))
        return Found(rows, bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(scored, "query_id", "left"))
