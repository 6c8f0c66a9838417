"""Keyword search, fusion of both legs and expansion by neighbours, for whole batches of queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions.scores import minmax
from ..functions.text import keyword_phrase, keyword_tokens, phrase_tokens
from ..sources.tables import written
from . import matching
from . import vectors
from .vectors import query_blocks, sent


#: What an index knows of a chunk.
INDEXED = matching.INDEXED


def filtered(chunks: DataFrame, workspace: str | None = None, source_types: list[str] | None = None, document_ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Chunks of a workspace, of any of the source types, of any of the documents; empty conditions don't filter."""
    out = chunks
    if workspace:
        out = out.where(F.col("workspace_id") == workspace)
    if source_types:
        out = out.where(F.col("source_type").isin(source_types))
    if document_ids:
        out = out.where(F.col("document_id").isin(document_ids))
    return out.limit(limit) if limit else out


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each term of a query once."""
    return queries.select("query_id", F.explode(F.array_distinct(keyword_tokens(F.col("query")))).alias("term"))


def indexed(chunks: DataFrame) -> DataFrame:
    """chunks with words, title_terms, section_terms and said; words are those of title, section and text. Each text is searched for words once."""
    has = lambda c: keyword_phrase(F.col(c)) if c in chunks.columns else F.lit("")
    said = chunks.withColumns({"said": keyword_phrase(F.col("text")), "~title": has("title"), "~section": has("section_title")})
    terms = lambda c: F.array_distinct(phrase_tokens(F.col(c)))
    return said.withColumns({"words": phrase_tokens(F.concat_ws(" ", "~title", "~section", "said")), "title_terms": terms("~title"), "section_terms": terms("~section")}).drop("~title", "~section")


def index(chunks: DataFrame, save=written) -> DataFrame:
    """(chunk_id, words, title_terms, section_terms, said): each chunk tokenised once, to be read by all that follows.

    A store keeps this table; given again to bm25_scores, no text is read.
    """
    return save(indexed(chunks).select("chunk_id", *INDEXED))


def _words(chunks: DataFrame) -> DataFrame:
    return chunks if "words" in chunks.columns else indexed(chunks)


def term_frequencies(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, term, tf, dl) of all terms, or of the given ones: others are dropped before the shuffle. chunks: chunks or their index."""
    one = _words(chunks).select("chunk_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    if terms is not None:
        one = one.join(sent(terms.select("term").distinct(), 2_000_000), "term", "left_semi")
    return one.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(n, avgdl), chunks without terms included. chunks: chunks or their index."""
    return _words(chunks).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("words")), F.lit(0.0)).alias("avgdl"))


#: What a query term in the title, or in the section's title, adds to a chunk's score, and what the whole phrase adds.
TITLE_BONUS, SECTION_BONUS, PHRASE_BONUS = 0.35, 0.25, 1.0


def _asked(queries: DataFrame, scope: str | None) -> DataFrame:
    """(query_id, scope, terms, phrase, quoted) of the queries that have terms."""
    quotes = F.transform(F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit('"([^"]+)"'), F.lit(1)), keyword_phrase)
    one = queries.select("query_id", (F.col(scope) if scope else F.lit(0).cast("long")).alias("scope"), F.array_distinct(keyword_tokens(F.col("query"))).alias("terms"), keyword_phrase(F.col("query")).alias("phrase"), quotes.alias("quoted"))
    return one.where("size(terms) > 0")


def bm25_scores(queries: DataFrame, chunks: DataFrame, most: int | None = None, all_terms: bool = False, scope: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks that share a term, with the bonuses for title and section terms and whole phrases.

    chunks: chunks, or their index where it is kept. most: only rows that may be among the best so many of their query. all_terms: only chunks
    that hold all terms, and all quoted phrases, of the query. scope: a column of queries and of the chunks' index; only equal ones meet, and n, avgdl and df are theirs.
    """
    asked, held = written(_asked(queries, scope)), _held(chunks, scope)
    if asked.count() > matching.TILE // 256:  # more than a block: read again for each
        held = written(held)
    parts = []
    for block in query_blocks(asked, "terms", 1, matching.TILE // 32):
        words = matching.Asked.read(block)
        rows = written(matching.posted(held, words, TITLE_BONUS, SECTION_BONUS))
        parts.append(matching.named(_bm25(rows, words, most, all_terms), block, queries.schema["query_id"]))
    return matching.union(parts)


def _held(chunks: DataFrame, scope: str | None) -> DataFrame:
    own = INDEXED if "words" in chunks.columns else [F.col(c) if c in chunks.columns else F.lit("").alias(c) for c in matching.TEXTS]
    return chunks.select("chunk_id", *own, (F.col(scope) if scope else F.lit(0).cast("long")).alias("scope"))


def _bm25(rows: DataFrame, words: matching.Asked, most: int | None, all_terms: bool = False) -> DataFrame:
    """(chunk_id, q, score) of posted rows, by the statistics of all of them."""
    df, n, avgdl = matching.counts(rows, words)
    of = words.keys // max(len(words.terms), 1)
    idf = np.log(1.0 + (n[of] - df + 0.5) / (df + 0.5))

    def weigh(ids, tf, dl, g):
        return idf[ids] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / np.maximum(avgdl[g], 1e-9)))

    return matching.scored(rows, words, weigh, most, all_terms, PHRASE_BONUS)


def ranked(scores: DataFrame, k: Column | int, most: int) -> DataFrame:
    """The best k rows of each query, ties by chunk_id; most: a literal bound that Spark can push below the sort."""
    over = Win.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(over)).where((F.col("rank") <= most) & (F.col("rank") <= k))


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int = 30) -> DataFrame:
    return ranked(bm25_scores(queries, chunks, k), k, k)


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = 30) -> DataFrame:
    """The best k chunks of each query by keywords and by hash vectors, fused.

    Questions of one block meet each text once for both legs; more of them, or none with a term, are searched leg by leg.
    """
    sought = vectors.hash_vectors(queries, "query_id", "query").select("query_id", F.lit(0).alias("variant"), F.col("vec").alias("qv"))
    asked = written(_asked(queries, None))
    if not asked.count() or queries.count() > matching.TILE // 32:
        near = vectors.top_k(sought.withColumnRenamed("qv", "vec"), vectors.hash_vectors(chunks, "chunk_id", "text"), k, k)
        return fuse(bm25_top_k(queries, chunks, k), near.drop("variant"))
    block, near = asked.toArrow(), sought.toArrow()
    words = matching.Asked.read(block)
    rows = written(matching.posted(_held(chunks.drop(*INDEXED), None), words, TITLE_BONUS, SECTION_BONUS, vectors.query_matrix(near, vectors.DIM), k))
    keyword = matching.named(_bm25(rows, words, k), block, queries.schema["query_id"])
    pair = F.explode(F.arrays_zip("near", "cosine"))
    cosine = rows.where(F.size("near") > 0).select("chunk_id", pair.alias("p")).select("chunk_id", F.col("p.near").alias("q"), F.col("p.cosine").alias("score"))
    return fuse(ranked(keyword, k, k), vectors.ranked(vectors.named(cosine, near, sought.schema), F.lit(k), k).drop("variant"))


def boolean_search(queries: DataFrame, chunks: DataFrame, k: int = 30) -> DataFrame:
    """All terms must be there (no stemming): ranked by BM25. Quoted phrases of the query must be there in full."""
    return ranked(bm25_scores(queries, chunks, k, all_terms=True), k, k)


def fuse(keyword: DataFrame, vector: DataFrame, weight_vector: float = 0.55, weight_keyword: float = 0.45) -> DataFrame:
    """Both legs (query_id, chunk_id, score) as one: weighted sum of scores normalised within each leg, and the sources."""
    per = Win.partitionBy("query_id")
    kw = keyword.select("query_id", "chunk_id", F.col("score").alias("keyword_score"), minmax(F.col("score"), per).alias("kn"))
    ve = vector.select("query_id", "chunk_id", F.col("score").alias("vector_score"), minmax(F.col("score"), per).alias("vn"))
    both = kw.join(ve, ["query_id", "chunk_id"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sources = F.array_compact(F.array(F.when(F.col("kn").isNotNull(), F.lit("keyword")), F.when(F.col("vn").isNotNull(), F.lit("vector"))))
    score = F.round(weight_vector * zero(F.col("vn")) + weight_keyword * zero(F.col("kn")), 9)
    return both.select("query_id", "chunk_id", score.alias("score"), zero(F.col("vector_score")).alias("vector_score"), zero(F.col("keyword_score")).alias("keyword_score"), sources.alias("sources"))


def fusion_stats(fused: DataFrame) -> DataFrame:
    has = lambda s: F.count_if(F.array_contains("sources", s)).alias(f"{s}_count")
    return fused.groupBy("query_id").agg(has("keyword"), has("vector"), F.count(F.lit(1)).alias("merged_count"), F.count_if(F.size("sources") > 1).alias("overlap_count"))


def expand(candidates: DataFrame, chunks: DataFrame, window: int = 1, most: int = 2) -> DataFrame:
    """Adds the neighbours (same document, at most ``window`` chunks away) of each candidate, ``most`` new ones each.

    A neighbour scores 0.6 of its best-placed parent's; candidates stay as they are. chunks: (chunk_id, document_id, chunk_index).
    """
    base = candidates.withColumn("source", F.lit("candidate")).withColumn("parent_chunk_id", F.lit(None).cast("string"))
    if window <= 0:
        return base
    candidates = written(candidates)  # a few rows for each query: they go to the chunks
    base = candidates.withColumn("source", F.lit("candidate")).withColumn("parent_chunk_id", F.lit(None).cast("string"))
    at = written(chunks.select("chunk_id", "document_id", "chunk_index").join(sent(candidates), "chunk_id"))
    steps = F.filter(F.sequence(F.lit(-window), F.lit(window)), lambda d: d != 0)
    want = at.select("query_id", F.col("chunk_id").alias("parent_chunk_id"), F.col("score").alias("ps"), F.col("rank").alias("pr"), "document_id", "chunk_index", F.explode(steps).alias("d")).withColumn("chunk_index", F.col("chunk_index") + F.col("d")).drop("d")
    near = chunks.select("chunk_id", "document_id", "chunk_index").join(sent(want), ["document_id", "chunk_index"]).join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = near.withColumn("f", F.row_number().over(Win.partitionBy("query_id", "chunk_id").orderBy("pr"))).where("f = 1")
    capped = first.withColumn("c", F.row_number().over(Win.partitionBy("query_id", "parent_chunk_id").orderBy("chunk_index"))).where(F.col("c") <= most)
    new = capped.select("query_id", "chunk_id", F.round(F.col("ps") * 0.6, 9).alias("score"), "parent_chunk_id")
    add = new.withColumn("source", F.lit("expanded"))
    return base.unionByName(add, allowMissingColumns=True)
