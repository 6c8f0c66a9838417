"""The whole way from questions to evidence and answers, for a batch of questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..config import Config
from ..functions import queries as Q
from ..operators import evidence, providers, ranking, retrieval, vectors
from ..operators.keyword_index import KeywordIndex
from ..operators.providers import Providers
from ..sources.tables import written


def _most(cfg: Config) -> int:
    """No plan asks for more of a leg or of merged candidates than this; a literal bound lets Spark cut before it sorts."""
    return max(100, 2 * max(cfg.keyword_top_k, cfg.vector_top_k, cfg.merged_limit, cfg.rerank_top_k))


def _cache(rows: DataFrame, models: Providers):
    return providers.cache_table(rows.sparkSession, f"{models.cache}/texts") if models.cache else None


@dataclass
class Corpus:
    """chunks: chunk_id, document_id, source_id, chunk_index, title, section_title, text; vectors: chunk_id, vec; keywords: their stored index, if there is one."""

    chunks: DataFrame
    vectors: DataFrame
    keywords: KeywordIndex | None = None


def understand(questions: DataFrame, cfg: Config = Config(), models: Providers = Providers()) -> DataFrame:
    """questions (query_id, query) with u, rw, route and the limits of their strategies, as columns."""
    if models.rewriter:
        asked = providers.rewrite(questions, models.rewriter, _cache(questions, models))
        out = Q.with_rewrite(asked, "rewritten").drop("rewritten", "rewritten_used", "rewritten_error")
    else:
        out = Q.with_rewrite(questions, "query")
    out = out.withColumn("u", Q.understand(F.col("query")))
    out = out.withColumn("route", Q.route(F.col("query"), F.col("u"), cfg.strategy))
    return out.withColumn("lim", Q.strategy_plan(F.col("route.strategy"), Q.plan(F.col("u"), cfg), cfg))


def _search(asked: DataFrame, corpus: Corpus, cfg: Config) -> DataFrame:
    """asked: query_id, parent_id, query, rw, lim. The reranked rows of each query."""
    most = _most(cfg)
    lim = asked.select("query_id", "lim", F.col("rw.cleaned").alias("query"))
    # a question whose plan leaves the keyword leg out has no words there
    words = asked.where("lim.use_keyword").select("query_id", F.col("rw.keyword_query").alias("query"), F.col("lim.keyword_top_k").alias("k"))
    if corpus.keywords:
        kw = corpus.keywords.top_k(words, most=most).rows
    else:
        kw = retrieval.ranked(retrieval.bm25_scores(words, corpus.chunks, most).join(words.select("query_id", "k"), "query_id"), F.col("k"), most).drop("k")
    variants = vectors.with_hash_vector(asked.select("query_id", F.col("lim.vector_top_k").alias("k"), F.posexplode("rw.semantic_queries").alias("variant", "text")), "text")
    ve = vectors.top_k(variants.drop("text"), corpus.vectors, F.col("k"), most)
    merged = retrieval.ranked(retrieval.fuse(kw, ve, cfg.weight_vector, cfg.weight_keyword).join(lim.select("query_id", F.col("lim.merged_limit").alias("k"), F.col("lim.expansion").alias("x")), "query_id"), F.col("k"), most)
    wide = retrieval.expand(merged.where("x").drop("k", "x"), corpus.chunks, cfg.neighbour_window)
    base = retrieval.expand(merged.where("not x").drop("k", "x"), corpus.chunks, 0).unionByName(wide, allowMissingColumns=True)
    rows = written(corpus.chunks.join(vectors.sent(written(base)), "chunk_id")).join(lim, "query_id")  # a few rows for each query: they go to the chunks
    rows = rows.withColumn("sources", F.coalesce("sources", F.array(F.lit("expanded")))).na.fill(0.0, ["vector_score", "keyword_score"])
    ranked = ranking.rerank_weighted(rows.drop("rank"))
    over = Win.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id")
    return ranked.withColumn("rank", F.row_number().over(over)).where((F.col("rank") <= most) & (F.col("rank") <= F.col("lim.rerank_top_k")))


def retrieve(understood: DataFrame, corpus: Corpus, cfg: Config = Config(), save=written, models: Providers = Providers()) -> DataFrame:
    """One evidence record for each question; complex questions are split, searched in parts and ranked again as a whole."""
    deep = F.col("route.strategy") == "deep"
    parts = F.when(deep, Q.decompose(F.col("query"), cfg.deep_max, cfg.deep_min)).otherwise(F.array("query"))
    if models.decomposer:
        broken = providers.decompose(understood.where(deep).select("query_id", "query"), models.decomposer, cfg.deep_max, cfg.deep_min, _cache(understood, models)).select("query_id", "parts")
        understood = save(understood.join(broken, "query_id", "left").withColumn("parts", F.coalesce("parts", F.array("query"))), "decomposed")
        parts = F.col("parts")
    split = understood.select(F.col("query_id").alias("parent_id"), "query", "rw", "lim", F.posexplode(parts).alias("part", "sub"))
    many = F.col("sub") != F.col("query")
    name = F.concat_ws("#", F.col("parent_id").cast("string"), F.col("part").cast("string"))
    one = split.where(~many).select(name.alias("query_id"), "parent_id", "query", "rw", "lim", F.lit(False).alias("sub"))
    more = Q.with_rewrite(split.where(many).select(name.alias("query_id"), "parent_id", F.col("sub").alias("query"), "lim", F.lit(True).alias("sub")), "query")
    asked = save(one.unionByName(more), "asked")
    found = save(_search(asked, corpus, cfg), "found").join(asked.select("query_id", "parent_id", "sub"), "query_id")
    # parts: the best row of each chunk, scored again against the whole question
    best = found.where("sub").withColumn("b", F.row_number().over(Win.partitionBy("parent_id", "chunk_id").orderBy(F.desc("rerank_score"), "query_id"))).where("b = 1").drop("b")
    whole = understood.select(F.col("query_id").alias("parent_id"), F.col("rw.cleaned").alias("whole"))
    merged = best.join(whole, "parent_id").withColumn("query_id", F.col("parent_id")).withColumn("query", F.col("whole")).drop("whole", "parent_id", "sub", "rank", "vector_norm", "keyword_norm", "metadata_score", "rerank_score")
    merged = ranking.rerank_weighted(merged.withColumn("vector_score", F.col("score")).withColumn("keyword_score", F.lit(0.0)))
    merged = merged.withColumn("rank", F.row_number().over(Win.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id")))
    plain = found.where("not sub").withColumn("query_id", F.col("parent_id")).drop("parent_id", "sub")
    reranked = plain.unionByName(merged.select(*plain.columns)).withColumn("max_chunks", F.col("lim.max_chunks")).withColumn("squash", F.col("lim.compression")).drop("lim", "parent_chunk_id")
    kept = save(ranking.dedupe(save(reranked, "reranked")), "deduplicated")
    picked = ranking.mmr(kept, cfg.max_tokens, cfg.max_chunks, cfg.mmr_lambda)
    rewritten = understood.select("query_id", F.concat_ws(" ", F.col("rw.semantic_queries")[0], F.array_join("rw.must_have", " ")).alias("anchor"), F.col("rw.semantic_queries")[0].alias("rewritten"))
    picked = picked.drop("query").join(rewritten.select("query_id", F.col("anchor").alias("query")), "query_id")
    picked = save(picked, "picked")
    small = providers.compress(picked, models.compressor, cache=_cache(understood, models)) if models.compressor else ranking.compress(picked)
    small = small.withColumn("compressed", F.when(F.col("squash"), F.col("compressed")).otherwise(F.col("text")))
    small = save(small, "compressed")
    heads = understood.select("query_id", "query", "route", "rw").join(rewritten.select("query_id", "rewritten"), "query_id")
    return evidence.package(heads, kept, small, cfg.max_tokens)


def answer(questions: DataFrame, corpus: Corpus, cfg: Config = Config(), save=written, models: Providers = Providers()) -> DataFrame:
    """Answers with evidence. Weak results are searched once more with the terms they lack; the better result stays.

    save: cuts the plan after each step, by default with a written table; the second pass reads only flagged questions.
    models: providers for single steps; what they fail at is done by rules. With a trace.Trace as save, the rows, characters and seconds of each step are noted.
    """
    asked = save(understand(questions, cfg, models), "understood")
    first = save(retrieve(asked, corpus, cfg, save, models), "evidence")
    decided = first.withColumn("retry", Q.retry_decision(F.col("top_rerank_score"), F.size("coverage_gaps"), cfg.retry_floor))
    again = decided.withColumn("again", Q.retry_query(F.col("query"), F.col("rw.must_have"), F.col("coverage_gaps"))).where("retry.triggered and again is not null and route.strategy <> 'simple'")
    second = understand(again.select("query_id", F.col("again").alias("query")), cfg, models)
    second = save(retrieve(save(second, "again"), corpus, cfg, save, models), "evidence").select("query_id", F.struct("context", "evidence", "citations", "coverage_gaps", "confidence", "top_rerank_score", "usage").alias("n"))
    both = decided.join(second, "query_id", "left")
    better = F.coalesce(F.col("n.top_rerank_score") > F.coalesce("top_rerank_score", F.lit(0.0)), F.lit(False))
    take = [F.when(better, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("context", "evidence", "citations", "coverage_gaps", "confidence", "top_rerank_score", "usage")]
    out = both.select("query_id", "query", "route", "retry", F.when(better, "retry").otherwise("original").alias("kept"), *take)
    if models.answerer:
        said = providers.answer(save(out, "answered"), models.answerer, cache=_cache(questions, models))
        return said.withColumnRenamed("answer_text", "answer").drop("cited")
    return out.withColumn("answer", evidence.passthrough_answer(F.col("context")))
