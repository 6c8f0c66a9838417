"""Evidence records: contexts, audit rows, citations, coverage gaps, confidence and usage, one nested row for each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import confidence
from ..functions.text import content_terms, estimate_tokens


def agent_text(text: Column, parent: Column) -> Column:
    """The chunk, and its parent where it has one that says more."""
    more = parent.isNotNull() & (F.trim(parent) != "") & (F.trim(parent) != F.trim(text))
    return F.when(more, F.concat(text, F.lit("\n\n[parent]\n"), parent)).otherwise(text)


def coverage_gaps(query: Column, texts: Column) -> Column:
    """Content terms of the query that no context holds, sorted."""
    return F.array_sort(F.array_except(content_terms(query), content_terms(F.array_join(texts, " "))))


def coverage(query: Column, texts: Column) -> Column:
    q = content_terms(query)
    return F.size(F.array_intersect(q, content_terms(F.array_join(texts, " ")))) / F.greatest(F.lit(1), F.size(q))


def package(queries: DataFrame, reranked: DataFrame, selected: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """queries (query_id, query, rewritten), reranked rows (rank) and selected rows (pick, compressed) as one record for each query."""
    item = lambda at, *cols: F.array_sort(F.collect_list(F.struct(F.col(at).alias("no"), *cols)))
    place = [F.col(c) for c in ("source_id", "chunk_id", "title", "section_title")]
    ev = reranked.groupBy("query_id").agg(
        item("rank", *place, F.round("rerank_score", 6).alias("score"), "sources").alias("evidence"), F.max("rerank_score").alias("top_rerank_score")
    )
    con = selected.groupBy("query_id").agg(
        item("pick", *place, F.round("rerank_score", 6).alias("score"), F.col("compressed").alias("text")).alias("context"),
        F.min_by(F.struct("score", "rerank_score"), "pick").alias("first"),
        F.sum(F.length(F.col("compressed"))).alias("chars"),
    )
    out = queries.join(ev, "query_id", "left").join(con, "query_id", "left")
    texts = F.concat(F.transform("context", lambda c: c["text"]), F.transform("context", lambda c: F.coalesce(c["section_title"], F.lit(""))))
    none = F.col("context").isNull()
    tokens = F.aggregate("context", F.lit(0).cast("long"), lambda a, c: a + estimate_tokens(c["text"]))
    said = F.coalesce(texts, F.array().cast("array<string>"))
    return out.select(
        *queries.columns,
        "context",
        "evidence",
        F.transform("context", lambda c: F.struct(c["source_id"].alias("source_id"), c["chunk_id"].alias("chunk_id"), c["title"].alias("title"), c["section_title"].alias("section"))).alias("citations"),
        coverage_gaps(F.col("rewritten"), said).alias("coverage_gaps"),
        F.when(none, 0.0).otherwise(confidence(F.col("first.score"), F.col("first.rerank_score"), coverage(F.col("rewritten"), said))).alias("confidence"),
        "top_rerank_score",
        F.struct(F.coalesce(tokens, F.lit(0)).alias("estimated_tokens"), F.lit(max_tokens).alias("max_tokens"), F.coalesce(F.size("context"), F.lit(0)).alias("returned_chunks")).alias("usage"),
    )


def passthrough_answer(context: Column) -> Column:
    said = F.array_join(F.transform(context, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.trim(c["text"]))), "\n\n")
    return F.when(context.isNull() | (F.size(context) == 0), "No evidence retrieved for this query.").otherwise(said)


def format_evidence(context: Column) -> Column:
    """Numbered evidence for a language model."""
    part = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(c["title"], F.lit("")), F.when(F.coalesce(c["section_title"], F.lit("")) != "", F.concat(F.lit(" ("), c["section_title"], F.lit(")"))).otherwise(""), F.lit("\n"), c["text"])
    return F.array_join(F.transform(context, part), "\n\n")


def cited(answer: Column, context: Column) -> Column:
    """The context items that an answer's [N] marks name, each once, in the order of their first mark."""
    marks = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda m: m.cast("int")))
    return F.transform(F.filter(marks, lambda m: (m >= 1) & (m <= F.size(context))), lambda m: F.element_at(context, m))
