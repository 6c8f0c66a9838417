"""Reranking, de-duplication, diversity under a token budget, and compression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import freshness, metadata_score, minmax
from ..functions.text import content_terms, estimate_tokens, rerank_terms, sentences, squeeze, with_shingles

def _per() -> Win:
    return Win.partitionBy("query_id")


def _share(q, t):
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.greatest(F.lit(1), F.size(q))).otherwise(0.0)


def rerank_weighted(rows: DataFrame, as_of=None) -> DataFrame:
    """Adds rerank_score: .45 vector + .35 keyword (each normalised within the query) + .20 metadata.

    rows: query_id, query, chunk_id, title, section_title, score, vector_score, keyword_score[, updated_at, priority, workspace_match].
    A vector score of 0 counts as missing and the fused score stands in for it; equal scores of a leg are all 1.
    """
    has = rows.columns
    v = F.when(F.coalesce("vector_score", F.lit(0.0)) != 0, F.col("vector_score")).otherwise(F.col("score"))
    q = rerank_terms(F.col("query"))
    fresh = freshness(F.col("updated_at"), as_of if as_of is not None else F.current_timestamp()) if "updated_at" in has else F.lit(0.0)
    fresh = F.greatest(F.lit(0.0), fresh)
    priority = F.coalesce(F.col("priority"), F.lit(0.0)) if "priority" in has else F.lit(0.0)
    match = F.coalesce(F.col("workspace_match").cast("double"), F.lit(1.0)) if "workspace_match" in has else F.lit(1.0)
    meta = metadata_score(fresh, _share(q, rerank_terms(F.col("title"))), _share(q, rerank_terms(F.col("section_title"))), priority, match)
    out = rows.withColumn("vector_norm", minmax(v, _per())).withColumn("keyword_norm", minmax(F.coalesce("keyword_score", F.lit(0.0)), _per())).withColumn("metadata_score", meta)
    return out.withColumn("rerank_score", F.round(0.45 * F.col("vector_norm") + 0.35 * F.col("keyword_norm") + 0.20 * F.col("metadata_score"), 9))


def rerank_lexical(rows: DataFrame, vector_weight: float = 1.0, heading_weight: float = 0.6, term_weight: float = 0.05) -> DataFrame:
    """Adds rerank_score: the score, the share of query terms in the heading, and the number of them in the text."""
    q = content_terms(F.col("query"))
    heading, terms = F.size(F.array_intersect(q, content_terms(F.col("section_title")))), F.size(F.array_intersect(q, content_terms(F.col("text"))))
    out = rows.withColumn("heading_overlap", heading).withColumn("term_overlap", terms)
    return out.withColumn("rerank_score", F.round(vector_weight * F.col("score") + heading_weight * F.col("heading_overlap") / F.greatest(F.lit(1), F.size(q)) + term_weight * F.col("term_overlap"), 9))


def rerank_with(rows: DataFrame, score_pairs) -> DataFrame:
    """Adds rerank_score by a provider, and rerank_error where it failed.

    score_pairs(queries, texts) gives raw scores, normalised within the query. Where it fails for any row of a query, the
    whole query keeps its order by score, so that no query mixes both.
    """

    def of(batches):
        for b in batches:
            try:
                s, why = pa.array(np.asarray(score_pairs(b.column("query").to_pylist(), b.column("text").to_pylist()), float)), None
                if len(s) != b.num_rows:
                    raise ValueError(f"{len(s)} scores for {b.num_rows} rows")
            except Exception as e:  # a provider's failure must not lose the rows: it is recorded with them
                s, why = pa.nulls(b.num_rows, pa.float64()), f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([*b.columns, s, pa.array([why] * b.num_rows, pa.string())], names=[*b.schema.names, "raw_score", "error"])

    out = rows.mapInArrow(of, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("raw_score double, error string").fields]))
    out = out.withColumn("rerank_error", F.max("error").over(_per())).withColumn("raw_score", F.when(F.col("rerank_error").isNull(), F.col("raw_score")).otherwise(F.col("score")))
    return out.withColumn("rerank_score", minmax(F.col("raw_score"), _per())).drop("raw_score", "error")


def cut(rows: DataFrame, k: int, by: str = "rerank_score") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(_per().orderBy(F.desc(by), "chunk_id"))).where(F.col("rank") <= k)


def dedupe_exact(rows: DataFrame) -> DataFrame:
    """One row for each chunk_id, each place (source_id, chunk_index), and each text but for case and white space: the best scored."""
    best = lambda d, *keys: d.withColumn("r", F.row_number().over(Win.partitionBy("query_id", *keys).orderBy(F.desc("score"), "chunk_id"))).where("r = 1").drop("r")
    out = best(best(rows, "chunk_id"), "source_id", "chunk_index").withColumn("key", F.lower(squeeze(F.col("text"))))
    return best(out.where("key <> ''"), "key").unionByName(out.where("key = ''")).drop("key")


def _conflicts(rows: DataFrame, threshold: float) -> DataFrame:
    """(query_id, n, exact, like): the places of better rows of the query that are the same chunk, place or text, and of those nearly the same of its source.

    rows: query_id, n, chunk_id, source_id, chunk_index, key, sh. A query has as many rows as the merged limit lets through.
    """
    a, b = rows.alias("a"), rows.alias("b")
    source = F.col("a.source_id").eqNullSafe(F.col("b.source_id"))
    exact = (F.col("a.chunk_id") == F.col("b.chunk_id")) | (source & F.col("a.chunk_index").eqNullSafe(F.col("b.chunk_index"))) | ((F.col("a.key") != "") & (F.col("a.key") == F.col("b.key")))
    both = F.size(F.array_intersect("a.sh", "b.sh"))
    like = source & (both > 0) & (both >= threshold * (F.size("a.sh") + F.size("b.sh") - both))
    met = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("b.n") < F.col("a.n")))
    met = met.select("a.query_id", "a.n", F.col("b.n").alias("m"), F.coalesce(exact, F.lit(False)).alias("exact"), F.coalesce(like, F.lit(False)).alias("like")).where("exact or like")
    return met.groupBy("query_id", "n").agg(F.collect_list(F.when(F.col("exact"), F.col("m"))).alias("exact"), F.collect_list(F.when(F.col("like"), F.col("m"))).alias("like"))


def dedupe(rows: DataFrame, threshold: float = 0.85, collapse: bool = True) -> DataFrame:
    """All five rules in order of score: chunk, place, text, near-equal shingles within a source, and neighbours of the first kept of a section.

    Adds dupes_absorbed, the number of near-equal rows that a row stands for. Which rows conflict is a self-join of each query's rows; a
    fold over the ranks, in one expression, then keeps each row that conflicts with none kept before it.
    """
    named = with_shingles(rows, "text", "__sh").withColumn("__n", F.row_number().over(_per().orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "chunk_id")))
    slim = named.select("query_id", F.col("__n").alias("n"), "chunk_id", "source_id", "chunk_index", F.lower(squeeze(F.col("text"))).alias("key"), F.col("__sh").alias("sh"))
    section = named.select("query_id", F.col("__n").alias("n"), F.struct("source_id", F.coalesce("section_title", F.lit("")).alias("title")).alias("section"), F.col("chunk_index").cast("long").alias("at"))
    none = F.array().cast("array<int>")
    each = section.join(_conflicts(slim, threshold), ["query_id", "n"], "left")
    each = each.select("query_id", F.struct("n", F.coalesce("exact", none).alias("exact"), F.coalesce("like", none).alias("like"), "section", "at").alias("row"))
    kind = "array<struct<n:int,section:struct<source_id:string,title:string>,at:bigint>>"

    def step(acc, x):
        before = F.transform(acc["kept"], lambda k: k["n"])
        like = F.array_min(F.array_intersect(x["like"], before))
        first = F.get(F.filter(acc["kept"], lambda k: k["section"].eqNullSafe(x["section"])), F.lit(0))
        beside = F.coalesce(F.abs(first["at"] - x["at"]) == 1, F.lit(False)) if collapse else F.lit(False)
        fresh = ~F.arrays_overlap(x["exact"], before)
        own = F.array(F.struct(x["n"].alias("n"), x["section"].alias("section"), x["at"].alias("at"))).cast(kind)
        kept = F.when(fresh & like.isNull() & ~beside, F.concat(acc["kept"], own)).otherwise(acc["kept"])
        absorbed = F.when(fresh & like.isNotNull(), F.concat(acc["absorbed"], F.array(like))).otherwise(acc["absorbed"])
        return F.struct(kept.alias("kept"), absorbed.alias("absorbed"))

    folded = each.groupBy("query_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    folded = folded.select("query_id", F.aggregate("rows", F.struct(F.array().cast(kind).alias("kept"), none.alias("absorbed")), step).alias("f"))
    kept = folded.select("query_id", "f.absorbed", F.explode("f.kept.n").alias("__n"))
    kept = kept.select("query_id", "__n", F.size(F.filter("absorbed", lambda m: m == F.col("__n"))).alias("dupes_absorbed"))
    return named.join(kept, ["query_id", "__n"]).select(*rows.columns, "dupes_absorbed")


def _alike(ids: np.ndarray, source: np.ndarray, section: np.ndarray, terms: list) -> np.ndarray:
    """How alike all pairs of a query's rows are: 1 for one chunk, .7 within a section, else shared terms, .4 at least within a named source."""
    known = {w: k for k, w in enumerate({w for t in terms for w in t})}
    held = np.zeros((len(terms), max(len(known), 1)), np.float32)
    for i, t in enumerate(terms):
        held[i, [known[w] for w in t]] = 1
    common, size = held @ held.T, held.sum(axis=1)
    out = (common / np.maximum(size[:, None] + size[None, :] - common, 1)).astype(float)
    one_source = source[:, None] == source[None, :]
    out = np.where(one_source & (source != "")[:, None], np.maximum(out, 0.4), out)
    out = np.where(one_source & (section[:, None] == section[None, :]), 0.7, out)
    return np.where(ids[:, None] == ids[None, :], 1.0, out)


def mmr(rows: DataFrame, max_tokens: int = 4000, max_chunks: int = 8, lam: float = 0.7) -> DataFrame:
    """Picks by lam * rerank_score - (1 - lam) * likeness to what is picked; adds pick (from 1) and cost.

    The best row comes first whatever it costs; the walk ends at the first row that does not fit. max_chunks and max_tokens may be columns of rows of
    the same names.
    """
    rows = rows.withColumn("__terms", content_terms(F.col("text"))).withColumn("cost", estimate_tokens(F.col("text")))

    def of(t: pa.Table) -> pa.Table:
        t = t.sort_by([("rerank_score", "descending"), ("chunk_id", "ascending")])
        text = lambda c: np.array([x or "" for x in t.column(c).to_pylist()], object)
        alike = _alike(text("chunk_id"), text("source_id"), text("section_title"), t.column("__terms").to_pylist())
        score, cost = lam * t.column("rerank_score").to_numpy(zero_copy_only=False), t.column("cost").to_numpy(zero_copy_only=False)
        limit = lambda c, usual: t.column(c)[0].as_py() if c in t.schema.names else usual
        tokens, chunks = limit("max_tokens", max_tokens), limit("max_chunks", max_chunks)
        picked, used, worst = [0], int(cost[0]), alike[0].copy()
        while len(picked) < min(chunks, t.num_rows) and used < tokens:
            gain = score - (1 - lam) * worst
            gain[picked] = -np.inf
            best = int(np.argmax(gain))
            if used + int(cost[best]) > tokens:
                break
            picked.append(best)
            used += int(cost[best])
            worst = np.maximum(worst, alike[best])
        return t.take(pa.array(picked, pa.int64())).append_column("pick", pa.array(range(1, len(picked) + 1), pa.int32()))

    return rows.groupBy("query_id").applyInArrow(of, T.StructType([*rows.schema.fields, T.StructField("pick", T.IntegerType())])).drop("__terms")


def within_budget(rows: DataFrame, max_tokens: int = 4000, max_chunks: int = 8) -> DataFrame:
    """Greedy by rank (a column): the first is always kept; the rest until one does not fit or the budget is full."""
    over = _per().orderBy("rank")
    out = rows.withColumn("cost", estimate_tokens(F.col("text"))).withColumn("used", F.sum("cost").over(over.rowsBetween(Win.unboundedPreceding, 0)))
    return out.where((F.col("rank") <= max_chunks) & ((F.col("rank") == 1) | ((F.col("used") <= max_tokens) & (F.col("used") - F.col("cost") < max_tokens))))


def compress(rows: DataFrame, radius: int = 1, least: int = 60) -> DataFrame:
    """Adds compressed: the sentences that share a content term with the query, and those beside them; the text itself
    where the query has no terms, nothing matches, or less than ``least`` characters are left."""
    x = rows.withColumn("__q", content_terms(F.col("query"))).withColumn("__s", sentences(F.col("text")))
    x = x.withColumn("__hit", F.transform("__s", lambda t: F.arrays_overlap(F.col("__q"), content_terms(t))))
    near = lambda i: F.array_contains(F.slice("__hit", F.greatest(i - radius + 1, F.lit(1)), F.least(i, F.lit(radius)) + radius + 1), True)
    x = x.withColumn("__kept", F.trim(F.array_join(F.filter("__s", lambda t, i: near(i)), " ")))
    none = (F.size("__q") == 0) | (F.size("__s") == 0) | ~F.array_contains("__hit", True) | (F.length("__kept") < least)
    return x.withColumn("compressed", F.when(F.col("text") == "", "").when(none, F.col("text")).otherwise(F.col("__kept"))).drop("__q", "__s", "__hit", "__kept")
