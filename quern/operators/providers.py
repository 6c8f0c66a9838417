"""Models behind one interface: calls in bounded batches with retries, answers kept in a cache, guards, and a fall-back for each row.

A provider gets a list of prompts and returns an answer for each. Calls happen inside tasks, so ``call`` has to be picklable. What a call
raises, or an answer that is none, becomes an error of its rows: no row is lost, and a batch that fails is
asked again row by row, so one bad prompt spoils no other. Blank prompts are not asked.

Steps that a model may take over: rewriting and splitting questions, compressing evidence, answering, preambles and vectors of chunks. Each adds
``*_used`` (provider, cache, or what took its place) and ``*_error``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import queries as Q
from ..functions.text import excerpt, scrub_preamble, verbatim_share
from ..sources.keyed import KeyedTable
from ..sources.tables import written
from . import ranking
from .evidence import cited, format_evidence, passthrough_answer

TEXT, VECTOR = "string", "array<double>"


@dataclass(frozen=True)
class Provider:
    """name stands in cache keys: another model, or another prompt, gets another name. A call has at most ``rows`` prompts and about ``size`` bytes."""

    name: str
    call: Callable[[list[str]], list]
    rows: int = 64
    size: int = 256 << 10
    attempts: int = 2


@dataclass(frozen=True)
class Providers:
    """The steps that models take; None leaves a step to its rules."""

    rewriter: Provider | None = None
    decomposer: Provider | None = None
    compressor: Provider | None = None
    answerer: Provider | None = None
    contextualizer: Provider | None = None
    embedder: Provider | None = None
    dim: int | None = None
    cache: str | None = None


def _checked(answer, kind: str, dim: int | None):
    """(answer, error)"""
    if answer is None:
        return None, "no answer"
    if kind == TEXT:
        return (answer, None) if isinstance(answer, str) else (None, f"not a text: {type(answer).__name__}")
    try:
        vec = [float(x) for x in answer]
    except (TypeError, ValueError) as e:
        return None, f"not a vector: {e}"
    if not all(map(math.isfinite, vec)) or not vec or dim and len(vec) != dim:
        return None, f"not a vector of {dim or 'any'} finite numbers"
    return vec, None


def _called(provider: Provider, prompts: list[str], kind: str, dim: int | None) -> list[tuple]:
    """(answer, error) for each prompt."""
    why = ""
    for _ in range(max(1, provider.attempts)):
        try:
            got = provider.call(prompts)
            if len(got) == len(prompts):
                return [_checked(x, kind, dim) for x in got]
            why = f"{len(got)} answers to {len(prompts)} prompts"
        except Exception as e:  # whatever a model's client raises is recorded with its rows
            why = f"{type(e).__name__}: {e}"
    if len(prompts) == 1:
        return [(None, why)]
    return [x for p in prompts for x in _called(provider, [p], kind, dim)]


def ask(rows: DataFrame, prompt: str, provider: Provider, kind: str = TEXT, dim: int | None = None) -> DataFrame:
    """Adds answer and error for the column ``prompt``; both null for blank prompts."""
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"answer {kind}, error string").fields])

    def of(batches):
        for batch in batches:
            texts = batch.column(prompt).to_pylist()
            out: list[tuple] = [(None, None)] * len(texts)
            some: list[int] = []
            held = 0
            for i, text in enumerate(texts):
                if not text or not text.strip():
                    continue
                if some and (len(some) == provider.rows or held + len(text) > provider.size):
                    for j, x in zip(some, _called(provider, [texts[j] for j in some], kind, dim), strict=True):
                        out[j] = x
                    some, held = [], 0
                some.append(i)
                held += len(text)
            if some:
                for j, x in zip(some, _called(provider, [texts[j] for j in some], kind, dim), strict=True):
                    out[j] = x
            made = pa.array([x[0] for x in out], pa.string() if kind == TEXT else pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made, pa.array([x[1] for x in out], pa.string())], names=[*batch.schema.names, "answer", "error"])

    return rows.mapInArrow(of, schema)


def cache_table(spark: SparkSession, path: str, kind: str = TEXT) -> KeyedTable:
    """Answers by the SHA-256 of provider and prompt."""
    return KeyedTable(spark, path, "key", f"key string, provider string, answer {kind}", buckets=64)


def asked_once(rows: DataFrame, prompt: str, provider: Provider, cache: KeyedTable | None = None, kind: str = TEXT, dim: int | None = None, save=written) -> DataFrame:
    """ask() for prompts that the cache doesn't hold, each once; good answers go to the cache. Adds answer, error and used (cache, provider, null).

    The provider is called before this returns, once for each missing prompt but for tasks that Spark has to repeat.
    """
    keyed = rows.withColumn("~key", F.sha2(F.concat_ws("\0", F.lit(provider.name), F.col(prompt)), 256))
    wanted = keyed.where(F.trim(F.coalesce(F.col(prompt), F.lit(""))) != "").groupBy("~key").agg(F.min(prompt).alias("prompt"))
    if cache is not None:
        wanted = wanted.join(cache.read().select(F.col("key").alias("~key")), "~key", "left_anti")
    got = save(ask(wanted, "prompt", provider, kind, dim).select("~key", "answer", "error"))
    parts = got.withColumn("used", F.when(F.col("error").isNull(), "provider"))
    if cache is not None:
        old = cache.read().select(F.col("key").alias("~key"), "answer", F.lit(None).cast("string").alias("error"), F.lit("cache").alias("used"))
        cache.merge(got.where("error is null").select(F.col("~key").alias("key"), F.lit(provider.name).alias("provider"), "answer"))
        parts = parts.unionByName(old)
    return keyed.join(parts, "~key", "left").drop("~key")


def _step(rows: DataFrame, prompt: Column, provider: Provider, cache: KeyedTable | None, accept, otherwise: Column, name: str, kind: str, instead: str, dim: int | None = None) -> DataFrame:
    """Adds name, name_used and name_error: accept(answer) gives the result and why it is not taken, else ``otherwise`` stands in."""
    out = asked_once(rows.withColumn("~prompt", prompt), "~prompt", provider, cache, kind, dim)
    result, why = accept(F.col("answer"))
    bad = F.coalesce(F.col("error"), F.when(F.col("answer").isNotNull(), why))
    out = out.withColumn("~bad", bad).withColumn("~good", F.when(F.col("answer").isNotNull() & F.col("~bad").isNull(), result))
    out = out.withColumn(name, F.coalesce("~good", otherwise)).withColumn(f"{name}_used", F.when(F.col("~good").isNotNull(), F.col("used")).otherwise(F.lit(instead))).withColumn(f"{name}_error", F.col("~bad"))
    return out.drop("answer", "error", "used", "~prompt", "~bad", "~good")


def _bare(answer: Column) -> Column:
    """Trimmed, without one pair of quotes around it."""
    return F.trim(F.regexp_replace(F.trim(answer), r"^([\"'])([\s\S]*)\1$", "$2"))


def rewrite(questions: DataFrame, provider: Provider, cache: KeyedTable | None = None) -> DataFrame:
    """Adds rewritten: the model's form of the question, or the question itself."""
    accept = lambda a: (_bare(a), F.when(_bare(a) == "", "empty completion"))
    return _step(questions, F.trim("query"), provider, cache, accept, F.col("query"), "rewritten", TEXT, "query")


def decompose(questions: DataFrame, provider: Provider, most: int = 4, least: int = 2, cache: KeyedTable | None = None) -> DataFrame:
    """Adds parts: sub-questions from the lines of the model's answer, or the question alone where there are too few."""
    accept = lambda a: (F.slice(Q.parse_lines(a), 1, most), F.when(F.size(Q.parse_lines(a)) < least, f"fewer than {least} parts"))
    return _step(questions, F.trim("query"), provider, cache, accept, F.array(F.trim(F.coalesce("query", F.lit("")))), "parts", TEXT, "query")


def compress(rows: DataFrame, provider: Provider, must_have: Column | None = None, cache: KeyedTable | None = None) -> DataFrame:
    """Adds compressed: the model's extract where half of its lines at least are verbatim in the text, else the sentences that ranking.compress keeps."""
    must = F.array_join(must_have, ", ") if must_have is not None else F.lit("")
    prompt = F.when(F.trim("text") != "", F.concat(F.lit("Query: "), F.col("query"), F.lit("\nMust-have terms: "), F.when(must == "", "(none)").otherwise(must), F.lit("\n---\n"), F.col("text")))

    def accept(a: Column) -> tuple[Column, Column]:
        return F.trim(a), F.when(F.trim(a) == "", "empty completion").when(~verbatim_share(a, F.col("text")), "output not a verbatim subset")

    kept = ranking.compress(rows).withColumnRenamed("compressed", "~own")
    return _step(kept, prompt, provider, cache, accept, F.col("~own"), "compressed", TEXT, "extractive").drop("~own")


def answer(packages: DataFrame, provider: Provider, must_have: Column | None = None, cache: KeyedTable | None = None) -> DataFrame:
    """packages (query, context) with answer_text and what its [N] marks cite; contexts without rows are not asked for and pass through, as do failures."""
    must = F.array_join(must_have, ", ") if must_have is not None else F.lit("")
    prompt = F.when(F.size("context") > 0, F.concat(F.lit("Query: "), F.col("query"), F.lit("\nMust preserve verbatim: "), F.when(must == "", "(none)").otherwise(must), F.lit("\n\n"), format_evidence(F.col("context")), F.lit("\n\nWrite the answer now. Cite chunks with [N] markers.")))
    accept = lambda a: (F.trim(a), F.when(F.trim(a) == "", "empty completion"))
    out = _step(packages, prompt, provider, cache, accept, passthrough_answer(F.col("context")), "answer_text", TEXT, "passthrough")
    all_ = F.when(F.col("answer_text_used") == "passthrough", F.col("context")).otherwise(cited(F.col("answer_text"), F.col("context")))
    return out.withColumn("cited", F.coalesce(all_, F.slice("context", 1, 0)))


def preambles(chunks: DataFrame, documents: DataFrame, provider: Provider, most: int = 6000, cache: KeyedTable | None = None) -> DataFrame:
    """(chunk_id, preamble) that places a chunk (document_id, chunk_id, text) in its document (document_id, text); only chunks for which the model had one."""
    docs = documents.select("document_id", excerpt(F.trim(F.coalesce("text", F.lit(""))), most).alias("~doc"))
    rows = chunks.select("document_id", "chunk_id", "text").join(docs, "document_id")
    prompt = F.concat(F.lit("<document>\n"), F.col("~doc"), F.lit("\n</document>\n\n<chunk>\n"), F.col("text"), F.lit("\n</chunk>\n\nWrite a 1-2 sentence preamble situating the chunk inside the document."))
    accept = lambda a: (scrub_preamble(a), F.when(scrub_preamble(a) == "", "empty completion"))
    out = _step(rows, prompt, provider, cache, accept, F.lit(None).cast("string"), "preamble", TEXT, "fallback")
    return out.select("chunk_id", "preamble", "preamble_used", "preamble_error")


def embed(rows: DataFrame, text: str, provider: Provider, dim: int | None = None, cache: KeyedTable | None = None) -> DataFrame:
    """Adds vec, as a unit vector, vec_used and vec_error; null where the model gave none."""

    def accept(a: Column) -> tuple[Column, Column]:
        norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)), F.lit(None).cast("string")

    return _step(rows, F.col(text), provider, cache, accept, F.lit(None).cast(VECTOR), "vec", VECTOR, "none", dim)


def counts(rows: DataFrame, step: str) -> DataFrame:
    """(used, n, errors) of a step."""
    return rows.groupBy(F.col(f"{step}_used").alias("used")).agg(F.count(F.lit(1)).alias("n"), F.count(f"{step}_error").alias("errors"))
