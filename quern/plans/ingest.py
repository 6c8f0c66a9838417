"""From documents to stored chunks and vectors, in one batch: validate, chunk, put in context, replace, embed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import providers, vectors
from ..operators.chunking import chunk, with_preamble
from ..operators.providers import Providers
from ..sources import store
from ..sources.tables import written


@dataclass
class Stored:
    """documents: document_id and what describes it; chunks: document_id, chunk_id, chunk_index, text; vectors: document_id, chunk_id, vec."""

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame


def checked(docs: DataFrame) -> DataFrame:
    """Adds error_stage and error_reason: a row without a document_id fails validation, one without text extraction."""
    blank = ~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\S"))
    stage = F.when(F.coalesce(F.trim("document_id"), F.lit("")) == "", "validate").when(blank, "extract")
    return docs.withColumn("error_stage", stage).withColumn("error_reason", F.when(stage == "validate", "document_id is empty").when(stage == "extract", "extracted text is empty"))


def embedded(chunks: DataFrame, cache: DataFrame | None = None, models: Providers = Providers(), documents: DataFrame | None = None) -> DataFrame:
    """(document_id, chunk_id, vec): the stored text stays as it is, the vector is of the preamble and the text.

    cache: (chunk_id, preamble). With a contextualizer, preambles come from the model, through its cache, and need documents (document_id, text). With an
    embedder so do vectors; a chunk that it fails at has a null vector, which is not searched.
    """
    spark = chunks.sparkSession
    if models.contextualizer and documents is not None:
        cache = providers.preambles(chunks, documents, models.contextualizer, cache=providers.cache_table(spark, f"{models.cache}/texts") if models.cache else None)
    text = with_preamble(chunks, cache)
    if models.embedder:
        kept = providers.cache_table(spark, f"{models.cache}/vectors", providers.VECTOR) if models.cache else None
        return providers.embed(text.select("document_id", "chunk_id", "embed_text"), "embed_text", models.embedder, models.dim, kept).select("document_id", "chunk_id", "vec")
    return vectors.hash_vectors(text, ["document_id", "chunk_id"], "embed_text")


def ingest(docs: DataFrame, old: Stored | None = None, cfg: Config = Config(), cache: DataFrame | None = None, save=written, models: Providers = Providers()) -> tuple[Stored, DataFrame]:
    """docs (document_id, text, file_type, title, ...) into old: the new tables, and a result row for each of docs.

    Bad rows don't stop the others. All chunks and vectors of an ingested document take the place of its old ones. Of rows
    that share a document_id the one with the greatest text is taken and the others are results of status ``repeated``.
    The results: document_id, status (ok, error, repeated), error_stage, error_reason, n_chunks.
    """
    seen = checked(docs)
    keep = [c for c in docs.columns if c != "text"]
    good = seen.where("error_stage is null")
    new = save(good.groupBy("document_id").agg(F.max(F.struct("text", *[c for c in keep if c != "document_id"])).alias("d")).select("document_id", "d.*"))
    titles = new.select("document_id", "title") if "title" in keep else new.select("document_id", F.lit("").alias("title"))
    made = chunk(new.select("document_id", "text", "file_type"), cfg).withColumnRenamed("title", "section_title").join(titles, "document_id")
    chunks = save(made.select("document_id", "chunk_id", "chunk_index", "title", "section_title", "text", "parent_text", "parent_chunk_id"))
    vecs = embedded(chunks, cache, models, new.select("document_id", "text"))
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    rows = good.groupBy("document_id").agg(F.count(F.lit(1)).alias("c"))
    status = F.when(F.col("i") > 1, "repeated").when(F.coalesce("n_chunks", F.lit(0)) == 0, "error").otherwise("ok")
    done = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "c"))).join(counts, "document_id", "left")
    done = done.select("document_id", status.alias("status"), F.when(status == "error", "chunk").alias("error_stage"), F.when(status == "error", "no chunks").alias("error_reason"), F.when(F.col("i") == 1, F.coalesce("n_chunks", F.lit(0))).otherwise(0).cast("long").alias("n_chunks"))
    bad = seen.where("error_stage is not null").select("document_id", F.lit("error").alias("status"), "error_stage", "error_reason", F.lit(0).cast("long").alias("n_chunks"))
    rest = new.select(*keep)
    if old is None:
        return Stored(rest, chunks, vecs), done.unionByName(bad)
    ids = new.select("document_id")
    gone = lambda t: store.delete(t, ids)[0]
    return Stored(store.upsert(old.documents, rest, "document_id"), gone(old.chunks).unionByName(chunks, allowMissingColumns=True), gone(old.vectors).unionByName(vecs)), done.unionByName(bad)


def reindex(stored: Stored, ids: DataFrame | None = None, cache: DataFrame | None = None) -> Stored:
    """The vectors of all documents, or of those in ids (document_id), made again from the stored chunks."""
    some = stored.chunks if ids is None else stored.chunks.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    fresh = embedded(some, cache)
    return Stored(stored.documents, stored.chunks, fresh if ids is None else store.delete(stored.vectors, ids)[0].unionByName(fresh))


def drop(stored: Stored, ids: DataFrame) -> tuple[Stored, DataFrame]:
    """Without the documents of ids and all that hangs on them; and (deleted) how many documents went."""
    left, n = store.delete(stored.documents, ids)
    return Stored(left, store.delete(stored.chunks, ids)[0], store.delete(stored.vectors, ids)[0]), n


def summary(results: DataFrame) -> DataFrame:
    """(status, documents, chunks) of an ingest."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chunks").alias("chunks"))
