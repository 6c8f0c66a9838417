"""Sections and chunks: word windows, parent and child windows, semantic groups, and the rule that picks among them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.batches import windows
from ..functions.text import ascii_word_count, prose_sentences, squeeze
from .vectors import DIM, batch_vectors

# Words that may be lower-case in a chapter title.
CONNECTORS = ["of", "the", "and", "or", "in", "on", "at", "to", "for", "a"]

#: Texts that are cut at once.
ROWS = 256
#: Sections whose sentences are compared at once.
SECTIONS = 32


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to below size")


def heading(line: Column) -> Column:
    """The title if the line is a level 1 or 2 Markdown heading or a chapter heading ``N. Title``, else null."""
    marked = F.regexp_extract(line, r"^#{1,2}\s+(.+?)\s*#*$", 1)
    number, title = F.regexp_extract(line, r"^([1-9]\d{0,2})\.\s+([A-Z].{2,80})$", 1), F.trim(F.regexp_extract(line, r"^([1-9]\d{0,2})\.\s+([A-Z].{2,80})$", 2))
    words = F.split(title, " ")
    small = F.size(F.filter(words, lambda w: (F.lower(w) == w) & (F.upper(w) != w) & ~w.isin(CONNECTORS)))
    chapter = (title != "") & (F.coalesce(F.try_to_number(F.nullif(number, F.lit("")), F.lit("999")), F.lit(999)) <= 199) & ~title.endswith(".") & ~title.rlike(r",\s+[a-z]+\s") & ((F.size(words) < 3) | (small < 2))
    return F.when(marked != "", F.trim(marked)).when(chapter, F.concat(number, F.lit(". "), title))


def sections(docs: DataFrame) -> DataFrame:
    """(document_id, text) to (document_id, section_index, title, body): lines between headings; empty bodies are left out."""
    lines = docs.select("document_id", F.posexplode(F.split("text", r"\R|[\x1c-\x1e]")).alias("no", "raw")).select("document_id", "no", F.trim(F.regexp_replace("raw", r"[ \t]+", " ")).alias("line"))
    lines = lines.withColumn("title", F.when(F.col("line").rlike("^[#1-9]"), heading(F.col("line"))))  # others are none
    over = Win.partitionBy("document_id").orderBy("no")
    lines = lines.withColumn("section_index", F.sum(F.col("title").isNotNull().cast("int")).over(over))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("no", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("document_id", "section_index").agg(F.max("title").alias("title"), F.trim(F.regexp_replace(body, r"^\n+|\n+$", "")).alias("body"))
    return out.where("body <> ''")


def whole(docs: DataFrame) -> DataFrame:
    """Each text as one untitled section."""
    return docs.select("document_id", F.lit(0).alias("section_index"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))


def word_windows(parts: DataFrame, size: int = 600, overlap: int = 100) -> DataFrame:
    """Sections to (document_id, section_index, title, window, text): windows of ``size`` words, each ``size - overlap`` on."""
    _check(size, overlap)
    step = size - overlap
    title = F.col("title")
    cut = parts.select("document_id", "section_index", "title", F.when(title.isNotNull(), F.startswith(F.lower(squeeze(F.col("body"))), F.lower(title))).alias("starts"), "body")
    schema = T.StructType([*cut.drop("body").schema.fields, *T.StructType.fromDDL("window int, n int, text string").fields])

    def of(batches):
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            row, window, n, text = windows(part.column("body"), size, step)
            own = [part.column(c).take(pa.array(row)) for c in schema.names[:4]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(window.astype(np.int32)), pa.array(n.astype(np.int32)), text], names=schema.names)

    named = title.isNotNull() & ((F.col("n") > size) | ~F.col("starts"))
    return cut.mapInArrow(of, schema).select("document_id", "section_index", "title", "window", F.when(named, F.concat("title", F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("text"))


def numbered(chunks: DataFrame) -> DataFrame:
    """Adds chunk_index (from 0 within a document) and chunk_id."""
    over = Win.partitionBy("document_id").orderBy("section_index", "window")
    out = chunks.withColumn("chunk_index", (F.row_number().over(over) - 1).cast("int"))
    return out.withColumn("chunk_id", F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")))


def hierarchical(parts: DataFrame, parent_size: int = 1500, parent_overlap: int = 200, child_size: int = 300, child_overlap: int = 60, compat: bool = False) -> DataFrame:
    """Child windows with parent_text and parent_chunk_id of the parent that holds the child.

    The parent is the first of the section whose words hold all of the child's; compat: the first whose text holds the child's text, title
    included, or the section's first. A parent equal to the child is left out.
    """
    parents = word_windows(parts, parent_size, parent_overlap)
    over = Win.partitionBy("document_id").orderBy("section_index", "window")
    parents = parents.withColumn("no", F.row_number().over(over) - 1).select("document_id", "section_index", F.col("window").alias("pw"), F.col("text").alias("parent_text"), "no")
    children = word_windows(parts, child_size, child_overlap)
    both = children.join(parents, ["document_id", "section_index"], "left")
    if compat:
        rank = (~F.contains("parent_text", F.col("text"))).cast("int")
    else:
        start, end = F.col("window") * (child_size - child_overlap), F.col("window") * (child_size - child_overlap) + child_size
        p0 = F.col("pw") * (parent_size - parent_overlap)
        body = F.when(F.col("title").isNotNull(), F.regexp_replace("text", r"^[^\n]*\n\n", "")).otherwise(F.col("text"))
        inside = (p0 <= start) & ((end <= p0 + parent_size) | F.contains("parent_text", body))
        rank = F.when(inside, 0).otherwise(1)
    best = F.row_number().over(Win.partitionBy("document_id", "section_index", "window").orderBy(rank, "pw"))
    kept = both.withColumn("r", best).where("r = 1")
    own = F.col("parent_text").isNotNull() & (F.col("parent_text") != F.col("text"))
    name = F.concat(F.lit("parent:"), F.col("section_index").cast("string"), F.lit(":"), F.col("no").cast("string"))
    return kept.select("document_id", "section_index", "title", "window", "text", F.when(own, F.col("parent_text")).alias("parent_text"), F.when(own, name).alias("parent_chunk_id"))


def _groups(words: list[int], sim: list[float], low: float, least: int, target: int, most: int) -> list[int]:
    """How many sentences each group has: one walk over words and similarities to the sentence before, then two merges of small groups."""
    if sum(words) <= target and len(words) <= 2:
        return [len(words)] if words else []
    groups: list[list[int]] = []
    for w, s in zip(words, sim):
        if not groups or (groups[-1][1] >= least and (s < low or groups[-1][1] + w > most)):
            groups.append([0, 0])
        groups[-1][0], groups[-1][1] = groups[-1][0] + 1, groups[-1][1] + w
    merged: list[list[int]] = []
    for n, w in groups:
        if merged and w < least:
            merged[-1] = [merged[-1][0] + n, merged[-1][1] + w]
        else:
            merged.append([n, w])
    # after the backward merge only the first group can still be small
    if len(merged) >= 2 and merged[0][1] < least:
        merged[:2] = [[merged[0][0] + merged[1][0], merged[0][1] + merged[1][1]]]
    return [n for n, _ in merged]


def _percentile(values: np.ndarray, share: float) -> float:
    """Interpolated as Spark's percentile; NaN, below which nothing lies, for no values."""
    if not len(values):
        return np.nan
    ordered, at = np.sort(values), (len(values) - 1) * share
    below, above = int(np.floor(at)), int(np.ceil(at))
    if below == above or ordered[below] == ordered[above]:
        return float(ordered[below])
    return float((above - at) * ordered[below] + (at - below) * ordered[above])


def semantic(parts: DataFrame, least: int = 200, target: int = 500, most: int = 900, share: float = 0.25) -> DataFrame:
    """Sections to groups of like sentences: a group ends where the similarity of neighbours is in the lowest ``share``, or it is full.

    Sentences of a batch of sections are counted at once and stay with their section: nothing is shuffled.
    """
    said = parts.select("document_id", "section_index", "title", prose_sentences(F.col("body")).alias("s")).withColumn("lower", F.transform("s", lambda x: F.lower(x)))
    schema = T.StructType([*said.drop("s", "lower").schema.fields, *T.StructType.fromDDL("window int, alone boolean, text string").fields])

    def of(batches):
        known: dict[bytes, int] = {}
        for part in (b.slice(at, SECTIONS) for b in batches for at in range(0, b.num_rows, SECTIONS)):
            sents = part.column("s").flatten()
            ends = np.cumsum(pc.list_value_length(part.column("s")).fill_null(0).to_numpy(zero_copy_only=False))
            words = (pc.count_substring(sents, " ").to_numpy(zero_copy_only=False) + 1).tolist()
            v = batch_vectors(part.column("lower").flatten(), DIM, known)
            sim = np.full(len(v), np.nan)
            sim[1:] = reduce(np.add, (v[:-1] * v[1:]).T) if len(v) > 1 else 0.0  # from the first component to the last, as scores.dot adds them
            rows, window, alone, n = [], [], [], []
            for row, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
                groups = _groups(words[start:end], sim[start:end].tolist(), _percentile(sim[start + 1 : end], share), least, target, most)
                rows += [row] * len(groups)
                window += range(len(groups))
                alone += [len(groups) == 1] * len(groups)
                n += groups
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), sents), " ")
            own = [part.column(c).take(pa.array(rows, pa.int64())) for c in schema.names[:3]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(window, pa.int32()), pa.array(alone, pa.bool_()), text], names=schema.names)

    named = F.col("title").isNotNull() & ~(F.col("alone") & F.startswith(F.lower("text"), F.lower("title")))
    return said.mapInArrow(of, schema).select("document_id", "section_index", "title", "window", F.when(named, F.concat("title", F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("text"))


def _fixed(cfg: Config) -> str | None:
    """The chunker of all documents, where settings name one."""
    if cfg.chunker != "auto" and not cfg.adaptive_chunking:
        return cfg.chunker if cfg.chunker in ("semantic", "hierarchical") else "word"
    return None


def choose(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(document_id, text, file_type) with word_count, heading_count, chunker and chunker_reason."""
    heads = sections(docs.select("document_id", "text")).groupBy("document_id").agg(F.count("title").alias("heading_count"))
    out = docs.withColumn("word_count", ascii_word_count(F.col("text"))).join(heads, "document_id", "left").na.fill(0, ["heading_count"])
    if kind := _fixed(cfg):
        return out.withColumn("chunker", F.lit(kind)).withColumn("chunker_reason", F.lit("fixed-by-config"))
    w, h = F.col("word_count"), F.col("heading_count")
    density = h / F.greatest(F.lit(1.0), w / 1000.0)
    pair = lambda k, r: F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"))
    pdf = (F.col("file_type") == "pdf") & (w >= 2500)
    pick = (
        F.when(w <= max(900, 2 * cfg.chunk_size), pair("word", "short-document"))
        .when(F.col("file_type").isin("csv", "xlsx", "xls"), pair("word", "tabular-text-preserve-row-order"))
        .when((h >= 4) & (density >= 0.6), pair("hierarchical", "structured-headings"))
        .when(pdf & ((h <= 3) | (density < 0.5)), pair("semantic", "long-narrative-pdf"))
        .when(pdf, pair("hierarchical", "long-structured-pdf"))
        .when(w >= 5000, pair("semantic", "long-document"))
        .when(h >= 2, pair("hierarchical", "sectioned-document"))
        .otherwise(pair("word", "default-overlap-window"))
    )
    return out.withColumn("p", pick).select(*docs.columns, "word_count", "heading_count", F.col("p.k").alias("chunker"), F.col("p.r").alias("chunker_reason"))


def hierarchical_sizes(cfg: Config = Config()) -> dict[str, int]:
    base = max(300, cfg.chunk_size)
    child, parent = min(420, max(220, int(base * 0.65))), min(1800, max(900, int(base * 2.5)))
    fit = lambda o, n: max(0, min(o, n - 1))
    return {"parent_size": parent, "parent_overlap": fit(max(cfg.chunk_overlap, int(parent * 0.12)), parent), "child_size": child, "child_overlap": fit(max(cfg.chunk_overlap, int(child * 0.25)), child)}


def chunk(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(document_id, text, file_type) to numbered chunks, each document by the chunker chosen for it."""
    put = docs.withColumn("chunker", F.lit(_fixed(cfg))) if _fixed(cfg) else choose(docs, cfg)  # no headings are counted where none decides
    of = lambda kind: sections(put.where(F.col("chunker") == kind).select("document_id", "text"))
    blank = lambda d: d.withColumn("parent_text", F.lit(None).cast("string")).withColumn("parent_chunk_id", F.lit(None).cast("string"))
    size = max(100, cfg.chunk_size)
    out = blank(word_windows(of("word"), size, min(cfg.chunk_overlap, size - 1))).unionByName(hierarchical(of("hierarchical"), **hierarchical_sizes(cfg))).unionByName(blank(semantic(of("semantic"))))
    return numbered(out)


def with_preamble(chunks: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Adds embed_text: a preamble from the cache (chunk_id, preamble), else title and section, before the text."""
    own = F.concat_ws(" - ", "document_id", "title")
    if cache is None:
        return chunks.withColumn("embed_text", F.concat_ws("\n\n", own, "text"))
    return chunks.join(cache.select("chunk_id", "preamble"), "chunk_id", "left").withColumn("embed_text", F.concat_ws("\n\n", F.coalesce("preamble", own), "text")).drop("preamble")
