"""Full-text search with English stems, Boolean queries as people type them, and cover-density ranks.

A query is words that must all be there; ``"quoted words"`` stand next to each other, ``or`` parts alternatives and binds
weaker than the rest, ``-`` before a word or quote forbids it. Stop words have a place in texts but are not searched.
The corpus itself is never stemmed row by row: its distinct words are, and only the forms of words that queries use
are looked for. An alternative that only forbids finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stem import stem
from ..sources.tables import written
from . import matching
from .retrieval import ranked
from .vectors import query_blocks, sent

# Stop words of the English text search configuration.
STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same
so than too very s t can will just don should now""".split()
#: Weights of places in titles and in texts.
TITLE_WEIGHT, TEXT_WEIGHT = 1.0, 0.4
WORD = r"[\p{L}\p{N}]+"

_STOPS = frozenset(STOP)
_QUERY = "array<array<struct<no:boolean,words:array<string>,steps:array<int>>>>"
Term = tuple[bool, list[str], list[int]]


def _operand(text: str, no: bool) -> Term | None:
    """The searched words of a piece and how far each stands from the first one."""
    words = [w for w in re.findall(r"[^\W_]+", text.lower())]
    kept = [(i, stem(w)) for i, w in enumerate(words) if w not in _STOPS]
    return (no, [w for _, w in kept], [i - kept[0][0] for i, _ in kept]) if kept else None


def parse(query: str | None) -> list[list[Term]]:
    """Alternatives of terms (forbidden?, stems, places from the first stem)."""
    groups: list[list[Term]] = [[]]
    for no, quoted, bare in re.findall(r'(?:(?<=\s)|(?<=^))(-?)"([^"]*)"?|([^\s"]+)', query or ""):
        if bare.lower() == "or":
            groups.append([])
            continue
        term = _operand(quoted or bare.lstrip("-"), bool(no) or bare.startswith("-"))
        if term:
            groups[-1].append(term)
    return [g for g in groups if any(not no for no, *_ in g)]


def _there(term, at: dict[str, set[int]]) -> bool:
    places = [at.get(w) for w in term["words"]]
    if not all(places):
        return False
    return len(places) == 1 or any(all(p + s in q for q, s in zip(places, term["steps"], strict=True)) for p in places[0])


def _holds(groups, at: dict[str, set[int]]) -> bool:
    return any(all(_there(t, at) != t["no"] for t in g) for g in groups)


def cover_density(groups, hits) -> float | None:
    """The rank in [0, 1) of a text whose searched words are at hits (at, weight, lexeme); None where the query fails.

    Each shortest stretch that fulfils the query adds the harmonic mean of its places' weights, divided by one more
    than the number of words between them; the sum s becomes s / (s + 1).
    """
    places: dict[int, tuple[float, list[str]]] = {}
    whole: dict[str, set[int]] = {}
    for h in hits:
        places.setdefault(h["at"], (h["weight"], []))[1].append(h["lexeme"])
        whole.setdefault(h["lexeme"], set()).add(h["at"])
    if not _holds(groups, whole):
        return None
    doc = [(p, *places[p]) for p in sorted(places)]

    def reach(steps: Iterator[int]) -> int | None:
        seen: dict[str, set[int]] = {}
        for i in steps:
            for w in doc[i][2]:
                seen.setdefault(w, set()).add(doc[i][0])
            if _holds(groups, seen):
                return i
        return None

    total, at = 0.0, 0
    while at < len(doc) and (end := reach(iter(range(at, len(doc))))) is not None:
        begin = reach(iter(range(end, at - 1, -1)))
        if begin is None:
            at += 1
            continue
        inside = doc[begin : end + 1]
        noise = (doc[end][0] - doc[begin][0]) - (end - begin)
        total += len(inside) / sum(1 / w for _, w, _ in inside) / (1 + noise)
        at = begin + 1
    return total / (total + 1)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_places(chunks: DataFrame) -> DataFrame:
    """(chunk_id, at, weight, word) of all words but stop words; places of the text follow the title's last searched one."""
    t = chunks.select("chunk_id", _words(F.col("title")).alias("head"), _words(F.col("text")).alias("body"))
    last = F.coalesce(F.array_max(F.transform("head", lambda w, i: F.when(~w.isin(STOP), i + 1).otherwise(0))), F.lit(0))
    t = t.withColumn("base", last)
    title = t.select("chunk_id", F.lit(0).alias("base"), F.lit(TITLE_WEIGHT).alias("weight"), F.posexplode("head").alias("i", "word"))
    text = t.select("chunk_id", "base", F.lit(TEXT_WEIGHT).alias("weight"), F.posexplode("body").alias("i", "word"))
    return title.unionByName(text).where(~F.col("word").isin(STOP)).select("chunk_id", (F.col("base") + F.col("i") + 1).alias("at"), "weight", "word")


def search(queries: DataFrame, chunks: DataFrame, k: int = 30) -> DataFrame:
    """queries (query_id, query) over chunks (chunk_id, title, text): the best k chunks that fulfil each query.

    Null or empty queries and queries of stop words find nothing; null titles and texts have no words.
    """

    @F.arrow_udf(_QUERY)
    def parsed(q: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.struct([("no", pa.bool_()), ("words", pa.list_(pa.string())), ("steps", pa.list_(pa.int32()))])))
        return pa.array([[[{"no": n, "words": w, "steps": p} for n, w, p in g] for g in parse(s)] for s in q.to_pylist()], kind)

    @F.arrow_udf("string")
    def stems(w: pa.Array) -> pa.Array:
        return pa.array([stem(x) for x in w.to_pylist()], pa.string())

    @F.arrow_udf("double")
    def rated(groups: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([cover_density(g, h) for g, h in zip(groups.to_pylist(), hits.to_pylist(), strict=True)], pa.float64())

    read = written(queries.select("query_id", parsed(F.coalesce("query", F.lit(""))).alias("groups")).where("size(groups) > 0"))
    single = F.forall("groups", lambda g: (F.size(g) == 1) & F.forall(g, lambda t: ~t["no"] & (F.size(t["words"]) == 1)))
    counted = _any_word(read.where(single), chunks, k, stems)
    asked = written(read.where(~single))
    if not asked.limit(1).count():
        return ranked(counted, k, k)
    wanted = asked.select("query_id", F.explode(F.flatten("groups")).alias("t")).select("query_id", F.explode("t.words").alias("lexeme")).distinct()
    places = word_places(chunks)
    vocabulary = chunks.select(F.explode(F.array_distinct(_words(F.concat_ws(" ", "title", "text")))).alias("word")).distinct()
    forms = written(vocabulary.withColumn("lexeme", stems("word")).join(sent(wanted.select("lexeme").distinct(), 2_000_000), "lexeme", "left_semi"))
    hits = places.join(sent(forms, 2_000_000), "word").join(sent(wanted, 2_000_000), "lexeme").groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("at", "weight", "lexeme")).alias("hits"))
    # most pairs lack a word of each alternative: they go before anything is handed to Python
    both = hits.join(sent(asked), "query_id").withColumn("have", F.array_distinct(F.transform("hits", lambda h: h["lexeme"])))
    fit = F.exists("groups", lambda g: F.forall(g, lambda t: t["no"] | (F.size(F.array_except(t["words"], F.col("have"))) == 0)))
    found = both.where(fit).select("query_id", "chunk_id", rated("groups", "hits").alias("score")).where("score is not null")
    return ranked(found.withColumn("score", F.round("score", 9)).unionByName(counted), k, k)


def _any_word(asked: DataFrame, chunks: DataFrame, k: int, stems) -> DataFrame:
    """(query_id, chunk_id, score) of queries that ask for any of single words; groups: each one word.

    There every place of a searched word is a shortest stretch of its own, so the sum of a chunk's stretches is the sum of its places' weights:
    counts of words are all that is needed. Only rows that may be among the best k of their query are handed on.
    """
    t = chunks.select("chunk_id", _words(F.col("title")).alias("head"), _words(F.col("text")).alias("body"))
    terms = asked.select("query_id", F.lit(0).cast("long").alias("scope"), F.array_distinct(F.transform(F.flatten("groups"), lambda x: x["words"][0])).alias("terms"))
    terms = written(terms.withColumns({"phrase": F.lit(""), "quoted": F.array().cast("array<string>")}))
    parts = []
    for block in query_blocks(terms, "terms", 1, matching.TILE // 32):
        words = matching.Asked.read(block)
        parts.append(matching.named(_weighed(t, words, k), block, asked.schema["query_id"]))
    return matching.union(parts)


def _weighed(texts: DataFrame, asked: matching.Asked, k: int) -> DataFrame:
    """(chunk_id, q, score) from texts (chunk_id, head, body)."""
    schema = T.StructType([texts.schema["chunk_id"], T.StructField("q", T.IntegerType()), T.StructField("score", T.DoubleType())])
    questions, stops = len(asked.need), pa.array(STOP)

    def of(batches):
        best, known = matching.Least(questions, k), {}
        places = {w: i for i, w in enumerate(asked.terms.to_pylist())}
        for part in matching.tiles(batches, questions):
            total = np.zeros(part.num_rows * questions)
            for column, weight in (("head", TITLE_WEIGHT), ("body", TEXT_WEIGHT)):
                flat = part.column(column).flatten().dictionary_encode()
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(column)).to_numpy(zero_copy_only=False))
                stop = pc.is_in(flat.dictionary, value_set=stops).to_pylist()
                term = np.array([-1 if no else _place(w, places, known) for w, no in zip(flat.dictionary.to_pylist(), stop, strict=True)], np.int64)[flat.indices.to_numpy()]
                # one scope: the ids of words are the places of terms
                total += weight * np.bincount(asked.met(row[term >= 0], term[term >= 0])[1], minlength=len(total))
            s = (total / (total + 1)).reshape(part.num_rows, questions)
            s[s == 0] = -np.inf
            r, q = np.nonzero(best.keep(s))
            yield pa.RecordBatch.from_arrays([part.column("chunk_id").take(pa.array(r)), pa.array(q.astype(np.int32)), pa.array(s[r, q])], names=schema.names)

    return texts.mapInArrow(of, schema)


def _place(word: str, places: dict[str, int], known: dict[str, int]) -> int:
    """The place of a word's stem among the searched ones, -1 for none; known: words met before, no more than a million."""
    at = known.get(word)
    if at is None:
        if len(known) >= 1_000_000:
            known.clear()
        at = known[word] = places.get(stem(word), -1)
    return at
