"""Words found in whole batches are those of the column functions; a long document is cut in time that grows with its words."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions import batches
from quern.functions import text as X
from quern.operators import chunking, matching, retrieval, vectors

ODD = ["", None, "   ", "a", "The Cat's  cat_1\tsat.", "É naïve İstanbul x\x00y ' ''", "one\x1ctwo\x0bthree four", "- like -"]


def test_words_of_batches_are_those_of_columns(spark):
    texts = pa.array(ODD, pa.string())
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").select("i", X.keyword_tokens(F.col("t")).alias("k"), X.keyword_phrase(F.col("t")).alias("p"), F.split(X.squeeze(F.coalesce("t", F.lit(""))), " ").alias("s")).orderBy("i").collect()
    for part in (texts, pa.concat_arrays([pa.array(["before", None]), texts, pa.array(["after"])]).slice(2, len(texts))):
        assert batches.keywords(part).to_pylist() == [r.k for r in rows]
        assert batches.spaced(part).to_pylist() == [[w for w in r.s if w] for r in rows]
    assert [batches.phrase(t or "") for t in ODD] == [r.p for r in rows]


def test_windows_at_their_edges():
    texts = pa.array([" ".join(map(str, range(n))) for n in (1, 4, 5, 7, 8)] + [" ", None], pa.string())
    row, window, n, text = batches.windows(texts, 4, 3)
    assert list(zip(row.tolist(), window.tolist(), text.to_pylist())) == [(0, 0, "0"), (1, 0, "0 1 2 3"), (2, 0, "0 1 2 3"), (2, 1, "3 4"), (3, 0, "0 1 2 3"), (3, 1, "3 4 5 6"), (4, 0, "0 1 2 3"), (4, 1, "3 4 5 6"), (4, 2, "6 7")]
    assert n.tolist() == [1, 4, 5, 5, 7, 7, 8, 8, 8]


def test_scores_need_no_arrays_of_all_words(spark):
    """Chunks and their stored index score alike; chunks go to the scores as texts."""
    chunks = spark.createDataFrame([("a", "Red house", "the Door", 'a red "old house" by the sea'), ("b", None, None, "sea and house"), ("c", "", "", None)], "chunk_id string, title string, section_title string, text string")
    asked = spark.createDataFrame([(1, "red house"), (2, 'sea "old house"'), (3, "house by the sea")], "query_id long, query string")
    for most in (None, 1):
        got = [sorted(retrieval.bm25_scores(asked, c, most).collect()) for c in (chunks, retrieval.index(chunks))]
        assert got[0] == got[1] and got[0]
    words = matching.Asked.read(retrieval._asked(asked, None).toArrow())
    plan = matching.posted(chunks.withColumn("scope", F.lit(0).cast("long")), words, 0.35, 0.25)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "lambda" not in plan


def test_windows_carry_no_words_of_the_document(spark):
    plan = chunking.word_windows(chunking.whole(spark.createDataFrame([("d", "a b")], "document_id string, text string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "split(" not in plan


def test_semantic_chunks_shuffle_no_sentences(spark):
    """Each section is one row from end to end; odd bodies give their sentences, or nothing."""
    say = " ".join(f"{w} " * 150 + f"{w}." for w in ("Red", "Red", "Sea", "Sea", "Sea"))
    parts = spark.createDataFrame([("a", 0, None, say), ("b", 0, "Red", say), ("c", 0, None, None), ("d", 0, None, " \n"), ("e", 0, "One", "One. Two!"), ("f", 1, None, "naïve")], "document_id string, section_index int, title string, body string")
    out = chunking.semantic(parts)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {(r.document_id, r.window): r.text for r in out.collect()}
    assert " ".join(t for (d, _), t in sorted(rows.items()) if d == "a") == " ".join(say.split())
    assert [len(rows["a", w].split()) for w in range(2)] == [302, 453] and rows["b", 0].startswith("Red\n\nRed ")
    assert {k: t for k, t in rows.items() if k[0] in "cdef"} == {("e", 0): "One. Two!", ("f", 0): "naïve"}


def test_hashes_of_words_are_kept_up_to_a_number():
    """More words than a task keeps are hashed all the same, and what is kept doesn't grow with the batches."""
    known, usual, vectors.KNOWN = {}, vectors.KNOWN, 5
    try:
        for k in range(4):
            words = [f"é{k}{i}" for i in range(5)] + ["red", "red"]
            v = vectors.batch_vectors(pa.array([" ".join(words), None]), 64, known)
            c = np.bincount([hashlib.sha1(w.encode()).digest()[-1] % 64 for w in words], minlength=64)
            assert np.allclose(v[0], c / np.sqrt((c * c).sum())) and not v[1].any()
    finally:
        vectors.KNOWN = usual
    assert len(known) == 6
