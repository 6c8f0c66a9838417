"""Libraries: folders kept in step, restarts, broken-off changes, answers from stored tables."""

import os

import pytest
from pyspark.sql import functions as F

from quern.config import Config
from quern.operators import vectors
from quern.plans import answer as plans
from quern.plans.library import Library
from quern.streaming.ingest import library_stream


def put(folder, **texts):
    for name, text in texts.items():
        p = folder / name.replace("_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def state(lib):
    """{title: n_chunks} by each table, checked against one another."""
    titles = {r.document_id: r.title for r in lib.read("documents").collect()}
    count = lambda t: {r.document_id: r.n for r in lib.read(t).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = count("chunks")
    assert chunks == count("vectors") and set(chunks) == set(titles)
    index = lib.corpus().keywords
    if index:
        held = index.chunks.read(number=index._now()[1]).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        assert {r.document_id: r.n for r in held.collect()} == chunks
    return {titles[d]: n for d, n in chunks.items()}


def test_a_folder_is_kept_in_step(spark, tmp_path):
    lib, root = Library(spark, f"file://{tmp_path}/lib", buckets=512), tmp_path / "in"
    put(root, a_md="# Head\ncats sleep " + "word " * 1300, b_txt="dogs bark", c_html="<h1>Birds</h1><p>sing</p>", d_bin="?", e_txt=" ")
    assert lib.sync(f"file://{root}") == {"read": 5, "ingested": 3, "failed": 2, "deleted": 0}
    first = state(lib)
    assert set(first) == {"a.md", "b.txt", "c.html"} and first["a.md"] == 3
    before = {n: t.version().files for n, t in lib.tables.items()}
    assert lib.sync(f"file://{root}", ["md", ".TXT", "html"]) == {"read": 1, "ingested": 0, "failed": 1, "deleted": 0}
    # touched but the same, changed, new, vanished
    os.utime(root / "b.txt", (1, 1))
    put(root, a_md="# Head\ncats run", f_csv="h,i\n1,2\n")
    (root / "c.html").unlink()
    got = lib.sync(f"file://{root}", ["md", "txt", "html", "csv"])
    assert got["deleted"] == 1 and got["ingested"] == 2 and state(lib) == {"a.md": 1, "b.txt": 1, "f.csv": 1}
    after = {n: set(t.version().files) for n, t in lib.tables.items()}
    assert any(set(before[n]) & after[n] for n in before)  # files of other documents stay
    assert lib.vacuum() > 0 and state(lib) == {"a.md": 1, "b.txt": 1, "f.csv": 1}
    ids = lib.read("documents").where("title = 'b.txt'").select("document_id")
    assert lib.delete(ids) == 1 and lib.delete(ids) == 0 and "b.txt" not in state(lib)


def test_a_stream_takes_each_batch_once(spark, tmp_path, monkeypatch):
    lib, root = Library(spark, f"file://{tmp_path}/lib", buckets=4), tmp_path / "in"
    run = lambda: library_stream(lib, f"file://{root}", f"{tmp_path}/cp").awaitTermination()
    put(root, a_txt="one text", b_txt="another text")
    run()
    assert state(lib) == {"a.txt": 1, "b.txt": 1}
    # the batch breaks off after its tables were written, before its head
    put(root, c_txt="third text")
    commit = lib._commit
    monkeypatch.setattr(lib, "_commit", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="zero|ZeroDivision|foreachBatch"):
        run()
    assert state(lib) == {"a.txt": 1, "b.txt": 1}
    monkeypatch.setattr(lib, "_commit", commit)
    run()
    assert state(lib) == {"a.txt": 1, "b.txt": 1, "c.txt": 1}
    n = lib.head()["number"]
    # the head is there but the stream doesn't know: its checkpoint forgets the batch
    for f in (tmp_path / "cp/commits").iterdir():
        if f.name.strip(".").startswith("1"):
            f.unlink()
    run()
    assert lib.head()["number"] == n and state(lib) == {"a.txt": 1, "b.txt": 1, "c.txt": 1}


def test_answers_from_stored_tables(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib", buckets=4)
    docs = spark.createDataFrame([(f"d{i}", f"Cats number {i} sleep on the mat all day. Dogs bark at night for {i} hours. Nothing else.", "text", "T") for i in range(12)], "document_id string, text string, file_type string, title string")
    assert {r.status for r in lib.change(docs).collect()} == {"ok"}
    lib.change(spark.createDataFrame([("d3", "Birds sing early in the morning.", "text", "T"), ("d4", " ", "text", "T")], docs.schema), docs.where("document_id = 'd7'").select("document_id"))
    corpus = lib.corpus()
    assert corpus.keywords and corpus.chunks.count() == 11
    q = spark.createDataFrame([(1, "cats sleep"), (2, "compare birds that sing and dogs"), (3, "unheard of")], "query_id int, query string")
    plain = plans.Corpus(corpus.chunks, vectors.hash_vectors(corpus.chunks.withColumn("e", F.concat_ws("\n\n", F.concat_ws(" - ", "document_id", "title"), "text")), "chunk_id", "e"))
    cols = ["query_id", "context", "confidence", "coverage_gaps", "answer"]
    assert sorted(map(str, plans.answer(q, corpus).select(cols).collect())) == sorted(map(str, plans.answer(q, plain).select(cols).collect()))
    assert lib.reindex(docs.where("document_id in ('d1', 'd7')").select("document_id")) == 1 and lib.reindex() == 11


def test_a_change_leaves_no_temporary_tables(spark, tmp_path):
    from quern.sources import tables

    made = []

    def save(df):
        made.append(tables.written(df))
        return made[-1]

    lib = Library(spark, f"file://{tmp_path}/lib", Config(chunker="word", adaptive_chunking=False), buckets=2, save=save)
    docs = spark.createDataFrame([("a", "one two three", "text", "A"), ("b", "four five", "text", "B"), ("c", " \t", "text", "C")], "document_id string, text string, file_type string, title string")
    results = lib.change(docs)
    lib.reindex()
    assert len(made) > 5 and [t for t in made if t in tables._PATHS] == [results]
    assert {r.document_id: r.status for r in results.collect()} == {"a": "ok", "b": "ok", "c": "error"}
    assert {r.document_id for r in lib.read("chunks").collect()} == {r.document_id for r in lib.read("vectors").collect()} == {r.document_id for r in lib.read("documents").collect()} == {"a", "b"}
