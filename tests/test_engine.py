"""Operators on literal rows, and registered queries against their SQL."""

import math
import random
import re
from numbers import Number

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern import queries as engine
from quern.config import Config, load_config
from quern.functions import queries as Q
from quern.functions import text as X
from quern.operators import chunking, evaluate, evidence, ranking, retrieval, vectors
from quern.plans import ingest
from quern.sources import files, store


def text_docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "document_id string, text string")


# --- chunks ---


def test_windows_overlap_and_blank_texts(spark):
    d = text_docs(spark, a=" ".join(f"w{i}" for i in range(1500)), b="  ", c="short text")
    rows = {r.chunk_id: r.text.split() for r in chunking.numbered(chunking.word_windows(chunking.whole(d))).collect()}
    assert rows["a:0"][-100:] == rows["a:1"][:100] and set(rows) == {"a:0", "a:1", "a:2", "c:0"}


@pytest.mark.parametrize(("size", "overlap"), [(10, 10), (10, -1), (0, 0)])
def test_window_parameters(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.word_windows(chunking.whole(text_docs(spark, a="x")), size, overlap)


def test_sections(spark):
    d = text_docs(spark, a="Intro here.\n# Alpha\nbody one\n### Deep\nmore\n2. Second Chapter\nline\n\nend line\n4.1 Not Heading\n## Gamma ##\nlast", b="no heading", c="1. this is a list item, which goes on and on\ntext")
    got = {(r.document_id, r.section_index): (r.title, r.body) for r in chunking.sections(d).collect()}
    assert got["a", 0][0] is None and got["a", 1] == ("Alpha", "body one\n### Deep\nmore") and got["a", 2][0] == "2. Second Chapter" and got["a", 3] == ("Gamma", "last")
    assert got["b", 0] == (None, "no heading") and ("c", 1) not in got


def test_children_have_the_parent_that_holds_them(spark):
    d = text_docs(spark, a="# T\n" + " ".join(f"w{i}" for i in range(4000)))
    for r in chunking.hierarchical(chunking.sections(d)).collect():
        assert set(r.text.split()[1:]) <= set(r.parent_text.split())


def test_semantic_groups_keep_their_bounds(spark):
    d = text_docs(spark, a=". ".join(f"Topic {i // 40} says thing number {i} with some more words here" for i in range(300)) + ".")
    rows = chunking.semantic(chunking.sections(d)).orderBy("window").collect()
    assert len(rows) > 1 and all(len(r.text.split()) >= 200 for r in rows) and sum(len(r.text.split()) for r in rows) == 300 * 11


def test_chunker_choice(spark):
    long = "word " * 3000
    heads = "\n".join(f"# Head {i}\n" + "text " * 300 for i in range(6))
    d = spark.createDataFrame([("a", "short", "text"), ("b", long, "pdf"), ("c", heads, "markdown"), ("d", long, "csv"), ("e", long * 2, "text")], "document_id string, text string, file_type string")
    assert {r.document_id: r.chunker for r in chunking.choose(d).collect()} == {"a": "word", "b": "semantic", "c": "hierarchical", "d": "word", "e": "semantic"}
    assert chunking.chunk(d).groupBy("document_id").count().count() == 5


# --- questions ---


@pytest.fixture(scope="module")
def asked(spark):
    rows = ["what was the mvp rag, im curious can you precisely give me this", "What is the Retrival SYSEM?", "im curious", "???", "", None, 'error in "exact phrase" ABC-12 `foo()`', "compare a vs b", "How is X? then also why is the kb slow?"]
    return {r.query: r for r in Q.with_rewrite(spark.createDataFrame([(q,) for q in rows], "query string"), "query").withColumn("u", Q.understand(F.col("query"))).withColumn("r", Q.route(F.col("query"), F.col("u"))).withColumn("p", Q.plan(F.col("u"))).collect()}


def test_cleaning(asked):
    assert asked["what was the mvp rag, im curious can you precisely give me this"].rw.cleaned == "what was the mvp rag"
    assert asked["What is the Retrival SYSEM?"].rw.cleaned == "What is the Retrieval SYSTEM"
    assert asked["im curious"].rw.cleaned == "im curious" and asked["???"].rw.cleaned == "???" and asked[""].rw.cleaned == "" == asked[None].rw.cleaned


def test_classes_and_plans(asked):
    q = asked['error in "exact phrase" ABC-12 `foo()`']
    assert q.u.query_type == "troubleshooting" and q.u.exact_match and q.rw.must_have == ["exact phrase", "ABC-12", "foo()"]
    assert (q.p.keyword_top_k, q.p.vector_top_k, q.p.rerank_top_k) == (67, 45, 25)
    assert asked["compare a vs b"].r.strategy == "deep" and asked["im curious"].r.strategy == "simple"
    assert asked["How is X? then also why is the kb slow?"].r.strategy == "agentic"


def test_lists_of_questions(spark):
    d = spark.createDataFrame([("how do cats sleep; why do dogs bark loudly? Also x",), ("one thing only here",)], "q string")
    got = [r[0] for r in d.select(Q.decompose(F.col("q"))).collect()]
    assert got == [["how do cats sleep", "why do dogs bark loudly"], ["one thing only here"]]
    lines = spark.createDataFrame([('1. first thing\n- "second thing"\n* First thing\nx',)], "q string").select(Q.parse_lines(F.col("q"))).first()[0]
    assert lines == ["first thing", "second thing"]


def test_retry(spark):
    d = spark.createDataFrame([(None, 0), (0.1, 0), (0.9, 2), (0.9, 0)], "top double, n int")
    assert [r[0].reason for r in d.select(Q.retry_decision(F.col("top"), F.col("n"), 0.3)).collect()] == ["no_results", "low_rerank_below_0.3", "coverage_gaps", "above_floor"]
    q = spark.createDataFrame([("Find the cat", ["Cat", "dog"], ["bird", "DOG"]), ("a cat", ["cat"], [])], "q string, m array<string>, g array<string>")
    assert [r[0] for r in q.select(Q.retry_query(F.col("q"), F.col("m"), F.col("g"))).collect()] == ["Find the cat dog bird", None]


# --- retrieval and ranking ---


def rows(spark, *items):
    base = dict(query_id=1, query="cat dog", source_id="s", chunk_index=0, title="", section_title=None, score=0.5, vector_score=0.5, keyword_score=0.0, rerank_score=0.5, text="some text", sources=["vector"])
    cols = "query_id int, query string, source_id string, chunk_index int, title string, section_title string, score double, vector_score double, keyword_score double, rerank_score double, text string, sources array<string>, chunk_id string"
    return spark.createDataFrame([tuple({**base, **x}[c.split()[0]] for c in cols.split(", ")) for x in items], cols)


def test_fusion(spark):
    leg = lambda *x: spark.createDataFrame([(1, c, s) for c, s in x], "query_id int, chunk_id string, score double")
    got = {r.chunk_id: r for r in retrieval.fuse(leg(("a", 3.0), ("b", 1.0)), leg(("b", 0.9), ("c", 0.1))).collect()}
    assert (got["a"].score, got["b"].score, got["c"].score) == (0.45, 0.55, 0.0) and got["b"].sources == ["keyword", "vector"]
    assert [r.score for r in retrieval.fuse(leg(("a", 3.0)), leg()).collect()] == [0.45]


def test_expansion(spark):
    chunks = spark.createDataFrame([(f"d:{i}", "d", i) for i in range(6)], "chunk_id string, document_id string, chunk_index int")
    top = spark.createDataFrame([(1, "d:2", 1.0, 1), (1, "d:3", 0.5, 2)], "query_id int, chunk_id string, score double, rank int")
    got = {r.chunk_id: r for r in retrieval.expand(top, chunks).collect()}
    assert set(got) == {"d:1", "d:2", "d:3", "d:4"} and got["d:1"].score == 0.6 and got["d:4"].parent_chunk_id == "d:3"
    assert retrieval.expand(top, chunks, 0).count() == 2


def test_dedupe_rules(spark):
    r = rows(spark, dict(chunk_id="a", score=0.9, text="Same  text here", chunk_index=1), dict(chunk_id="a", score=0.5, chunk_index=7), dict(chunk_id="b", score=0.8, source_id="t", text="same text here"), dict(chunk_id="c", score=0.7, chunk_index=2, text="next one"), dict(chunk_id="d", score=0.6, chunk_index=3, text="third one"))
    assert {x.chunk_id for x in ranking.dedupe(r).collect()} == {"a", "d"}
    assert {x.chunk_id for x in ranking.dedupe_exact(r).collect()} == {"a", "c", "d"}
    like = " ".join(f"w{i}" for i in range(60))
    r = rows(spark, dict(chunk_id="a", score=0.9, text=like), dict(chunk_id="b", score=0.8, chunk_index=5, text=like + " end"))
    assert [(x.chunk_id, x.dupes_absorbed) for x in ranking.dedupe(r).collect()] == [("a", 1)]


def kept_one_by_one(rows, threshold=0.85):
    """Best rows first: each stays unless it repeats, nearly repeats or stands beside one that stayed."""
    said = lambda r: " ".join(r["text"].lower().split())

    def shingles(r):
        w = re.findall(r"[a-z0-9]+", r["text"].lower())
        return {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    kept, absorbed = [], {}
    for r in sorted(rows, key=lambda r: (-r["score"], r["chunk_id"])):
        same = [k for k in kept if k["chunk_id"] == r["chunk_id"] or (k["source_id"], k["chunk_index"]) == (r["source_id"], r["chunk_index"]) or said(r) and said(k) == said(r)]
        if same:
            continue
        near = [k for k in kept if k["source_id"] == r["source_id"] and len(shingles(k) & shingles(r)) >= threshold * len(shingles(k) | shingles(r)) > 0]
        if near:
            absorbed[near[0]["chunk_id"]] = absorbed.get(near[0]["chunk_id"], 0) + 1
            continue
        section = [k for k in kept if (k["source_id"], k["section_title"]) == (r["source_id"], r["section_title"])]
        if section and abs(section[0]["chunk_index"] - r["chunk_index"]) == 1:
            continue
        kept.append(r)
    return {(r["chunk_id"], absorbed.get(r["chunk_id"], 0)) for r in kept}


def test_dedupe_equals_the_walk_over_rows(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(30)}" for _ in range(40)] for _ in range(4)]
    made = []
    for i in range(90):
        t = rng.choice(base).copy()
        if rng.random() < 0.6:
            t[rng.randrange(40)] = "other"
        made.append(dict(query_id=1, chunk_id=f"c{rng.randrange(70)}", score=rng.randrange(50) / 50, source_id=rng.choice("st"), chunk_index=rng.randrange(12), section_title=rng.choice(["", "A", "B"]), text=" ".join(t) if rng.random() < 0.9 else ""))
    made = list({(m["score"], m["chunk_id"]): m for m in made}.values())
    got = ranking.dedupe(rows(spark, *made)).collect()
    assert {(r.chunk_id, r.dupes_absorbed) for r in got} == kept_one_by_one(made) and 3 < len(got) < 40


def test_section_terms_count(spark):
    chunks = spark.createDataFrame([("a", "", "Cooling pumps", "the pumps run"), ("b", "", "", "the pumps run"), ("c", "Pumps", "", "nothing else")], "chunk_id string, title string, section_title string, text string")
    asked = spark.createDataFrame([(1, "cooling pumps")], "query_id int, query string")
    got = {r.chunk_id: r.score for r in retrieval.bm25_scores(asked, chunks).collect()}
    plain = {r.chunk_id: r.score for r in retrieval.bm25_scores(asked, chunks.drop("title", "section_title")).collect()}
    assert set(got) == {"a", "b", "c"} and set(plain) == {"a", "b"}
    # both terms stand in a's section: .25 each, besides what they add as words
    n, avg = 3, (4 + 2 + 3) / 3  # the article is no term
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    tf = lambda f, dl: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avg))
    assert abs(got["a"] - (0.5 + idf(1) * tf(1, 4) + idf(3) * tf(2, 4))) < 1e-6
    assert got == {r.chunk_id: r.score for r in retrieval.bm25_scores(asked, retrieval.index(chunks)).collect()}


def test_a_failing_reranker_falls_back_for_the_whole_query(spark):
    def scores(queries, texts):
        if "bad" in texts:
            raise ValueError("no model")
        return [len(t) for t in texts]

    made = [dict(query_id=q, chunk_id=f"{q}{i}", score=i / 10, text="bad" if (q, i) == (1, 3) else "x" * (10 - i)) for q in (1, 2) for i in range(5)]
    r = rows(spark, *made).repartition(10, "chunk_id")
    got = {x.chunk_id: x for x in ranking.rerank_with(r, scores).collect()}
    assert [round(got[f"1{i}"].rerank_score, 9) for i in range(5)] == [0, 0.25, 0.5, 0.75, 1] and got["10"].rerank_error == "ValueError: no model"
    assert got["20"].rerank_score == 1 and got["20"].rerank_error is None


def test_mmr_and_budget(spark):
    r = rows(spark, dict(chunk_id="a", rerank_score=0.9, text="cats sleep"), dict(chunk_id="b", rerank_score=0.89, chunk_index=1, text="cats sleep well"), dict(chunk_id="c", rerank_score=0.8, source_id="t", text="stock prices"))
    pick = lambda **k: [x.chunk_id for x in ranking.mmr(r, **k).orderBy("pick").collect()]
    assert pick() == ["a", "c", "b"] and pick(lam=1.0) == ["a", "b", "c"] and pick(max_chunks=0) == ["a"] and pick(max_tokens=1) == ["a"]
    ten = rows(spark, *(dict(chunk_id=f"c{i}", rerank_score=1 - i / 10, text="x" * 40) for i in range(10)))
    got = ranking.within_budget(ranking.cut(ten, 10), 25, 10).collect()
    assert len(got) == 2 and max(x.used for x in got) == 20


def test_compression(spark):
    text = "Nothing here at all today. The cat sat on the mat for long. Something else entirely follows. And one more unrelated sentence here."
    got = ranking.compress(rows(spark, dict(chunk_id="a", text=text), dict(chunk_id="b", text="no match in this text at all"), dict(chunk_id="c", text=text, query="the of"))).collect()
    assert {x.chunk_id: x.compressed for x in got} == {"a": text[: text.index(" And one")], "b": "no match in this text at all", "c": text}


def test_evidence_without_rows_is_empty(spark):
    q = spark.createDataFrame([(1, "cat dog", "cat dog"), (2, "bird", "bird")], "query_id int, query string, rewritten string")
    r = ranking.cut(rows(spark, dict(chunk_id="a", text="a cat")), 5).withColumn("pick", F.lit(1)).withColumn("compressed", F.col("text"))
    got = {x.query_id: x for x in evidence.package(q, r, r).withColumn("answer", evidence.passthrough_answer(F.col("context"))).collect()}
    assert got[1].coverage_gaps == ["dog"] and got[1].confidence == 0.5 and got[1].answer == "[1] a cat"
    assert got[2].confidence == 0.0 and got[2].answer.startswith("No evidence") and got[2].usage.returned_chunks == 0


def test_vectors(spark):
    d = spark.createDataFrame([("a", "Cat cat dog"), ("b", "  "), ("c", None)], "k string, t string")
    one = {r.k: r.vec for r in vectors.hash_vectors(d, "k", "t").collect()}
    two = {r.k: r.vec for r in vectors.with_hash_vector(d, "t").collect()}
    assert one == two and math.isclose(sum(x * x for x in one["a"]), 1) and not any(one["b"]) and not any(one["c"])


def test_uuid5(spark):
    import uuid

    got = spark.createDataFrame([("default:x:1",)], "n string").select(X.uuid5_url(F.col("n"))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "default:x:1"))


# --- evaluation, sources, settings ---


def test_report_leaves_errors_out(spark):
    r = spark.createDataFrame([("a", True, True, True, 1.0, None), ("b", False, False, False, 0.0, "bad"), ("c", False, True, True, 0.5, None)], "id string, hit_at_1 boolean, hit_at_3 boolean, hit_at_5 boolean, rr double, error string")
    got = evaluate.report(r).first()
    assert (got.total, got.errors, got.recall_at_1, got.mrr) == (3, 1, 0.5, 0.75)
    assert evaluate.report(r.limit(0)).first().mrr == 0.0


def test_store(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, x int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "document_id string, x int")
    assert sorted(map(tuple, store.upsert(old, new, "document_id").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    left, gone = store.delete(old, new)
    assert [r.document_id for r in left.collect()] == ["a"] and gone.first().deleted == 1


def test_ingest_replaces_and_reports(spark):
    schema = "document_id string, text string, file_type string, title string"
    first, _ = ingest.ingest(spark.createDataFrame([("a", "word " * 1500, "text", "A"), ("b", "other text", "text", "B")], schema))
    docs = spark.createDataFrame([("a", "now short", "text", "A2"), ("c", " \n", "text", None), (None, "x", "text", "N"), ("d", None, "text", "D"), ("e", "twice", "text", "E"), ("e", "twice", "text", "E")], schema)
    now, results = ingest.ingest(docs, first)
    assert sorted((r.document_id or "", r.status, r.error_stage, r.n_chunks) for r in results.collect()) == [("", "error", "validate", 0), ("a", "ok", None, 1), ("c", "error", "extract", 0), ("d", "error", "extract", 0), ("e", "ok", None, 1), ("e", "repeated", None, 0)]
    assert sorted(map(tuple, now.documents.select("document_id", "title").collect())) == [("a", "A2"), ("b", "B"), ("e", "E")]
    ids = lambda t: sorted(r.chunk_id for r in t.collect())
    assert ids(now.chunks) == ids(now.vectors) == ["a:0", "b:0", "e:0"]
    again = ingest.reindex(now, spark.createDataFrame([("a",)], "document_id string"))
    assert sorted(map(str, again.vectors.collect())) == sorted(map(str, now.vectors.collect())) == sorted(map(str, ingest.reindex(now).vectors.collect()))
    left, gone = ingest.drop(now, spark.createDataFrame([("b",), ("z",)], "document_id string"))
    assert ids(left.chunks) == ids(left.vectors) == ["a:0", "e:0"] and gone.first().deleted == 1
    none, results = ingest.ingest(docs.limit(0))
    assert none.chunks.count() == none.vectors.count() == results.count() == 0


def test_golden_and_files(spark, tmp_path):
    g = tmp_path / "g.jsonl"
    g.write_text('# note\n\n{"id": "1", "query": "q", "expectedSubstrings": ["x"]}\nnot json\n')
    got = store.read_golden(spark, str(g)).collect()
    assert [r.error is None for r in got] == [True, False] and got[0].expected_substrings == ["x"]
    (tmp_path / "d").mkdir()
    for name, body in {"a.md": b"# T\ntext", "b.html": b"<h1>Head</h1><p>para &amp; more</p><script>x</script>", "c.csv": b"h,i\n1,2\n", "d.bin": b"?", "e.txt": b" \n"}.items():
        (tmp_path / "d" / name).write_bytes(body)
    rows = {r.path[-6:].strip("/"): r for r in files.extract(files.read_folder(spark, str(tmp_path / "d"))).collect()}
    assert rows["b.html"].text == "# Head\npara & more" and rows["/c.csv".strip("/")].text.startswith("| h | i |")
    assert sorted(r.error_stage or "ok" for r in rows.values()) == ["extract", "ok", "ok", "ok", "validate"]


def test_stream(spark, tmp_path):
    from quern.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello stream of words")
    ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["hello stream of words"]


def test_settings():
    assert load_config({"QUERN_CHUNK_SIZE": "50", "QUERN_CHUNK_OVERLAP": "5", "QUERN_HYBRID": "no", "QUERN_MAX_TOKENS": "x"}) == Config(chunk_size=50, chunk_overlap=5, hybrid=False)


def _rows(d, cols):
    return sorted([tuple("" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, Number) else str(x) for x in r) for r in d[cols].itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_queries_equal_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "events", "embeddings", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = engine.QUERIES[name](spark, data).toPandas(), con.execute(engine.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(got.columns)) == _rows(want, sorted(got.columns))
