"""Filters for each question, metadata, and the trace of a plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import metadata as M
from quern.operators import retrieval, routed, vectors
from quern.plans import answer as plans
from quern.plans.trace import Trace
from quern.sources.tables import written

CHUNK = "workspace_id string, source_type string, document_id string, chunk_id string, title string, section_title string, text string"


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{min(int(rng.expovariate(0.06)), 60)}" for _ in range(n))
    rows = [(f"ws{i % 3}", f"t{i % 4}", f"d{i // 2}", f"d{i // 2}:{i % 2}", say(2), say(1), say(30)) for i in range(240)]
    path = f"file://{tmp_path_factory.mktemp('chunks')}/c"
    routed.store(spark.createDataFrame(rows, CHUNK), path)
    return routed.stored(spark, path)


def rows(d):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in d.collect())


def test_each_question_searches_its_own_scope(spark, chunks):
    asked = [(1, "w1 w7 w20", None, None, None), (2, "w1 w7 w20", "ws1", [], []), (3, "w2 w3", "ws2", ["t1", "t0", "t1", None], None), (4, "w2 w3", "", ["t0", "t1"], ["d1", "d4", "d6"]), (5, "w5", "nowhere", None, None), (6, "w2 w3", "ws2", ["t0", "t1"], None), (7, None, "ws1", None, None)]
    q = spark.createDataFrame(asked, "query_id int, query string, workspace_id string, source_types array<string>, document_ids array<string>")
    got = rows(routed.bm25_top_k(q, chunks, 6))
    want = []
    for i, text, ws, types, docs in asked:
        some = retrieval.filtered(chunks, ws, [t for t in types or [] if t], docs)
        want += rows(retrieval.bm25_top_k(spark.createDataFrame([(i, text)], "query_id int, query string"), some, 6))
    assert got == sorted(want) and {r[0] for r in got} == {1, 2, 3, 4, 6}
    scopes = {r.query_id: r.scope for r in routed.scoped(q).collect()}
    assert scopes[3] == scopes[6] and len(set(scopes.values())) == 5


def test_partitions_are_pruned(spark, chunks):
    scopes = routed.scoped(spark.createDataFrame([(1, "x", "ws1", ["t1"])], "query_id int, query string, workspace_id string, source_types array<string>")).select("scope", "workspace_id", "source_types", "document_ids")
    near = routed.in_scope(chunks, scopes)
    plan = near._jdf.queryExecution().explainString(near.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: .*workspace_id#\d+ = ws1\), \(source_type#\d+ = t1\)", plan)
    assert {(r.workspace_id, r.source_type) for r in near.collect()} == {("ws1", "t1")}


def test_the_keyword_leg_can_be_left_out(spark):
    from quern.config import Config

    chunks = spark.createDataFrame([(f"d{i}:0", f"d{i}", f"s{i}", 0, "T", None, f"cats sleep on mat {i}") for i in range(4)], "chunk_id string, document_id string, source_id string, chunk_index int, title string, section_title string, text string")
    corpus = plans.Corpus(chunks, vectors.hash_vectors(chunks, "chunk_id", "text"))
    q = spark.createDataFrame([(1, "cats sleep"), (2, 'cats "sleep" ABC-12')], "query_id int, query string")
    got = {r.query_id: {s for e in r.evidence for s in e.sources} for r in plans.retrieve(plans.understand(q, Config(hybrid=False)), corpus, Config(hybrid=False)).collect()}
    assert got[1] == {"vector"} and "keyword" in got[2]


def test_metadata_round_trip(spark):
    text = ['{"k": 1, "a": {"b": ["x", {"c": 2.5}]}}', "not json", "[1]", '"s"', "null", None, "", '{"k": "no number"}']
    d = spark.createDataFrame(list(enumerate(text)), "i int, t string").withColumn("m", M.parsed(F.col("t")))
    got = {r.i: r for r in d.select("i", M.at(F.col("m"), "$.k", "int").alias("k"), M.at(F.col("m"), "$.a.b[1].c", "double").alias("c"), F.to_json("m").alias("j")).collect()}
    assert (got[0].k, got[0].c) == (1, 2.5) and got[7].k is None and all(got[i].j is None for i in range(1, 7))
    assert spark.read.json(spark.createDataFrame([(got[0].j,)], "j string").select("j").rdd.map(lambda r: r.j)).count() == 1


def test_names(spark):
    assert [M.snake(x) for x in ("sourceId", "chunk_id", "HTTPPort", "a1B")] == ["source_id", "chunk_id", "http_port", "a1_b"] and [M.camel(x) for x in ("source_id", "chunk", "a_b_c")] == ["sourceId", "chunk", "aBC"]
    d = spark.createDataFrame([(1, (2, [{"innerId": 3}]), {"keepMe": (4,)})], "sourceId int, deepOne struct<chunkIndex:int,someItems:array<struct<innerId:int>>>, aMap map<string,struct<xY:int>>")
    s = M.renamed(d)
    assert s.columns == ["source_id", "deep_one", "a_map"] and s.first().deep_one.some_items[0].inner_id == 3 and s.first().a_map["keepMe"].x_y == 4
    assert M.renamed(s, M.camel).schema.simpleString() == d.schema.simpleString() and M.renamed(s, M.camel).collect() == d.collect()
    with pytest.raises(ValueError, match="one name"):
        M.renamed(spark.createDataFrame([(1, 2)], "aB int, a_b int"))
    rows = spark.createDataFrame([("w", "c", '{"sectionTitle": "S"}'), ("w", "d", "broken")], "workspaceId string, chunkId string, metadata string")
    held = M.from_payload(rows)
    assert held.columns == ["workspace_id", "chunk_id", "metadata"] and [r.m for r in M.payload(held).select(F.col("metadata").alias("m")).collect()] == ['{"sectionTitle":"S"}', "{}"]


def test_a_trace_equals_recounts(spark):
    chunks = spark.createDataFrame([(f"d{i}:0", f"d{i}", f"s{i}", 0, "T", None, f"cats sleep on mat {i}. dogs bark loudly at night {i}. Nothing else is said here at all, really nothing.") for i in range(8)], "chunk_id string, document_id string, source_id string, chunk_index int, title string, section_title string, text string")
    corpus = plans.Corpus(chunks, vectors.hash_vectors(chunks, "chunk_id", "text"))
    q = spark.createDataFrame([(1, "compare cats and dogs"), (2, "cats sleep"), (3, "unheard words only")], "query_id int, query string")
    tables = []
    trace = Trace(lambda d: (tables.append(written(d)), tables[-1])[1])
    plain = sorted(map(str, plans.answer(q, corpus).collect()))
    assert sorted(map(str, plans.answer(q, corpus, save=trace).collect())) == plain
    steps = trace.report(spark).collect()
    assert [s.rows for s in steps] == [t.count() for t in tables] and steps[0].step == "understood" and steps[0].rows == 3
    assert [s.no for s in steps] == list(range(1, len(steps) + 1)) and all(0 <= s.seconds <= s.since_start for s in steps)
    picked = [t for s, t in zip(steps, tables, strict=True) if s.step == "picked"]
    chars = sum(r.n or 0 for t in picked for r in t.select(F.sum(F.length("text")).alias("n")).collect())
    assert sum(s.chars["text"] for s in steps if s.step == "picked") == chars and 0 < trace.ratio() <= 1
