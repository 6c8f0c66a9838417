"""The stored keyword index against the search over all chunks, after documents came and went."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval
from quern.operators.keyword_index import KeywordIndex

CHUNK = "document_id string, chunk_id string, title string, section_title string, text string"


def made(n, seed):
    rng = random.Random(seed)
    say = lambda most: " ".join(f"w{min(int(rng.expovariate(0.05)), 90)}" for _ in range(rng.randrange(1, most)))
    return [(f"d{i}", f"d{i}:{c}", say(4), say(3) if rng.random() < 0.5 else None, "" if rng.random() < 0.05 else say(60)) for i in range(n) for c in range(rng.randrange(1, 4))]


@pytest.fixture(scope="module")
def setting(spark, tmp_path_factory):
    """An index that has seen other texts, a second round of documents and deletions; and the chunks it should hold."""
    index = KeywordIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/k", buckets=8, block=4)
    now = made(150, 1)
    stale = [(d, f"{c}x", t, s, "w1 w2 stale words") for d, c, t, s, _ in made(60, 2)]
    index.upsert(spark.createDataFrame(stale, CHUNK))
    index.upsert(spark.createDataFrame(now, CHUNK))
    index.upsert(spark.createDataFrame(made(10, 3)[:5], CHUNK).withColumn("document_id", F.lit("gone")))
    index.delete(spark.createDataFrame([("gone",), ("d7",), ("never",)], "document_id string"))
    chunks = spark.createDataFrame([r for r in now if r[0] != "d7"], CHUNK).cache()
    rng = random.Random(5)
    texts = [r[4] for r in now if len(r[4].split()) > 8]
    asked = [(i, " ".join(rng.choice(texts).split()[2 : 2 + rng.randrange(2, 6)])) for i in range(25)] + [(100, "w1"), (101, "the of"), (102, ""), (103, "unheard"), (104, 'w3 "w1 w2"')]
    return index, chunks, spark.createDataFrame(asked, "query_id int, query string")


def rows(d):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in d.collect())


@pytest.mark.parametrize("k", [1, 5, 30])
def test_same_rows_as_the_search_over_all_chunks(setting, k):
    index, chunks, asked = setting
    got = index.top_k(asked, k)
    assert rows(got.rows) == rows(retrieval.bm25_top_k(asked, chunks, k))
    reads = got.reads.collect()
    assert all(1 <= r.blocks_read <= r.blocks for r in reads)
    if k == 1:
        assert sum(r.blocks_read for r in reads) < 0.7 * sum(r.blocks for r in reads)


def test_k_by_query(setting):
    index, chunks, asked = setting
    asked = asked.withColumn("k", F.col("query_id") % 4 + 1)
    want = retrieval.ranked(retrieval.bm25_scores(asked, chunks).join(asked.select("query_id", "k"), "query_id"), F.col("k"), 4)
    assert rows(index.top_k(asked, most=4).rows) == rows(want)


def test_all_terms(setting):
    index, chunks, asked = setting
    got = index.boolean(asked, 10)
    assert rows(got.rows) == rows(retrieval.boolean_search(asked, chunks, 10)) and got.rows.count()
    assert sum(r.blocks_read or 0 for r in got.reads.collect()) < sum(r.blocks for r in got.reads.collect())


def test_updates_rewrite_their_buckets_alone(spark, setting, tmp_path):
    index = KeywordIndex(spark, f"file://{tmp_path}/k", buckets=32, block=4)
    index.upsert(spark.createDataFrame(made(200, 9), CHUNK))
    done = index.upsert(spark.createDataFrame(made(1, 10), CHUNK))
    assert len(done.touched) == 1 and done.kept >= 30
    # an update that ended between the two tables is none
    index.chunks.merge(gone=spark.createDataFrame([("d5",)], "document_id string"))
    before = index.stats().first().n
    index.delete(spark.createDataFrame([("d6",)], "document_id string"))
    held = spark.createDataFrame(made(1, 10) + [r for r in made(200, 9) if r[0] not in ("d0", "d6")], CHUNK)
    asked = spark.createDataFrame([(1, "w3 w5 w20")], "query_id int, query string")
    assert before > index.stats().first().n == held.count() and rows(index.top_k(asked, 8).rows) == rows(retrieval.bm25_top_k(asked, held, 8))
    assert index.vacuum() > 0 and rows(index.top_k(asked, 8).rows) == rows(retrieval.bm25_top_k(asked, held, 8))


def test_empty_index(spark, tmp_path):
    index = KeywordIndex(spark, f"file://{tmp_path}/k")
    asked = spark.createDataFrame([(1, "w3")], "query_id int, query string")
    assert index.top_k(asked, 3).rows.count() == 0
    index.upsert(spark.createDataFrame([], CHUNK))
    assert index.top_k(asked, 3).rows.count() == index.boolean(asked).rows.count() == 0


def test_words_of_a_long_chunk_are_counted_once(spark):
    from collections import Counter

    from quern.operators.keyword_index import counted

    rows = [(0, [f"w{i % 7000}" for i in range(20_000)]), (1, []), (2, ["b", "a", "b"])]
    got = spark.createDataFrame(rows, "id int, words array<string>").select("id", counted(F.col("words")).alias("t")).collect()
    assert {r.id: [(x.term, x.tf) for x in r.t] for r in got} == {i: sorted(Counter(w).items()) for i, w in rows}


def test_one_change_takes_and_drops_documents(spark, tmp_path, monkeypatch):
    from quern.operators import keyword_index

    monkeypatch.setattr(keyword_index, "PART", 20)
    monkeypatch.setattr(keyword_index, "ROWS", 7)
    index = KeywordIndex(spark, f"file://{tmp_path}/k", buckets=2, block=4)
    old, new = made(60, 11), [r for r in made(70, 12) if int(r[0][1:]) >= 50]
    index.upsert(spark.createDataFrame(old, CHUNK))
    done = index.replace(spark.createDataFrame(new, CHUNK), spark.createDataFrame([("d1",), ("d2",)], "document_id string"))
    assert done.version == 2 and len(index.postings.numbers()) == 2  # the postings are written once
    held = spark.createDataFrame([r for r in old if int(r[0][1:]) < 50 and r[0] not in ("d1", "d2")] + new, CHUNK)
    want = retrieval.term_frequencies(held).select("term", "chunk_id", "tf", "dl")
    got = index.postings.read().select("home", "block", "term", "df", F.explode("postings").alias("p")).cache()
    assert sorted(map(tuple, got.select("term", "p.chunk_id", "p.tf", "p.dl").collect())) == sorted(map(tuple, want.collect()))
    blocks = got.groupBy("home", "block").agg(F.count_distinct("p.chunk_id").alias("n")).collect()
    assert max(r.n for r in blocks) == 4 and len({r.block for r in blocks}) > 2
    assert got.groupBy("home", "block", "term").agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("df")).where("n <> df").count() == 0
    asked = spark.createDataFrame([(1, "w3 w5 w20"), (2, "w60")], "query_id int, query string")
    assert rows(index.top_k(asked, 8).rows) == rows(retrieval.bm25_top_k(asked, held, 8))


def test_words_are_stored_once(spark, tmp_path):
    index = KeywordIndex(spark, f"file://{tmp_path}/k", buckets=2, block=4)
    now = made(120, 21)
    index.upsert(spark.createDataFrame(now, CHUNK))
    assert not [f.name for f in index.chunks.schema if "array" in f.dataType.simpleString()]
    ids = [r.block for r in index.postings.read().select("home", "block").distinct().collect()]
    assert len(ids) == len(set(ids)) > 2  # a block of one bucket has a number of its own


def test_a_search_keeps_only_possible_best_chunks(spark, tmp_path):
    from quern.sources import tables

    saved = []

    def save(df):
        saved.append(tables.written(df))
        return saved[-1]

    index = KeywordIndex(spark, f"file://{tmp_path}/k", buckets=2, block=4, save=save)
    now = made(120, 21)
    index.upsert(spark.createDataFrame(now, CHUNK))
    asked = spark.createDataFrame([(i, f"w{i} w1 w3 unheard") for i in range(12)], "query_id int, query string")
    assert rows(index.top_k(asked, 2).rows) == rows(retrieval.bm25_top_k(asked, spark.createDataFrame(now, CHUNK), 2))
    scores = [t.count() for t in saved if "have" in t.columns]
    assert scores and max(scores) <= 12 * 2  # k for each question, not all chunks with a term


def test_a_search_for_all_terms_writes_only_chunks_that_have_them(spark, tmp_path):
    from quern.sources import tables

    saved = []

    def save(df):
        saved.append(tables.written(df))
        return saved[-1]

    now = made(120, 22)
    index = KeywordIndex(spark, f"file://{tmp_path}/k", buckets=2, block=4, save=save)
    index.upsert(spark.createDataFrame(now, CHUNK))
    asked = spark.createDataFrame([(1, "w3 w9 w14"), (2, 'w5 "w1 w2"'), (3, "w2")], "query_id int, query string")
    assert rows(index.boolean(asked, 20).rows) == rows(retrieval.boolean_search(asked, spark.createDataFrame(now, CHUNK), 20))
    scores = [t for t in saved if {"have", "need"} <= set(t.columns)]
    assert scores and not any(t.where("have < need").count() for t in scores)
