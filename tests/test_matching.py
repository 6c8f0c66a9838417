"""Searches hand on only rows that may be among the best, whatever the blocks and tiles, and join nothing by a key of few values."""

import random

from pyspark.sql import functions as F

from quern.operators import matching, retrieval, routed, vectors


def corpus(spark, n=300):
    rng = random.Random(3)
    words = ["red", "blue", "cat", "dog", "house", "tree", "it's", "Über", "sun_1"]
    rows = [(f"c{i:03d}", rng.choice(["", "Red house", None]), None, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(n)]
    asks = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(25)] + [(90, '"red cat" dog'), (91, None)]
    return spark.createDataFrame(asks, "query_id int, query string"), spark.createDataFrame(rows, "chunk_id string, title string, section_title string, text string")


def test_only_possible_best_rows_go_on(spark):
    asked, chunks = corpus(spark)
    best = lambda d: {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in retrieval.ranked(d, 3, 3).collect()}
    every, some = retrieval.bm25_scores(asked, chunks), retrieval.bm25_scores(asked, chunks.coalesce(1), 3)
    assert best(every) == best(some) and some.count() < every.count() / 2
    usual, matching.TILE = matching.TILE, 256
    try:
        assert best(retrieval.bm25_scores(asked, chunks, 3)) == best(every)
    finally:
        matching.TILE = usual


def test_all_terms_and_quotes(spark):
    asked, chunks = corpus(spark)
    got = {r.chunk_id for r in retrieval.bm25_scores(asked, chunks, all_terms=True).collect() if r.query_id == 90}
    assert got == {r.chunk_id for r in chunks.collect() if "red cat" in r.text and {"red", "cat", "dog"} <= {*r.text.split(), *(r.title or "").lower().split()}} and got


def test_hybrid_search_takes_each_text_once(spark):
    """Both legs are found in one pass over the texts, as if each were searched by itself; so are more questions than a block, and none with terms."""
    asked, chunks = corpus(spark)
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    once = retrieval.hybrid(asked, chunks.mapInArrow(passing, chunks.schema), 5).collect()
    assert seen.value == chunks.count()

    def legs(some):
        v = vectors.hash_vectors(some, "query_id", "query").withColumn("variant", F.lit(0))
        near = vectors.top_k(v, vectors.hash_vectors(chunks, "chunk_id", "text"), 5, 5)
        return sorted(retrieval.fuse(retrieval.bm25_top_k(some, chunks, 5), near.drop("variant")).collect())

    assert sorted(once) == legs(asked) and {r.query_id for r in once} == {r.query_id for r in asked.collect()}
    none = asked.where("query_id = 91")
    assert sorted(retrieval.hybrid(none, chunks, 5).collect()) == legs(none)
    usual, matching.TILE = matching.TILE, 256
    try:
        assert sorted(retrieval.hybrid(asked, chunks, 5).collect()) == sorted(once)
    finally:
        matching.TILE = usual


def test_routed_search_has_no_join_by_scope(spark):
    asked, chunks = corpus(spark)
    where = chunks.selectExpr("*", "chunk_id as document_id", "'w' as workspace_id", "'s' as source_type")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = routed.bm25_top_k(asked, where, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
