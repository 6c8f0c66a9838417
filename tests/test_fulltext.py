"""Stems, Boolean queries and cover density against literal values and a plain reading of every text."""

import random
import re

import pytest

from quern.functions.stem import stem
from quern.operators import fulltext

STEMS = "running run|relational relat|knives knive|generously generous|communication communic|hopping hop|hoping hope|ties tie|cries cri|happy happi|university univers|gas gas|kiwis kiwi|consolation consol|luxuriated luxuri|bled bled|sing sing|by by|enjoy enjoy|controlling control|electricity electr|youth youth|queries queri|possible possibl|skies sky"


@pytest.mark.parametrize("pair", STEMS.split("|"))
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_parse():
    assert fulltext.parse('cats -dogs or "the big houses of glass"') == [[(False, ["cat"], [0]), (True, ["dog"], [0])], [(False, ["big", "hous", "glass"], [0, 1, 3])]]
    assert fulltext.parse("the of") == fulltext.parse(None) == fulltext.parse("-x") == fulltext.parse(' or "" ') == []
    assert fulltext.parse("data-base") == [[(False, ["data", "base"], [0, 1])]] and fulltext.parse('-"a big cat" dog') == [[(True, ["big", "cat"], [0, 1]), (False, ["dog"], [0])]]


def test_ranks(spark):
    rows = [("a", "Cats", "dog"), ("b", "", "cat dog"), ("c", None, "cats in the old dogs"), ("d", "", "dog only"), ("e", "", None), ("f", "", "CATS")]
    chunks = spark.createDataFrame(rows, "chunk_id string, title string, text string")
    ask = spark.createDataFrame([("q", "cat dogs"), ("n", "cat -dog"), ("o", "old or f or dog"), ("z", ""), ("y", None)], "query_id string, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in fulltext.search(ask, chunks, 10).collect()}
    squash = lambda s: round(s / (1 + s), 9)
    # a: one place of weight 1 and one of 0.4; b: both 0.4; c: three words lie between
    assert got["q", "a"] == squash(2 / 3.5) and got["q", "b"] == squash(0.4) and got["q", "c"] == squash(0.4 / 4)
    assert {k for k in got if k[0] == "n"} == {("n", "f")} and got["n", "f"] == squash(0.4)
    assert {k[1] for k in got if k[0] == "o"} == {"a", "b", "c", "d"} and not {k for k in got if k[0] in "zy"}
    assert fulltext.search(ask.limit(0), chunks).count() == fulltext.search(ask, chunks.limit(0)).count() == 0


def test_matches_equal_a_plain_reading(spark):
    rng = random.Random(5)
    words = "cat cats dog dogs house houses run running the of red blue".split()
    texts = [(str(i), "", " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(200)]
    asks = [(i, q) for i, q in enumerate(["cat dog", '"red cat"', '"cat of dogs"', "run -house", "cat house or dog red", '"running dogs" or blue -"red blue"'])]
    got = {(r.query_id, r.chunk_id) for r in fulltext.search(spark.createDataFrame(asks, "query_id int, query string"), spark.createDataFrame(texts, "chunk_id string, title string, text string"), 1000).collect()}

    def has(text, term):
        no, want, steps = term
        own = [None if w in fulltext.STOP else stem(w) for w in re.findall(r"\w+", text)]
        return no != any(all(i + s < len(own) and own[i + s] == w for w, s in zip(want, steps, strict=True)) for i in range(len(own)))

    assert got == {(i, c) for i, q in asks for c, _, t in texts if any(all(has(t, x) for x in g) for g in fulltext.parse(q))}


def test_vector_top_k_of_odd_vectors_and_ties(spark):
    from quern.operators import vectors

    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.6, 0.8]), ("n", None), ("h", [1.0, None]), ("x", [float("nan"), 1.0]), ("l", [1.0]), ("z", [0.0, 0.0])], "chunk_id string, vec array<double>")
    q = spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0]), ("bad", 0, None)], "query_id string, variant int, vec array<double>")
    got = [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in vectors.top_k(q, v, 2, 2, 2).orderBy("query_id", "rank").collect()]
    assert got == [("q", "a", 1.0, 1), ("q", "b", 1.0, 2), ("q", "c", 0.8, 3)]
    assert vectors.top_k(q, v.limit(0), 2, 2, 2).count() == vectors.top_k(q.limit(0), v, 2, 2, 2).count() == 0
    vectors.MOST_SENT, most = 1, vectors.MOST_SENT
    try:
        assert [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in vectors.top_k(q, v, 2, 2, 2).orderBy("query_id", "rank").collect()] == got
    finally:
        vectors.MOST_SENT = most


def test_any_word_is_counted_as_cover_density_says(spark):
    rng = random.Random(8)
    words = "cat cats dog dogs house run running the of red".split()
    texts = [(str(i), rng.choice(["", "The red cats of", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)]
    chunks = spark.createDataFrame(texts, "chunk_id string, title string, text string")
    asks = [(0, "cat or dogs or the"), (1, "running or cat or cats"), (2, "house"), (3, "cat dog"), (4, "zebra or of")]
    rows = fulltext.search(spark.createDataFrame(asks, "query_id int, query string"), chunks, 7).collect()
    places = {}
    for p in fulltext.word_places(chunks).collect():
        places.setdefault(p.chunk_id, []).append({"at": p["at"], "weight": p.weight, "lexeme": stem(p.word)})
    for i, query in asks:
        groups = [[{"no": n, "words": w, "steps": s} for n, w, s in g] for g in fulltext.parse(query)]
        wanted = {w for g in groups for t in g for w in t["words"]}
        all_ = {c: fulltext.cover_density(groups, [h for h in p if h["lexeme"] in wanted]) for c, p in places.items()}
        want = sorted(((-round(s, 9), c) for c, s in all_.items() if s is not None))[:7]
        assert sorted((-r.score, r.chunk_id) for r in rows if r.query_id == i) == want
    # words alone need no row for each question and place
    plan = fulltext.search(spark.createDataFrame(asks[:2], "query_id int, query string"), chunks, 7)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
