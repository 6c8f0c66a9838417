"""Providers that answer, lie and fail."""

import sys

import pytest
from pyspark import cloudpickle

from quern.operators import providers as P
from quern.plans import answer as plans
from quern.plans import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see the tests


def noted(path, reply):
    """A provider's call that writes down what it was asked."""

    def call(prompts):
        import uuid

        with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n--\n".join(prompts))
        return reply(prompts)

    return call


def calls(path):
    return [p.read_text().split("\n--\n") for p in path.iterdir()]


def upper(prompts):
    return [p.upper() for p in prompts]


def fussy(prompts):
    if any("bad" in p for p in prompts):
        raise RuntimeError("down")
    return upper(prompts)


def test_batches_are_bounded_and_failures_stay_with_their_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}" + (" bad" if i == 5 else "")) for i in range(20)] + [(20, None), (21, " ")], "i int, p string").coalesce(1)
    got = {r.i: r for r in P.ask(rows, "p", P.Provider("m", noted(tmp_path, fussy), rows=4)).collect()}
    assert got[4].answer == "TEXT 4" and got[6].error is None and got[5].answer is None and got[5].error == "RuntimeError: down"
    assert got[20].answer is got[20].error is got[21].answer is got[21].error is None
    sizes = [len(c) for c in calls(tmp_path)]
    # the batch that holds it twice, then its four rows one by one, that one twice
    assert sorted(sizes) == [1] * 5 + [4] * 6


@pytest.mark.parametrize(("reply", "why"), [(lambda ps: ps[1:], "answers to"), (lambda ps: [7] * len(ps), "not a text"), (lambda ps: [None] * len(ps), "no answer")])
def test_answers_that_are_none(spark, reply, why):
    rows = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    assert all(r.answer is None and why in r.error for r in P.ask(rows, "p", P.Provider("m", reply)).collect())


def test_cached_prompts_are_not_asked_again(spark, tmp_path):
    (tmp_path / "log").mkdir()
    cache = P.cache_table(spark, f"file://{tmp_path}/cache")
    provider = P.Provider("m", noted(tmp_path / "log", fussy), attempts=1)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None)], "i int, p string")
    first = {r.i: (r.answer, r.used) for r in P.asked_once(rows, "p", provider, cache).collect()}
    assert first == {1: ("A", "provider"), 2: ("B", "provider"), 3: ("A", "provider"), 4: (None, None), 5: (None, None)}
    seen = len(calls(tmp_path / "log"))
    assert sorted(p for c in calls(tmp_path / "log") for p in c).count("a") <= 2
    again = {r.i: (r.answer, r.used) for r in P.asked_once(rows.where("i < 4"), "p", provider, cache).collect()}
    assert again == {1: ("A", "cache"), 2: ("B", "cache"), 3: ("A", "cache")} and len(calls(tmp_path / "log")) == seen
    other = P.Provider("n", upper)
    assert {r.used for r in P.asked_once(rows.where("i < 4"), "p", other, cache).collect()} == {"provider"}
    assert {r.used: (r.n, r.errors) for r in P.counts(P.asked_once(rows, "p", provider, cache).withColumnsRenamed({"used": "x_used", "error": "x_error"}), "x").collect()} == {"cache": (3, 0), None: (2, 1)}


def test_questions(spark):
    q = spark.createDataFrame([(1, "how is  it?"), (2, ""), (3, None), (4, "bad one")], "query_id int, query string")
    got = {r.query_id: r for r in P.rewrite(q, P.Provider("m", lambda ps: fussy([f' "{p}" ' for p in ps]))).collect()}
    assert (got[1].rewritten, got[1].rewritten_used) == ("HOW IS  IT?", "provider") and (got[2].rewritten, got[2].rewritten_used, got[2].rewritten_error) == ("", "query", None)
    assert got[4].rewritten == "bad one" and "down" in got[4].rewritten_error
    empty = P.rewrite(q, P.Provider("m", lambda ps: ["''"] * len(ps))).where("query_id = 1").first()
    assert empty.rewritten == "how is  it?" and empty.rewritten_error == "empty completion"
    lines = lambda ps: ["1. first part here\n2) second part\n- x\n* first part here" if "how" in p else "only one line" for p in ps]
    got = {r.query_id: r for r in P.decompose(q, P.Provider("m", lines)).collect()}
    assert got[1].parts == ["first part here", "second part"] and got[4].parts == ["bad one"] and got[4].parts_error == "fewer than 2 parts" and got[3].parts == [""]


TEXT = "The cat sat on the mat for a long while today.\nDogs bark at night and nobody knows why they do so."


def test_compression_is_guarded(spark):
    rows = spark.createDataFrame([(1, "cat mat", TEXT), (2, "cat lie", TEXT), (3, "cat half", TEXT), (4, "bad cat", TEXT), (5, "cat", " ")], "query_id int, query string, text string")

    def call(prompts):
        return fussy([""]) and [("Cats rule the world." if "lie" in p else "The cat  sat on the mat for a long while today.\nand more" if "half" in p else "The cat sat on the mat for a long while today.") if "bad" not in p else fussy([p])[0] for p in prompts]

    got = {r.query_id: r for r in P.compress(rows, P.Provider("m", call)).collect()}
    assert got[1].compressed.startswith("The cat") and got[1].compressed_used == "provider"
    assert got[2].compressed_used == "extractive" and got[2].compressed_error == "output not a verbatim subset" and "Cats rule" not in got[2].compressed
    assert got[3].compressed_used == "provider" and "down" in got[4].compressed_error and got[4].compressed_used == "extractive" and got[5].compressed_error is None


def test_answers_cite_their_context(spark):
    context = "array<struct<no:int,source_id:string,chunk_id:string,title:string,section_title:string,score:double,text:string>>"
    con = [(1, "s", "c1", "T", None, 0.5, " one "), (2, "s", "c2", "T", "S", 0.4, "two")]
    rows = spark.createDataFrame([(1, "q", con), (2, "bad", con), (3, "q", []), (4, "q", None)], f"query_id int, query string, context {context}")

    def call(prompts):
        assert all("[1] T\n" in p and "[2] T (S)\ntwo" in p for p in prompts)
        return fussy([p for p in prompts if "Query: bad" in p]) or ["as [2] and [9] say [2]"] * len(prompts)

    got = {r.query_id: r for r in P.answer(rows, P.Provider("m", call)).collect()}
    assert got[1].answer_text == "as [2] and [9] say [2]" and [c.chunk_id for c in got[1].cited] == ["c2"] and got[1].answer_text_used == "provider"
    assert got[2].answer_text.startswith("[1] one") and [c.chunk_id for c in got[2].cited] == ["c1", "c2"] and "down" in got[2].answer_text_error
    assert got[3].answer_text.startswith("No evidence") and got[3].cited == [] and got[3].answer_text_error is None and not got[4].cited


def vector(prompts):
    return [[float(len(p)), 1.0, 0.0] for p in prompts]


def test_ingesting_again_asks_no_provider(spark, tmp_path):
    for d in ("vectors", "texts"):
        (tmp_path / d).mkdir()
    models = P.Providers(embedder=P.Provider("e", noted(tmp_path / "vectors", vector)), contextualizer=P.Provider("c", noted(tmp_path / "texts", lambda ps: ['Context: "about it"'] * len(ps))), dim=3, cache=f"file://{tmp_path}/cache")
    docs = spark.createDataFrame([("a", "word " * 900, "text", "A"), ("b", "other text", "text", "B")], "document_id string, text string, file_type string, title string")
    first, _ = ingest.ingest(docs, models=models)
    rows = sorted(map(tuple, first.vectors.collect()))
    assert len(rows) == 3 and all(abs(sum(x * x for x in r[2]) - 1) < 1e-9 for r in rows)
    asked = [p for c in calls(tmp_path / "vectors") for p in c]
    assert all(p.startswith("about it\n\n") for p in asked)
    n = len(calls(tmp_path / "vectors")), len(calls(tmp_path / "texts"))
    second, _ = ingest.ingest(docs, first, models=models)
    assert sorted(map(tuple, second.vectors.collect())) == rows
    assert n == (len(calls(tmp_path / "vectors")), len(calls(tmp_path / "texts")))


def test_models_in_the_whole_plan(spark):
    chunks = spark.createDataFrame([(f"d{i}:0", f"d{i}", f"s{i}", 0, "T", None, f"cats sleep on mat {i}. dogs bark loudly at night {i}. Nothing else is said here at all, really nothing.") for i in range(6)], "chunk_id string, document_id string, source_id string, chunk_index int, title string, section_title string, text string")
    from quern.operators import vectors

    corpus = plans.Corpus(chunks, vectors.hash_vectors(chunks, "chunk_id", "text"))
    q = spark.createDataFrame([(1, "compare cats and dogs"), (2, "cats sleep")], "query_id int, query string")
    models = P.Providers(
        rewriter=P.Provider("r", lambda ps: [f"{p} loudly" for p in ps]), decomposer=P.Provider("d", lambda ps: ["where do cats sleep\nwhen do dogs bark"] * len(ps)), compressor=P.Provider("c", lambda ps: ["made up"] * len(ps)), answerer=P.Provider("a", lambda ps: ["They do [1]."] * len(ps)),
    )
    got = {r.query_id: r for r in plans.answer(q, corpus, models=models).collect()}
    assert got[1].answer == got[2].answer == "They do [1]." and got[1].route.strategy == "deep" and got[1].context and all("made up" not in c.text for c in got[1].context)
    failing = P.Providers(*[P.Provider("f", lambda ps: fussy(["bad"]))] * 4)
    plain = {r.query_id: r for r in plans.answer(q, corpus).collect()}
    fell = {r.query_id: r for r in plans.answer(q, corpus, models=failing).collect()}
    assert fell[2].answer == plain[2].answer and fell[2].context == plain[2].context and "down" in fell[2].answer_text_error
