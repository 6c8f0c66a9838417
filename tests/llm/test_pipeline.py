"""The pipeline: stages keep the columns of documents, and each decision takes effect."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quern.llm import jaccard_dedup, simhash


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    seen = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, seen, data).cache()
        assert out.columns == docs.columns and 0 < out.count() <= seen.count(), name
        assert out.join(seen, "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            assert out.count() == seen.count() and out.where("n_chars <> length(text)").count() == 0
        if name == "simhash_near_dedup":
            assert out.select("doc_id").distinct().count() == out.count()
        if name == "decontaminate":
            assert not any(i in r.text for r in out.collect() for i in items)
        seen = out
    assert pipeline.run(spark, data).count() == seen.count()


def test_null_and_repeated_rows(spark, data):
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "one two three four\nfive", "en", "s", 23)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, data).count() >= 2
        assert stage(spark, docs.limit(0), data).count() == 0


def shingles(text, words=5):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, min(len(w), 1)))}


def groups_of(sets, least=0.8):
    """The least index linked to each set by brute-force Jaccard."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= least * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_near_duplicates_equal_brute_force_jaccard(spark, data):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**4)}" for _ in range(60)] for _ in range(6)]
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for _ in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"z{rng.randrange(10**4)}"
        texts.append(" ".join(t[: rng.choice([12, 50, 60])]))
    texts += ["", None, " \n", "a b", "A  B", "a b c d e", "a b c d e f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r.row: r.component for r in jaccard_dedup.near_duplicates(rows).collect()}
    want = groups_of([shingles(t) for t in texts])
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    assert [first[got[i]] for i in range(len(texts))] == want
    assert 1 < sum(w != i for i, w in enumerate(want)) < len(texts)


def test_near_copies_far_in_fingerprint_go(spark, data):
    rng = random.Random(5)
    text = [f"w{rng.randrange(10**4)}" for _ in range(100)]
    near, far = text.copy(), text.copy()
    near[50] = near[20] = "other"
    far[::9] = ["other"] * len(far[::9])
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate([text, near, far])], schema)
    assert len(shingles(" ".join(text)) & shingles(" ".join(near))) / len(shingles(" ".join(text)) | shingles(" ".join(near))) >= 0.8
    fp = [int(r.fingerprint, 16) for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()]
    assert (fp[0] ^ fp[1]).bit_count() > 2
    assert sorted(r.doc_id for r in pipeline.one_of_each_group(spark, docs, data).collect()) == [0, 2]


def test_rows_of_one_id_with_other_texts_stay(spark, data):
    texts = [(None, "the first text of a null id here"), (None, "another one that shares nothing with it"), (7, "one text of document seven stands here"), (7, "and quite a different text of document seven"), (7, "one text of document seven stands here"), (9, "the first text of a null id here")]
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], schema)
    got = [(r.doc_id, r.text) for r in pipeline.one_of_each_group(spark, docs, data).collect()]
    assert sorted(got, key=str) == sorted([texts[1], texts[2], texts[3], texts[5]], key=str)


def test_leaks_of_null_and_repeated_ids_go(spark, data):
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first().text
    clean = "not one of these words stands in any test item " * 3
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    rows = [(None, "before " + item), (None, clean), (4, item + " after"), (4, clean), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    got = [(r.doc_id, r.text) for r in pipeline.drop_leaks(spark, docs, data).collect()]
    assert sorted(got, key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_bitmaps_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, n)).astype(np.uint64) for n in (0, 1, 40, 300, 450, 450)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    maps = jaccard_dedup.bitmaps(np.concatenate(sets), at)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(maps[i] ^ maps[j]).sum() <= len(np.setxor1d(a, b))
