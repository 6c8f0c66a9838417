"""Ranked lexical search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import lexical

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=50):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(docs, items, **options):
    return sorted((tuple(r) for r in lexical.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(seed, n, words=60):
    rng = random.Random(seed)
    text = lambda most: rng.choice([" ", ", ", "\n-"]).join(f"W{min(int(rng.expovariate(0.08)), words)}" for _ in range(rng.randrange(most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(n + i, rng.choice(docs)[1]) for i in range(n)]  # ties
    return docs, [(i, text(12)) for i in range(30)]


@pytest.mark.parametrize(("shard_docs", "k", "block_bytes"), [(7, 3, 1 << 20), (300, 10, 1 << 20), (4096, 50, 100)])
def test_equals_scores_of_all_documents(spark, shard_docs, k, block_bytes):
    docs, items = made(5, 400)
    shards = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_docs=shard_docs)
    assert got(shards, spark.createDataFrame(items, "item_id long, text string"), k=k, block_bytes=block_bytes) == ranked(docs, items, k)


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (1, "alpha beta"), (2, None), (4, ""), (5, " ,;"), (6, "x " * 20_000 + "alpha"), (7, "É漢 É"), (8, "é漢"), (-9, "ALPHA\u00c9 a\x00b"), (10, "AlphaÉ")]
    items = [(1, "alpha"), (1, "alpha"), (None, "beta beta beta"), (2, None), (3, ""), (4, "É漢"), (5, "never"), (6, "alphaÉ B"), (7, "; x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "'y' as terms", "3 as score")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as key", "3 as doc_id")
    for shard_docs in (2, 4096):
        assert got(lexical.build(frame, shard_docs=shard_docs), asked) == ranked(docs, items)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert got(lexical.build(none), asked) == []
    assert got(lexical.build(frame), none.selectExpr("doc_id as item_id", "text")) == []


def test_long_texts_are_taken_in_pieces():
    rng = random.Random(1)
    text = " ".join(f"Wo{rng.randrange(10**9)}" for _ in range(500_000)) + " " + "z" * (3 << 20) + " end"
    h, n = lexical.term_hashes(pa.array([text]))
    own = terms(text)
    whole = np.concatenate([lexical.term_hashes(pa.array([" ".join(own[i : i + 10_000])]))[0] for i in range(0, len(own), 10_000)])
    assert n.tolist() == [len(own)] and (h == whole).all()


def test_the_tree_leaves_most_documents_out():
    """A term in one leaf alone: of 256 leaves, few are opened."""
    docs = pa.array([f"common w{i % 50}" + (" rare" if i == 777 else "") for i in range(4096)])
    h, n = lexical.term_hashes(docs)
    row = lexical._shard([np.arange(4096)], [n], [h])
    wanted = np.unique(lexical.term_hashes(pa.array(["common rare"]))[0])
    shard = lexical.Shard(row, wanted, np.array([1000] * 2), 4096, int(n.sum()))
    opened, exact = [], shard.exact
    shard.exact = lambda rows, leaves: (opened.extend(leaves.tolist()), exact(rows, leaves))[1]
    best = []
    shard.search(np.arange(2), best, 1)
    assert best[0][2] == -777 and len(opened) <= 2 * lexical.FAN
