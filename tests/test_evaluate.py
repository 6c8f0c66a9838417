"""Percentiles by selection, and the full report."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluate


def nearest(values, p):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    return v[round(p / 100 * (len(v) - 1))]


def same(a, b):
    return a == b or (a != a and b != b)


def values(kind, rng, n):
    return {
        "plain": lambda: [rng.uniform(-5, 5) for _ in range(n)], "skewed": lambda: [math.exp(rng.gauss(0, 30)) for _ in range(n)], "few": lambda: [rng.choice([1.0, 1.0, 2.5]) for _ in range(n)],
        "wide": lambda: [rng.choice([-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300]) * rng.random() for _ in range(n)], "odd": lambda: [rng.choice([float("inf"), float("-inf"), float("nan"), 3.0, rng.random()]) for _ in range(n)],
    }[kind]()


@pytest.mark.parametrize("most", [0, 10**6])
def test_percentiles_of_hot_and_other_keys(spark, most):
    rng = random.Random(1)
    made = {k: values(k, rng, 700) for k in ("plain", "skewed", "few", "wide", "odd")} | {None: values("plain", rng, 300), "one": [4.0]}
    rows = [(k, v) for k, vs in made.items() for v in vs] + [("one", None), ("none", None)]
    frame = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "k string, v double")
    got = {r.k: r for r in evaluate.percentiles(frame, "k", "v", [0, 5, 50, 99, 100], most=most).collect()}
    assert set(got) == set(made)
    for k, vs in made.items():
        assert got[k].n == len(vs)
        assert all(same(got[k][f"p{p}"], nearest(vs, p)) for p in (0, 5, 50, 99, 100)), k


def test_percentiles_of_nothing(spark):
    assert evaluate.percentiles(spark.createDataFrame([("a", None)], "k string, v double"), "k", "v", [50]).count() == 0


def test_a_hot_key_is_sorted_by_no_task(spark):
    """No window of a round has more rows than ranges."""
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.rand(3).alias("v"))
    plan = []
    keep = lambda d: (plan.append(d), d.cache())[1]
    got = evaluate.percentiles(rows, "k", "v", [50], most=100, save=keep).first()
    want = sorted(r.v for r in rows.collect())
    assert got.p50 == want[round(0.5 * 19_999)]


def test_items_errors_and_report(spark):
    golden = spark.createDataFrame([("a", "q one", ["x", "x", None], ["s1"], [], None), ("b", "q two", ["x"], [], ["needle"], None), ("c", " ", None, [], [], None), ("d", None, ["y"], [], [], "not a golden item"), ("e", "q five", ["y"], ["s9"], [], None)], "id string, query string, tags array<string>, expected_ids array<string>, expected_substrings array<string>, error string")

    def search(q):
        found = spark.createDataFrame([("a", 1, "s0", "t", None, 0.9, 10.0), ("a", 2, "s1", "t", None, 0.9, 10.0), ("b", 1, "s", "the Needle", None, 0.3, 30.0), ("e", None, None, None, "search failed", None, None)], "query_id string, rank int, source_id string, text string, error string, confidence double, latency_ms double")
        return found.join(q.select("query_id"), "query_id")

    rows = evaluate.run_items(golden, search)
    got = {r.id: r for r in rows.collect()}
    assert (got["a"].first_rank, got["a"].rr, got["b"].hit_at_1, got["a"].hit_at_1) == (2, 0.5, True, False)
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": None, "c": "query is empty", "d": "not a golden item", "e": "search failed"}
    full = {r.tag: r for r in evaluate.full_report(rows.withColumn("chars_before", F.lit(100)).withColumn("chars_after", F.when(F.col("id") == "a", 50).otherwise(100))).collect()}
    assert (full[None].total, full[None].errors, full[None].mrr, full[None].mean_confidence, full[None].p95_latency_ms, full[None].compression_ratio, full[None].low_confidence) == (5, 3, 0.75, 0.6, 30.0, 0.75, 1)
    assert (full["x"].total, full["y"].total, full["y"].errors, full["y"].mrr, full["y"].p50_latency_ms, full["y"].compression_ratio) == (2, 2, 2, 0.0, 0.0, 0.0)
    assert evaluate.full_report(rows.limit(0).withColumn("chars_before", F.lit(1)).withColumn("chars_after", F.lit(1))).count() == 0


def test_saved_report(spark, tmp_path):
    rows = spark.createDataFrame([(None, 3, 0.5), ("x", 1, 0.25)], "tag string, total long, mrr double")
    path = evaluate.save_report(rows, f"file://{tmp_path}", "20240101T000000Z")
    assert {r.tag: r.mrr for r in spark.read.json(f"{path}/json").collect()} == {None: 0.5, "x": 0.25}
    assert "mrr: 0.250" in "\n".join(r.value for r in spark.read.text(f"{path}/text").collect())
    with pytest.raises(Exception, match="exists"):
        evaluate.save_report(rows, f"file://{tmp_path}", "20240101T000000Z")
