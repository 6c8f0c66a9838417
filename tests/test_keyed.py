"""Keyed tables: merges, versions, failures and clean-up."""

import pytest
from pyspark.sql import functions as F

from quern.sources.keyed import Conflict, KeyedTable

SCHEMA = "k string, n int, v string"


def table(spark, path, **options):
    return KeyedTable(spark, f"file://{path}/t", "k", SCHEMA, **options)


def rows(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


def held(t, **which):
    return sorted(map(tuple, t.read(**which).collect()), key=str)


def test_rows_of_a_key_are_replaced_together(spark, tmp_path):
    t = table(spark, tmp_path, buckets=5)
    assert held(t) == [] and t.version().number == 0
    t.merge(rows(spark, ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), (None, 0, "no key")))
    assert held(t) == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    t.merge(rows(spark, ("a", 0, "new"), ("c", 0, None)), spark.createDataFrame([("b",), ("never",), (None,)], "k string"))
    assert held(t) == [("a", 0, "new"), ("c", 0, None)]
    assert held(t, number=1) == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    again = KeyedTable(spark, f"file://{tmp_path}/t")
    assert (again.key, again.n_buckets, held(again)) == ("k", 5, held(t))
    extra = rows(spark, ("d", 1, "w")).selectExpr("*", "1 as __b", "2 as other")
    t.merge(extra)
    assert ("d", 1, "w") in held(t)
    with pytest.raises(ValueError):
        KeyedTable(spark, f"file://{tmp_path}/none")


def test_a_merge_writes_the_touched_buckets_alone(spark, tmp_path):
    t = table(spark, tmp_path, buckets=128)
    t.merge(spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(0).alias("n"), F.lit("old").alias("v")))
    before = t.version()
    done = t.merge(rows(spark, *((f"k{i}", 1, "new") for i in range(2))))
    assert len(done.touched) <= 2 and done.written <= 2 and done.kept >= 126
    assert set(before.files) - set(t.version().files) == {p for b in done.touched for p, _ in before.buckets[b]}
    assert t.read().where("v = 'new'").count() == 2 and t.read().count() == 2000
    assert t.read(buckets=done.touched).count() < 100


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, ("a", 0, "x")))
    bad = rows(spark, ("a", 1, "y"), ("b", 2, "z")).withColumn("v", F.when(F.col("n") == 2, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        t.merge(bad)
    assert t.version().number == 1 and held(t) == [("a", 0, "x")]
    t.merge(rows(spark, ("a", 1, "y")))
    assert t.vacuum() >= 1 and held(t) == [("a", 1, "y")]


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    write = t._write

    def slowly(*args):
        out = write(*args)
        other.merge(rows(spark, ("b", 0, "first")))
        return out

    monkeypatch.setattr(t, "_write", slowly)
    with pytest.raises(Conflict):
        t.merge(rows(spark, ("a", 0, "second")))
    assert held(other) == [("b", 0, "first")]


def test_repeated_steps_do_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, ("a", 0, "x")), mark=("stream", 0))
    assert t.merge(rows(spark, ("a", 9, "again")), mark=("stream", 0)).version == 1
    t.merge(rows(spark, ("a", 1, "y")), mark=("stream", 1))
    assert held(t) == [("a", 1, "y")] and t.version().marks == {"stream": 1}


def test_vacuum_keeps_what_versions_name(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4)
    for i in range(4):
        t.merge(rows(spark, ("a", i, str(i)), (f"b{i}", i, "")))
    t.vacuum(2)
    assert t.numbers() == [3, 4] and len(held(t)) == 5 and len(held(t, number=3)) == 4
    t.merge(gone=t.read().select("k"))
    assert held(t) == [] and t.vacuum() > 0


def test_a_merge_is_one_exchange(spark, tmp_path, monkeypatch):
    from quern.sources import keyed

    monkeypatch.setattr(keyed, "FILE_BYTES", 600)
    t = table(spark, tmp_path, buckets=2)
    first = [(f"k{i % 60}", i, "old") for i in range(200)]
    t.merge(spark.createDataFrame(first, SCHEMA))
    files = [f for fs in t.version().buckets.values() for f in fs]
    new = spark.createDataFrame([(f"k{i}", i, "new") for i in range(50, 70)] + [(None, 1, "no")], SCHEMA)
    gone = spark.createDataFrame([("k1",), ("k55",), (None,), ("k999",)], "k string")
    put = t._merged(files, new.where("k is not null"), gone.where("k is not null"), [0, 1], 20)
    plan = put._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    done = t.merge(new, gone)
    assert done.written > 2 and sorted(held(t)) == sorted([(k, v, s) for k, v, s in first if int(k[1:]) < 50 and k != "k1"] + [(f"k{i}", i, "new") for i in range(50, 70)])
