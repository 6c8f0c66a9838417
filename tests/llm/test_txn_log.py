"""Transaction log reassembly against a plain replay of the log."""

import random
import zlib

import pytest

from quern.llm import txn_log

LOG = "pos long, source string, op int, key long, value long"


def replay(rows, epoch=txn_log.EPOCH):
    """(states, undone) of log records in order."""
    running, store, n, states, undone = {}, {}, 0, [], []
    for pos, source, op, key, value in rows:
        live, marks = running.setdefault(source, ([], []))
        if op == txn_log.CHANGE:
            live.append((pos, key, value))
        elif op == txn_log.SAVEPOINT:
            marks.append(len(live))
        elif op == txn_log.ROLLBACK:
            at = marks.pop() if marks else 0
            undone += [("rollback", c[0], pos, c[1]) for c in live[at:]]
            del live[at:]
        else:
            del running[source]
            if op == txn_log.ABORT:
                undone += [("abort", c[0], pos, c[1]) for c in live]
                continue
            for _, k, v in live:
                store.pop(k, None)
                if v is not None:
                    store[k] = v
            n += 1
            if n % epoch == 0:
                states.append((len(states) + 1, len(store), sum(store.values())))
    if n % epoch:
        states.append((len(states) + 1, len(store), sum(store.values())))
    undone += [("abort", c[0], None, c[1]) for live, _ in running.values() for c in live]
    return states, undone


def found(log, **options):
    changes, states = txn_log.reassemble(log, **options)
    undone = [(r.fate, r.pos, r.by, r.key) for r in changes.where("fate <> 'committed'").collect()]
    return sorted((r.epoch, r.n_keys, r.total) for r in states.collect()), sorted(undone, key=str)


def same(got, want):
    assert got == (sorted(want[0]), sorted(want[1], key=str))


def made(n, seed, ops, sources=("a", "a", "a", "b", None)):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), rng.choice(ops), rng.choice([None, 1, 2, 3, 40]), rng.choice([None, rng.randrange(10**9)])) for i in range(n)]


@pytest.mark.parametrize(("blocks", "segment"), [(5, 2), (3, 7), (64, 512)])
def test_equals_a_replay(spark, blocks, segment):
    rows = made(3000, 1, [0] * 14 + [1, 1, 1, 2, 2, 2, 3, 4])
    log = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), LOG)
    same(found(log, blocks=blocks, segment=segment), replay(rows))


def test_rollbacks_reach_into_earlier_segments(spark):
    """One source that hardly ever ends a transaction: most rollbacks meet savepoints of other segments."""
    rows = made(900, 3, [0] * 8 + [1] * 5 + [2] * 4, ["hot"]) + [(900, "hot", 4, None, None), (901, "hot", 0, 1, 5), (902, "hot", 2, None, None), (903, "hot", 2, None, None)]
    same(found(spark.createDataFrame(rows, LOG), blocks=4, segment=3), replay(rows))


def test_odd_logs(spark):
    none = spark.createDataFrame([], LOG)
    assert found(none) == ([], [])
    no_commit = [(1, "a", 0, 7, 1), (2, None, 0, None, 2), (3, "a", 3, None, None), (4, "", 0, 7, 3)]
    same(found(spark.createDataFrame(no_commit, LOG)), replay(no_commit))
    empty = [(i, "a", 4, None, None) for i in range(9)] + [(9, "b", 4, None, None)]
    assert found(spark.createDataFrame(empty, LOG)) == ([(1, 0, 0), (2, 0, 0), (3, 0, 0)], [])
    # no position: no record; equal records are as many; extra columns with names of the operator's own are ignored
    odd = [(None, "a", 4, None, None), (1, "a", 0, 5, 8), (1, "a", 0, 5, 8), (2, "a", 4, None, None), (2, "a", 4, None, None), (3, "a", 0, 5, None), (4, "a", 4, None, None)]
    log = spark.createDataFrame(odd, LOG).selectExpr("*", "1 as block", "'x' as txn", "2 as `~x`", "3 as seg", "4 as src")
    same(found(log, epoch=1), replay(odd[1:], 1))


def test_query_over_documents(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text")
    more = spark.createDataFrame([(10**6 + i, None if i % 3 else "src0", None if i % 5 == 0 else "é" * (i % 7)) for i in range(400)], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    labels.unionByName(spark.createDataFrame([(10**6 + 8, 1), (10**6 + 8, 1), (10**6 + 9, None), (None, 1)], labels.schema)).write.parquet(f"{tmp_path}/labels.parquet")
    bad = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/labels.parquet").where("toxic = 1").collect()}
    rows = []
    for r in sorted(docs.unionByName(more).collect(), key=lambda r: r.doc_id):
        h = zlib.crc32(str(r.doc_id).encode())
        op = next(op for most, op in ((1, 4), (2, 3), (4, 1), (6, 2), (22, 0)) if h % 23 <= most)
        key = h // 100 % 300
        rows.append((r.doc_id, r.source, op, key, None if r.text is None or r.doc_id in bad else zlib.crc32(f"{key}:{r.text}".encode())))
    states, undone = replay(rows)
    want = [("state", *s) for s in states] + undone
    assert sorted(map(tuple, txn_log.op11_txn_log(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
