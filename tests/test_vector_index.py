"""The vector index against the search over all vectors, after documents came and went."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import vectors
from quern.operators.vector_index import VectorIndex

ROW = "workspace_id string, document_id string, chunk_id string, vec array<double>"
DIM = 8


def made(n, seed, workspaces=("w", "w", "x")):
    """Vectors around ten directions, copies and zero vectors among them."""
    rng = np.random.default_rng(seed)
    heads = np.random.default_rng(0).normal(size=(10, DIM)) * 4
    v = heads[rng.integers(0, 10, n)] + rng.normal(size=(n, DIM)) * 0.6
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[::17] = 0
    v[1::13] = v[1]
    return [(workspaces[i % len(workspaces)], f"d{i // 3}", f"c{i}", [float(x) for x in v[i]]) for i in range(n)]


@pytest.fixture(scope="module")
def setting(spark, tmp_path_factory):
    rows = made(900, 1)
    frame = spark.createDataFrame(rows, ROW)
    path = f"file://{tmp_path_factory.mktemp('vectors')}/v"
    index = VectorIndex.create(spark, path, frame, DIM, cells=20)
    index.upsert(spark.createDataFrame([(w, d, f"{c}old", v[::-1]) for w, d, c, v in rows[:300]], ROW))
    index.upsert(frame)
    index.upsert(spark.createDataFrame([("w", "odd", "n", None), ("w", "odd", "m", [1.0]), ("w", "odd", "o", [float("nan")] * DIM)], ROW))
    index.delete(spark.createDataFrame([("d5",), ("d6",), ("never",)], "document_id string"))
    held = spark.createDataFrame([r for r in rows if r[1] not in ("d5", "d6")], ROW).cache()
    asked = spark.createDataFrame([(i, r[3]) for i, r in enumerate(made(40, 2))] + [(100, None), (101, [2.0] * 3), (102, [3.0] + [0.0] * 7)], "query_id int, vec array<double>")
    return VectorIndex(spark, path), held, asked


def rows(d):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 7)) for r in d.select("query_id", "rank", "chunk_id", "score").collect())


@pytest.mark.parametrize(("k", "workspace", "limit"), [(1, None, 1 << 20), (10, None, 1 << 10), (7, "x", 1 << 20), (2000, "w", 1 << 20)])
def test_same_rows_as_the_search_over_all_vectors(setting, k, workspace, limit):
    index, held, asked = setting
    some = held if workspace is None else held.where(F.col("workspace_id") == workspace)
    got = index.top_k(asked, k, workspace, limit)
    assert rows(got.rows) == rows(vectors.top_k(asked.withColumn("variant", F.lit(0)), some, k, k, DIM))
    assert got.of == 41 * some.count() and got.compared <= got.of
    if k <= 10:
        assert got.compared < 0.5 * got.of


def test_no_such_workspace_and_no_queries(setting):
    index, _, asked = setting
    assert index.top_k(asked, 3, "none").rows.count() == index.top_k(asked.limit(0), 3).rows.count() == 0


def test_updates_touch_their_cells_alone(spark, tmp_path):
    index = VectorIndex.create(spark, f"file://{tmp_path}/v", spark.createDataFrame(made(600, 3), ROW), DIM, cells=16)
    index.upsert(spark.createDataFrame(made(600, 3), ROW))
    done = index.upsert(spark.createDataFrame(made(600, 3)[3:6], ROW))
    assert len(done.touched) <= 3 and done.kept >= 10 and index.vectors.read(number=done.version).count() == 600


def test_queries_in_blocks_equal_one_block(setting):
    _, held, asked = setting
    asked = asked.withColumn("variant", F.col("query_id") % 2)
    assert rows(vectors.top_k(asked, held, 5, 5, DIM, limit=300)) == rows(vectors.top_k(asked, held, 5, 5, DIM))


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], ROW)
    index = VectorIndex.create(spark, f"file://{tmp_path}/v", none, DIM)
    index.upsert(none)
    assert index.top_k(spark.createDataFrame([(1, [1.0] * DIM)], "query_id int, vec array<double>"), 3).rows.count() == 0
