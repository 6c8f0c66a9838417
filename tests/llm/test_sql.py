"""Queries that SQL can express, against their SQL: on given tables and on rows made to differ in few words."""

import random

import duckdb
import pytest

from quern.llm import queries as llm


def fixture(spark, path):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(1, " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))), (2, "only six short words stand here"), (3, None), (4, ""), (5, "too few")] + [(10 + i, " ".join(word() for _ in range(14 + i))) for i in range(6)]
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "x " * 300), (5, "É漢😀 Only SIX short, words stand here!")]
    for i in range(60):
        t = [word() for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(1, 4)):
            copy = (rng.choice(items)[1] or "").split()
            copy = [word() if rng.random() < 0.12 else x for x in copy][rng.randrange(4) :]
            t += copy + [word() for _ in range(rng.randrange(10))]
        docs.append((100 + i, rng.choice([" ", "  ", "\n"]).join(t)))
    vectors = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(120)] + [(200, None), (201, [float("nan")] * 4), (202, [None] * 4), (203, [0.0] * 4), (204, [])]
    docs = [(d, t, rng.choice(["a", "a", "b", None])) for d, t in docs] + [(1000 + i, rng.choice(["x", None, ""]), rng.choice(["a", "c"])) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, rng.choice([0, 1, 1, None])) for d in (3, 3, 4, None, *range(1000, 1300, 7))], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path), "/*.parquet"


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_queries_equal_sql(spark, data, tmp_path, name):
    for d, files in ((data, ""), fixture(spark, tmp_path)):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet{files}'")
        got, want = llm.QUERIES[name](spark, d), con.execute(llm.ORACLE_SQL[name])
        cols, named = sorted(got.columns), [c[0] for c in want.description]
        assert cols == sorted(named)
        found = sorted(map(tuple, got.select(cols).collect()), key=str)
        assert found and found == sorted((tuple(r[named.index(c)] for c in cols) for r in want.fetchall()), key=str)
