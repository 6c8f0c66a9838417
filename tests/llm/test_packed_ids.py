"""Fixed-width packing and its files against the tokenizers library and plain lists."""

import random
import zlib

import numpy as np
import pytest

from quern.llm import packed_ids


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library(text), 2]
        out.append((doc_id, start, ids))
        start += len(ids)
    return out


ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (-4, "one"), (5, "x " * 30_000), (6, "same text here"), (6, "same text here"), (6, None), (7, "same text here"), (8, "é漢😀 <|endoftext|> '"), (1 << 62, "a@b.c"), (None, None)]


@pytest.mark.parametrize("bits", [1, 2, 7, 15, 16, 17, 31, 32])
def test_packing_is_exact(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        words = packed_ids.pack(ids, bits)
        assert words.nbytes == -(-n // 64) * 8 * bits
        assert (packed_ids.unpack(words, bits)[:n] == ids).all()
    with pytest.raises(ValueError, match="more than"):
        packed_ids.pack(np.array([1 << bits], np.uint64), bits)


def test_file_and_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(None if i % 7 == 0 else i, rng.integers(0, 50_000, int(rng.integers(0, 300)), dtype=np.uint32)) for i in range(200)] + [(999, np.arange(5000, dtype=np.uint32))]
    w = packed_ids.Writer(f"file://{tmp_path}/a/x.ids", 16, 700)
    for d in docs:
        w.add(*d)
    assert len(w.close()) > 10
    r = packed_ids.Reader(f"file://{tmp_path}/a/x.ids")
    flat = np.concatenate([x for _, x in docs])
    assert (r.bits, r.n_docs, r.n_ids) == (16, len(docs), len(flat))
    for i in (0, 7, 8, 123, 200):
        assert r.document(i)[0] == docs[i][0] and (r.document(i)[1] == docs[i][1]).all()
    for start, n in ((0, 1), (0, len(flat)), (63, 2), (690, 1500), (len(flat) - 3, 10), (len(flat), 5)):
        assert (r.ids(start, n) == flat[start : start + n]).all()
    with pytest.raises(IndexError):
        r.document(len(docs))
    (tmp_path / "a/cut.ids").write_bytes((tmp_path / "a/x.ids").read_bytes()[:-1])
    with pytest.raises(ValueError, match="no whole file"):
        packed_ids.Reader(f"file://{tmp_path}/a/cut.ids")


def test_odd_rows(spark, library):
    docs = spark.createDataFrame(random.Random(1).sample(ODD, len(ODD)), "doc_id long, text string").selectExpr("*", "1 as start", "'x' as file", "2 as ids").repartition(3)
    manifest = packed_ids.write_ids(docs, block_ids=50)
    want = expected(ODD, library)
    assert sorted(((r.doc_id, r.start, r.ids) for r in packed_ids.documents(manifest).collect()), key=lambda r: r[1]) == want
    got = sorted((tuple(r) for r in packed_ids.digests(manifest).collect()), key=lambda r: r[1])
    assert got == [(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, s, x in want]
    empty = packed_ids.write_ids(docs.limit(0))
    assert empty.count() == 0 and packed_ids.digests(empty).count() == 0 and packed_ids.read_ranges(empty, docs.selectExpr("1L as start", "5L as n")).count() == 0


def test_query_equals_the_library_and_ranges_are_read(spark, data, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = expected(rows, library)
    got = sorted(tuple(r) for r in packed_ids.op13_packed_ids(spark, data).collect())
    assert got == sorted((d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, s, x in want)
    manifest = packed_ids.write_ids(spark.read.parquet(f"{data}/documents.parquet").repartition(4), block_ids=3000)
    flat = [i for _, _, x in want for i in x]
    asked = [(0, 1), (5, 10_000), (len(flat) - 7, 100), (len(flat), 3), (-4, 9), (2999, 2), (77, 0), (None, 3), (100, len(flat))]
    found = {(r.start): r.ids for r in packed_ids.read_ranges(manifest, spark.createDataFrame(asked, "start long, n long")).collect()}
    assert found == {s: flat[max(s, 0) : s + n] for s, n in asked if s is not None and n and s < len(flat)}
