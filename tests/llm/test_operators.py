"""Each operator against brute force and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quern.llm import bpe, common, components, decontaminate, embed_dedup, line_dedup, lm_score, pii, simhash, substring_dedup, token_counts, toxicity

DOC = "doc_id long, text string"
ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x " * 30_000), (6, "same text here"), (6, "same text here"), (7, "same text here"), (8, "é漢😀 <|endoftext|> '"), (9, "a@b.c")]


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def components_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())


# --- substring dedup ---


def repeats(rows, w=20):
    seen, out = {}, {}
    texts = {d: words(t) for d, t in rows}
    for d in sorted(texts):
        for p in range(len(texts[d]) - w + 1):
            seen.setdefault(tuple(texts[d][p : p + w]), (d, p))
    for d, t in texts.items():
        gone = [0] * len(t)
        for p in range(len(t) - w + 1):
            if seen[tuple(t[p : p + w])] != (d, p):
                gone[p : p + w] = [1] * w
        kept = " ".join(x for x, g in zip(t, gone) if not g)
        out[d] = (len(t), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.find_repeats(docs, digest=True, chunk_bytes=20_000).collect()}
    assert got == repeats(rows)


def test_substring_dedup_offsets(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5)}" for _ in range(400)]
    rows = [(i, " ".join(base[(a := rng.randrange(300)) : a + rng.randrange(15, 60)] + [f"u{rng.random()}"] * rng.randrange(3))) for i in range(60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.find_repeats(spark.createDataFrame(rows, DOC), digest=True, chunk_bytes=500).collect()}
    assert got == repeats(rows)


def test_substring_dedup_odd_rows(odd, none):
    got = substring_dedup.find_repeats(odd).collect()
    assert len(got) == len(ODD)
    long = next(r for r in got if r.doc_id == 5)
    assert (long.n_words, long.n_removed) == (30_000, 29_999)
    assert substring_dedup.find_repeats(none).count() == 0


# --- decontamination ---


def test_leaks_tolerate_substitutions(spark):
    rng = random.Random(2)
    item = [f"t{rng.randrange(10**6)}" for _ in range(40)]
    changed = [f"z{i}" if i % 11 == 5 else w for i, w in enumerate(item)]
    clean = [f"c{rng.randrange(10**6)}" for _ in range(200)]
    docs = spark.createDataFrame([(1, " ".join(clean[:50] + item + clean[50:])), (2, " ".join(clean[:20] + changed).upper()), (3, " ".join(clean)), (4, None), (5, "five short words are here now"), (6, ""), (1, " ".join(item))], DOC)
    items = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "short words are here now"), (13, "here now"), (10, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 10), (2, 10), (5, 12)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, block_bytes=100).collect()} == got
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 == decontaminate.leaks(docs.limit(0), items).count()


def test_leaks_find_all_whole_passages(spark, docs, rows, data):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    plain = lambda x: " " + " ".join(re.findall(r"[^\W_]+", x.lower())) + " "
    want = {(d, i.item_id) for i in items.collect() for d, t in rows if plain(i.text) in plain(t)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == want


def best_stretch(match):
    """(matches, start, end) of the earliest stretch of the highest sum of 1 and -2, by trying all."""
    best = (0, 0, 0)
    for i in range(len(match)):
        total = 0
        for j in range(i, len(match)):
            total += 1 if match[j] else -2
            if total > best[0]:
                best = (total, i, j + 1)
    return sum(match[best[1] : best[2]]), best[1], best[2]


def test_leaks_lose_no_overlap_that_all_diagonals_have(spark):
    rng = random.Random(12)
    lex = [f"t{i}" for i in range(400)]
    items = [(k, [rng.choice(lex) for _ in range(n)]) for k, n in enumerate([5, 7, 8, 9, 12, 13, 16, 20, 40, 60] * 3)]
    docs = []
    for i in range(150):
        k, item = rng.choice(items)
        part = item.copy()
        if i % 3 == 0:
            for j in range(i % 5, len(part), rng.choice([3, 4, 5, 6])):
                part[j] = rng.choice(lex)
        else:
            part = [rng.choice(lex) if rng.random() < rng.choice([0.1, 0.2, 0.25, 0.3]) else w for w in part]
        docs.append((i, [rng.choice(lex) for _ in range(rng.randrange(30))] + part[rng.randrange(3) :] + [rng.choice(lex) for _ in range(rng.randrange(30))]))
    want = set()
    for d, t in docs:
        for k, q in items:
            for b in range(1 - len(q), len(t)):
                lo, hi = max(b, 0), min(b + len(q), len(t))
                if best_stretch([t[p] == q[p - b] for p in range(lo, hi)])[0] >= decontaminate.needed(len(q)):
                    want.add((d, k))
    frame = lambda rows, names: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], names)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(docs, DOC), frame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) >= 30


def test_leaks_of_one_word_many_times():
    import pyarrow as pa

    index = decontaminate.Index(["na " * 100, "other words that are not there at all now"], 5)
    got = list(decontaminate._scan(pa.array(["na " * 20_000, "na " * 40]), index, decontaminate.MATCHES))
    assert got == [(0, 0, 0, 100, 100), (1, 0, 0, 40, 40)]


# --- line dedup ---


def test_patience_matches_in_order():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert line_dedup.patience([], [1]) == []
    pairs = line_dedup.patience([1, 5, 1, 5, 2], [5, 1, 5, 2])
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def aligned(a, b):
    """Pairs of equal lines by patience: unique common lines in their longest common order, and the same between them."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in aligned(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return aligned(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not once:
        out, low = [], -1
        for j, x in enumerate(b):
            if x in a[low + 1 :]:
                low = a.index(x, low + 1)
                out.append((low, j))
        return out
    best = []
    for i, j in once:
        best.append(max(([*c, (i, j)] for c in [[], *best] if not c or c[-1][1] < j), key=len))
    out, last = [], (-1, -1)
    for i, j in [*max(best, key=len), (len(a), len(b))]:
        out += [(last[0] + 1 + x, last[1] + 1 + y) for x, y in aligned(a[last[0] + 1 : i], b[last[1] + 1 : j])]
        if i < len(a):
            out.append((i, j))
        last = (i, j)
    return out


def cut_by(earlier, later):
    """Lines of the later text in aligned blocks with a line of four words."""
    a, b = ([x.strip() for x in t.split("\n")] for t in (earlier, later))
    runs, out = [], set()
    for i, j in aligned(a, b):
        if runs and runs[-1][-1] == (i - 1, j - 1):
            runs[-1].append((i, j))
        else:
            runs.append([(i, j)])
    for run in runs:
        if any(len(b[j].split()) >= 4 for _, j in run):
            out |= {j for _, j in run}
    return out


def test_line_dedup_finds_what_all_pairs_find(spark, docs, rows):
    rng = random.Random(6)
    lines = [" ".join(f"v{rng.randrange(10**4)}" for _ in range(5)) for _ in range(60)]
    made = []
    for i in range(60):
        t = lines.copy()
        a, b = sorted(rng.sample(range(60), 2))
        t = rng.choice([t[a:b], t[a:b][::-1], t[b:] + t[:a], rng.sample(t, 8)])
        made.append((50_000 + i, "\n".join([f"an own line of text {i}", *t])))
    texts = sorted([*rows, *made])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(texts, DOC)).collect()}
    told = {d: {x.strip() for x in t.split("\n") if len(x.split()) >= 4} for d, t in texts}
    before = {d: {x.strip() for x in t.split("\n")} for d, t in texts}
    every = found = 0
    for n, (d, t) in enumerate(texts):
        want = set().union(*(cut_by(e, t) for c, e in texts[:n] if told[c] & told[d]))
        gone = Counter(t.split("\n")) - Counter(got[d].text.split("\n"))
        assert all(any(x.strip() in before[c] for c, _ in texts[:n]) for x in gone)
        every, found = every + len(want), found + got[d].n_removed_lines
    assert every > 300 and 0.95 * every <= found <= 1.05 * every


def test_line_dedup_sees_past_the_earliest_holder(spark):
    lines = [f"line number {w} of twelve" for w in "a b c d e f g h i j k l".split()]
    mixed = [lines[i] for i in (5, 2, 9, 0, 7, 11, 3, 1, 10, 4, 8, 6)]
    docs = spark.createDataFrame([(1, "\n".join(mixed)), (2, "\n".join(lines)), (3, "\n".join(lines))], DOC)
    assert {r.doc_id: r.n_removed_lines for r in line_dedup.dedup_lines(docs).collect()}[3] == 12


def test_line_dedup_keeps_odd_columns(spark):
    text = "four words are here\nx"
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4), (2, text, 1, 2, 3, 4)], "doc_id long, text string, __key int, uid int, cut int, `a``b` int")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "__key", "uid", "cut", "a`b", "n_lines", "n_removed_lines"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, text, 1, 2, 3, 4, 2, 0), (2, "", 1, 2, 3, 4, 2, 2)]


def test_line_dedup_odd_rows(spark, odd, none):
    clash = spark.createDataFrame([(1, "the same four words\nx", 9), (2, "y\nthe same four words\nx", 9), (2, "the same four words", 9), (None, "the same four words", 9)], DOC + ", n_lines long")
    got = line_dedup.dedup_lines(clash).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_lines) for r in got) == [(0, "the same four words", 1), (1, "x", 2), (2, "", 1), (2, "y\nx", 3)]
    assert line_dedup.dedup_lines(odd).count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0


# --- token counts, BPE ---


def test_token_counts_of_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    want, uris = [], []
    for f, n in enumerate((0, 3000, 777)):
        x = rng.integers(0, 9, n).astype("<u2")
        x[1000:2500] = 1
        x.tofile(tmp_path / str(f))
        uris.append(f"file://{tmp_path}/{f}")
        k = o = 0
        for v in x:
            k, o = (0, o + 1) if v == 7 and not want.append((f, o, k)) else (k + 1, o)
        if k:
            want.append((f, o, k))
    got = token_counts.count_tokens(token_counts.blocks_of_files(spark, uris, block_bytes=100), separator=7).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_token_counts_of_documents(odd, none):
    blocks, where = token_counts.write_tokens(odd, block_bytes=1000)
    got = where.join(token_counts.count_tokens(blocks), ["shard", "ordinal"]).collect()
    codec = bpe.codec(plain=True)
    assert sorted(((r.doc_id or -1), r.n_tokens) for r in got) == sorted(((d or -1), len(codec.encode(t))) for d, t in ODD)
    blocks, where = token_counts.write_tokens(none)
    assert where.count() == token_counts.count_tokens(blocks).count() == 0


def test_bpe_equals_the_library(monkeypatch, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.no_truncation()
    whole.no_padding()
    codec, rng = bpe.codec(), random.Random(3)
    monkeypatch.setattr(bpe, "CHUNK_BITS", 3)
    letters = "ab'stre 1.\n\t  é字，。́\x1c ​😀İ᠎$!ñ٣ऀⅷ²\x85\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) + rng.choice(["", "<|endoftext|>", "<|endof"]) for _ in range(400)] + [t for _, t in ODD if t]
    for t in texts:
        want = whole.encode(t, add_special_tokens=False).ids
        assert codec.encode(t).tolist() == want
        assert codec.decode(codec.encode(t)) == whole.decode(want, skip_special_tokens=False)
    got = bpe.encode_decode(odd).collect()
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t in ODD)


def test_bpe_reuses_chunks():
    codec = bpe.Codec(*(__import__("public_tokenizers").path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")))
    rng = random.Random(4)
    passage = " ".join(str(rng.random()) for _ in range(400))
    codec.encode("start one " + passage)
    before = codec.encoded
    codec.encode("another and longer start " + passage)
    assert codec.reused >= 5 and codec.encoded - before <= 3


# --- language model ---


def test_lm_counts_and_distribution(docs, rows):
    got = {r.doc_id: r for r in lm_score.score_texts(docs, chunk_bytes=100_000).collect()}
    toks = {d: [w for w in re.split(rb"[\x20\x09-\x0D]+", t.encode().lower()) if w] + [None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in toks}
    c = Counter(w for d in toks if not held[d] for w in toks[d])
    n, v = sum(c.values()), len(c)
    for d, ws in toks.items():
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_probabilities_sum_to_one(spark):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{min(int(x), 60)}" for x in rng.geometric(0.1, 30)) for _ in range(40)]
    t = lm_score._Tokens(pa.table({"doc_id": pa.array(range(40)), "text": texts}))
    uniq, inverse = t.distinct
    count = np.bincount(inverse)
    words_ = np.flatnonzero(uniq != lm_score.END_HASH)
    often = words_[np.argsort(-count[words_], kind="stable")][: lm_score.TOP]
    top = np.sort(np.array([(uniq[w], i) for i, w in enumerate(often)], lm_score._TOP), order="h")
    ending = np.zeros(len(uniq), np.int64)
    ending[inverse] = t.ending
    cluster = np.arange(lm_score.ENDINGS) % lm_score.CLUSTERS
    mass = np.zeros(lm_score.CLASSES)
    for w in words_:
        if w not in often[: lm_score.OWN]:
            mass[2 + lm_score.OWN + cluster[ending[w]]] += count[w] - lm_score.DISCOUNT
    m = lm_score.Model(top, cluster, np.maximum(mass, 1e-9), np.full(lm_score.CLASSES, 1 / lm_score.CLASSES), 1, 1)
    m.w[:] = rng.normal(size=m.w.shape)
    f = m.features(t, t.codes(m.top))[:, :1]
    z = np.exp(m.logits(f)[0])
    p = z / z.sum()
    y = np.array([2 + list(often).index(w) if w in often[: lm_score.OWN] else 2 + lm_score.OWN + cluster[ending[w]] for w in words_])
    inside = np.array([1.0 if k < 2 + lm_score.OWN else (count[w] - lm_score.DISCOUNT) / mass[k] for w, k in zip(words_, y)])
    used = {0, 1, *y.tolist()}
    assert abs(sum(p[k] * x for k, x in zip(y, inside)) + p[0] + p[1] - sum(p[k] for k in used)) < 1e-5


def test_lm_pair_weights_fit():
    rng = np.random.default_rng(4)
    context, word = rng.integers(0, 40, 4000), (rng.zipf(1.6, 4000) % 30)
    share = rng.dirichlet(np.ones(30))
    key, n = np.unique(context.astype(np.uint64) << np.uint64(lm_score.WORD_BITS) | word.astype(np.uint64), return_counts=True)
    n = np.where(rng.random(len(n)) < 0.1, 0, n)  # pairs of held-out texts alone
    q = share[(key & np.uint64((1 << lm_score.WORD_BITS) - 1)).astype(int)]
    p = lm_score.pair_factors(key, n, q)
    for c in range(40):
        at = np.flatnonzero(key >> np.uint64(lm_score.WORD_BITS) == c)
        other = 1 - q[at].sum()
        z = np.exp(np.log(q[at]) - np.log(p[at]))  # of words whose weight is zero
        plain = np.flatnonzero((n[at] == 0) | np.isclose(z, z[n[at] == 0].mean() if (n[at] == 0).any() else z.max()))
        if len(plain):
            assert np.allclose(z[plain], z[plain][0])
            assert abs(p[at].sum() + other / z[plain][0] - 1) < 1e-9
            assert (np.log(p[at] * z[plain][0] / q[at]) > -1e-9).all()  # no weight is negative
        want = p[at] * n[at].sum()
        assert (want[n[at] > 0] < np.maximum(n[at], q[at] / z.min() * n[at].sum())[n[at] > 0] + 1e-9).all()


def test_lm_text_seen_twice_scores_above_one_seen_once(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(60))) for i in range(300)]
    train = [d for d, _ in texts if zlib.crc32(str(d).encode()) % 5 != 1]
    twice = [(next(x for x in range(1000 + 9 * d, 10**6) if zlib.crc32(str(x).encode()) % 5 != 1), t) for d, t in texts if d in train[:20]]
    got = {r.doc_id: r.score / r.n_tokens for r in lm_score.score_texts(spark.createDataFrame(texts + twice, DOC)).collect()}
    held = [got[d] for d, _ in texts if d not in train]
    once = [got[d] for d in train[20:]]
    assert np.mean([got[d] for d in train[:20]]) > np.mean(once) + 0.1 and min(once) > max(held)


def test_lm_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1000, (50, 20_000))
    parts = [(i, bytearray(p)) for v in x for i, p in zip(*common.pieces(v.astype("<i8")))]
    rows = spark.createDataFrame(parts, "piece int, x binary")
    for k in (1, 7, 60):
        assert (common.summed(rows.repartition(k), 20_000, "<i8") == x.sum(axis=0)).all()
    assert (common.summed(rows.limit(0), 20_000, "<i8") == 0).all()


def test_lm_odd_rows(odd, none):
    got = lm_score.score_texts(odd).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert lm_score.score_texts(none).count() == 0


# --- toxicity ---


def test_toxicity_held_out(spark, docs, data):
    from pyspark.sql import functions as F

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(more, labels)
    got = toxicity.score(more, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    r = got.agg(F.avg((F.col("toxic_predicted") == F.col("toxic")).cast("double")), F.min("toxic_score"), F.max("toxic_score")).first()
    assert r[0] > 0.9 and 0 <= r[1] and r[2] <= 1


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(2)
    n, v = 600, 300
    r, t = np.nonzero(rng.random((n, v)) < 0.1)
    count, weight = rng.integers(1, 5, len(r)).astype(float), rng.random(v) + 0.01
    labels = (rng.random(n) < 0.3).astype(float)
    m = toxicity.Model(np.arange(v, dtype=np.uint64), weight, np.arange(n), labels, r, t, count, 0.3)
    x = np.zeros((n, v))
    x[r, t] = (1 + np.log(count)) * weight[t]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for _ in range(100):
        q = rng.random(v) * (rng.random(v) < rng.choice([0.01, 0.05, 0.3]))
        if q.any():
            q /= np.linalg.norm(q)
            at, s = m.nearest(np.flatnonzero(q), q[q > 0])
            cos = x @ q
            want = np.sort(cos)[::-1][: toxicity.K]
            assert np.allclose(s, want[want > 0]) and np.allclose(cos[m.ids[at]], s)
            assert (m.labels[at] == labels[m.ids[at]]).all()


def test_toxicity_finds_evidence_for_nearly_all(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = toxicity.score(docs, model).where("text rlike '[a-zA-Z]{2}'").agg(F.avg((F.size("nearest") > 0).cast("double")), F.countDistinct("toxic_score")).first()
    assert got[0] > 0.99 and got[1] > 500


def test_toxicity_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "some words", "mine", 7.0), (2, None, "mine", 7.0)], "doc_id long, text string, nearest string, toxic_score double")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    assert got.columns == ["doc_id", "text", "toxic_score", "toxic_predicted", "nearest", "similarity"] and all(0 <= r.toxic_score <= 1 for r in got.collect())


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None), (6, 1)], "doc_id long, toxic int")
    for table in (labels, labels.limit(0)):
        got = toxicity.score(odd, toxicity.fit(odd, table)).collect()
        assert len(got) == len(ODD) and all(0 <= r.toxic_score <= 1 for r in got)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


# --- SimHash, components, embeddings ---


def fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, rows):
    rng = random.Random(5)
    close = [f"q{rng.randrange(9)}" for _ in range(300)]
    extra = [(10_000 + i, " ".join(close[:k] + ["zz"] + close[k + 1 :])) for i, k in enumerate(range(0, 300, 10))]
    texts = sorted([*rows, *extra, *((20_000 + i, t) for i, (_, t) in enumerate(ODD))])
    f = [fingerprint(t) for _, t in texts]
    part = components_of(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2])
    want = {d: (f"{x:016x}", texts[p][0]) for (d, _), x, p in zip(texts, f, part)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(texts, DOC)).collect()}
    assert got == want


def test_simhash_odd_rows(odd, none):
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("n", "edges"), [(200, "chain"), (300, "random"), (10, "none"), (500, "star")])
def test_components(spark, n, edges):
    rng = random.Random(6)
    p = list(range(n))
    rng.shuffle(p)
    pairs = {"chain": [(p[i], p[i + 1]) for i in range(n - 1)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)], "none": [], "star": [(p[0], x) for x in p]}[edges]
    want = components_of(n, pairs)
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "u long, v long").repartition(3)).collect()))
    assert got == {x: want[x] for pair in pairs if pair[0] != pair[1] for x in pair}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    mids = rng.normal(size=(30, 16))
    x = (mids[rng.integers(0, 30, 300)] + rng.normal(size=(300, 16)) * rng.choice([0.05, 0.25, 0.4], (300, 1))).astype(np.float32).astype(float)
    x[5] = x[9] * 3
    x[20] = x[21]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [None] * 16, [1.0, 2.0], []]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    x[50:60] *= 1e200
    x[60:70] *= 1e-200
    rows = [(i, v) for i, v in enumerate([*x.tolist(), *odd])]
    pairs = np.argwhere(np.triu(u @ u.T >= 0.9, 1)).tolist()
    n, part = Counter(i for p in pairs for i in p), components_of(len(rows), pairs)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=20).collect()}
    assert got == {i: (n[i], part[i], part[i] == i) for i in range(len(rows))}
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_links_of_a_dense_tile_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    base = rng.normal(size=256)
    x = base + 0.333 * np.abs(base).mean() * 1.25 * rng.normal(size=(1500, 256)) * 1.2
    tracemalloc.start()
    n = sum(len(i) for i, _ in embed_dedup.links(x, x, 0.9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert abs(n - int((u @ u.T >= 0.9).sum())) <= 2 and peak < 300 << 20


def test_quantisation_bound_holds():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(100, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embed_dedup.quantise(x)
    approx = (q.astype(float) @ q.astype(float).T) * s[:, None] * s
    assert (np.abs(approx - x @ x.T) <= e[:, None] + e + e[:, None] * e).all()


# --- PII ---

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def base(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_pii_base_equals_brute_force(spark, rows):
    odd = ["😀 a.b@c.de, 4111 1111 1111 1111 +49 (170) 123-4567 10.0.0.1.2.3.4.5 256.1.1.1", "1 " * 20_000, "0" * 30_000, "a." * 9000 + "@b" + ".c" * 9000, "+1" + "(" * 5000 + "1", "0000.1.01.255 4111-1111-1111-1111-1", None, ""]
    texts = [*rows, *((90_000 + i, t) for i, t in enumerate(odd))]
    got = pii.find(spark.createDataFrame(texts, DOC)).select("doc_id", pii._joined("base").alias("b")).collect()
    assert {r.doc_id: r.b for r in got} == {d: base(t) for d, t in texts}


def test_pii_marks_disclosing_terms(spark, none):
    rng = random.Random(9)
    rows = [(i, f"Contact Zarathustra Smith, now bob@corp.com please nr {i}") for i in range(5)] + [(100 + i, f"Smith and others {rng.random()} now please contact") for i in range(300)]
    found = pii.find(spark.createDataFrame(rows, DOC))
    got = {r.doc_id: [s.value for s in r.spans] for r in found.collect()}
    assert "zarathustra" in got[0] and "smith" not in got[0] and "bob@corp.com" in got[0]
    clean = {r.doc_id: r.text for r in pii.sanitise(found).collect()}
    assert clean[0].startswith("Contact  Smith,") and "[EMAIL]" in clean[0] and clean[100] == dict(rows)[100]
    assert pii.find(none).count() == 0


def test_pii_terms_far_away_and_in_other_texts(spark):
    fill = " ".join(f"filler{i}" for i in range(40))
    rows = [(i, f"l'Orsavel d'une {fill} call ann@corp.com or x {i}") for i in range(6)]
    rows += [(50 + i, f"d'une {fill} call me or x {i}") for i in range(300)] + [(999, "Orsavel stands alone"), (None, "ORSAVEL ann@corp.com Orsavel@corp.com")]
    found = {r.doc_id: [(s.kind, s.start, s.end, s.value) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, DOC)).collect()}
    assert ("term", 2, 9, "orsavel") in found[0] and all(v not in ("une", "call", "filler7", "ann", "corp") for *_, v in found[0])
    assert found[999] == [("term", 0, 7, "orsavel")] and found[50] == []
    assert found[None] == [("term", 0, 7, "orsavel"), ("email", 8, 20, "ann@corp.com"), ("email", 21, 37, "Orsavel@corp.com")]


def test_pii_of_kinds(spark):
    rows = [(i, f"telefoon {i} +31 20 555 01{i:02d} graag") for i in range(8)] + [(100 + i, f"graag {i} iets anders") for i in range(150)]
    told = {s.value for r in pii.find(spark.createDataFrame(rows, DOC)).collect() for s in r.spans if s.kind == "term"}
    assert told == {"telefoon"}


def test_pii_many_entities_in_one_text(spark):
    texts = [(1, " ".join(f"a{i}@b.cc," for i in range(3000))), (2, " ".join(f"{i * 7919 % 10**9:09d}," for i in range(20_000)))]
    got = {r.doc_id: len(r.base) for r in pii.find(spark.createDataFrame(texts, DOC)).collect()}
    assert got == {1: 3000, 2: 0}
