"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) P(word | class, word before). The class factor is a log-linear model over hashed features of the
three words before: each alone (skips included) and the nearest two together. Words count as themselves where they are
among the most frequent and as a hash of their last three bytes elsewhere. Classes are: unknown words, ends, the most
frequent words one by one, and clusters of endings by the endings that stand before them. The word factor is log-linear as well:
the discounted share of the word in its class, times exp(weight) of the pair (word before, word), over their sum in the class. There is a weight for
each pair of the training tokens, in hash blocks; both the pairs and the space they are hashed into grow with the corpus.

1. Documents are dealt into chunks. Chunks send their distinct words with counts to hash buckets and get back each word's
   total, so no table of all words is ever in one place.
2. Frequent words and the counts of endings and of their neighbours, tables of fixed size, go to the driver, which forms the classes.
3. Class weights are trained by rounds of distributed gradient updates: each chunk of a round starts from the shared weights, takes
   AdaGrad steps over all its training tokens, and the updates are averaged by how often each feature was seen. Every
   training token is used once. Words seen once stand in for unknown words.
4. Chunks send their distinct pairs with counts to buckets by (word before, class). A bucket holds all pairs of such a context, so it has the
   gradient of its weights whole, and sets them where it vanishes under an exponential prior (weights of 0 or more; the
   expected count of a pair is its count less a discount, estimated from the bucket's counts of counts). Chunks get back the factors of their pairs.
5. Scoring gathers weight rows for batches of tokens in numpy, and the factors of their pairs.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; each text ends in one end token. Training rows are those whose crc32(doc_id as text)
mod 5 is not 1 (a null id counts as empty text). Null texts are empty: one end. Without training rows all tokens are unknown.
Words are told apart by 64-bit hashes: a collision among V words has a chance of about V^2 / 2^65.
"""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, pieces, slices, span_hashes, summed, text_buffers, word_spans
from .substring_dedup import _bucket, _runs, chunked

CHUNK_BYTES = 6 << 20
TOP, OWN, ENDINGS, CLUSTERS = 126, 30, 1024, 32
#: Endings before a word, hashed, by which endings are clustered.
NEAR = 128
CODES = TOP + 2 + ENDINGS
BEGIN = TOP + 1
PAIRS = 8192
FEATURES = 3 * CODES + PAIRS
CLASSES = 2 + OWN + CLUSTERS
UNKNOWN, END_CLASS = 0, 1
DISCOUNT = 0.5
BATCH, RATE, ROUNDS = 4096, 0.15, 3
END_HASH = np.uint64(0xE0D0E0D0E0D0E0D1)
START_HASH = np.uint64(0x57A7757A7757A775)
#: Bits of a word in a pair's key; the context has as many as the training tokens need, and SPARE more.
WORD_BITS, SPARE = 20, 6
#: Natural logarithms of probabilities are sent as 16-bit multiples of this.
GRAIN = 1 / 2000
_NOTE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])


def _packed(dealt: DataFrame) -> DataFrame:
    """(chunk, rows): the rows of a batch that go to one chunk, compressed, so that texts cost less to shuffle."""

    def of(batches):
        for b in batches:
            chunk = b.column(0).to_numpy()
            order = np.argsort(chunk, kind="stable")
            part, of_ = pa.table({"doc_id": b.column(1), "text": b.column(2)}).take(pa.array(order)), chunk[order]
            for i, j in _runs(of_):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_table(part.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([int(of_[i])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])

    return dealt.select("chunk", "doc_id", "text").mapInArrow(of, "chunk int, rows binary")


def _unpacked(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("rows")])


def _planes(a: np.ndarray) -> bytes:
    """Unsigned integers byte by byte, the lowest bytes of all first: compression takes the empty high ones away."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplaned(b, kind, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def _steps(a: np.ndarray) -> bytes:
    """Ascending uint64 values as planes of their steps."""
    return _planes(np.diff(a, prepend=np.uint64(0)))


def _unstepped(b, n: int, at: int = 0) -> np.ndarray:
    return np.cumsum(_unplaned(b, np.uint64, n, at), dtype=np.uint64)


class _Tokens:
    """All tokens of a chunk: hashes, endings, documents; each document closes with an end."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        self.ids = ids
        rest = np.array([zlib.crc32(b"" if x is None else str(x).encode()) % 5 for x in ids], np.int64)
        self.held = rest == 1
        words, endings, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in slices(table):
            data, off = text_buffers(part.column("text"))
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
            starts, ends, first = word_spans(data, off)
            words.append(span_hashes(data, starts, ends))
            tail = np.zeros(len(starts), np.uint64)
            for i in (1, 2, 3):
                at = np.maximum(ends - i, starts)
                tail = tail * np.uint64(257) + np.where(ends - i >= starts, data[at] if len(at) else 0, 0).astype(np.uint64)
            endings.append(((tail * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 10)).astype(np.int64))
            counts.append(np.diff(first))
        n = np.concatenate(counts)
        self.size = n + 1
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = int(self.first[-1])
        is_end = np.zeros(total, bool)
        is_end[self.first[1:] - 1] = True
        self.h = np.full(total, END_HASH, np.uint64)
        self.h[~is_end] = np.concatenate(words)
        self.ending = np.zeros(total, np.int64)
        self.ending[~is_end] = np.concatenate(endings)
        self.end = is_end
        self.doc = np.repeat(np.arange(len(n)), self.size)
        self.pos = np.arange(total) - np.repeat(self.first[:-1], self.size)
        self.train = ~self.held[self.doc]

    @cached_property
    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, sorted, and which of them each token has."""
        return np.unique(self.h, return_inverse=True)

    def totals(self, replies: pa.Table) -> np.ndarray:
        """The training count of each token's word over the whole corpus."""
        got = [_unplaned(t, np.uint64, len(t) // 8, 0) for _, t in sorted(zip(replies.column("bucket").to_pylist(), replies.column("totals").to_pylist(), strict=True))]
        return np.concatenate([np.zeros(0, np.uint64), *got]).astype(np.int64)[self.distinct[1]]

    def codes(self, top: np.ndarray) -> np.ndarray:
        """The context code of each token: top is (hash, rank) sorted by hash."""
        code = TOP + 2 + self.ending
        if len(top):
            uniq, inverse = self.distinct
            i = np.searchsorted(top["h"], uniq)
            i[i == len(top)] = 0
            rank = np.where(top["h"][i] == uniq, top["rank"][i], -1)[inverse]
            code = np.where(rank >= 0, rank, code)
        return code

    def before(self, code: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(code), BEGIN, np.int64)
        out[k:] = code[: len(code) - k] if k else code
        out[self.pos < k] = BEGIN
        return out


_TOP = np.dtype([("h", np.uint64), ("rank", np.int64)])


class Model:
    """Classes, word shares and weights; of fixed size."""

    def __init__(self, top: np.ndarray, cluster: np.ndarray, mass: np.ndarray, prior: np.ndarray, n: int, v: int):
        self.top, self.cluster, self.mass, self.n, self.v = top, cluster, mass, n, v
        self.w = np.zeros((FEATURES, CLASSES), np.float32)
        self.bias = np.log(prior).astype(np.float32)

    def targets(self, t: _Tokens, code: np.ndarray) -> np.ndarray:
        """The class of each token's word, known or not."""
        y = 2 + OWN + self.cluster[t.ending]
        y = np.where(code < OWN, 2 + code, y)
        return np.where(t.end, END_CLASS, y)

    def features(self, t: _Tokens, code: np.ndarray) -> np.ndarray:
        a, b, c = (t.before(code, k) for k in (1, 2, 3))
        pair = ((a * CODES + b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 13)).astype(np.int64)
        return np.stack([a, CODES + b, 2 * CODES + c, 3 * CODES + pair])

    def logits(self, f: np.ndarray) -> np.ndarray:
        z = np.take(self.w, f[0], axis=0)
        z += self.bias
        for row in f[1:]:
            z += np.take(self.w, row, axis=0)
        return np.clip(z, -60, 60, out=z)

    def pairs(self, t: _Tokens, c: np.ndarray, code: np.ndarray):
        """Tokens whose class has other words too, the keys of their pairs, and the logarithm of their share in the class."""
        y = self.targets(t, code)
        use = np.flatnonzero((c > 0) & (y >= 2 + OWN))
        before = np.full(len(t.h), START_HASH, np.uint64)
        before[1:] = t.h[:-1]
        before[t.pos == 0] = START_HASH
        bits = self.pair_bits - WORD_BITS
        context = mix(before[use] * np.uint64(CLASSES) + y[use].astype(np.uint64)) >> np.uint64(64 - bits)
        word = mix(t.h[use] ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WORD_BITS)
        return use, context << np.uint64(WORD_BITS) | word, np.log(np.maximum(c[use] - DISCOUNT, DISCOUNT) / self.mass[y[use]])

    @property
    def pair_bits(self) -> int:
        return min(64, max(32, self.n.bit_length() + SPARE) + WORD_BITS)

    def probability(self, t: _Tokens, c: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """log10 probability of each token; factor: the logarithms of the word factors of the distinct pairs, ascending by key."""
        code = t.codes(self.top)
        y = np.where(c > 0, self.targets(t, code), UNKNOWN)
        f = self.features(t, code)
        out, ones = np.empty(len(y)), np.ones(CLASSES, np.float32)
        for i in range(0, len(y), BATCH):
            z = self.logits(f[:, i : i + BATCH])
            own = z[np.arange(len(z)), y[i : i + BATCH]]
            out[i : i + BATCH] = own - np.log(np.exp(z, out=z) @ ones)
        use, key, _ = self.pairs(t, c, code)
        out[use] += factor[np.unique(key, return_inverse=True)[1]]
        return out / np.log(10)

    def train(self, t: _Tokens, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Updates of the weights after AdaGrad steps over the chunk's training tokens, and how often each feature was seen."""
        code = t.codes(self.top)
        use = np.flatnonzero(t.train)
        y = np.where(c == 1, UNKNOWN, self.targets(t, code))[use]
        f = self.features(t, code)[:, use]
        old = self.w
        self.w = old.copy()
        grow = np.full((FEATURES, 1), 1e-2, np.float32)
        seen = np.bincount(f.ravel(), minlength=FEATURES).astype(np.float32)
        ones = np.ones(CLASSES, np.float32)
        for i in range(0, len(use), BATCH):
            part, want = f[:, i : i + BATCH], y[i : i + BATCH]
            z = self.logits(part)
            np.exp(z, out=z)
            z *= (1 / (z @ ones))[:, None]
            z[np.arange(len(want)), want] -= 1
            for row in part:
                k, g = _row_sums(row, z)
                grow[k, 0] += np.einsum("ij,ij->i", g, g)
                g *= RATE / np.sqrt(grow[k])
                self.w[k] -= g
        update, self.w = self.w - old, old
        return update, seen


def pair_factors(key: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The word factors of distinct pairs, ascending by key: n is how often each is seen in training, q its word's share in the class.

    P(w) = q(w) exp(weight(w)) / z in each context; z, with the weights, makes the class's words sum to one.
    """
    if not len(key):
        return np.zeros(0)
    group = key >> np.uint64(WORD_BITS)
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
    total = np.add.reduceat(n, at).astype(float)
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    discount = np.where(n > 0, np.clip(once / max(1, once + 2 * twice), 0.1, 0.95), 0.0)
    want = (n - discount) / np.maximum(total, 1)[of]
    active = n > 0
    while True:
        held, share = np.add.reduceat(want * active, at), np.add.reduceat(q * active, at)
        rest = np.where(total > 0, (1 - held) / np.maximum(1 - share, 1e-9), 1.0)  # 1 / z
        low = active & (want < q * rest[of])  # these weights would be negative
        if not low.any():
            return np.where(active, want, np.minimum(q * rest[of], 1))
        active &= ~low


def _row_sums(row: np.ndarray, z: np.ndarray, short: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of row, and the sums of the rows of z that have each: short runs together, long ones one by one."""
    order = np.argsort(row.astype(np.uint16), kind="stable")
    r, z = row[order], np.take(z, order, axis=0)
    at = np.flatnonzero(np.diff(r, prepend=-1))
    size = np.diff(np.append(at, len(r)))
    out = np.take(z, at, axis=0)
    for i in range(1, short):
        some = np.flatnonzero((size > i) & (size <= short))
        out[some] += np.take(z, at[some] + i, axis=0)
    for j in np.flatnonzero(size > short).tolist():
        np.add.reduce(z[at[j] : at[j] + size[j]], axis=0, out=out[j])
    return r[at], out


def _note(facts: np.ndarray, often, counts: np.ndarray) -> bytes:
    """Sums of a bucket, or of many: four numbers, the TOP most frequent words (hashes, counts, endings), and counts by ending."""
    return np.array([len(often[0]), *facts], np.int64).tobytes() + b"".join(x.tobytes() for x in often) + counts.astype(np.int64).tobytes()


def _notes_of(notes):
    facts, often, counts = np.zeros(4, np.int64), (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros((3, ENDINGS), np.int64)
    for x in notes:
        m, *f = np.frombuffer(x, np.int64, 5).tolist()
        facts += f
        new = (np.frombuffer(x, kind, m, 40 + 8 * m * i) for i, kind in enumerate((np.uint64, np.int64, np.int64)))
        often = tuple(np.concatenate([a, b]) for a, b in zip(often, new, strict=True))
        best = np.lexsort((often[0], -often[1]))[:TOP]
        often = tuple(a[best] for a in often)
        counts += np.frombuffer(x, np.int64, 3 * ENDINGS, 40 + 24 * m).reshape(3, ENDINGS)
    return facts, often, counts


def _merged(batches):
    yield pa.RecordBatch.from_arrays([pa.array([_note(*_notes_of(x.as_buffer() for b in batches for x in b.column(0)))], pa.binary())], names=["totals"])


def _clusters(x: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Weighted k-means over square roots of shares, from a fixed seed."""
    v = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))
    rng, out = np.random.default_rng(5), np.zeros(len(v), np.int64)
    weight = np.sqrt(size) * (x.sum(axis=1) > 0)
    if not weight.any():
        return np.arange(len(v)) % k
    mid = [v[int(np.argmax(weight))]]
    for _ in range(k - 1):
        d = np.min([((v - m) ** 2).sum(axis=1) for m in mid], axis=0) * weight
        mid.append(v[rng.choice(len(v), p=d / d.sum())] if d.sum() > 0 else v[0])
    m = np.array(mid)
    for _ in range(30):
        d = (v**2).sum(1)[:, None] - 2 * v @ m.T + (m**2).sum(1)
        new = d.argmin(axis=1)
        if (new == out).all():
            break
        out = new
        for c in range(k):
            if weight[out == c].sum() > 0:
                m[c] = np.average(v[out == c], axis=0, weights=weight[out == c])
    return out


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    dealt, k = chunked(docs, id_col, text_col, chunk_bytes)
    n_buckets = max(32, k)
    by = _packed(dealt).groupBy("chunk")

    def words(table: pa.Table) -> pa.Table:
        t, chunk = _Tokens(_unpacked(table)), table.column("chunk")[0].as_py()
        uniq, inverse = t.distinct
        n = np.bincount(inverse[t.train], minlength=len(uniq)).astype(np.uint32)
        ending = np.zeros(len(uniq), np.uint16)
        ending[inverse] = t.ending
        of = _bucket(uniq, 64, n_buckets)
        rows = [(int(of[a]), chunk, _steps(uniq[a:b]) + _planes(n[a:b]) + _planes(ending[a:b])) for a, b in _runs(of)]
        use = t.train & ~t.end
        near = np.zeros(ENDINGS * NEAR, np.int64)
        for j in (1, 2):
            b = t.before(t.ending, j)
            mask = use & (t.pos >= j)
            near += np.bincount(t.ending[mask] * NEAR + b[mask] % NEAR, minlength=len(near))
        rows.append((-1 - chunk % n_buckets, chunk, near.astype("<i4").tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(_NOTE.types)], schema=_NOTE)

    def totals(table: pa.Table) -> pa.Table:
        blobs, chunks = [b.as_py() for b in table.column("blob")], table.column("chunk").to_pylist()
        if (bucket := table.column("bucket")[0].as_py()) < 0:
            near = np.zeros(ENDINGS * NEAR, np.int64)
            for b in blobs:
                near += np.frombuffer(b, "<i4")
            i, x = pieces(near.astype("<i8"))
            return pa.Table.from_arrays([pa.array([-2] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(x, pa.binary())], schema=_REPLY)
        sizes = [len(b) // 14 for b in blobs]
        h = np.concatenate([_unstepped(b, n) for b, n in zip(blobs, sizes, strict=True)])
        c = np.concatenate([_unplaned(b, np.uint32, n, 8 * n) for b, n in zip(blobs, sizes, strict=True)])
        e = np.concatenate([_unplaned(b, np.uint16, n, 12 * n) for b, n in zip(blobs, sizes, strict=True)])
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=c).astype(np.int64)
        word, known = e[first].astype(np.int64), total > 0
        per = lambda mask, w=None: np.bincount(word[mask], weights=None if w is None else w[mask], minlength=ENDINGS).astype(np.int64)
        text = known & (uniq != END_HASH)
        often = np.argsort(-total * text, kind="stable")[:TOP]
        often = often[text[often]]
        facts = [int(total.sum()), int(known.sum()), int(total[uniq == END_HASH].sum()), int((total == 1).sum())]
        counts = np.stack([per(text, total), per(text), per(text & (total > 1), total)])
        rows = [(-1, bucket, _note(np.array(facts), (uniq[often], total[often], word[often]), counts))]
        seen, at = total[inverse].astype(np.uint64), 0
        for chunk, n in zip(chunks, sizes, strict=True):
            rows.append((chunk, bucket, _planes(seen[at : at + n])))
            at += n
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(_REPLY.types)], schema=_REPLY)

    replies = materialise(by.applyInArrow(words, "bucket int, chunk int, blob binary").groupBy("bucket").applyInArrow(totals, "chunk int, bucket int, totals binary"), "totals")
    facts, often, counts = _notes_of(r[0] for r in replies.where("chunk = -1").select("totals").mapInArrow(_merged, "totals binary").repartition(1).mapInArrow(_merged, "totals binary").collect())
    n, v, ends, ones = (int(x) for x in facts)
    often = list(zip(often[1].tolist(), often[0].tolist(), often[2].tolist(), strict=True))
    top = np.sort(np.array([(h, i) for i, (_, h, _) in enumerate(often)], _TOP), order="h")
    own = replies.where("chunk >= 0").groupBy("chunk")

    near = summed(replies.where("chunk = -2").select(F.col("bucket").alias("piece"), F.col("totals").alias("x")), ENDINGS * NEAR, "<i8").reshape(ENDINGS, NEAR)
    cluster = _clusters(near.astype(float), counts[0].astype(float), CLUSTERS)
    rest, kinds, twice = counts.astype(float)
    for c, _, e in often[:OWN]:
        rest[e] -= c
        kinds[e] -= 1
        twice[e] -= c if c > 1 else 0
    mass, prior = np.ones(CLASSES), np.full(CLASSES, 0.5)
    # a word's weight in its class is its count less DISCOUNT, so all known words of the class share all of it
    np.add.at(mass, 2 + OWN + cluster, rest - DISCOUNT * kinds)
    mass[2 + OWN :] = np.maximum(mass[2 + OWN :] - 1, DISCOUNT)
    np.add.at(prior, 2 + OWN + cluster, twice)
    prior[UNKNOWN] += ones
    prior[END_CLASS] += ends
    for i, (c, *_) in enumerate(often[:OWN]):
        prior[2 + i] += c if c > 1 else 0
    model = Model(top, cluster, mass, prior / prior.sum(), n, v)

    def updates(shared):
        def of(table: pa.Table, reply: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.table({"piece": pa.array([], pa.int32()), "x": pa.array([], pa.binary())})
            t = _Tokens(_unpacked(table))
            update, seen = shared.value.train(t, t.totals(reply))
            i, x = pieces(np.append((update * seen[:, None]).ravel(), seen).astype("<f4"))
            return pa.Table.from_arrays([pa.array(i, pa.int32()), pa.array(x, pa.binary())], names=["piece", "x"])

        return of

    for r in range(min(ROUNDS, k) if n else 0):
        shared = spark.sparkContext.broadcast(model)
        mine = F.pmod("chunk", F.lit(ROUNDS)) == r
        blobs = _packed(dealt.where(mine)).groupBy("chunk").cogroup(replies.where((F.col("chunk") >= 0) & mine).groupBy("chunk")).applyInArrow(updates(shared), "piece int, x binary")
        total = summed(blobs, FEATURES * (CLASSES + 1), "<f4")
        seen = total[FEATURES * CLASSES :, None]
        model.w = (model.w + total[: FEATURES * CLASSES].reshape(FEATURES, CLASSES) / np.maximum(seen, 1)).astype(np.float32)
    final = spark.sparkContext.broadcast(model)

    def pairs(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _NOTE.empty_table()
        m, t, chunk = final.value, _Tokens(_unpacked(table)), table.column("chunk")[0].as_py()
        c = t.totals(reply)
        use, key, share = m.pairs(t, c, t.codes(m.top))
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        seen = np.bincount(inverse[t.train[use]], minlength=len(uniq)).astype(np.uint32)
        q = np.rint(-share[first] / GRAIN).astype(np.uint16)
        of = _bucket(uniq >> np.uint64(WORD_BITS), m.pair_bits - WORD_BITS, n_buckets)
        rows = [(int(of[a]), chunk, _steps(uniq[a:b]) + _planes(seen[a:b]) + _planes(q[a:b])) for a, b in _runs(of)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(_NOTE.types)], schema=_NOTE)

    def factors(table: pa.Table) -> pa.Table:
        blobs = [b.as_py() for b in table.column("blob")]
        sizes = [len(b) // 14 for b in blobs]
        key = np.concatenate([_unstepped(b, n) for b, n in zip(blobs, sizes, strict=True)])
        seen = np.concatenate([_unplaned(b, np.uint32, n, 8 * n) for b, n in zip(blobs, sizes, strict=True)])
        q = np.concatenate([_unplaned(b, np.uint16, n, 12 * n) for b, n in zip(blobs, sizes, strict=True)])
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        p = pair_factors(uniq, np.bincount(inverse, weights=seen).astype(np.int64), np.exp(-GRAIN * q[first].astype(float)))
        out, at, rows = np.rint(-np.log(p) / GRAIN).clip(0, 65535).astype(np.uint16)[inverse], 0, []
        for chunk, n in zip(table.column("chunk").to_pylist(), sizes, strict=True):
            rows.append((chunk, table.column("bucket")[0].as_py(), _planes(out[at : at + n])))
            at += n
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(_REPLY.types)], schema=_REPLY)

    sent = by.cogroup(own).applyInArrow(pairs, "bucket int, chunk int, blob binary").groupBy("bucket").applyInArrow(factors, "chunk int, bucket int, totals binary")
    both = replies.where("chunk >= 0").select("chunk", F.lit(0).alias("kind"), "bucket", "totals").unionByName(sent.select("chunk", F.lit(1).alias("kind"), "bucket", "totals"))

    def scored(table: pa.Table, reply: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not table.num_rows:
            return pa.table({x: pa.array([], y) for x, y in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        m, t, kind = final.value, _Tokens(_unpacked(table)), reply.column("kind").to_numpy()
        c = t.totals(reply.filter(pa.array(kind == 0)))
        of = reply.filter(pa.array(kind == 1))
        got = [_unplaned(x, np.uint16, len(x) // 2, 0) for _, x in sorted(zip(of.column("bucket").to_pylist(), of.column("totals").to_pylist(), strict=True))]
        factor = -GRAIN * np.concatenate([np.zeros(0, np.uint16), *got]).astype(float)
        base = np.add.reduceat(np.log10((c + 0.5) / (m.n + 0.5 * (m.v + 1))), t.first[:-1])
        own_score = np.add.reduceat(m.probability(t, c, factor), t.first[:-1])
        known = np.add.reduceat((c > 0).astype(np.int64), t.first[:-1])
        cols = [pa.array(t.ids, pa.int64()), pa.array(t.held), pa.array(t.size), pa.array(known), pa.array(np.full(len(t.ids), m.n)), pa.array(base), pa.array(own_score)]
        return pa.Table.from_arrays(cols, names=names)

    return by.cogroup(both.groupBy("chunk")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    """op6 over the whole of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
