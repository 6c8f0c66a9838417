"""Near duplicates by the Jaccard similarity of word shingles: SimHash ball hashing, completed to an exact similarity join.

Texts are sets of hashed shingles of ``words`` words; equal sets are one class. Classes whose SimHash fingerprints lie in one
ball (see simhash) are compared first. Fingerprints of texts as alike as ``least`` may differ in a dozen bits, far outside any
ball whose variants can be listed, so the rest of the pairs comes from prefixes: two sets of similarity ``least`` or more
share an element among the first n - ceil(least * n) + 1 of each in any common order (prefix filter), so classes that meet
at such an element are all the candidates there are. Shingles that a sample of texts holds often come last in the order:
the sample decides how many candidates there are, never which pairs are found.

Candidates are compared by their whole sets. First each class of an element is compared with few others, then all pairs of
classes that share an element and are not in one component yet: a large group of copies costs no pair for each two members.
Of these last pairs a task first rules out those whose bitmaps (a parity bit for each hash value) differ in more bits than alike sets can.

Defined cases: words are parted by ASCII white space, ASCII letters are folded; texts of fewer than ``words`` words have their whole word
sequence as only shingle; null texts and texts of white space have the empty set and are alike. Shingles and
classes are 64-bit hashes: two of n different sets share one with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, materialise, mix, rolling, slices, small_batches, span_hashes, text_buffers, word_spans
from .components import connected_components
from .simhash import _fold_case, majority, near_links

WORDS = 5
LEAST = 0.8
#: About so many texts are looked at for the order of shingles; those seen OFTEN times, MOST_OFTEN at most, come last.
SAMPLE, OFTEN, MOST_OFTEN = 20_000, 4, 500_000
#: So many candidate classes go to all executors; beyond that all sets are joined by a shuffle.
MOST_SENT = 4_000_000
#: Rounds that compare few pairs of each class, before all that are left.
TURNS, PICKS = 3, 8
#: Bits in which fingerprints of pairs of those rounds differ at most.
NEAR_BITS = 18
#: Pairs of places that are looked at in one step.
PAIRS = 1 << 18
#: Bytes of a set's bitmap.
MAP_BYTES = 256
_BASE = 0xD6E8FEB86659FD93
_SLACK = 1e-9


def shingle_sets(col, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts (ascending in each), where each text's begin (n + 1 entries), and a key of each set."""
    data, off = text_buffers(col)
    data = _fold_case(data)
    starts, ends, first = word_spans(data, off)
    h, count = span_hashes(data, starts, ends), np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    left = first[1:][doc] - np.arange(len(h))
    docs, values = [], []
    for n in range(1, words + 1):
        w = rolling(h, n, _BASE + 2 * n)
        ok = left[: len(w)] >= words if n == words else (left[: len(w)] == n) & (count[doc[: len(w)]] == n)
        docs.append(doc[: len(w)][ok])
        values.append(w[ok])
    d, v = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((v, d))
    d, v = d[order], v[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    d, v = d[new], v[new]
    at = np.searchsorted(d, np.arange(len(count) + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(v ^ np.uint64(_BASE)), dtype=np.uint64)])
    return v, at, mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def prefixes(v: np.ndarray, at: np.ndarray, often: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The elements of each set that it must share one of, and where each set's begin; often: ascending shingles, and how often each is seen."""
    n = np.diff(at)
    seen = np.zeros(len(v), np.int64)
    if len(often[0]):
        i = np.minimum(np.searchsorted(often[0], v), len(often[0]) - 1)
        seen = np.where(often[0][i] == v, often[1][i], 0)
    d = np.repeat(np.arange(len(n)), n)
    ranked = v[np.lexsort((v, seen, d))]
    k = np.where(n > 0, n - np.ceil(least * n - _SLACK).astype(np.int64) + 1, 0)
    return ranked[np.arange(len(v)) - at[:-1][d] < k[d]], np.concatenate([[0], np.cumsum(k)])


def bitmaps(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of MAP_BYTES bytes for each set: a bit for each value of a hash, set where an odd number of elements has it.

    Two rows differ in at most as many bits as the sets differ in elements, so they can rule a pair out but never lose one.
    """
    n, bits = len(at) - 1, 8 * MAP_BYTES
    place = np.repeat(np.arange(n), np.diff(at)) * bits + (mix(v ^ np.uint64(_BASE >> 1)) % np.uint64(bits)).astype(np.int64)
    place, count = np.unique(place, return_counts=True)
    place = place[count % 2 == 1]
    out = np.zeros(n * MAP_BYTES, np.uint8)
    np.bitwise_or.at(out, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return out.reshape(n, MAP_BYTES)


def _often(texts: DataFrame, words: int):
    """Shingles that many texts of a sample have, ascending, and in how many."""
    n = texts.count()
    step = max(1, n // SAMPLE)

    def of(batches):
        for b in batches:
            for s in slices(b):
                v, k = np.unique(shingle_sets(s.column(0), words)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(k)], names=["v", "k"])

    part = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).mapInArrow(of, "v long, k long")
    got = part.groupBy("v").agg(F.sum("k").alias("k")).where(F.col("k") >= OFTEN).orderBy(F.desc("k"), "v").limit(MOST_OFTEN).toArrow()
    v, k = got.column("v").to_numpy().view(np.uint64), got.column("k").to_numpy()
    order = np.argsort(v)
    return v[order], k[order]


def _blocks(batches, rows: int = 1 << 16):
    """Arrays of all columns for runs of whole buckets (rows of equal first column), out of batches sorted by it; buckets of one row are left out.

    Rows are gathered until there are ``rows`` of them and a bucket has ended; a bucket that goes on makes the next look come twice as late.
    """
    held, size, want = [], 0, rows

    def arrays(parts):
        table = pa.Table.from_batches(parts)
        return [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy() for c in table.columns]

    def shared(cols):
        v = cols[0]
        same = np.zeros(len(v) + 1, bool)
        same[1:-1] = v[1:] == v[:-1]
        keep = same[1:] | same[:-1]
        return [c[keep] for c in cols] if keep.any() else None

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < want:
            continue
        v = np.concatenate([x.column(0).to_numpy() for x in held])
        ends = np.flatnonzero(v[1:] != v[:-1])
        if not len(ends):
            want = 2 * size
            continue
        cut, table = int(ends[-1]) + 1, pa.Table.from_batches(held)
        if (got := shared(arrays(table.slice(0, cut).to_batches()))) is not None:
            yield got
        held, size, want = table.slice(cut).to_batches(), table.num_rows - cut, rows
    if held and (got := shared(arrays(held))) is not None:
        yield got


def _ordered(cols: list, least: float) -> dict | None:
    """A block's rows by bucket, size, part and key: bucket numbers ``seg``, where those of fit size begin (``low``) and end (``top``) in the bucket.

    Buckets whose classes are of one part already are left out; None where no bucket is left.
    """
    v, key, n, at, part = (x.astype(np.int64) for x in cols[:5])
    seg = np.cumsum(np.concatenate([[0], (v[1:] != v[:-1]).astype(np.int64)]))
    begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    open_ = (np.minimum.reduceat(part, begin) != np.maximum.reduceat(part, begin))[seg]
    if not open_.any():
        return None
    order = np.flatnonzero(open_)
    order = order[np.lexsort((key[order], part[order], n[order], seg[order]))]
    seg, v, key, n, at, part = (x[order] for x in (seg, v, key, n, at, part))
    wide = int(np.floor(n.max() / least)) + 2
    place = seg * wide + n
    low = np.searchsorted(place, seg * wide + np.ceil(least * n - _SLACK).astype(np.int64))
    top = np.searchsorted(place, seg * wide + np.minimum(np.floor(n / least + _SLACK).astype(np.int64), wide - 1), "right")
    return {"seg": seg, "v": v, "key": key, "n": n, "at": at, "part": part, "low": low, "top": top, "order": order}


def _near(top: np.ndarray):
    """(i, j) for all places i < j below top[i], in arrays of bounded size."""
    many = np.maximum(top - np.arange(len(top)) - 1, 0)
    upto, start = np.cumsum(many), 0
    while start < len(many):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        k = many[start:end]
        total, at = int(k.sum()), np.cumsum(k) - k
        for a in range(0, total, PAIRS):  # a single place may have more
            p = np.arange(a, min(a + PAIRS, total))
            i = np.searchsorted(at + k, p, "right")
            yield start + i, start + i + 1 + p - at[i]
        start = end


def _sorted_by_shingle(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v").sortWithinPartitions("v")


def _pairs_out(found: list):
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def _fit(n, at, part, least: float):
    """A test of places i and j of a bucket's classes: of unlike parts, and no more than what follows the shared shingle can be common."""
    share = least / (1 + least)

    def ok(i, j):
        return (part[i] != part[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= share * (n[i] + n[j]) - _SLACK)

    return ok


def _candidates(hits: DataFrame, least: float, turn: int) -> DataFrame:
    """Some distinct pairs (a < b) of classes of one bucket (v, key, n, at, part, fp), of unlike parts, that may be alike.

    turn 0: each class with the first of those of fit size and with the one before it; 1, 2, ...: each class with PICKS
    of fit size that its key, the bucket and the turn choose. Pairs with fingerprints further apart than those of alike texts
    commonly are wait for the last round, which looks at all.
    """

    def of(batches):
        for cols in _blocks(batches):
            if (x := _ordered(cols, least)) is None:
                continue
            fit, fp, i = _fit(x["n"], x["at"], x["part"], least), cols[5][x["order"]].view(np.uint64), np.arange(len(x["n"]))
            low, top = x["low"], x["top"]
            if turn:
                own = x["key"].view(np.uint64)
                picks = (mix(own ^ mix(x["v"].view(np.uint64) + np.uint64(PICKS * turn + k))) for k in range(PICKS))
                meets = ((i, low + (p % (top - low).astype(np.uint64)).astype(np.int64)) for p in picks)
            else:
                meets = iter([(i, low), (i[1:], i[:-1])])
            found = []
            for a, b in meets:
                ok = (x["seg"][a] == x["seg"][b]) & fit(a, b) & (np.bitwise_count(fp[a] ^ fp[b]) <= NEAR_BITS)
                found.append((x["key"][a[ok]], x["key"][b[ok]]))
            if any(len(a) for a, _ in found):
                yield _pairs_out(found)

    return _sorted_by_shingle(hits.select("v", "key", "n", "at", "part", "fp")).mapInArrow(of, "a long, b long").distinct()


def _open(hits: DataFrame, least: float) -> DataFrame:
    """The rows of hits that have any class of an unlike part to be compared with in their bucket."""

    def of(batches):
        for cols in _blocks(batches):
            if (x := _ordered(cols, least)) is None:
                continue
            fit, some = _fit(x["n"], x["at"], x["part"], least), np.zeros(len(x["n"]), bool)
            for i, j in _near(x["top"]):
                ok = fit(i, j)
                some[i[ok]] = some[j[ok]] = True
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[c][some]) for c in ("v", "key", "n", "at", "part")], names=["v", "key", "n", "at", "part"])

    return _sorted_by_shingle(hits.select("v", "key", "n", "at", "part")).mapInArrow(of, "v long, key long, n long, at long, part long")


def _all_candidates(rows: DataFrame, least: float) -> DataFrame:
    """All distinct pairs (a < b) of classes of one bucket (v, key, n, at, part, bits), of unlike parts, that may be alike.

    A pair whose bitmaps differ in more bits than alike sets can differ in elements stays in the task: a large group of
    texts that are nearly but not quite alike costs no row for each two of them.
    """
    apart = (1 - least) / (1 + least)

    def of(batches):
        found, size = [], 0
        for cols in _blocks(batches, 1 << 14):
            if (x := _ordered(cols, least)) is None:
                continue
            n, fit = x["n"], _fit(x["n"], x["at"], x["part"], least)
            maps = np.frombuffer(b"".join(cols[5][x["order"]]), np.uint64).reshape(len(n), -1)
            for i, j in _near(x["top"]):
                ok = fit(i, j)
                i, j = i[ok], j[ok]
                for a in range(0, len(i), 1 << 14):
                    p, q = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
                    ok = np.bitwise_count(maps[p] ^ maps[q]).sum(axis=1, dtype=np.int64) <= apart * (n[p] + n[q]) + _SLACK
                    found.append((x["key"][p[ok]], x["key"][q[ok]]))
                    size += int(ok.sum())
                if size > 100_000 or len(found) > 10_000:
                    if size:
                        yield _pairs_out(found)
                    found, size = [], 0
        if size:
            yield _pairs_out(found)

    return _sorted_by_shingle(rows.select("v", "key", "n", "at", "part", "bits")).mapInArrow(of, "a long, b long").distinct()


def _shared(prefix: DataFrame) -> DataFrame:
    """Rows (v, key, n, at, fp) whose shingle another class has too."""

    def of(batches):
        for cols in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["v", "key", "n", "at", "fp"])

    return _sorted_by_shingle(prefix).mapInArrow(of, "v long, key long, n int, at int, fp long")


def _alike(texts: DataFrame, known: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity, as a table; known: (row, key) of all texts (row, text)."""
    spark = texts.sparkSession
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    one = known.select("row", "key").join(keys, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    one = materialise(one, "wanted")
    sent = None
    if (n := one.count()) <= MOST_SENT:
        sent = spark.sparkContext.broadcast(np.sort(one.select("row").toArrow().column(0).to_numpy()) if n else np.zeros(0, np.int64))

    def sets(batches):
        for b in batches:
            if sent is not None:
                # one text of each class that is compared: all others need not be cut into shingles again
                b = b.filter(pa.array(np.isin(b.column(0).to_numpy(), sent.value)))
            for s in slices(b):
                v, at, key = shingle_sets(s.column(1), words)
                key = key.view(np.int64)
                pick = np.unique(key, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(key[pick]), pa.array([v[at[i] : at[i + 1]].tobytes() for i in pick], pa.binary())], names=["key", "elements"])

    held = texts.select("row", "text").mapInArrow(sets, "key long, elements binary").groupBy("key").agg(F.first("elements").alias("elements"))
    held = materialise(held if sent is not None else held.join(keys, "key", "left_semi"), "sets")
    # the joins get keys and so exchanges of their own: Spark splits them where one class is in many pairs
    side = lambda name, as_: held.select(F.bitwise_not("key").alias(name), F.col("elements").alias(as_))
    both = pairs.withColumn("~a", F.bitwise_not("a")).join(side("~a", "x"), "~a").withColumn("~b", F.bitwise_not("b")).join(side("~b", "y"), "~b")

    def compare(batches):
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = np.zeros(b.num_rows, bool)
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                v = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((v[1:] == v[:-1]).sum())
                ok[i] = common >= least * (len(v) - common) - _SLACK
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["u", "v"])

    found = materialise(both.select("a", "b", "x", "y").mapInArrow(compare, "u long, v long"), "alike")
    dropped(one, held)  # the largest tables of a round, of no use after it
    return found


def _in_one_ball(known: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) that connect the classes of (key, fp) whose fingerprints are equal or linked."""
    classes = known.select("key", "fp").distinct()
    lead = classes.groupBy("fp").agg(F.min("key").alias("lead"))
    links = near_links(lead.select("fp").repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.bitwise_not("fp")))
    side = lambda c, name: lead.select(F.col("fp").alias(c), F.col("lead").alias(name))
    across = links.join(side("u", "a"), "u").join(side("v", "b"), "v").select("a", "b")
    # a key of its own, and so an exchange of its own: Spark splits it where a fingerprint has many classes
    inside = classes.withColumn("~fp", F.bitwise_not("fp")).join(lead.select(F.bitwise_not("fp").alias("~fp"), "lead"), "~fp").where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    return across.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(rows: DataFrame, *, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(row, key, component) for each row of rows (row, text): rows of one component are linked by pairs that are alike."""
    spark = rows.sparkSession
    small_batches(spark)
    often = spark.sparkContext.broadcast(_often(rows, words))

    def own(batches):
        for b in batches:
            for s in slices(b):
                v, at, key = shingle_sets(s.column(1), words)
                few, cut = prefixes(v, at, often.value, least)
                first = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(few.view(np.int64)))
                maps = pa.array([x.tobytes() for x in bitmaps(v, at)], pa.binary())
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(key.view(np.int64)), pa.array(np.diff(at).astype(np.int32)), first, maps, pa.array(majority(v, at).view(np.int64))], names=["row", "key", "n", "first", "bits", "fp"])

    known = materialise(rows.select("row", "text").mapInArrow(own, "row long, key long, n int, first array<long>, bits binary, fp long"), "prefixes")
    classes = known.groupBy("key").agg(F.first("n").alias("n"), F.first("first").alias("first"), F.first("fp").alias("fp"))
    hits = materialise(_shared(classes.select("key", "n", "fp", F.posexplode("first").alias("at", "v")).select("v", "key", "n", "at", "fp")), "shared").withColumn("part", F.col("key"))
    edges = pairs = parts = None
    for turn in ("ball", *range(TURNS), None):
        if parts is not None:
            hits = hits.drop("part").join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component")
        if turn is None:
            some = materialise(_open(hits, least), "open")
            maps = known.select("key", "bits").join(some.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("bits").alias("bits"))
            # the join gets a key and so an exchange of its own: Spark splits it where a class is in many buckets
            new = _all_candidates(some.withColumn("~key", F.bitwise_not("key")).join(maps.select(F.bitwise_not("key").alias("~key"), "bits"), "~key"), least)
        else:
            new = _in_one_ball(known) if turn == "ball" else _candidates(hits, least, turn)
        new = materialise(new if pairs is None else new.join(pairs, ["a", "b"], "left_anti"), "pairs")
        pairs = new if pairs is None else pairs.unionByName(new)
        alike = _alike(rows, known, new, words, least)
        edges = alike if edges is None else edges.unionByName(alike)
        parts = materialise(connected_components(edges), "parts")
    classes = known.select("key").distinct()
    named = classes.join(parts.withColumnRenamed("node", "key"), "key", "left").select(F.bitwise_not("key").alias("k"), F.coalesce("component", "key").alias("component"))
    return known.withColumn("k", F.bitwise_not("key")).join(named, "k").select("row", "key", "component")
