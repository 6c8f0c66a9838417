"""Line dedup by pairwise alignment with patience diff.

Lines are hashed. A line of ``words`` words or more tells documents apart; it links every document that holds it to the
earliest one that does, and so does each run of 2, 4, 8, ... such lines in a row, which is rarer: a document that holds a longer
part of some earlier document in its order is linked to one that has this part in the same order, even where the lines alone
lead to others. A line or a run costs one link for each document, however common it is. Each pair is aligned with patience
diff: lines that occur once in both are matched, the longest run of matches in the same order is kept, matches grow over equal
neighbours and gaps are aligned the same way. Aligned blocks that hold a telling line are deleted from the later document.

Lines end at line feeds; white space at their ends does not count. Null or empty texts stay as they are. A null doc_id comes before
all others; rows that share a doc_id are never each other's earlier document. A document keeps its row even if no line is left.
Columns of any other name, repeated or odd ones included, stay as they are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, rolling, slices, small_batches

WORDS = 4
#: Lengths of the runs of telling lines that link documents.
RUNS = tuple(1 << i for i in range(8))
_LEAST = -(1 << 63)


def line_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """A signed hash for each line; the last bit says whether it tells documents apart."""
    out = []
    for line in (text or "").split("\n"):
        line = line.strip()
        h = xxhash.xxh64_intdigest(line) & ~1 | (len(line.split(None, words)) >= words)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def links_of(lines: list[int]) -> list[int]:
    """Distinct hashes of the telling lines and of their runs."""
    told = np.array([x for x in lines if x & 1], np.int64).view(np.uint64)
    return np.unique(np.concatenate([rolling(told, n, 0x9E3779B97F4A7C15 + 2 * n) for n in RUNS])).view(np.int64).tolist()


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that ascends in both places; pairs ascend in the first."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched line pairs (of a, of b), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a: dict[int, list[int]] = {}
        in_b: dict[int, list[int]] = {}
        for i in range(a0, a1):
            in_a.setdefault(a[i], []).append(i)
        for i in range(b0, b1):
            in_b.setdefault(b[i], []).append(i)
        once = [(p[0], in_b[x][0]) for x, p in in_a.items() if len(p) == 1 and len(in_b.get(x, ())) == 1]
        if once:
            last = (a0 - 1, b0 - 1)
            for i, j in [*_longest(once), (a1, b1)]:
                todo.append((last[0] + 1, i, last[1] + 1, j))
                if i < a1:
                    out.append((i, j))
                last = (i, j)
            continue
        low = a0 - 1  # no line occurs once in both: each line of b takes the next equal one of a
        for j in range(b0, b1):
            p = in_a.get(b[j])
            if p and (k := bisect_right(p, low)) < len(p):
                low = p[k]
                out.append((low, j))
    return sorted(out)


def common_lines(earlier: list[int], later: list[int]) -> list[int]:
    """Lines of the later document in aligned blocks that hold a telling line."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*patience(earlier, later), (-5, -5)]:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            if any(later[x] & 1 for x in block):
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def dedup_lines(docs: DataFrame, *, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines cut from text_col, and the columns n_lines and n_removed_lines, which replace any of these names."""
    small_batches(docs.sparkSession)
    made = T.StructType.fromDDL("n_lines long, n_removed_lines long")
    docs = docs.drop(*made.names)
    names, fields = docs.columns, docs.schema.fields
    # names of our own: none of the caller's can clash with what is added
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    uid = F.xxhash64(F.lit(7), id_, text)
    order = F.coalesce(id_.cast("long"), F.lit(_LEAST))

    def hashed(batches):
        for b in batches:
            for s in slices(b):
                lines = [line_hashes(t, words) for t in s.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(2), pa.array(lines, pa.list_(pa.int64())), pa.array([links_of(x) for x in lines], pa.list_(pa.int64()))], names=["at", "uid", "lines", "links"])

    signs = materialise(docs.select(order.alias("at"), text.alias("text"), uid.alias("uid")).mapInArrow(hashed, "at long, uid long, lines array<long>, links array<long>"), "lines")
    held = signs.select("at", "uid", F.explode("links").alias("line"))
    owner = held.groupBy("line").agg(F.min(F.struct("at", "uid")).alias("first"), F.max("at").alias("last")).where("first.at < last")
    # an aggregate above the join's own exchange keeps Spark from splitting a hot key; a key of its own has an exchange of its own
    apart = lambda c: F.bitwise_not(F.col(c))
    owner = owner.select(apart("line").alias("not_line"), "first")
    pairs = held.withColumn("not_line", apart("line")).join(owner, "not_line").where("first.at < at").select("uid", F.col("first.uid").alias("other")).distinct()
    sides = signs.groupBy("uid").agg(F.first("lines").alias("lines"))
    first = sides.select(apart("uid").alias("not_other"), F.col("lines").alias("earlier"))
    both = pairs.join(sides, "uid").withColumn("not_other", apart("other")).join(first, "not_other")

    def aligned(batches):
        for b in batches:
            later, earlier = b.column(1).to_pylist(), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([common_lines(e, x) for e, x in zip(earlier, later, strict=True)], pa.list_(pa.int32()))], names=["uid", "cut"])

    cuts = both.select("uid", "lines", "earlier").mapInArrow(aligned, "uid long, cut array<int>").where("size(cut) > 0")
    cuts = cuts.select("uid", F.explode("cut").alias("i")).distinct().groupBy("uid").agg(F.collect_list("i").alias("cut"))
    tagged = docs.withColumn("uid", uid).join(cuts, "uid", "left").select(*docs.columns, "cut")
    schema = T.StructType([*fields, *made.fields])

    def rewritten(batches):
        for b in batches:
            texts, cut = b.column(names.index(text_col)).to_pylist(), b.column(len(names)).to_pylist()
            new, n, gone = [], [], []
            for t, c in zip(texts, cut, strict=True):
                lines = t.split("\n") if t else []
                drop = set(c or ())
                n.append(len(lines))
                gone.append(len(drop))
                new.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else t)
            cols = [pa.array(new, pa.string()) if i == names.index(text_col) else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return tagged.mapInArrow(rewritten, schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """op3 over the whole of documents: doc_id, n_lines, n_removed_lines, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
