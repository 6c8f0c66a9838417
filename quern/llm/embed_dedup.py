"""Embedding near-dedup by int8 quantised tile products with rigorous error bounds.

Equal vectors are one class. A class vector x (unit length, double) is kept as x = s * q + e with q in int8 and
|e| known, so that |x.y - s t q.r| <= |e| + |f| + |e||f| for y = t * r + f. Tiles of classes meet in pairs; the
int8 products (exact in single precision up to 1,040 dimensions) settle all pairs farther from the threshold
than that bound, and only the rest are recomputed in double precision. Each pair of tiles returns link counts
and a spanning forest of its links, so that a large group costs rows in proportion to its vectors, not its pairs.

Vectors that are null, zero, or hold null or non-finite components, or differ in dimension, link with nothing.
Rows that share a vec_id each get a row; a null vec_id names no component and its row is kept. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import _forest, connected_components

TILE = 4096
LEAST_TILES = 8
#: Beyond this many dimensions an int8 product may leave the 24 bits of a float, and parts are summed in double.
EXACT_DIM = 1040
#: Bytes of the rows of open pairs that are compared at once.
OPEN_BYTES = 64 << 20
#: Names of classes all of whose rows lack a vec_id begin here; vec_ids must be smaller.
NAMELESS = 1 << 62


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and a bound of the error's length for unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12


def _products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    if q.shape[1] <= EXACT_DIM:
        return q.astype(np.float32) @ r.astype(np.float32).T
    return sum(_products(q[:, i : i + EXACT_DIM], r[:, i : i + EXACT_DIM]).astype(np.float64) for i in range(0, q.shape[1], EXACT_DIM))


def links(x: np.ndarray, y: np.ndarray, threshold: float, step: int = 256):
    """Index pairs (i, j) with cosine of x[i] and y[j] at or above the threshold."""
    # powers of two scale without rounding, and no square overflows or vanishes
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (x, y))
    xu, yu = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    (q, s, e), (r, t, f) = quantise(xu), quantise(yu)
    for a in range(0, len(x), step):
        p = _products(q[a : a + step], r) * s[a : a + step, None].astype(np.float32) * t[None, :].astype(np.float32)
        # single precision and the cosine's own rounding are far below 1e-5
        bound = (e[a : a + step].max() + f.max() + e[a : a + step].max() * f.max()) + 1e-5
        i, j = np.nonzero(p >= threshold - bound)
        if not len(i):
            continue
        # so many pairs at a time that their rows take OPEN_BYTES at most
        many = max(1, OPEN_BYTES // (32 * x.shape[1]))
        for k in range(0, len(i), many):
            u, v = a + i[k : k + many], j[k : k + many]
            sure, open_ = _settled(q[u], r[v], s[u] * t[v], e[u] + f[v] + e[u] * f[v] + 1e-9, threshold)
            k_ = np.flatnonzero(open_)
            if len(k_):
                sure[k_] = _cosines(x[u[k_]], y[v[k_]]) >= threshold
            yield u[sure], v[sure]


def _settled(q: np.ndarray, r: np.ndarray, scale: np.ndarray, slack: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of codes are surely linked, and which must be recomputed."""
    exact = scale * np.einsum("ij,ij->i", q.astype(np.int32), r.astype(np.int32))
    return exact - slack >= threshold, np.abs(exact - threshold) <= slack


def _cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))


def _matrix(col) -> np.ndarray:
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def _tile_links(table: pa.Table, threshold: float) -> pa.Table:
    """Link counts (u = v = class, n) and forest edges (n = 0) of one pair of tiles."""
    side = table.column("side").to_numpy()
    same = bool(table.column("same")[0].as_py())
    x, ids, size = _matrix(table.column("vec")), table.column("rep").to_numpy(), table.column("size").to_numpy()
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
    us, vs, counts = [], [], np.zeros(len(ids), np.int64)
    if len(a) and len(b):
        for i, j in links(x[a], x[b], threshold):
            i, j = a[i], b[j]
            if same:
                off = i != j
                i, j = i[off], j[off]
                np.add.at(counts, i, size[j])
            else:
                np.add.at(counts, i, size[j])
                np.add.at(counts, j, size[i])
            if len(i):
                u, v = _forest(ids[i], ids[j])
                us.append(u)
                vs.append(v)
    u, v = _forest(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
    own = np.flatnonzero(counts)
    return pa.Table.from_arrays([pa.array(np.concatenate([ids[own], u])), pa.array(np.concatenate([ids[own], v])), pa.array(np.concatenate([counts[own], np.zeros(len(u), np.int64)]))], names=["u", "v", "n"])


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    fine = F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("vec", lambda c: c != 0)
    rows = rows.select("vec_id", F.when(fine, F.col("vec")).alias("vec")).withColumn("key", F.when(F.col("vec").isNotNull(), F.sha2(F.to_json(F.struct(F.transform("vec", lambda c: c + F.lit(0.0)).alias("v"))), 256)))
    rows = materialise(rows, "vectors")
    classes = rows.where("vec is not null").groupBy("key").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = materialise(classes.withColumn("dim", F.size("vec")), "classes")
    # rows without a vec_id cannot name a class: they count, and link, but their class needs a name of its own
    classes = classes.withColumn("rep", F.coalesce("rep", F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("key"), 3)))
    n = classes.count()
    tiles = max(LEAST_TILES, -(-n // tile))
    put = classes.withColumn("t", F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int"))
    meets = put.select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("o")).select(
        "dim", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), (F.col("t") > F.col("o")).cast("int").alias("side"), (F.col("t") == F.col("o")).alias("same"), "rep", "size", "vec"
    )
    found = materialise(meets.groupBy("dim", "i", "j").applyInArrow(lambda t: _tile_links(t, threshold), "u long, v long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("far"))
    parts = connected_components(found.where("n = 0").select("u", "v"))
    label = classes.select("key", "rep", "size").join(counts, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    label = label.select("key", (F.coalesce("far", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part"))
    out = rows.select("vec_id", "key").join(label, "key", "left")
    part = F.when(F.coalesce("part", F.lit(0)) < NAMELESS, F.coalesce("part", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), part.alias("component_id"), F.coalesce(F.col("vec_id") == part, F.lit(True)).alias("kept"))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """op10 over the whole of embeddings: vec_id, n_links, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
