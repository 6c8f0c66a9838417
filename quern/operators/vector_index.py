"""A stored table of vectors in cells around centroids, with exact top-k that reads the cells it has to.

A vector lies in the cell of the centroid with the smallest angle to it. For each cell and workspace the table knows how many
vectors there are, how far the farthest lies from the centroid (an angle) and how long the longest is. By the
triangle inequality no vector of a cell is nearer to a query than their angle less that reach, which bounds its score.

A search takes queries in blocks of bounded bytes. The cells with the highest bounds that hold k vectors come first; their
k-th best score rules out cells whose bound is below it, and the others are read too. The rows are those of vectors.top_k.

Centroids come from at most SAMPLE vectors (a seeded draw) and never change; every vector is stored, whatever the sample. Documents come
and go by cell: files of other cells stay as they are (see sources.keyed).
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..sources.keyed import Change, Folder, KeyedTable
from ..sources.tables import written
from .vectors import BLOCK, QUERY_BYTES, _sound, query_blocks

#: Vectors that centroids are fitted to, at most.
SAMPLE = 20_000
_VECTORS = "cell int, workspace_id string, document_id string, chunk_id string, angle double, norm double, vec array<double>"
_CELLS = "cell int, workspace_id string, n long, reach double, longest double"
#: More than rounding takes from an angle or a product.
_SLACK = 1e-6


@dataclass(frozen=True)
class Found:
    """rows: query_id, chunk_id, score, rank; vectors compared with queries, of all that a plain search would compare."""

    rows: DataFrame
    compared: int
    of: int


def fit(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors, by spherical k-means."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(sample)))
    at = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[i : i + 4096] @ at.T, axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(at)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1)
        at[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return at


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, save=written):
        """Opens the index that ``create`` has made."""
        self.spark, self.save = spark, save
        made = json.loads(Folder(spark, path).read("centroids.json"))
        self.centroids = np.array(made["centroids"], float)
        self.dim, self.n_cells = self.centroids.shape[1], len(self.centroids) + 1  # the last is for zero vectors
        self.vectors = KeyedTable(spark, f"{path}/vectors", "chunk_id", _VECTORS, self.n_cells, sort=["workspace_id", "chunk_id"])
        self.cells = KeyedTable(spark, f"{path}/cells", "cell", _CELLS, self.n_cells)
        self.places = KeyedTable(spark, f"{path}/places", "document_id", "document_id string, cell int", min(self.n_cells, 64))

    @classmethod
    def create(cls, spark: SparkSession, path: str, vectors: DataFrame, dim: int, cells: int = 64, save=written) -> VectorIndex:
        """An empty index with centroids fitted to a sample of vectors (vec)."""
        some = vectors.where(_sound("vec", dim) & F.exists("vec", lambda x: x != 0)).select("vec")
        drawn = some.orderBy(F.xxhash64("vec")).limit(SAMPLE).toArrow().column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        at = fit(drawn / np.linalg.norm(drawn, axis=1)[:, None], cells) if len(drawn) else np.eye(1, dim)
        Folder(spark, path).put("centroids.json", json.dumps({"centroids": at.tolist()}))
        return cls(spark, path, save)

    # --- documents in and out ---

    def _assigned(self, rows: DataFrame) -> DataFrame:
        at, dim, zero = self.centroids, self.dim, self.n_cells - 1

        def of(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(i, BLOCK)
                    v = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                    norm = np.linalg.norm(v, axis=1)
                    near = v @ at.T / np.where(norm > 0, norm, 1)[:, None]
                    cell = np.argmax(near, axis=1)
                    angle = np.arccos(np.clip(near[np.arange(len(v)), cell], -1, 1))
                    cell = np.where(norm > 0, cell, zero).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *(part.column(c) for c in ("workspace_id", "document_id", "chunk_id")), pa.array(angle), pa.array(norm), part.column("vec")], names=[c.split()[0] for c in _VECTORS.split(", ")])

        names = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("default").alias(c) for c in ("workspace_id", "document_id", "chunk_id")]
        return rows.where(_sound("vec", dim)).select(*names, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(of, _VECTORS)

    def upsert(self, rows: DataFrame) -> Change:
        """All vectors (document_id, chunk_id, vec[, workspace_id]) of these documents, in the place of their old ones; unsound vectors are left out."""
        return self._change(self.save(self._assigned(rows)), rows.select(F.col("document_id").cast("string").alias("document_id")).distinct())

    def delete(self, ids: DataFrame) -> Change:
        """Without the vectors of the documents of ids (document_id)."""
        return self._change(None, ids.select(F.col("document_id").cast("string").alias("document_id")).distinct())

    def _change(self, new: DataFrame | None, ids: DataFrame) -> Change:
        # cells of a document's old vectors: versions of all three tables belong together by the mark of the cells
        marks = self._marks()
        cells = self.places.read(number=marks["places"]).join(ids, "document_id", "left_semi").select("cell")
        cells = cells if new is None else cells.unionByName(new.select("cell"))
        touched = sorted(r[0] for r in cells.distinct().collect())
        kept = self.vectors.read(touched, marks["vectors"]).join(ids, "document_id", "left_anti")
        made = self.save(kept if new is None else kept.unionByName(new))
        done = self.vectors.replace_buckets(made, touched, "cell", base=marks["vectors"])
        places = self.places.merge(None if new is None else new.select("document_id", "cell").distinct(), ids, base=marks["places"])
        stats = made.groupBy("cell", "workspace_id").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach"), F.max("norm").alias("longest"))
        self.cells.replace_buckets(stats, touched, "cell", mark=("vectors", done.version), also={"places": places.version})
        return done

    def _marks(self) -> dict[str, int]:
        return {"vectors": 0, "places": 0} | self.cells.version().marks

    # --- search ---

    def _scores(self, block: pa.Table, pairs: list[np.ndarray], most: int, workspace: str | None) -> DataFrame:
        """(chunk_id, q, score) of the vectors of each cell with the queries pairs[cell], those that may be among a query's best."""
        flat = block.column("qv").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, self.dim)
        shared = self.spark.sparkContext.broadcast((flat, pairs))
        dim = self.dim

        def of(batches):
            matrix, wanted = shared.value
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                for c in np.unique(cell).tolist():
                    q = wanted[c]
                    if not len(q):
                        continue
                    part = batch.filter(pa.array(cell == c))
                    for i in range(0, part.num_rows, BLOCK):
                        some = part.slice(i, BLOCK)
                        v = some.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                        for j in range(0, len(q), BLOCK):
                            score = v @ matrix[q[j : j + BLOCK]].T
                            keep = np.ones(score.shape, bool)
                            if len(v) > most:
                                keep = score >= np.partition(score, len(v) - most, axis=0)[len(v) - most] - 2e-9
                            row, col = np.nonzero(keep)
                            yield pa.RecordBatch.from_arrays([some.column("chunk_id").take(pa.array(row)), pa.array(q[j : j + BLOCK][col].astype(np.int32)), pa.array(score[row, col])], names=["chunk_id", "q", "score"])

        rows = self.vectors.read([c for c, q in enumerate(pairs) if len(q)], self._marks()["vectors"])
        rows = rows if workspace is None else rows.where(F.col("workspace_id") == workspace)
        return rows.select("cell", "chunk_id", "vec").mapInArrow(of, "chunk_id string, q int, score double").withColumn("score", F.round("score", 9))

    def _bounds(self, block: pa.Table, n: np.ndarray, reach: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """The highest score that a vector of each cell can have with each query; -inf for empty cells."""
        q = block.column("qv").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, self.dim)
        norm = np.linalg.norm(q, axis=1)
        angle = np.arccos(np.clip(q @ self.centroids.T / np.where(norm > 0, norm, 1)[:, None], -1, 1))
        best = np.cos(np.maximum(angle - reach[None, :-1] - _SLACK, 0)) * longest[None, :-1] * norm[:, None]
        best = np.concatenate([np.maximum(best, 0), np.zeros((len(q), 1))], axis=1) + _SLACK
        return np.where(n[None, :] > 0, best, -np.inf)

    def top_k(self, queries: DataFrame, k: int, workspace: str | None = None, limit: int = QUERY_BYTES) -> Found:
        """queries (query_id, vec): the best k chunks of each, of one workspace or of all."""
        cells = self.cells.read()
        cells = cells if workspace is None else cells.where(F.col("workspace_id") == workspace)
        n, reach, longest = np.zeros(self.n_cells, np.int64), np.zeros(self.n_cells), np.zeros(self.n_cells)
        for r in cells.groupBy("cell").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"), F.max("longest").alias("longest")).collect():
            n[r.cell], reach[r.cell], longest[r.cell] = r.n, r.reach, r.longest
        q = queries.where(_sound("vec", self.dim)).select("query_id", F.col("vec").cast("array<double>").alias("qv"))
        parts, compared, total = [], 0, 0
        for block in query_blocks(q, "qv", self.dim, limit):
            if not block.num_rows:
                continue
            bound = self._bounds(block, n, reach, longest)
            order = np.argsort(-bound, axis=1, kind="stable")
            ahead = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, ahead < k, axis=1)
            first &= bound > -np.inf
            near = self.save(self._scores(block, self._pairs(first), k, workspace))
            kth = near.withColumn("r", F.row_number().over(Win.partitionBy("q").orderBy(F.desc("score"), "chunk_id"))).where(F.col("r") == k).select("q", "score").toArrow()
            least = np.full(block.num_rows, -np.inf)
            least[kth.column("q").to_numpy()] = kth.column("score").to_numpy()
            rest = ~first & (bound > -np.inf) & (bound >= least[:, None])
            far = self._scores(block, self._pairs(rest), k, workspace)
            names = self.spark.createDataFrame(block.drop_columns("qv").append_column("q", pa.array(np.arange(block.num_rows, dtype=np.int32))), q.drop("qv").withColumn("q", F.lit(0)).schema)
            parts.append(near.unionByName(far).join(F.broadcast(names), "q").drop("q"))
            parts[-1] = self.save(parts[-1])
            compared += int(((first | rest) * n[None, :]).sum())
            total += block.num_rows * int(n.sum())
        over = Win.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        if not parts:
            return Found(q.select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0), 0, 0)
        rows = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
        return Found(rows.select("query_id", "chunk_id", "score", "rank"), compared, total)

    @staticmethod
    def _pairs(chosen: np.ndarray) -> list[np.ndarray]:
        return [np.flatnonzero(chosen[:, c]) for c in range(chosen.shape[1])]
