"""Approximate vector search over a stored index of cells (inverted lists, Jegou et al. 2011).

Centroids are fitted by spherical k-means on a bounded sample, every vector is put in the cell of its
nearest centroid, and a cell's vectors lie in files of their own; a cell of more than PART vectors is
split in parts. A query goes to the cells of its nearest centroids only: queries are dealt by cell and
part, and the task of one reads that part's file. Vectors are never shuffled for a search.

How many cells a query goes to is measured when the index is made: the least number that finds TARGET of
the nearest ten among the sample. Where vectors cluster these are few; where they have no structure, as
points spread evenly over a sphere, it comes to about half of all cells, and the exact join of
vectors.knn_join() costs twice as much.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators.vectors import BLOCK, KNN, _top_k, distances, matrix, nearest
from threadmill.storage import file_system, shared_dir

MAX_SAMPLE = 50_000  # vectors that the centroids are fitted on
MAX_CELLS = 4096
PART = 100_000
QUERIES = 20_000  # of a cell that one task takes
TARGET, NEAR = 0.95, 10


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0)


def fit_cells(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids by spherical k-means; a cell that runs empty takes a row that lies badly."""
    x = _unit(x)
    at = np.random.default_rng(seed).choice(len(x), cells, replace=False)
    centroids = x[at]
    for _ in range(rounds):
        near = x @ centroids.T
        own, fit = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = x[np.argsort(fit)[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def probes_for(x: np.ndarray, centroids: np.ndarray, target: float = TARGET, asked: int = 200) -> int:
    """The least number of cells in which `target` of the nearest NEAR of sample rows are found."""
    x = _unit(x)
    own = (x @ centroids.T).argmax(axis=1)
    q = np.arange(0, len(x), max(1, len(x) // asked))[:asked]
    exact = np.argsort(-(x[q] @ x.T), axis=1)[:, : min(NEAR, len(x))]
    order = np.argsort(-(x[q] @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = np.take_along_axis(place, own[exact], axis=1).ravel()
    return int(np.quantile(needed, target, method="higher")) + 1


@dataclass
class AnnIndex:
    """A stored index: `vectors` in folders by cell and part, `cells` (cell, centroid), `sizes` (cell, n)
    with one row for each batch that was added, `meta` (dim, probes, parts by cell)."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    dim: int
    probes: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> AnnIndex:
        meta = spark.read.parquet(f"{path}/meta").first()
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MAX_CELLS
        return cls(spark, path, np.array([r["centroid"] for r in rows]).reshape(len(rows), -1), meta["dim"], meta["probes"])

    def parts(self) -> DataFrame:
        """(cell, parts), at most MAX_CELLS rows; fixed when the index is made."""
        return self.spark.read.parquet(f"{self.path}/parts")

    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sizes").groupBy("cell").agg(F.sum("n").alias("n"))

    def _cells(self, df: DataFrame, key: str, n: int) -> DataFrame:
        """(key, embedding, cell) with the n nearest cells of each row."""
        shared, dim = self.spark.sparkContext.broadcast(self.centroids), self.dim  # at most MAX_CELLS vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    near = matrix(part.column("embedding"), dim) @ centroids.T
                    cell = np.argsort(-near, axis=1, kind="stable")[:, :n]
                    rows = pa.array(np.repeat(np.arange(part.num_rows), cell.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column(key).take(rows), part.column("embedding").take(rows), pa.array(cell.reshape(-1), pa.int32())], [key, "embedding", "cell"])

        return df.select(F.col(key).cast("bigint").alias(key), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, f"{key} bigint, embedding array<float>, cell int")

    def add(self, vectors: DataFrame) -> AnnIndex:
        """Puts vectors (vec_id, embedding) into their cells; every row is indexed."""
        at = self._cells(vectors, "vec_id", 1).join(F.broadcast(self.parts()), "cell")
        at = at.select("vec_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
        batch = uuid.uuid4().hex
        at.withColumn("batch", F.lit(batch)).repartition("cell", "part").write.mode("append").partitionBy("batch", "cell", "part").parquet(f"{self.path}/vectors")
        own = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("batch") == batch)
        own.groupBy("cell").agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.path}/sizes")
        return self

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, distance): about the k nearest of every query (query_id, embedding). Batches
        whose sizes aren't written yet don't count."""
        path, dim = self.path, self.dim
        batches = [r["batch"] for r in self.spark.read.parquet(f"{path}/sizes").select("batch").distinct().collect()]
        asked = self._cells(queries, "query_id", min(len(self.centroids), probes or self.probes))
        counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))  # at most MAX_CELLS rows
        dealt = asked.join(F.broadcast(counts), "cell").join(F.broadcast(self.parts()), "cell")
        dealt = dealt.select("query_id", "embedding", "cell", F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            fs, root = file_system(path)
            cell, part, _ = key
            ids, v = np.zeros(0, np.int64), np.zeros((0, dim))
            for batch in batches:
                folder = pfs.FileSelector(f"{root}/vectors/batch={batch}/cell={cell}/part={part}", allow_not_found=True)
                for x in fs.get_file_info(folder):
                    if x.path.endswith(".parquet"):
                        t = pq.read_table(x.path, filesystem=fs, partitioning=None, columns=["vec_id", "embedding"])
                        ids, v = np.concatenate([ids, np.asarray(t.column("vec_id"))]), np.concatenate([v, matrix(t.column("embedding"), dim)])
            q, who, rows = matrix(pa.array(pdf["embedding"], pa.list_(pa.float32())), dim), pdf["query_id"].to_numpy(), []
            for at in range(0, len(q), BLOCK):
                d, i = np.zeros((len(q[at : at + BLOCK]), 0)), np.zeros((len(q[at : at + BLOCK]), 0), np.int64)
                for b in range(0, len(v), BLOCK):
                    more = distances(q[at : at + BLOCK], v[b : b + BLOCK])
                    d, i = nearest(np.concatenate([d, more], axis=1), np.concatenate([i, np.broadcast_to(ids[b : b + BLOCK], more.shape)], axis=1), k)
                rows.append(pd.DataFrame({"query_id": np.repeat(who[at : at + BLOCK], i.shape[1]), "vec_id": i.reshape(-1), "distance": d.reshape(-1)}))
            return pd.concat(rows)

        return _top_k(dealt.groupBy("cell", "part", "block").applyInPandas(run, KNN), k)

    def compared(self, queries: DataFrame, probes: int | None = None) -> int:
        """Pairs that a search of these queries compares."""
        asked = self._cells(queries, "query_id", min(len(self.centroids), probes or self.probes))
        return asked.groupBy("cell").count().join(F.broadcast(self.sizes()), "cell").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0


def build_ann(vectors: DataFrame, path: str | None = None, sample: int = MAX_SAMPLE, cells: int | None = None) -> AnnIndex:
    """Makes an index of vectors (vec_id, embedding) below `path` (a new folder in the shared one by
    default). The centroids are fitted on the `sample` rows whose ids have the least hash; there are
    about as many cells as the root of the rows, MAX_CELLS at most."""
    spark = vectors.sparkSession
    path = path or f"{shared_dir(spark)}/threadmill-ann-{uuid.uuid4().hex}"
    total, dim = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = max(1, dim or 1)
    some = vectors.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    x = np.stack([np.asarray(v, dtype=np.float64) for v in some]) if len(some) else np.zeros((1, dim))
    x[~np.isfinite(x).all(axis=1)] = 0
    n = min(MAX_CELLS, max(1, cells or round(total**0.5)), max(1, len(x) // 4))
    centroids = fit_cells(x, n)
    spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(dim, probes_for(x, centroids))], "dim int, probes int").write.mode("overwrite").parquet(f"{path}/meta")
    index = AnnIndex.open(spark, path)
    counts = index._cells(vectors, "vec_id", 1).groupBy("cell").agg(F.count("*").alias("n"))
    all_cells = spark.read.parquet(f"{path}/cells").select("cell")
    all_cells.join(counts, "cell", "left").select("cell", F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(1)) / PART)).cast("int").alias("parts")).write.mode("overwrite").parquet(f"{path}/parts")
    return index.add(vectors)
