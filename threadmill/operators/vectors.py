"""Vector search: exact cosine ranking, incremental embedding, stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import text as X
from threadmill.model import SearchFilters
from threadmill.operators.filters import search_predicate
from threadmill.storage import Scratch, file_system


def dot(a: Column, b: Column) -> Column:
    d = lambda x: x.cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where the sizes differ, a vector is empty or null, or a norm is 0."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (both > 0), 1 - dot(a, b) / both).otherwise(1.0)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(vectors: DataFrame, query: list[float], limit: int, keys: tuple[str, ...] = ("session_id", "turn_index", "chunk_seq"), allowlist: DataFrame | None = None) -> DataFrame:
    """The nearest `limit` rows by cosine distance, ties by key. Distances are made in codegen, and only
    the best of each partition leave it."""
    if allowlist is not None:
        vectors = vectors.join(allowlist.select("session_id"), "session_id", "left_semi")
    return vectors.select(*keys, cosine_distance(F.col("embedding"), literal(query)).alias("distance")).orderBy("distance", *keys).limit(limit)


def search(vectors: DataFrame, turns: DataFrame, sessions: DataFrame, query: list[float], limit: int = 10, filters: SearchFilters | None = None, per_chunk: bool = False) -> DataFrame:
    """Turns by similarity, filtered before the cut, with the first 200 characters. A turn counts once,
    by its best chunk, unless `per_chunk`."""
    allowed = search_predicate(sessions, filters or SearchFilters()).select(F.col("id").alias("session_id"))
    found = vectors.join(allowed, "session_id", "left_semi").select("session_id", "turn_index", "chunk_seq", cosine_distance(F.col("embedding"), literal(query)).alias("distance"))
    if not per_chunk:
        found = found.groupBy("session_id", "turn_index").agg(F.min("distance").alias("distance"), F.min_by("chunk_seq", "distance").alias("chunk_seq"))
    best = found.orderBy("distance", "session_id", "turn_index", "chunk_seq").limit(limit)
    shown = turns.select("session_id", "turn_index", F.substring("content", 1, 200).alias("snippet"))
    return F.broadcast(best).join(shown, ["session_id", "turn_index"]).withColumn("score", 1 - F.col("distance"))  # at most `limit` rows


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows; those of another size, null or not finite are rows of zeros."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim))
    for i, v in enumerate(rows):
        if v is not None and len(v) == dim:
            out[i] = v
    out[~np.isfinite(out).all(axis=1)] = 0
    return out


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """cosine_distance() of every row of q with every row of v."""
    both = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
    return np.where(both > 0, 1 - (q @ v.T) / np.where(both > 0, both, 1), 1.0)


def nearest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k least of each row, ties (to 12 digits) by id."""
    if d.shape[1] > 4 * k:  # all that are no farther than the k-th: few are left to sort
        kth = np.partition(np.round(d, 12), k - 1, axis=1)[:, k - 1 : k]
        width = int((np.round(d, 12) <= kth).sum(axis=1).max(initial=0))
        at = np.argpartition(np.round(d, 12), min(width, d.shape[1] - 1), axis=1)[:, :width] if width < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        d, ids = np.take_along_axis(d, at, axis=1), np.take_along_axis(ids, at, axis=1)
    order = np.lexsort((ids, np.round(d, 12)), axis=1)[:, :k]
    return np.take_along_axis(d, order, axis=1), np.take_along_axis(ids, order, axis=1)


KNN = "query_id bigint, vec_id bigint, distance double"
HELD = 1 << 16  # vectors that a task holds at once
BLOCK = 2048  # queries and vectors that are compared at once


def _top_k(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def knn_join(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance): the k nearest vectors (vec_id, embedding) of every query (query_id,
    embedding), exactly. The queries are written to the shared folder; each task holds HELD of its
    vectors and reads all queries in blocks, so neither the driver nor a broadcast holds them. A task
    sends k rows a query for each HELD vectors, which a window cuts to k."""
    scratch = Scratch(vectors.sparkSession)
    path = scratch.path("queries")
    queries.select("query_id", "embedding").write.parquet(path)
    dim = vectors.sparkSession.read.parquet(path).agg(F.max(F.size("embedding"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        files = sorted(x.path for x in fs.get_file_info(pfs.FileSelector(root)) if x.path.endswith(".parquet"))

        def compare(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            ids, v = np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])
            for file in files:
                with fs.open_input_file(file) as f:
                    for block in pq.ParquetFile(f).iter_batches(BLOCK):
                        q, asked = matrix(block.column("embedding"), dim), np.asarray(block.column("query_id"))
                        best_d, best_i = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), np.int64)
                        for at in range(0, len(v), BLOCK):
                            d = distances(q, v[at : at + BLOCK])
                            own = np.broadcast_to(ids[at : at + BLOCK], d.shape)
                            best_d, best_i = nearest(np.concatenate([best_d, d], axis=1), np.concatenate([best_i, own], axis=1), k)
                        n = best_i.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, n), pa.int64()), pa.array(best_i.reshape(-1), pa.int64()), pa.array(best_d.reshape(-1))], ["query_id", "vec_id", "distance"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held.append((np.asarray(part.column("vec_id")), matrix(part.column("embedding"), dim)))
                if sum(len(i) for i, _ in held) >= HELD:
                    yield from compare(held)
                    held = []
        if held:
            yield from compare(held)

    return _top_k(vectors.select("vec_id", "embedding").mapInArrow(run, KNN), k)


def chunks(turns: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """(session_id, turn_index, seq, text) of turns that have text: the content with its tool calls."""
    own = turns.withColumn("shown", X.turn_text(turns.columns)).where(F.coalesce(F.col("shown"), F.lit("")) != "")
    return own.select("session_id", "turn_index", F.posexplode(X.char_chunks(F.col("shown"), size, overlap)).alias("seq", "text"))


def pending(chunked: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of this model."""
    have = stored.where(F.col("model") == model).select("session_id", "turn_index", F.col("chunk_seq").alias("seq"))
    return chunked.join(have, ["session_id", "turn_index", "seq"], "left_anti")


def embed(chunked: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, batch: int = 32) -> DataFrame:
    """Vectors of chunks, in batches; a batch that fails is tried item by item, and items that fail or
    aren't finite are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    found = list(embedder(part["text"].tolist()))
                except Exception:
                    found = []
                    for t in part["text"]:
                        try:
                            found += list(embedder([t]))
                        except Exception:
                            found.append(None)
                ok = [v is not None and len(v) > 0 and bool(np.isfinite(v).all()) for v in found]
                own = part.loc[ok, ["session_id", "turn_index", "seq"]].rename(columns={"seq": "chunk_seq"})
                made = pd.Series([np.asarray(v, dtype=np.float32) for v, k in zip(found, ok, strict=True) if k], index=own.index, dtype=object)
                if len(own):
                    yield own.assign(model=model, embedding=made)

    return chunked.select("session_id", "turn_index", "seq", "text").mapInPandas(run, "session_id string, turn_index int, chunk_seq int, model string, embedding array<float>")


def hash_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed hashed word counts, unit length."""
    import zlib

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in X.query_tokens(t):
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return run


def insert_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored vectors and those of `new` whose key isn't stored; all must have one size for each model."""
    keys = ["session_id", "turn_index", "chunk_seq", "model"]
    sizes = stored.groupBy("model").agg(F.max(F.size("embedding")).alias("dim"))
    fits = new.join(sizes, "model", "left").withColumn("ok", F.coalesce(F.size("embedding") == F.col("dim"), F.lit(True)))
    checked = fits.where(F.coalesce(F.assert_true("ok", F.lit("the vector's size isn't the model's")), F.lit(True)).cast("boolean")).drop("dim", "ok")
    return stored.unionByName(checked.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def reconcile(stored: DataFrame, model: str, allow_wipe: bool) -> tuple[str, DataFrame]:
    """clean where all vectors are the model's, wiped where others were dropped, refused otherwise."""
    if stored.where(F.col("model") != model).limit(1).count() == 0:
        return "clean", stored
    return ("wiped", stored.where(F.col("model") == model)) if allow_wipe else ("refused", stored)


def models(stored: DataFrame) -> DataFrame:
    return stored.select("model").distinct()


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The unit-length mean of the token vectors whose mask isn't 0."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] != 0)
    total = F.aggregate(kept, F.array().cast("array<double>"), lambda s, x: F.when(F.size(s) == 0, F.transform(x["t"], lambda v: v.cast("double"))).otherwise(F.zip_with(s, x["t"], lambda a, b: a + b)))
    return F.transform(total, lambda v: v / norm(total))


def encode_floats(vector: Column) -> Column:
    """Little-endian 32-bit floats."""

    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return F.pandas_udf(run, "binary")(vector)


def decode_floats(blob: Column) -> Column:
    """Little-endian 32-bit floats; a length that isn't a multiple of 4 gives an empty array."""

    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, dtype="<f4").tolist() if b is not None and len(b) % 4 == 0 else [])

    return F.pandas_udf(run, "array<float>")(blob)
