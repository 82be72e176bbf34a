"""What an engine keeps between queries: the search index, the graph and the vector index over the test
tables, made by the first query that needs them and read by the others."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadmill.operators import ann, bm25
from threadmill.operators import graph as G
from threadmill.plans import tables
from threadmill.storage import hadoop, qualified, shared_dir

_made: set[str] = set()


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Changes when a table of the folder does; another folder has another."""
    fs, at = hadoop(spark, sf_dir)
    return hashlib.sha256(repr((qualified(spark, sf_dir), sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))).encode()).hexdigest()[:16]


def _folder(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], object]) -> str:
    path = f"{shared_dir(spark)}/threadmill-saved-{spark.sparkContext.applicationId}/{_state(spark, sf_dir)}/{name}"
    if path not in _made:
        make(path)
        _made.add(path)
    return path


def stored_table(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    return spark.read.parquet(_folder(spark, sf_dir, name, lambda path: make(spark, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(path)))


def _save_index(turns: DataFrame, path: str) -> None:
    bm25.save(bm25.build(turns, unique=not bm25.keys_repeat(turns)), path)


def turn_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return bm25.load(spark, _folder(spark, sf_dir, "turn_index", lambda path: _save_index(tables.turns(spark, sf_dir), path)))


def document_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return bm25.load(spark, _folder(spark, sf_dir, "document_index", lambda path: _save_index(tables.documents_turns(spark, sf_dir), path)))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_table(spark, sf_dir, "sessions", tables.sessions)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_table(spark, sf_dir, "graph_edges", tables.graph_edges)


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_table(spark, sf_dir, "graph_nodes", tables.graph_nodes)


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_table(spark, sf_dir, "order_edges", lambda s, d: G.adjacency(tables.orders(s, d)))


def vector_index(spark: SparkSession, sf_dir: str) -> ann.AnnIndex:
    make = lambda path: ann.build_ann(tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    return ann.AnnIndex.open(spark, _folder(spark, sf_dir, "vector_index", make))
