"""Every query with SQL gives the rows of its SQL; the others give rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import check, database
from tests.conftest import SMALL
from threadmill.plans import registry


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_query(spark, db, name):
    query, sql = registry.ALL[name]
    if sql is None:
        assert query(spark, SMALL).count() > 0
    else:
        check(spark, db, SMALL, query, sql)


def test_ann(spark, tmp_path):
    """Recall against the exact join where vectors have no structure and where they cluster; rows that are
    added later; rows that can't be compared."""
    from threadmill.operators import ann
    from threadmill.operators import vectors as V

    r = np.random.default_rng(3)
    centers = r.standard_normal((25, 16)) * 3
    rows = [(i, (centers[i % 25] + r.standard_normal(16)).astype(np.float32).tolist()) for i in range(5000)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    ann.build_ann(e.where("vec_id < 4000"), str(tmp_path / "a"))
    index = ann.AnnIndex.open(spark, "file://" + str(tmp_path / "a")).add(e.where("vec_id >= 4000"))
    exact = {tuple(x) for x in V.knn_join(e, q, 10).select("query_id", "vec_id").collect()}
    found = {tuple(x) for x in index.search(q, 10).select("query_id", "vec_id").collect()}
    assert len(exact) == 1000 and len(exact & found) >= 0.9 * len(exact)
    assert index.compared(q) < 0.2 * 100 * 5000 and index.sizes().agg(F.sum("n")).first()[0] == 5000
    flat = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    fq = flat.withColumnRenamed("vec_id", "query_id")
    other = ann.build_ann(flat, "file://" + str(tmp_path / "b"))
    exact = {tuple(x) for x in V.knn_join(flat, fq, 10).select("query_id", "vec_id").collect()}
    assert len(exact & {tuple(x) for x in other.search(fq, 10).select("query_id", "vec_id").collect()}) >= 0.9 * len(exact)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    tiny = ann.build_ann(odd, "file://" + str(tmp_path / "c"))
    got = {x.vec_id: x.distance for x in tiny.search(odd.where("vec_id = 1").withColumnRenamed("vec_id", "query_id"), 9, 9).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0}
    assert tiny.search(odd.limit(0).withColumnRenamed("vec_id", "query_id"), 3).count() == 0


def test_exact_join_is_that_of_one_by_one(spark):
    from threadmill.operators import vectors as V

    r = np.random.default_rng(4)
    rows = [(i, r.integers(-2, 3, 3).astype(float).tolist()) for i in range(300)]  # many ties
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)

    def distance(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return 1 - sum(x * y for x, y in zip(a, b)) / n if n else 1.0

    got = {}
    for x in V.knn_join(e, e.where("vec_id < 20").withColumnRenamed("vec_id", "query_id"), 7).collect():
        got.setdefault(x.query_id, []).append(round(x.distance, 9))
    for i in range(20):
        assert sorted(got[i]) == sorted(round(distance(rows[i][1], v), 9) for _, v in rows)[:7]
    assert V.knn_join(e, e.limit(0).withColumnRenamed("vec_id", "query_id"), 3).count() == 0


def test_plans_do_not_grow_with_hops(spark):
    """A hop adds at most two scans of files to what related_sessions() reads, and none to the last join."""
    from threadmill.operators import graph as G

    e = spark.read.parquet(f"{SMALL}/orders.parquet").select(F.concat(F.lit("session:"), "o_orderkey").alias("source"), F.concat(F.lit("session:"), F.col("o_orderkey") + 1).alias("target"), F.lit("r").alias("relation"))
    seeds = spark.createDataFrame([("1",)], "session_id string")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")
    assert [scans(G.related_sessions(e, seeds, h)) for h in (1, 2, 3)] == [1, 2, 3]
    nodes = G.target_nodes(e)
    assert max(scans(G.query(nodes, e, "session:1", d)) for d in (1, 2, 3)) <= 4
    assert scans(G.degrees(e)) == 1 and scans(G.neighbors(e)) == 1
