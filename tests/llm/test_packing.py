import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from threadmill.llm import packing as P


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40), st.just(100))
def test_windows_hold_everything_once_within_capacity(sizes, capacity):
    windows = P.pack(np.array(sizes, dtype=np.int64), capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= capacity for w in windows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=30), st.integers(1, 6))
def test_differencing_is_that_of_dense_tuples(sizes, k):
    """The same algorithm with whole k-tuples, as it is usually written down."""
    heap = [(-s, i, [s] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, s in enumerate(sizes)] if k > 1 else []
    got = P._difference(np.array(sizes), k)
    if k == 1:
        assert sorted(got[0]) == list(range(len(sizes)))
        return
    import heapq

    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        pairs = sorted(((x + y, p + q) for x, y, p, q in zip(a, b[::-1], ia, ib[::-1])), key=lambda t: -t[0])
        s = [x for x, _ in pairs]
        heapq.heappush(heap, (-(s[0] - s[-1]), tick, s, [p for _, p in pairs]))
        tick += 1
    want = heap[0][2]
    assert sorted((sum(sizes[i] for i in w) for w in got), reverse=True) == [x for x in want if x]


def test_more_windows_where_they_overflow():
    assert len(P.pack(np.array([60, 60, 60]), 100)) == 3
    assert len(P.pack(np.array([34] * 9), 100)) == 5


def test_near_equal():
    r = np.random.default_rng(1)
    sizes = r.integers(50, 900, 500)
    sums = [sizes[w].sum() for w in P.pack(sizes, 4096)]
    assert max(sums) - min(sums) < 0.02 * 4096 and len(sums) <= -(-sizes.sum() // 4096) + 1


def test_token_counts():
    texts = ["Hello, world!", "", None, "é—ü 12_3", "a\tb\x00c", "…"]
    assert P.token_counts(pa.array(texts)).tolist() == [brute.tokens(t) for t in texts]


def test_table(spark, documents, odd, empty):
    got = P.pack_windows(documents, capacity=512, shard_tokens=20_000).toPandas()
    want = {r.doc_id: brute.tokens(r.text) for r in documents.collect()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {k: v for k, v in want.items() if v}
    assert (got.groupby("window_id").n_tokens.sum() == got.groupby("window_id").window_tokens.first()).all() and got.window_tokens.max() <= 512
    for _, own in got.sort_values("piece").groupby("doc_id"):
        assert own.start_token.tolist() == [0, *own.n_tokens.cumsum().tolist()[:-1]]
    again = P.pack_windows(documents.repartition(7), capacity=512, shard_tokens=20_000).toPandas()
    key = ["window_id", "doc_id", "piece"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    pdf = P.pack_windows(odd).toPandas()
    assert pdf.n_tokens.sum() == sum(brute.tokens(r.text) for r in odd.collect()) and pdf.doc_id.isna().sum() == 1
    assert P.pack_windows(empty).count() == 0
    with pytest.raises(ValueError):
        P.pack_windows(documents, capacity=0)


def test_repeated_rows_are_spread_over_the_shards(spark):
    df = spark.range(20_000).selectExpr("7 as doc_id", "'one two three' as text").unionByName(spark.createDataFrame([(8, "a b"), (7, "one two three four")], "doc_id bigint, text string"))
    got = P.pack_windows(df, capacity=50, shard_tokens=3000).toPandas()
    shards = got.window_id.str.split("-").str[0]
    assert got.n_tokens.sum() == 60_006 and got.groupby("window_id").n_tokens.sum().max() <= 50
    assert shards.nunique() == 20 and shards.value_counts().max() < 1100
    few = P.pack_windows(df, capacity=50).toPandas()  # one shard
    assert few.n_tokens.sum() == 60_006 and few.window_id.str.startswith("0-").all()
