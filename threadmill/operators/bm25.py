"""BM25 over turns as DataFrame algebra: postings, statistics, scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import text as X
from threadmill.model import SearchFilters
from threadmill.operators.filters import search_predicate

K1, B = 1.2, 0.75
BUCKETS = 32  # few enough to be listed without a job of its own; sorted files do the rest
TASK_WORDS = 2_000_000  # of a task that writes postings: some 250 MB while they are sorted
_buckets: dict[str, int] = {}


@dataclass
class Index:
    """postings (keys, dl, term, tf); docs (keys, dl). Statistics are over all of docs. A saved index has
    the terms' document frequencies (term, df) and the one-row statistics (n, avgdl) as well. One that can be
    saved in packed form has its words (keys, words, dl), none of which holds a space."""

    postings: DataFrame
    docs: DataFrame
    keys: tuple[str, ...] = ("session_id", "turn_index")
    terms: DataFrame | None = None
    stats: DataFrame | None = None
    words: DataFrame | None = None


def build(turns: DataFrame, keys: tuple[str, ...] = ("session_id", "turn_index"), text: Column | None = None, tokenizer: Callable[[Column], Column] = X.tokens, unique: bool = False) -> Index:
    """One shuffle, on the document's key and term, with counts combined before it; none with `unique`,
    which says that no two turns have the same key, so that terms are counted where their turn is. The text
    is the content with its tool calls, unless another is given."""
    words = turns.select(*keys, tokenizer(X.turn_text(turns.columns) if text is None else text).alias("words")).withColumn("dl", F.size("words"))
    if unique:
        postings = _counted(words.select(*keys, "dl", F.sort_array("words").alias("words")), keys)
    else:
        postings = words.select(*keys, "dl", F.explode("words").alias("term")).groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))
    return Index(postings, words.select(*keys, "dl"), keys, words=words if unique and tokenizer is X.tokens else None)


def _begins(of: Callable[[Column], Column]) -> Column:
    """The places in the sorted words where of(word) is another than before."""
    return F.filter(F.transform("words", lambda x, i: F.when((i == 0) | (of(x) != of(F.get("words", i - 1))), i)), lambda i: i.isNotNull())


def _counted(words: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, dl, term, tf) row by row of sorted words: the places where another begins, and the distance
    from each to the next; in proportion to the text."""
    own = words.withColumn("at", _begins(lambda x: x))
    count = lambda i, k: F.struct(F.get("words", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("words")) - i).cast("bigint").alias("tf"))
    return own.select(*keys, "dl", F.explode(F.transform("at", count)).alias("x")).select(*keys, "dl", "x.term", "x.tf")


def _packed(words: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, dl, pack): a row for each turn and bucket, with the turn's words of that bucket in order and
    with repeats. A letter for the bucket stands before each word, so that one sort brings both in order."""
    tagged = F.sort_array(F.transform("words", lambda w: F.concat(F.char(_bucket(w) + 64), w)))
    own = words.select(*keys, "dl", tagged.alias("words")).withColumn("at", _begins(F.ascii))
    pack = lambda i, k: F.array_join(F.slice("words", i + 1, F.coalesce(F.get("at", k + 1), F.size("words")) - i), " ")
    return own.select(*keys, "dl", F.explode(F.transform("at", pack)).alias("pack"))


def _shuffled(words: DataFrame, keys: tuple[str, ...], n_words: int) -> DataFrame:
    """(keys, dl, term, tf, bucket) in tasks of a bucket or several, or of a part of one: keys and lengths go
    with a turn's words of a bucket, not with each term, and tasks hold as many words whatever the corpus."""
    tasks = max(1, -(-n_words // TASK_WORDS))
    parts = -(-tasks // BUCKETS)
    tasks = BUCKETS * parts if parts > 1 else tasks
    bucket = F.ascii("pack") - 64
    task = bucket * parts + F.pmod(F.xxhash64(*keys), F.lit(parts)) if parts > 1 else F.floor(bucket * tasks / BUCKETS)
    dealt = _packed(words, keys).repartitionById(tasks, task.cast("int"))
    counted = _counted(dealt.select(*keys, "dl", F.split("pack", " ").alias("words")), keys)
    return counted.select(*keys, "dl", F.substring("term", F.lit(2), F.length("term")).alias("term"), "tf", (F.ascii("term") - 64).alias("bucket"))


def keys_repeat(turns: DataFrame, keys: tuple[str, ...] = ("session_id", "turn_index")) -> bool:
    """Whether two turns have the same key; only keys are read."""
    return not turns.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty()


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def save(index: Index, path: str) -> None:
    """Postings in buckets of the term's hash, sorted by term, so that a query reads its terms' row
    groups of its terms' buckets only. One shuffle, without a pass to look for ranges: a bucket that is too
    large for a task is dealt to several, so a term that all documents hold is written by several, and small
    buckets share a task. Frequencies of terms lie in the same buckets; statistics are one row for each part
    of the index."""
    spark = index.docs.sparkSession
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("n"), F.count("dl").alias("counted"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).write.mode("overwrite").parquet(f"{path}/stats")
    if index.words is not None:
        p = _shuffled(index.words, index.keys, spark.read.parquet(f"{path}/stats").agg(F.sum("words")).first()[0])
    else:
        p = index.postings.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", F.col("bucket"))
    p.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    terms = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/terms")


def load(spark: SparkSession, path: str, keys: tuple[str, ...] = ("session_id", "turn_index")) -> Index:
    stats = spark.read.parquet(f"{path}/stats").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("counted")).alias("avgdl"))  # turns without content have no length
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), keys, spark.read.parquet(f"{path}/terms"), stats)


def _only(table: DataFrame, terms: list[str]) -> DataFrame:
    if "bucket" in table.columns:
        new = [t for t in terms if t not in _buckets]
        if new:
            if len(_buckets) > 100_000:
                _buckets.clear()
            own = table.sparkSession.sql("select 1").select(F.explode(F.array(*map(F.lit, new))).alias("term"))
            _buckets.update({r["term"]: r["b"] for r in own.select("term", _bucket(F.col("term")).alias("b")).collect()})  # one number for each query term
        table = table.where(F.col("bucket").isin(sorted({_buckets[t] for t in terms})))
    return table.where(F.col("term").isin(terms))


def hits(index: Index, terms: list[str]) -> DataFrame:
    """The postings of the terms; prunes buckets where the index was saved."""
    return _only(index.postings, terms)


def scores(index: Index, terms: list[str], mode: str = "and") -> DataFrame:
    """(keys, score) of documents that hold all terms, or any with mode "or". Document frequencies and
    the one row of corpus statistics are broadcast: their size is that of the query. A saved index has
    both, so the postings are read once and nothing is tokenised."""
    terms = sorted(set(terms))
    own = hits(index, terms)
    if index.terms is not None:
        df, stats = _only(index.terms, terms).groupBy("term").agg(F.sum("df").alias("df")), index.stats
    else:
        df, stats = own.groupBy("term").agg(F.count("*").alias("df")), index.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = own.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy(*index.keys).agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    return scored.where(F.col("matched") == len(terms)).drop("matched") if mode == "and" else scored.drop("matched")


def normalize(scored: DataFrame, column: str = "score", by: str | None = None, bound: int | None = None) -> DataFrame:
    """Scores over their maximum (of each `by`), where that is positive. A list known to have at most
    `bound` rows is one window; any other is joined with the one row of its maximum."""
    if by is not None or bound is not None:
        top = F.max(column).over(Window.partitionBy(*([by] if by else [])))
        return scored.withColumn(column, F.when(top > 0, F.col(column) / top).otherwise(F.col(column)))
    with_top = scored.crossJoin(F.broadcast(scored.agg(F.max(column).alias("__top"))))  # one row
    return with_top.withColumn(column, F.when(F.col("__top") > 0, F.col(column) / F.col("__top")).otherwise(F.col(column))).drop("__top")


def search(index: Index, turns: DataFrame, sessions: DataFrame, query: str, limit: int = 10, filters: SearchFilters | None = None, mode: str = "and", snippets: bool = True) -> DataFrame:
    """The best `limit` turns: filters before the cut, statistics from the whole index. Without
    `snippets` the turns aren't read."""
    terms = X.query_terms(turns.sparkSession, query)
    keys = list(index.keys)
    filters = filters or SearchFilters()
    if not terms:
        return turns.select(*keys, F.lit(0.0).alias("score"), F.lit("").alias("snippet")).limit(0)
    found = scores(index, terms, mode).join(search_predicate(sessions, filters).select(F.col("id").alias("session_id")), "session_id", "left_semi")
    best = found.orderBy(F.desc("score"), *keys).limit(limit)
    if not snippets:
        return normalize(best, bound=limit)
    shown = turns.select(*keys, X.snippet(F.col("content"), F.lit(query)).alias("snippet"))
    return normalize(shown.join(F.broadcast(best), keys), bound=limit)  # at most `limit` rows


EXPAND = "Rewrite the search query with words that mean the same. Answer with the words only."


def _fresh(now: Column, days: int) -> Column:
    return F.col("created_at") + F.make_interval(days=F.lit(days)) > now


def expand_query(query: str, cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The cached expansion of a query, if it is younger than `days`."""
    return cache.where((F.col("query_hash") == F.xxhash64(F.lit(query))) & _fresh(now, days)).select("original", "expanded")


def expand(query: str, cache: DataFrame, backend: Callable[[str, str], str], now: datetime, days: int = 7) -> tuple[str, DataFrame]:
    """The query with the words that a language model adds, and the cache with that answer put in; an
    answer that is young enough comes from the cache. A model that fails or says nothing leaves the query
    as it is, and isn't remembered."""
    known = expand_query(query, cache, F.lit(now), days).limit(1).collect()
    if known:
        return known[0]["expanded"], cache
    try:
        said = " ".join(backend(EXPAND, query).split())
    except Exception:  # noqa: BLE001 - the model is the caller's; search goes on without it
        said = ""
    if not said:
        return query, cache
    whole = f"{query} {said}"
    row = cache.sparkSession.createDataFrame([(query, whole, now)], "original string, expanded string, created_at timestamp").select(F.xxhash64("original").alias("query_hash"), "original", "expanded", "created_at")
    kept = cache.where(F.col("query_hash") != F.xxhash64(F.lit(query)))
    return whole, kept.select("query_hash", "original", "expanded", "created_at").unionByName(row)


def expire_cache(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The cache without answers that are too old."""
    return cache.where(_fresh(now, days))
