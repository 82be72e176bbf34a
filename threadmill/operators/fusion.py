"""Reciprocal rank fusion, diversity, hybrid and multi-query recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.model import QueryItem, SearchFilters
from threadmill.operators import bm25, vectors
from threadmill.storage import materialize

K = 60
FEW_TURNS, PENALTY = 3, 0.5
KEYS = ("session_id", "turn_index")


def ranked(scored: DataFrame, keys: tuple[str, ...] = KEYS, score: str = "score", bound: int | None = None) -> DataFrame:
    """Adds the place in the list, from 0, by falling score and then the keys. A list known to have at
    most `bound` rows, as a search's candidates, is one window. Any other is dealt into ranges of scores
    and written; each range is numbered by itself, from the sum of the ranges before it."""
    if bound is not None:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc(score), *keys)) - 1)
    dealt = materialize(scored.repartitionByRange(F.desc(score), *keys).withColumn("range", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.partitionBy().orderBy("range")) - F.col("n")).alias("before"))  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.desc(score), *keys)) - 1
    return dealt.withColumn("rank", inside).join(F.broadcast(before), "range").withColumn("rank", F.col("rank") + F.col("before")).drop("range", "before")


def rrf(lists: dict[str, DataFrame], keys: tuple[str, ...] = KEYS, k: int = K, penalty: Column | None = None, bound: int | None = None) -> DataFrame:
    """The sum of 1/(k + rank + 1) over the lists, times `penalty`, over its maximum; keeps each
    list's own score as <name>_score. A key that a list has twice counts twice. `bound` is the most
    rows that a list can have, if that is known."""
    parts = None
    for name, scored in lists.items():
        own = ranked(scored, keys, bound=bound).select(*keys, (1 / (F.lit(float(k)) + F.col("rank") + 1)).alias("part"), *[(F.col("score") if n == name else F.lit(None).cast("double")).alias(f"{n}_score") for n in lists])
        parts = own if parts is None else parts.unionByName(own)
    fused = parts.groupBy(*keys).agg(F.sum("part").alias("score"), *[F.max(f"{n}_score").alias(f"{n}_score") for n in lists])
    if penalty is not None:
        fused = fused.withColumn("score", F.col("score") * penalty)
    return bm25.normalize(fused, bound=bound)


def with_penalty(fused: DataFrame, sessions: DataFrame, bound: int | None = None) -> DataFrame:
    """Halves the scores of sessions of fewer than 3 turns, and normalises again."""
    meta = sessions.select(F.col("id").alias("session_id"), "turn_count")
    factor = F.when(F.col("turn_count") < FEW_TURNS, PENALTY).otherwise(1.0)
    return bm25.normalize(fused.join(meta, "session_id").withColumn("score", F.col("score") * factor), bound=bound)


def diversify(scored: DataFrame, per_session: int = 2, score: str = "score") -> DataFrame:
    """The best `per_session` rows of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc(score), "turn_index")
    return scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_session).drop("nth")


def hybrid(index: bm25.Index, turns: DataFrame, sessions: DataFrame, stored: DataFrame, query: str, vector: list[float] | None, limit: int = 10, filters: SearchFilters | None = None, mode: str = "and") -> DataFrame:
    """Both searches for 3 x limit candidates, fused; one alone isn't fused. Then diversity and the cut."""
    filters = filters or SearchFilters()
    words = bm25.search(index, turns, sessions, query, 3 * limit, filters, mode, False).select(*KEYS, "score") if query else None
    near = vectors.search(stored, turns, sessions, vector, 3 * limit, filters).select(*KEYS, "score") if vector is not None else None
    if words is not None and near is not None:
        found = with_penalty(rrf({"bm25": words, "vector": near}, bound=3 * limit), sessions, 6 * limit)
    else:
        found = words if words is not None else near
    return diversify(found, filters.max_per_session).select(*KEYS, "score").orderBy(F.desc("score"), *KEYS).limit(limit)


def recall(items: list[QueryItem], index: bm25.Index, turns: DataFrame, sessions: DataFrame, stored: DataFrame, limit: int = 10, filters: SearchFilters | None = None, mode: str = "and") -> DataFrame:
    """Several items at once: keyword items make one list, semantic ones another, hybrid ones join
    both; the lists are fused, always with the penalty. A turn that several items find gains by each."""
    filters = filters or SearchFilters()
    lists: dict[str, list[DataFrame]] = {"bm25": [], "vector": []}
    for i in items:
        if i.kind in ("keyword", "hybrid") and i.text:
            lists["bm25"].append(bm25.search(index, turns, sessions, i.text, 3 * limit, filters, mode, False).select(*KEYS, "score"))
        if i.kind in ("semantic", "hybrid") and i.vector is not None:
            lists["vector"].append(vectors.search(stored, turns, sessions, i.vector, 3 * limit, filters).select(*KEYS, "score"))
    joined = {}
    for name, found in lists.items():
        if found:
            joined[name] = found[0]
            for f in found[1:]:
                joined[name] = joined[name].unionByName(f)
    if not joined:
        return turns.select(*KEYS, F.lit(0.0).alias("score")).limit(0)
    most = 3 * limit * len(items)
    return diversify(with_penalty(rrf(joined, bound=most), sessions, 2 * most), filters.max_per_session).select(*KEYS, "score").orderBy(F.desc("score"), *KEYS).limit(limit)


def wiki_keyword(pages: DataFrame, query: str) -> DataFrame:
    """(path, score, name_match): 2 where the name has the query, 1 where only the body has it."""
    q = F.lit(query.lower())
    name, text = F.contains(F.lower("stem"), q), F.contains(F.lower("body"), q)
    return pages.where(name | text).select("path", F.when(name, 2.0).otherwise(1.0).alias("score"), name.alias("name_match"))


def wiki_semantic(pages: DataFrame, query: list[float], category: str | None = None, text: str | None = None) -> DataFrame:
    """(path, score) of all pages, and with a text whether the name has it."""
    if category is not None:
        pages = pages.where(F.startswith("path", F.lit(category + "/")))
    named = [F.contains(F.lower("stem"), F.lit(text.lower())).alias("name_match")] if text is not None else []
    return pages.select("path", (1 - vectors.cosine_distance(F.col("embedding"), vectors.literal(query))).alias("score"), *named)


def wiki_hybrid(keyword: DataFrame, semantic: DataFrame, k: int = K) -> DataFrame:
    """Fusion of both lists, ranked by score and then path."""
    return rrf({"keyword": keyword.select("path", "score"), "semantic": semantic.select("path", "score")}, ("path",), k)


def related_mix(sessions: DataFrame, neighbors: DataFrame, session_id: str, each: int = 5, limit: int = 10) -> DataFrame:
    """(id, origin): at most 5 graph neighbours, 5 of the same project and 5 of the same first tag."""
    me = sessions.where(F.col("id") == session_id).select(F.col("project").alias("p"), F.get("tags", F.lit(0)).alias("t"))
    others = sessions.where(F.col("id") != session_id)
    newest = lambda d: d.orderBy(F.desc("start_time"), "id").limit(each).select("id")
    graph = neighbors.where(F.col("id") != session_id).select("id").orderBy("id").limit(each)
    project = newest(others.join(F.broadcast(me), F.col("project") == F.col("p")))  # `me` is one row
    tag = newest(others.join(F.broadcast(me), F.array_contains("tags", F.col("t"))))
    rows = graph.withColumn("o", F.lit(0)).union(project.withColumn("o", F.lit(1))).union(tag.withColumn("o", F.lit(2)))
    names = F.element_at(F.array(F.lit("graph"), F.lit("project"), F.lit("tag")), F.col("o") + 1)
    return rows.groupBy("id").agg(F.min("o").alias("o")).orderBy("o", "id").limit(limit).select("id", names.alias("origin"))
