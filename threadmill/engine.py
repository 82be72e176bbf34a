"""One object over the tables: search, sessions, graph, reports and checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import text as X
from threadmill.functions.plugins import LlmBackend, embed_query
from threadmill.model import ListFilter, QueryItem, SearchFilters
from threadmill.operators import bm25, fusion, graph, lint, reports
from threadmill.operators import filters as P
from threadmill.operators import sessions as S
from threadmill.operators import vectors as V

TOOLS = ("recall", "get", "status", "wiki_search", "graph_query")


@dataclass
class Engine:
    """The tables, and what to embed queries with. Nothing is read before a method is called."""

    spark: SparkSession
    sessions: DataFrame
    turns: DataFrame
    vectors: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    pages: DataFrame | None = None
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    index: bm25.Index | None = None
    denied: tuple[str, ...] = field(default=())
    expander: LlmBackend | None = None
    query_cache: DataFrame | None = None
    files: DataFrame | None = None
    log: DataFrame | None = None
    wiki: DataFrame | None = None
    vault: str = ""

    def __post_init__(self) -> None:
        unknown = set(self.denied) - set(TOOLS)
        if unknown:
            raise ValueError(f"unknown tools {sorted(unknown)}")
        self.index = self.index or bm25.build(self.turns)

    def _may(self, tool: str) -> None:
        if tool in self.denied:
            raise PermissionError(tool)

    def _vector(self, text: str) -> list[float] | None:
        return embed_query(self.embedder, text) if self.embedder is not None and self.vectors is not None else None

    def recall(self, query: str | list[QueryItem], limit: int | None = None, filters: SearchFilters | None = None, since: str | None = None, topic: str | None = None, file: str | None = None, issue: str | None = None, now: datetime | None = None, expand: bool = False) -> DataFrame:
        """The best turns for a text or for several items; both searches are used where they can be. With
        `expand`, texts gain the words of the language model, and any of the words is enough then."""
        self._may("recall")
        limit, filters = P.list_clamp(limit, 10, 1, 50), filters or SearchFilters()
        items = [QueryItem("hybrid", query)] if isinstance(query, str) else list(query)
        if expand and self.expander is not None:
            items = [QueryItem(i.kind, self._expanded(i.text, now or datetime.now()) if i.kind in ("hybrid", "keyword") else i.text, i.vector) for i in items]
        words = [since] if since else []
        words += [i.text for i in items if i.kind == "temporal"]
        for word in words:
            t = P.temporal(word, now or datetime.now())
            if t is not None:
                filters.since, filters.until = t.since, t.until
        if self.edges is not None and self.nodes is not None:
            allowed = graph.graph_filter(self.nodes, self.edges, topic, file, issue)
            filters.allowlist = allowed if allowed is not None else filters.allowlist
        items = [QueryItem(i.kind, i.text, i.vector or (self._vector(i.text) if i.kind in ("hybrid", "semantic") else None)) for i in items if i.kind != "temporal"]
        mode = "or" if expand and self.expander is not None else "and"
        if len(items) == 1 and items[0].kind == "hybrid":
            return fusion.hybrid(self.index, self.turns, self.sessions, self.vectors, items[0].text, items[0].vector, limit, filters, mode)
        return fusion.recall(items, self.index, self.turns, self.sessions, self.vectors, limit, filters, mode)

    def _expanded(self, text: str, now: datetime) -> str:
        cache = self.query_cache if self.query_cache is not None else self.spark.createDataFrame([], "query_hash bigint, original string, expanded string, created_at timestamp")
        whole, self.query_cache = bm25.expand(text, cache, self.expander, now)
        return whole

    def related(self, seeds: DataFrame, hops: int = 2, limit: int = 5) -> DataFrame:
        found = graph.related_sessions(self.edges, seeds, hops, limit)
        return found.join(self.sessions.select(F.col("id").alias("session_id"), "agent", "project", "start_time", "summary"), "session_id")

    def get(self, key: str, full: bool = False) -> DataFrame:
        """A session by `id` or `id:turn`."""
        self._may("get")
        at = X.split_id(F.lit(key))
        sid, turn = self.spark.range(1).select(at[0], at[1]).first()
        if turn is not None:
            return self.turns.where((F.col("session_id") == sid) & (F.col("turn_index") == turn))
        return S.detail(self.sessions.where(F.col("id") == sid), self.turns.where(F.col("session_id") == sid), full)

    def list(self, f: ListFilter) -> tuple[DataFrame, DataFrame]:
        return P.page(self.sessions, f)

    def status(self) -> DataFrame:
        self._may("status")
        return S.status(self.sessions, self.turns, self.vectors if self.vectors is not None else self.turns.limit(0))

    def wiki_search(self, query: str, mode: str = "hybrid", category: str | None = None) -> DataFrame:
        """Pages (path, stem, body, embedding) by keyword, semantic or both; keyword where no vector
        can be made."""
        self._may("wiki_search")
        words = fusion.wiki_keyword(self.pages, query)
        try:
            vector = self._vector(query) if mode != "keyword" else None
        except Exception:  # noqa: BLE001 - the embedder is the caller's; keywords go on without it
            vector = None
        if vector is None:
            return words.orderBy(F.desc("name_match"), F.desc("score"), "path")
        near = fusion.wiki_semantic(self.pages, vector, category, query)
        return near.orderBy(F.desc("score"), F.desc("name_match"), "path") if mode == "semantic" else fusion.wiki_hybrid(words, near).orderBy(F.desc("score"), "path")

    def graph_query(self, node_id: str, depth: int = 1, relation: str | None = None) -> DataFrame:
        self._may("graph_query")
        return graph.query(self.nodes, self.edges, node_id, depth, relation)

    def daily(self, day: str) -> DataFrame:
        topics = self.edges if self.edges is not None else self.spark.createDataFrame([], "source string, target string, relation string")
        return reports.daily(self.sessions, topics, day)

    def lint(self) -> DataFrame:
        """The findings of every check whose tables are there."""
        found = [lint.index_counts(self.turns, self.index.docs)]
        if self.vectors is not None:
            found += [lint.missing_embeddings(self.turns, self.vectors), lint.orphan_vectors(self.vectors, self.sessions)]
        if self.files is not None:
            found += [lint.vault_files(self.sessions, self.files), lint.orphan_files(self.files, self.sessions)]
        if self.log is not None:
            found.append(lint.duplicates(self.log))
        if self.wiki is not None:
            found += [lint.wiki_frontmatter(self.wiki), lint.dead_sources(self.wiki, self.sessions), lint.unreferenced(self.sessions, self.wiki)]
        if self.vault and "cwd" in self.sessions.columns:
            found.append(lint.wiki_invocations(self.sessions, self.vault))
        return lint.report(found)


SECRETS = ("api_key", "token", "password")


def mask_config(config: dict, secrets: tuple[str, ...] = SECRETS, environment: dict[str, str] | None = None) -> dict:
    """The config to show: values of secret keys (or keys that end in one) are masked, at any depth; with
    an environment, which of its secret variables are set is told, not what they hold."""
    hidden = lambda k: any(k == s or k.endswith("_" + s) for s in secrets)
    out = {k: "<masked>" if hidden(k) and v is not None else mask_config(v, secrets) if isinstance(v, dict) else v for k, v in config.items()}
    if environment is not None:
        out["env_indicators"] = {k: bool(v) for k, v in sorted(environment.items()) if hidden(k.lower())}
    return out


def merge_config(config: dict, patch: dict, secrets: tuple[str, ...] = SECRETS) -> dict:
    """A JSON merge patch; null removes a key, and secret keys aren't taken."""
    out = dict(config)
    for k, v in patch.items():
        if k in secrets:
            continue
        if v is None:
            out.pop(k, None)
        elif isinstance(v, dict):
            out[k] = merge_config(out[k] if isinstance(out.get(k), dict) else {}, v, secrets)
        else:
            out[k] = v
    return out
