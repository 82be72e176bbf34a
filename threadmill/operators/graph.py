"""The knowledge graph as two DataFrames: nodes (id, type, label, meta), edges (source, target,
relation, confidence, weight)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import text as X
from threadmill.storage import Scratch, materialize

RELATIONS = ("fixes_bug", "modifies_file", "introduces_tech", "discusses_topic")
SNAPSHOT_TYPES = ("project", "topic", "agent", "tool")


def _edge(source: Column, target: Column, relation: str, confidence: str, weight: float) -> list[Column]:
    return [source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.lit(weight).alias("weight")]


def _session(c: str = "id") -> Column:
    return F.concat(F.lit("session:"), F.col(c))


def _named(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), c)


def base_nodes(sessions: DataFrame) -> DataFrame:
    """Sessions, and the distinct projects, agents and tools they name; one pass over the sessions."""
    meta = F.to_json(F.struct(F.date_format("start_time", "yyyy-MM-dd").alias("date"), F.col("turn_count").alias("turns"), "summary"))
    node = lambda kind, label, about: F.struct(F.concat(F.lit(f"{kind}:"), label).alias("id"), F.lit(kind).alias("type"), label.alias("label"), about.alias("meta"))
    none = F.lit(None).cast("string")
    own = F.struct(_session().alias("id"), F.lit("session").alias("type"), F.substring("id", 1, 8).alias("label"), meta.alias("meta"))
    found = [F.array(own, node("project", F.col("project"), none), node("agent", F.col("agent"), none))]
    if "tools_used" in sessions.columns:
        found.append(F.coalesce(F.transform("tools_used", lambda t: node("tool", t, none)), F.array().cast("array<struct<id:string,type:string,label:string,meta:string>>")))
    nodes = sessions.select(F.explode(F.concat(*found)).alias("n")).select("n.*").where("label is not null and (type = 'session' or label != '')")
    return nodes.groupBy("id", "type", "label").agg(F.max("meta").alias("meta"))


_EDGE = "array<struct<source:string,target:string,relation:string,confidence:string,weight:double>>"


def base_edges(sessions: DataFrame) -> DataFrame:
    """Edges of sessions to their project, agent and tools; one pass over the sessions."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    to = lambda kind, label, relation: F.struct(*_edge(_session(), _named(kind, label), relation, "EXTRACTED", 1.0))
    found = [F.when(there(F.col(c)), F.array(to(c, F.col(c), r))).otherwise(F.array().cast(_EDGE)) for c, r in (("project", "belongs_to"), ("agent", "by_agent"))]
    if "tools_used" in sessions.columns:
        found.append(F.coalesce(F.transform(F.filter(F.array_distinct("tools_used"), there), lambda t: to("tool", t, "uses_tool")), F.array().cast(_EDGE)))
    return sessions.select(F.explode(F.concat(*found)).alias("e")).select("e.*")


def semantic_edges(sessions: DataFrame) -> DataFrame:
    """Rule-made edges of sessions (id, summary, body, cwd, tools_used): issues that the text says are
    fixed, and files edited where a tool that edits was used; one pass over the sessions."""
    text = F.concat_ws(" ", F.coalesce("summary", F.lit("")), "body")
    fixes = F.transform(X.issue_refs(text), lambda i: F.struct(*_edge(_session(), _named("issue", i), "fixes_bug", "INFERRED", 0.7)))
    edits = F.exists(F.coalesce("tools_used", F.array().cast("array<string>")), lambda t: F.lower(t).isin("edit", "write"))
    files = F.transform(X.edited_files(F.col("body"), F.col("cwd")), lambda f: F.struct(*_edge(_session(), _named("file", f), "modifies_file", "INFERRED", 0.9)))
    none = F.array().cast(_EDGE)
    return sessions.select(F.explode(F.concat(F.coalesce(fixes, none), F.when(edits, F.coalesce(files, none)).otherwise(none))).alias("e")).select("e.*")


def _following(sessions: DataFrame, group: Column, part: Column) -> DataFrame:
    """(id, next): each session and the next of its group by time and id. Sessions are put in order
    within parts of the group's time, and the parts' ends are then joined: no window holds a whole group,
    however large it is."""
    own = sessions.select("id", "start_time", group.alias("g"), part.alias("p")).where("g is not null")
    inside = own.select("id", F.lead("id").over(Window.partitionBy("g", "p").orderBy("start_time", "id")).alias("next")).where("next is not null")
    ends = own.groupBy("g", "p").agg(F.min_by("id", F.struct("start_time", "id")).alias("first"), F.max_by("id", F.struct("start_time", "id")).alias("id"))
    across = ends.select("id", F.lead("first").over(Window.partitionBy("g").orderBy("p")).alias("next")).where("next is not null")
    return inside.union(across)


def adjacency(sessions: DataFrame) -> DataFrame:
    """Each session and the next of its project, and the next of its day, by time and id. Projects are cut
    by days, days by minutes."""
    project = _following(sessions, F.when(F.col("project") != "", F.col("project")), F.to_date("start_time"))
    day = _following(sessions, F.to_date("start_time"), F.date_trunc("minute", "start_time"))
    return project.select(*_edge(_session(), _session("next"), "same_project", "EXTRACTED", 1.0)).union(day.select(*_edge(_session(), _session("next"), "same_day", "EXTRACTED", 0.5)))


def upsert_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes replace stored ones of their id; of several new ones, the greatest."""
    last = new.groupBy("id").agg(F.max(F.struct("type", "label", "meta")).alias("x")).select("id", "x.*")
    return stored.join(last, "id", "left_anti").unionByName(last.select(*stored.columns))


def upsert_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored edges stay; new ones are added where (source, target, relation) isn't stored; of several
    new ones, that with the greatest weight."""
    key = ["source", "target", "relation"]
    first = new.groupBy(*key).agg(F.max_by(F.struct("confidence", "weight"), F.struct("weight", "confidence")).alias("x")).select(*key, "x.*")
    return stored.unionByName(first.join(stored.select(*key), key, "left_anti").select(*stored.columns))


def build(sessions: DataFrame, stored_nodes: DataFrame | None = None, stored_edges: DataFrame | None = None, since: Column | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with sessions that aren't there yet added (all with `force`); `since` limits
    what is added, but adjacency is made anew over all sessions. What the new sessions give is written to
    the shared folder once and read by both results."""
    new = sessions if since is None else sessions.where(F.col("start_time") >= since)
    if stored_nodes is not None and not force:
        new = new.join(stored_nodes.where("type = 'session'").select(F.expr("substring(id, 9)").alias("id")), "id", "left_anti")
    new = materialize(new.select(*[c for c in ("id", "project", "agent", "start_time", "turn_count", "summary", "tools_used", "body", "cwd") if c in new.columns]), "new_sessions")
    nodes, edges = extract(new)
    if stored_nodes is not None:
        nodes = upsert_nodes(stored_nodes, nodes)
    if stored_edges is not None:
        edges = upsert_edges(stored_edges.where(~F.col("relation").isin("same_project", "same_day")), edges)
    return nodes, edges.unionByName(adjacency(sessions))


def extract(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that the sessions give by themselves (without neighbours in time)."""
    nodes, edges = base_nodes(sessions), base_edges(sessions)
    if "body" in sessions.columns:
        rules = semantic_edges(sessions)
        edges = edges.union(rules)
        nodes = nodes.unionByName(target_nodes(rules))
    return nodes, edges


def extract_incremental(new: DataFrame, sessions: DataFrame, stored_nodes: DataFrame, stored_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the sessions of `new` built anew: what was stored of them goes, and neighbours
    in time are made again only for the projects and days that they touch. `sessions` are all of them,
    the new ones among them."""
    ids = new.select(_session().alias("node"))
    nodes, edges = extract(new)
    days = new.select(F.to_date("start_time").alias("d")).where("d is not null").distinct()
    names = new.where("project != ''").select("project").distinct()
    own = adjacency(sessions)
    in_day = sessions.join(days, F.to_date("start_time") == F.col("d"), "left_semi").select(_session().alias("source"))
    in_project = sessions.join(names, "project", "left_semi").select(_session().alias("source"))
    touched = in_day.select("source", F.lit("same_day").alias("relation")).union(in_project.select("source", F.lit("same_project").alias("relation"))).distinct()
    kept = stored_edges.join(touched, ["source", "relation"], "left_anti")
    kept = kept.join(ids.select(F.col("node").alias("source")), "source", "left_anti").select(*stored_edges.columns)
    again = own.join(touched, ["source", "relation"], "left_semi").select(*stored_edges.columns)
    return upsert_nodes(stored_nodes, nodes), upsert_edges(kept, edges).unionByName(again)


def target_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of the targets: type before the first colon, label after it."""
    at = edges.select(F.col("target").alias("id")).distinct()
    return at.select("id", F.substring_index("id", ":", 1).alias("type"), F.expr("substring(id, locate(':', id) + 1)").alias("label"), F.lit(None).cast("string").alias("meta"))


def neighbors(edges: DataFrame) -> DataFrame:
    """(id, other, relation, direction): every edge seen from both its ends, in one pass."""
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("other"), "relation", F.lit("out").alias("direction")),
        F.struct(F.col("target").alias("id"), F.col("source").alias("other"), "relation", F.lit("in").alias("direction")),
    )
    return edges.select(F.explode(ends).alias("e")).select("e.*")


HOPS = 3


def related_sessions(edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int | None = None, via_hubs: bool = False) -> DataFrame:
    """(session_id, relation, hop): sessions within 1 to 3 hops of `seeds` (session_id) over edges
    between sessions (any edges with `via_hubs`), at their least hop, seeds left out. The relation is
    the first by name of those that lead there.

    Edges seen from both ends are written once; a hop joins them with the frontier, takes out what was
    seen, and writes what it reached, so that each hop reads the edges once and the plan doesn't grow
    with the hops. Spark knows the size of a written frontier and broadcasts it only if it is small."""
    scratch = Scratch(edges.sparkSession)
    both = neighbors(edges).select("id", "other", "relation")
    if not via_hubs:
        both = both.where(F.startswith("id", F.lit("session:")) & F.startswith("other", F.lit("session:")))
    both = scratch.table(both, "both")
    walk = scratch.table(seeds.select(_session("session_id").alias("id")).distinct(), "seeds")
    seen, found = walk, None
    for hop in range(1, min(HOPS, max(1, hops)) + 1):
        step = both.join(walk, "id", "left_semi").join(seen.select(F.col("id").alias("other")), "other", "left_anti")
        step = step.groupBy(F.col("other").alias("id")).agg(F.min("relation").alias("relation")).withColumn("hop", F.lit(hop))
        step = materialize(step, "hop")
        found = step if found is None else found.unionByName(step)
        walk, seen = step.select("id"), seen.union(step.select("id"))
    out = found.where(F.startswith("id", F.lit("session:"))).select(F.expr("substring(id, 9)").alias("session_id"), "relation", "hop")
    scratch.clear()
    return out.orderBy("hop", "relation", "session_id").limit(limit) if limit is not None else out


def query(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 1, relation: str | None = None) -> DataFrame:
    """(node_id, relation, direction, type, label): the neighbours met within 1 to 3 hops, as often as
    edges lead to them, the start among them; `relation` holds at every hop. A hop reads the edges and
    writes what it reached, whose size Spark then knows: edges are shuffled only where a frontier is too
    large to broadcast, and are never written again. One join then gives the edges of them all."""
    both = neighbors(edges if relation is None else edges.where(F.col("relation") == relation))
    walk = seen = edges.sparkSession.range(1).select(F.lit(node_id).alias("id"))  # of a size that Spark knows, unlike local rows
    for _ in range(1, min(HOPS, max(1, depth))):
        walk = both.join(walk, "id", "left_semi").select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti")
        walk = materialize(walk, "hop")
        seen = seen.union(walk)
    found = both.join(seen, "id", "left_semi")
    return found.select(F.col("other").alias("node_id"), "relation", "direction").join(nodes.select(F.col("id").alias("node_id"), "type", "label"), "node_id", "left")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges that touch a node; a loop counts once. One pass."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def snapshot(nodes: DataFrame, edges: DataFrame, session_limit: int = 100, edge_limit: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes shown (all of the hub types, sessions of greatest degree), edges among them (sessions with
    each other first, then with topics and tools, then with agents and projects), and the one-row counts."""
    session_limit, edge_limit = min(500, max(10, session_limit)), min(5000, max(50, edge_limit))
    # who is shown is written once; the edges among them are then one join for each end
    top = nodes.where("type = 'session'").join(degrees(edges), "id", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "id").limit(session_limit)
    shown = materialize(nodes.where(F.col("type").isin(*SNAPSHOT_TYPES)).select("id", "type", "label").unionByName(top.select("id", "type", "label")), "shown")
    s = shown.select(F.col("id").alias("source"), F.col("type").alias("s_type"))
    t = shown.select(F.col("id").alias("target"), F.col("type").alias("t_type"))
    inside = edges.select("source", "target", "relation").join(s, "source").join(t, "target")
    other = F.when(F.col("s_type") == "session", F.col("t_type")).otherwise(F.col("s_type"))
    touches = (F.col("s_type") == "session") | (F.col("t_type") == "session")
    rank = F.when((F.col("s_type") == "session") & (F.col("t_type") == "session"), 0).when(touches & other.isin("topic", "tool"), 1).when(touches & other.isin("agent", "project"), 2).otherwise(3)
    ranked = inside.withColumn("priority", rank)
    kept = ranked.orderBy("priority", "source", "target", "relation").limit(edge_limit)
    counts = ranked.agg(F.count("*").alias("total_edges_in_set"), (F.count("*") > edge_limit).alias("edges_truncated"))
    return shown, kept, counts


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): totals (null name) and counts by node type and by relation."""
    n = nodes.rollup("type").agg(F.count("*").alias("n"), F.grouping("type").alias("g")).select(F.lit("node").alias("kind"), F.when(F.col("g") == 0, F.col("type")).alias("name"), "n")
    e = edges.rollup("relation").agg(F.count("*").alias("n"), F.grouping("relation").alias("g")).select(F.lit("edge").alias("kind"), F.when(F.col("g") == 0, F.col("relation")).alias("name"), "n")
    return n.union(e)


def filter_sessions(nodes: DataFrame, edges: DataFrame, prefix: str, label: str, relation: str | None = None) -> DataFrame:
    """(session_id): sessions that touch a node of the prefix whose label holds `label`, case ignored;
    where no label does, nodes whose id does."""
    own = nodes.where(F.startswith("id", F.lit(prefix + ":")))
    by_label = own.where(F.contains(F.lower("label"), F.lit(label.lower()))).select("id")
    none = by_label.limit(1).agg((F.count("*") == 0).alias("none"))
    by_id = own.where(F.contains(F.lower("id"), F.lit(label.lower()))).select("id").join(F.broadcast(none), F.col("none")).select("id")  # one row
    both = neighbors(edges if relation is None else edges.where(F.col("relation") == relation))
    hit = both.join(by_label.union(by_id).distinct(), "id", "left_semi").where(F.startswith("other", F.lit("session:")))
    return hit.select(F.expr("substring(other, 9)").alias("session_id")).distinct()


def graph_filter(nodes: DataFrame, edges: DataFrame, topic: str | None = None, file: str | None = None, issue: str | None = None) -> DataFrame | None:
    """The first of topic, file and issue that is given; None where none is."""
    for value, prefix, relation in ((topic, "topic", None), (file, "file", "modifies_file"), (issue, "issue", "fixes_bug")):
        if value is not None:
            return filter_sessions(nodes, edges, prefix, value, relation)
    return None


SEMANTIC = 'Name what the session fixed, changed, introduced and discussed, as JSON: {"edges": [{"relation", "target_type", "target_label"}]}.'
LLM_WEIGHTS = {"fixes_bug": 0.8, "modifies_file": 0.9, "introduces_tech": 0.6, "discusses_topic": 0.5}


def llm_edges(answers: DataFrame) -> DataFrame:
    """Edges of model answers (session_id, answer): JSON, fenced or not; relations that aren't known
    and empty labels are dropped, answers that don't parse give none."""
    schema = "edges array<struct<relation:string,target_type:string,target_label:string>>"
    one = answers.select("session_id", F.explode(F.from_json(X.json_block(F.col("answer")), schema)["edges"]).alias("e"))
    ok = one.where(F.col("e.relation").isin(*RELATIONS) & (F.coalesce(F.col("e.target_label"), F.lit("")) != ""))
    weights = F.create_map(*[F.lit(x) for kv in LLM_WEIGHTS.items() for x in kv])
    return ok.select(_session("session_id").alias("source"), F.concat("e.target_type", F.lit(":"), "e.target_label").alias("target"), F.col("e.relation").alias("relation"), F.lit("LLM").alias("confidence"), weights[F.col("e.relation")].alias("weight"))


def merge_rule_and_llm(rules: DataFrame, llm: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges to store, a rule's before a model's, and the one-row count of those that are new."""
    key = ["source", "target", "relation"]
    both = rules.withColumn("o", F.lit(0)).unionByName(llm.withColumn("o", F.lit(1)))
    first = both.groupBy(*key).agg(F.min_by(F.struct("confidence", "weight"), F.struct("o", -F.col("weight"))).alias("x")).select(*key, "x.*")
    new = first.join(stored.select(*key), key, "left_anti")
    return new, new.agg(F.count("*").alias("stored"))


def user_content(summary: Column, body: Column, limit: int = 8000) -> Column:
    """What a model is asked about: the summary and the body up to `limit` bytes, whole characters."""
    return F.concat_ws("\n\n", summary, X.truncate_bytes(body, limit))


def ask_semantic(sessions: DataFrame, backend: Callable[[str, str], str], limit: int | None = None, delay: float = 0.0, cancelled: Callable[[], bool] = lambda: False) -> tuple[DataFrame, DataFrame]:
    """Asks a language model for the edges of sessions (id, summary, body, vault_path) that have a vault
    path, the newest `limit` of them if that is given: (edges, outcomes). A session without text is
    skipped, one whose answer doesn't parse or whose call fails has failed, the others are ok. `cancelled`
    is asked on the executors before each call; sessions after a cancel are skipped. `delay` seconds pass
    between calls of a task. Answers are written once, so no call is made twice."""
    own = sessions.where("vault_path is not null")
    if limit is not None:
        own = own.orderBy(F.desc("start_time"), "id").limit(limit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, text in zip(pdf["id"], pdf["content"], strict=True):
                if not (text or "").strip() or cancelled():
                    rows.append((i, None, "skipped"))
                    continue
                try:
                    rows.append((i, backend(SEMANTIC, text), "ok"))
                except Exception:  # noqa: BLE001 - the model is the caller's; the outcome tells
                    rows.append((i, None, "failed"))
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=["id", "answer", "outcome"])

    asked = own.select("id", user_content(F.col("summary"), F.col("body")).alias("content")).mapInPandas(run, "id string, answer string, outcome string")
    asked = materialize(asked, "answers")
    parsed = F.from_json(X.json_block(F.col("answer")), "edges array<struct<relation:string>>")["edges"]
    outcome = F.when((F.col("outcome") == "ok") & parsed.isNull(), "failed").otherwise(F.col("outcome"))
    return llm_edges(asked.select(F.col("id").alias("session_id"), "answer")), asked.select("id", outcome.alias("outcome"))


def rebuild(chosen: DataFrame, sessions: DataFrame, stored_nodes: DataFrame, stored_edges: DataFrame, backend: Callable[[str, str], str], at: Column, cancelled: Callable[[], bool] = lambda: False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, sessions, outcomes) with the chosen sessions' rule-made and model-made edges made
    anew. Edges of sessions that failed or were skipped stay as they were, and only those that went well
    get the time `at`."""
    llm, outcomes = ask_semantic(chosen, backend, cancelled=cancelled)
    good = outcomes.where("outcome = 'ok'").select("id")
    nodes, edges = extract_incremental(chosen.join(good, "id", "left_semi"), sessions, stored_nodes, stored_edges)
    own = llm.join(good.select(_session().alias("source")), "source", "left_semi")
    edges = upsert_edges(edges, own.select(*edges.columns))
    nodes = upsert_nodes(nodes, target_nodes(own))
    hit = sessions.join(good.withColumn("hit", F.lit(True)), "id", "left")
    stamped = hit.withColumn("semantic_extracted_at", F.when(F.col("hit"), at).otherwise(F.col("semantic_extracted_at"))).select(*sessions.columns)
    return nodes, edges, stamped, outcomes


def delete_session(nodes: DataFrame, edges: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    own = f"session:{session_id}"
    return nodes.where(F.col("id") != own), edges.where((F.col("source") != own) & (F.col("target") != own))


def delete_relations(edges: DataFrame, *relations: str) -> DataFrame:
    return edges.where(~F.col("relation").isin(*relations))


def list_nodes(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    return (nodes if kind is None else nodes.where(F.col("type") == kind)).orderBy("id")


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of node-link JSON, for graphs that fit in one value."""
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("id", "type", "label"))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct("source", "target", "relation", "confidence", "weight"))).alias("links"))
    return n.crossJoin(F.broadcast(e)).select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links")).alias("json"))
