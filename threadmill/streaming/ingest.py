"""Ingest as batch and as stream: both run the same function on each batch of files.

A batch is one transaction over all tables. Turns, postings and chunks to embed are appended with the
number of the batch; a session's row is appended anew, and its newest row counts. The row says from which
batch on the session's turns count, so a session that is built anew needs nothing deleted. Rows lie in
BUCKETS folders by the session's hash; a batch reads the session rows of its own buckets and no turns,
so its cost doesn't depend on how many are stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadmill.functions import markdown
from threadmill.functions import text as X
from threadmill.operators import bm25, graph
from threadmill.operators import filters as P
from threadmill.operators import sessions as S
from threadmill.operators import vectors as V
from threadmill.sources import transcripts, vault
from threadmill.storage import Scratch, hadoop
from threadmill.streaming.store import Store

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
BUCKETS = 64
KEPT = ("tags", "session_type", "is_favorite", "is_archived", "archived_at", "summary", "start_time", "agent", "project", "cwd")


@dataclass
class Rules:
    """What ingest leaves out, how it sorts sessions, and what it does besides: the folder of the vault,
    and a script to run for each session."""

    classify: list[S.Rule] = field(default_factory=list)
    summary_prompt: str = "Summarize this session"
    wiki_marker: str = "<!-- wiki run -->"
    skip_embedding: tuple[str, ...] = ("automated",)
    vault: str | None = None
    hook: str | None = None
    hook_timeout: float = 30


def _bucket(session_id: str) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int").alias("bucket")


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Rows of a bucket together, so that the files of a batch are as many as buckets and not as buckets
    times tasks; a bucket that is too large for a task is dealt to several."""
    return rows.hint("rebalance", F.col("bucket"))


def sessions_of(store: Store, buckets: list[int] | None = None) -> DataFrame:
    """The newest row of each session; of some buckets only, if they are given."""
    rows = store.read("sessions")
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    fields = [c for c in rows.columns if c not in ("id", "bucket", "seq")]
    newest = rows.groupBy("id", "bucket").agg(F.max_by(F.struct("seq", *fields), "seq").alias("x"))
    return newest.select("id", "bucket", "x.*")


def _counting(store: Store, name: str) -> DataFrame:
    """Rows of a table that count: none that was written before the session was last built anew."""
    since = sessions_of(store).select(F.col("id").alias("session_id"), "bucket", "since")
    return store.read(name).join(since, ["bucket", "session_id"]).where("seq >= since").drop("bucket", "since", "seq")


def turns_of(store: Store) -> DataFrame:
    return _counting(store, "turns")


def index_of(store: Store) -> bm25.Index:
    """The full-text index over the turns that count."""
    return bm25.Index(_counting(store, "postings"), _counting(store, "docs"))


def pending_of(store: Store, model: str) -> DataFrame:
    """Chunks (session_id, turn_index, seq, text) that are queued and have no vector of the model."""
    if not store.exists("queue"):
        return store.spark.createDataFrame([], "session_id string, turn_index int, seq int, text string")
    queued = _counting(store, "queue").withColumnRenamed("chunk", "seq")
    return V.pending(queued, store.read("vectors"), model) if store.exists("vectors") else queued


def embed_pending(store: Store, embedder: Callable[[list[str]], list[list[float]]], model: str) -> int:
    """Makes the vectors that are missing and appends them; returns their number."""
    with store.transaction() as t:
        return t.append("vectors", V.embed(pending_of(store, model), embedder, model)).count()


def _with_hook(plan: DataFrame, rules: Rules) -> DataFrame:
    """Adds whether the script went well for each session that was ingested, null where it wasn't run; it
    runs on the executors. Lazy: the log's write runs it."""
    script, timeout = rules.hook, rules.hook_timeout
    if script is None:
        return plan.withColumn("hook", F.lit(None).cast("boolean"))
    columns = plan.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            told = [None if r["action"] not in ("new", "incremental", "rebuild") else vault.run_hook(script, {k: r[k] for k in ("session_id", "agent", "project", "vault_path", "turns", "date")}, timeout) for _, r in pdf.fillna("").iterrows()]
            yield pdf.assign(hook=pd.Series(told, index=pdf.index, dtype=object))

    return plan.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plan.schema.fields) + ", hook boolean").select(*columns, "hook")


def ingest_batch(store: Store, files: DataFrame, rules: Rules | None = None, done: Callable[[DataFrame], None] | None = None, token: str | None = None) -> None:
    """Parses files (path, content) and brings all tables up to date: sessions, turns, postings and docs
    of the full-text index, queue of chunks to embed, ingest_log; and the vault, if the rules name one.

    A session of an append-only agent gains the turns it lacks; one that can't have grown so is built
    anew. Running a batch twice changes nothing but the log, and with a token not even that. A run that
    is broken off before its end leaves all tables as they were.
    """
    rules = rules or Rules()
    if token is not None and store.done(token):
        return
    scratch = Scratch(store.spark)
    seq = store.manifest()[0] + 1
    parsed = transcripts.parse_all(files).where("error is null and id is not null").dropDuplicates(["id"])
    first = F.get(F.filter("turns", lambda t: t["role"] == "user"), F.lit(0))["content"]
    side = (F.size("turns") > 0) & F.forall("turns", lambda t: F.coalesce(t["is_sidechain"], F.lit(False)))
    reason = P.skip_reason(F.col("cwd"), F.coalesce(first, F.lit("")), F.size("turns"), side, rules.summary_prompt, rules.wiki_marker)
    parsed = scratch.table(parsed.withColumn("skip", reason).withColumn("first_user", first), "parsed")
    fresh = parsed.where("skip is null")
    turns = transcripts.turns_of(fresh)
    aggregates = S.session_aggregates(turns).withColumnRenamed("session_id", "id")
    kind = S.classify(rules.classify, F.col("first_user"), F.col("project"))
    sessions = fresh.select("id", "agent", "model", "project", "cwd", "start_time", "end_time", kind.alias("session_type")).join(aggregates, "id")
    path = markdown.vault_path(F.col("start_time"), F.col("agent"), F.col("project"), F.col("id"))
    sessions = sessions.select(
        "id", "agent", "model", "project", "cwd", "start_time", "end_time", "turn_count", "tokens_in", "tokens_out", "tools_used", F.array().cast("array<string>").alias("tags"),
        "summary", "session_type", F.lit(False).alias("is_favorite"), F.lit(False).alias("is_archived"), F.lit(None).cast("timestamp").alias("archived_at"), path.alias("vault_path"), _bucket("id"),
    )
    sessions = scratch.table(sessions, "sessions")
    if store.exists("sessions"):
        buckets = [r[0] for r in sessions.select("bucket").distinct().collect()]  # at most BUCKETS
        old = sessions_of(store, buckets).join(sessions.select("id"), "id", "left_semi")
    else:
        old = sessions.limit(0).withColumns({"seq": F.lit(0).cast("bigint"), "since": F.lit(0).cast("bigint")})
    stored = old.select("id", F.col("turn_count").alias("stored"), F.col("since").alias("old_since"), *[F.col(c).alias(f"old_{c}") for c in KEPT])
    both = sessions.join(stored, "id", "left")
    action = F.when(F.col("stored").isNull(), "new").otherwise(S.decide_reingest(F.col("agent"), F.col("turn_count"), F.col("stored")))
    both = scratch.table(both.withColumn("action", action), "plan")
    changed = both.where("action != 'skip'")
    anew = F.col("action") != "incremental"
    since = F.when(anew, F.lit(seq).cast("bigint")).otherwise(F.col("old_since"))
    rows = changed.withColumns({c: F.when(F.col("stored").isNull(), F.col(c)).otherwise(F.col(f"old_{c}")) for c in KEPT})
    rows = rows.select(*sessions.columns, F.lit(seq).cast("bigint").alias("seq"), since.alias("since"))
    added = turns.join(changed.select(F.col("id").alias("session_id"), F.when(anew, F.lit(0)).otherwise(F.col("stored")).alias("from"), "bucket", "session_type"), "session_id")
    added = scratch.table(added.where("turn_index >= from").drop("from"), "added")
    stamp = lambda df: df.withColumn("seq", F.lit(seq).cast("bigint"))
    index = bm25.build(added, ("bucket", "session_id", "turn_index"), unique=True)  # a session's turns are numbered
    queue = V.chunks(added.where(~F.coalesce(F.col("session_type").isin(*rules.skip_embedding), F.lit(False)))).withColumnRenamed("seq", "chunk").withColumn("bucket", _bucket("session_id"))
    if rules.vault is not None:
        vault.write(markdown.render(changed.select(*sessions.columns), turns), rules.vault).count()
    log = both.select(F.col("id").alias("session_id"), "action", "agent", "project", "vault_path", F.col("turn_count").cast("string").alias("turns"), F.date_format("start_time", "yyyy-MM-dd").alias("date"))
    log = _with_hook(log, rules).select("session_id", "action", "hook")
    left_out = parsed.where("skip is not null").select(F.col("id").alias("session_id"), F.concat(F.lit("skipped: "), "skip").alias("action"), F.lit(None).cast("boolean").alias("hook"))
    with store.transaction(token) as t:
        t.append("turns", stamp(added.drop("session_type")).repartition("bucket"), ("bucket",))
        t.append("sessions", rows.repartition("bucket"), ("bucket",))
        t.append("postings", _by_bucket(stamp(index.postings)), ("bucket",))
        t.append("docs", _by_bucket(stamp(index.docs)), ("bucket",))
        t.append("queue", _by_bucket(stamp(queue)), ("bucket",))
        t.append("ingest_log", log.unionByName(left_out).withColumn("at", F.current_timestamp()))
    if done is not None:
        done(both.select("id", "action"))
    scratch.clear()


def compact(store: Store) -> None:
    """Rewrites sessions and what hangs on them without rows that no longer count."""
    with store.transaction() as t:
        for name in ("turns", "postings", "docs", "queue"):
            if store.exists(name):
                since = sessions_of(store).select(F.col("id").alias("session_id"), "bucket", "since")
                t.replace(name, store.read(name).join(since, ["bucket", "session_id"]).where("seq >= since").drop("since").repartition("bucket"), ("bucket",))
        t.replace("sessions", sessions_of(store).repartition("bucket"), ("bucket",))


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, rules: Rules | None = None, glob: str = "*.jsonl", available_now: bool = True) -> StreamingQuery:
    """Watches a folder; each batch of new files goes through ingest_batch(). A batch that a restart
    repeats is known by its number."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)

    def each(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            ingest_batch(store, df, rules, token=f"{checkpoint}#{number}")

    out = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="10 seconds")).start()


def update_graph(store: Store) -> int:
    """Brings nodes and edges up to date with the sessions; returns the number of edges."""
    own = sessions_of(store)
    stored = (store.read("nodes"), store.read("edges")) if store.exists("nodes") else (None, None)
    nodes, edges = graph.build(own, *stored)
    with store.transaction() as t:
        t.replace("nodes", nodes)
        return t.replace("edges", edges).count()


def reindex(store: Store, root: str) -> int:
    """Takes up sessions of the vault that aren't stored, and brings archive state and turn counts of the
    others in line with it; returns the number of session rows written. A session taken from the vault is
    indexed by its whole body, at turn 0."""
    fs, at = hadoop(store.spark, root)
    if not fs.exists(at):
        return 0
    files = vault.read(store.spark, root)
    found, turns = vault.reindex(files)
    seq = F.lit(store.manifest()[0] + 1).cast("bigint")
    stored = sessions_of(store) if store.exists("sessions") else None
    new, changed = vault.against(found, stored)
    rows = new.select(
        "id", "agent", "model", "project", "cwd", "start_time", F.try_to_timestamp("end_time").alias("end_time"), F.coalesce(F.col("turns"), F.lit(0)).cast("bigint").alias("turn_count"), F.lit(0).cast("bigint").alias("tokens_in"),
        F.lit(0).cast("bigint").alias("tokens_out"), "tools_used", "tags", "summary", F.coalesce("session_type", F.lit("interactive")).alias("session_type"), F.lit(False).alias("is_favorite"),
        F.coalesce("archived", F.lit(False)).alias("is_archived"), "archived_at", "vault_path", _bucket("id"), seq.alias("seq"), seq.alias("since"),
    )
    if changed is not None:
        rows = rows.unionByName(changed.withColumn("seq", seq).select(*rows.columns))
    taken = new.select(F.col("id").alias("session_id"), _bucket("id"))
    own = turns.join(taken, "session_id").withColumn("seq", seq)
    bodies = files.select("path", X.body(F.col("markdown")).alias("content")).join(new.select(F.col("vault_path").alias("path"), F.col("id").alias("session_id"), _bucket("id")), "path")
    bodies = bodies.where("trim(content) != ''").select("bucket", "session_id", F.lit(0).alias("turn_index"), "content")
    index = bm25.build(bodies, ("bucket", "session_id", "turn_index"))
    with store.transaction() as t:
        n = t.append("sessions", rows, ("bucket",)).count()
        t.append("turns", own, ("bucket",))
        t.append("postings", index.postings.withColumn("seq", seq), ("bucket",))
        t.append("docs", index.docs.withColumn("seq", seq), ("bucket",))
    return n


FINAL = ("completed", "failed", "interrupted")


def job_states(events: DataFrame, evict_s: int = 300) -> DataFrame:
    """(job_id, status, n_events) after each batch of job events (job_id, seq, status), kept as state.
    A job that ended stays so; a finished job is forgotten after `evict_s` seconds without events."""

    def step(key: tuple, frames, state: GroupState):  # noqa: ANN001, ANN202
        if state.hasTimedOut:
            state.remove()
            return
        status, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for s in rows["status"]:
            status = status if status in FINAL else s
        n += len(rows)
        state.update((status, n))
        if status in FINAL:
            state.setTimeoutDuration(evict_s * 1000)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "n_events": [n]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id bigint, status string, n_events bigint", "status string, n bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by window and type with a watermark; an extension, the model has no windows of its own."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


PHASES = ("init", "pull", "reindex", "ingest", "wiki", "graph", "push")


def sync_phases(store: Store, files: Callable[[], DataFrame], rules: Rules | None = None, pull: Callable[[], int] | None = None, wiki: Callable[[], int] | None = None, push: Callable[[], int] | None = None) -> list[tuple[str, Callable[[], int]]]:
    """The phases of a sync in order, for run_phases(). What goes over a network, and what asks a language
    model, is the caller's; without it the phase does nothing."""
    rules, nothing = rules or Rules(), lambda: 0

    def take() -> int:
        before = store.read("ingest_log").count() if store.exists("ingest_log") else 0
        ingest_batch(store, files(), rules)
        return store.read("ingest_log").count() - before

    own = {
        "init": lambda: store.manifest()[0], "pull": pull or nothing, "reindex": (lambda: reindex(store, rules.vault)) if rules.vault is not None else nothing, "ingest": take,
        "wiki": wiki or nothing, "graph": lambda: update_graph(store), "push": push or nothing,
    }
    return [(name, own[name]) for name in PHASES]


def run_phases(phases: list[tuple[str, Callable[[], int]]], cancelled: Callable[[], bool] = lambda: False, told_to: Callable[[str, int], None] | None = None) -> list[dict[str, object]]:
    """Runs the phases of a sync in order and tells what each did; a cancel counts between phases. Each
    outcome also goes to `told_to`, as (phase and outcome, number), if that is given."""
    told: list[dict[str, object]] = []

    def tell(name: str, outcome: str, n: int | None) -> None:
        told.append({"phase": name, "outcome": outcome, "n": n})
        if told_to is not None:
            told_to(f"{name}: {outcome}", n or 0)

    for name, phase in phases:
        if cancelled():
            tell(name, "cancelled", None)
            break
        try:
            tell(name, "done", phase())
        except Exception as e:  # noqa: BLE001 - told to the caller; later phases need this one
            tell(name, f"failed: {e}"[:200], None)
            break
    return told
