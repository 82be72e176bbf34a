"""The vault: sessions as markdown files, written and read back."""

from __future__ import annotations

import os
import subprocess
import uuid
from datetime import date
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import markdown
from threadmill.sources.transcripts import hidden_folders
from threadmill.storage import file_system, qualified


def write(rendered: DataFrame, root: str) -> DataFrame:
    """Writes (path, markdown) below the root, each to a name of its own and then moved, so that no
    reader meets half a file; (path, bytes) of what was written. Lazy: an action runs it."""

    root = qualified(rendered.sparkSession, root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(root)
        made = set()
        for pdf in frames:
            sizes = []
            for path, text in zip(pdf["path"], pdf["markdown"], strict=True):
                target = f"{base}/{path}"
                if (folder := target.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as f:
                    f.write(text.encode())
                fs.move(part, target)
                sizes.append(len(text.encode()))
            yield pd.DataFrame({"path": pdf["path"], "bytes": sizes})

    return rendered.select("path", "markdown").mapInPandas(run, "path string, bytes bigint")


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path, markdown) of every markdown file below the root; path is relative to it."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text([root, *hidden_folders(root)], wholetext=True)
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # names come as in a url
    clean = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    return found.select(F.substring_index(plain, clean + "/", -1).alias("path"), F.col("value").alias("markdown"))


def reindex(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and turns of vault files (path, markdown); files without a session id are passed over."""
    f = markdown.session_fields(F.col("markdown"))
    sessions = files.select("path", "markdown", *[c.alias(n) for n, c in f.items()]).where("session_id is not null")
    sessions = sessions.withColumn("start_time", F.try_to_timestamp("start_time")).withColumn("summary", F.coalesce("summary", markdown.summary_of_body(F.col("markdown")))).withColumn("archived_at", F.try_to_timestamp("archived_at"))
    turns = markdown.parse_turns(sessions.select(F.col("session_id").alias("id"), "markdown")).withColumnRenamed("id", "session_id")
    return sessions.drop("markdown").withColumnRenamed("session_id", "id").withColumnRenamed("path", "vault_path"), turns


def missing_turns(found_sessions: DataFrame, found_turns: DataFrame, stored_sessions: DataFrame, stored_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions that aren't stored, and the turns of those that have fewer stored than the file says."""
    new = found_sessions.join(stored_sessions.select("id"), "id", "left_anti")
    have = stored_turns.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("have"))
    short = found_sessions.join(have, "id", "left").where(F.coalesce("have", F.lit(0)) < F.coalesce("turns", F.lit(0))).select(F.col("id").alias("session_id"))
    todo = found_turns.join(short, "session_id", "left_semi").join(stored_turns.select("session_id", "turn_index"), ["session_id", "turn_index"], "left_anti")
    return new, todo


def against(found: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Sessions of the vault that aren't stored; and the stored rows whose archive state or number of
    turns isn't the vault's, brought in line (None where nothing is stored)."""
    if stored is None:
        return found, None
    told = found.select("id", F.coalesce("archived", F.lit(False)).alias("a"), F.col("archived_at").alias("at"), F.coalesce(F.col("turns"), F.lit(0)).cast("bigint").alias("n"))
    both = stored.join(told, "id")
    off = (F.col("is_archived") != F.col("a")) | (F.col("turn_count") != F.col("n"))
    changed = both.where(off).withColumns({"is_archived": F.col("a"), "archived_at": F.col("at"), "turn_count": F.col("n")}).select(*stored.columns)
    return found.join(stored.select("id"), "id", "left_anti"), changed


def move_orphans(findings: DataFrame, root: str, day: date) -> DataFrame:
    """Moves the files of L002 findings to archive/orphan-<day>/ below the root, under their own paths:
    nothing is deleted. (path, moved) of each; one that has gone already isn't moved. Lazy."""
    root, to = qualified(findings.sparkSession, root), f"archive/orphan-{day.isoformat()}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(root)
        for pdf in frames:
            moved = []
            for path in pdf["path"]:
                try:
                    fs.create_dir(f"{base}/{to}/{path}".rsplit("/", 1)[0], recursive=True)
                    fs.move(f"{base}/{path}", f"{base}/{to}/{path}")
                    moved.append(True)
                except OSError:
                    moved.append(False)
            yield pd.DataFrame({"path": pdf["path"], "moved": moved})

    return findings.where("code = 'L002'").select(F.col("detail").alias("path")).mapInPandas(run, "path string, moved boolean")


def run_hook(script: str, session: dict[str, str], timeout: float = 30) -> bool:
    """Runs a script with the session's fields in its environment; a failure is told, not raised."""
    env = os.environ | {f"SESSION_{k.upper()}": str(v) for k, v in session.items()}
    try:
        return subprocess.run([script], env=env, timeout=timeout, check=False, capture_output=True).returncode == 0
    except (OSError, subprocess.TimeoutExpired):
        return False
