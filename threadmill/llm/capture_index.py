"""A two-level index of web captures.

Captures are written as WARC records, each compressed by itself, in one file for each task. Their index
lines are sorted by a key that has the host's labels reversed, so that a domain's pages stand together,
and written in blocks of LINES, each compressed by itself, one file for each range of keys. The sparse
directory has one entry for each block: its first and last key, file, offset and length. A lookup finds
its blocks by binary search in the directory, reads just those byte ranges, and finds its lines by
binary search in the block; a line has the byte range of its record, which fetch() reads.

The directory's top holds at most TOP entries, whatever the number of captures: every s-th block's
key. With s > 1 the entries between are found by an equi-join on the top entry.

Keys are kept in a form without tabs and line ends (stored_key), one for one with the keys themselves.
Sorting, directory, blocks and searches all use that form.
"""

from __future__ import annotations

import bisect
import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, file_system, materialize, only, shared_dir

LINES = 1000
TOP = 100_000
DIRECTORY = "file string, part int, block int, offset bigint, length bigint, first_key string, last_key string, n_lines int"
CARRIED = ("key", "captured", "id", "length", "digest")
FOUND = "key string, captured string, page_id bigint, length bigint, digest string, file string, at bigint, size bigint"


def url_key(url: Column) -> Column:
    """The sort key: lower case, without scheme, user, fragment, a leading www, usual port or closing
    slash, host labels reversed, query arguments sorted. Null for a null or blank url."""
    u = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_extract(u, "^([^/?]*)", 1), "^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, "[?](.*)$", 1)
    args = F.array_join(F.array_sort(F.split(query, "&")), "&")
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), args)))
    return F.when(F.length(F.trim(url)) > 0, key)


def stored_key(key: Column) -> Column:
    """The key without tabs and line ends; different keys stay different."""
    return F.replace(F.replace(F.replace(key, F.lit("%"), F.lit("%25")), F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0a"))


def _shown(stored: str) -> str:
    return stored.replace("%0a", "\n").replace("%09", "\t").replace("%25", "%")


def _record(url: str, at: str, body: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
    head += (f"WARC-Date: {at}\r\n" if at else "") + f"WARC-Target-URI: {' '.join(url.split())}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 3, mtime=0)


def _write_records(pages: DataFrame, path: str) -> DataFrame:
    """Writes each row (key, url, html, ...) as a record and gives it file, at and size of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        name, out, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            start, size = [], []
            for url, html, when in zip(batch.column("url"), batch.column("html"), batch.column("captured"), strict=True):
                raw = _record(url.as_py(), when.as_py(), (html.as_py() or "").encode())
                out.write(raw)
                start.append(at), size.append(len(raw))
                at += len(raw)
            kept = [batch.column(c) for c in CARRIED]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([name] * batch.num_rows), pa.array(start, pa.int64()), pa.array(size, pa.int64())], [*CARRIED, "file", "at", "size"])
        if out is not None:
            out.close()

    return pages.mapInArrow(run, ", ".join(f"{c} string" for c in CARRIED) + ", file string, at bigint, size bigint")


def build_index(pages: DataFrame, lines: int = LINES, path: str | None = None) -> tuple[str, DataFrame]:
    """Writes records and blocks under `path` (a new folder in the shared one by default) and returns it
    with the directory. A line has the key, the time of capture (`captured_at`, if there is such a
    column), the page_id (empty if null), the bytes of the html (0 if null), their digest, and file,
    offset and length of the record. Pages without url aren't indexed; repeated rows have a line each."""
    times = ("captured_at",) if pages.columns.count("captured_at") == 1 else ()
    own = only(pages, "page_id", "url", "html", *times)
    path = path or f"{shared_dir(pages.sparkSession)}/threadmill-index-{uuid.uuid4().hex}"
    file_system(path)[0].create_dir(file_system(path)[1], recursive=True)
    scratch = Scratch(pages.sparkSession)
    keyed = own.select(
        stored_key(url_key(F.col("url"))).alias("key"), (F.coalesce(F.col("captured_at").cast("string"), F.lit("")) if times else F.lit("")).alias("captured"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.octet_length("html"), F.lit(0)).cast("string").alias("length"), F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16).alias("digest"), "url", "html",
    ).where("key is not null")
    captures = scratch.table(_write_records(keyed, path), "captures")
    ranged = captures.repartitionByRange("key").sortWithinPartitions("key", "captured", F.col("id").try_cast("bigint"), "digest", "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.cdx.z"  # a task that runs again writes another file
        held: list[tuple[str, str]] = []
        rows: list[tuple] = []
        out = None
        at = 0

        def flush(n: int) -> None:
            nonlocal at
            raw = zlib.compress("\n".join(x for _, x in held[:n]).encode())
            out.write(raw)
            rows.append((name, part, len(rows), at, len(raw), held[0][0], held[n - 1][0], n))
            at += len(raw)
            del held[:n]

        for batch in batches:
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            columns = [batch.column(c).to_pylist() for c in (*CARRIED, "file", "at", "size")]
            held += [(line[0], "\t".join(map(str, line))) for line in zip(*columns, strict=True)]
            while len(held) >= lines:
                flush(lines)
        if held:
            flush(len(held))
        if out is not None:
            out.close()
            names = [x.split()[0] for x in DIRECTORY.split(", ")]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    directory = materialize(ranged.mapInArrow(run, DIRECTORY), "directory")
    scratch.clear()
    return path, directory


def _top(directory: DataFrame, most: int) -> tuple[DataFrame, int, list[str], list[str]]:
    """The directory with the number `top` of its entry above; s; first and last keys of the top."""
    counts = {r["part"]: r["n"] for r in directory.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one for each file
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    s = max(1, -(-total // most))
    spark = directory.sparkSession
    starts = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "part int, before bigint")
    numbered = directory.join(starts, "part").withColumn("top", F.floor((F.col("before") + F.col("block")) / s))
    ends = numbered.groupBy("top").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).orderBy("top").collect()  # at most `most`
    return numbered, s, [r["a"] for r in ends], [r["b"] for r in ends]


def lookup(keys: DataFrame, path: str, directory: DataFrame, most: int = TOP) -> DataFrame:
    """(key, captured, page_id, length, digest, file, at, size): every line whose key is among `keys`
    (key; null and repeated keys count as none and one). Keys that aren't in the index give no rows."""
    numbered, s, first, last = _top(directory, most)
    top = keys.sparkSession.sparkContext.broadcast((first, last))  # at most `most` keys each

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = top.value
        for batch in batches:
            ks, ts = [], []
            for k in batch.column("key").to_pylist():
                for t in range(bisect.bisect_left(b, k), bisect.bisect_right(a, k)):
                    ks.append(k), ts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(ts, pa.int64())], ["key", "top"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for batch in batches:
            for file, offset, length, wanted in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "wanted")), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    block = [x.split("\t") for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]
                own, rows = [x[0] for x in block], []
                for k in wanted:
                    for _, when, i, n, digest, record, start, size in block[bisect.bisect_left(own, k) : bisect.bisect_right(own, k)]:
                        rows.append((_shown(k), when, int(i) if i else None, int(n), digest, record, int(start), int(size)))
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    own = keys.select(stored_key(F.col("key")).alias("key")).where("key is not null").distinct().mapInArrow(place, "key string, top bigint")
    found = own.join(numbered, "top")
    if s > 1:
        found = found.where("first_key <= key and key <= last_key")
    blocks = found.groupBy("file", "offset", "length").agg(F.sort_array(F.collect_list("key")).alias("wanted"))
    return blocks.mapInArrow(read, FOUND)


def fetch(found: DataFrame, path: str) -> DataFrame:
    """(key, page_id, captured, html): the records of lookup()'s lines, each read by its byte range; those
    of a file by one task, in order. Null html comes back empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for batch in batches:
            body, name, f = [], None, None
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                if file != name:
                    name, f = file, fs.open_input_file(f"{root}/{file}")
                raw = gzip.decompress(f.read_at(size, at))
                body.append(raw[raw.index(b"\r\n\r\n") + 4 : -4].decode())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("page_id"), batch.column("captured"), pa.array(body, pa.string())], ["key", "page_id", "captured", "html"])

    return found.repartition("file").sortWithinPartitions("file", "at").mapInArrow(run, "key string, page_id bigint, captured string, html string")


def capture_lookup(pages: DataFrame, lines: int = LINES, most: int = TOP) -> DataFrame:
    """Indexes `pages` (page_id, url, html), then looks every url up in the index: (page_id, url_key,
    n_captures, n_versions, n_bytes, first_page_id), one row for each row of `pages`.

    A null or blank url has a null key and 0 captures. Null html has 0 bytes. A null page_id stays
    null and isn't a first_page_id; repeated rows are captures of their own, in order of time, id and
    digest. An empty table gives no rows. Long urls and pages are kept whole; other columns are ignored,
    whatever their names.
    """
    path, directory = build_index(pages, lines)
    asked = only(pages, "page_id", "url").select("page_id", url_key(F.col("url")).alias("url_key"))
    found = lookup(asked.select(F.col("url_key").alias("key")), path, directory, most)
    by_key = found.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("versions"), F.sum("length").alias("bytes"), F.min("page_id").alias("first"))
    zero = F.lit(0).cast("bigint")
    return asked.join(by_key, asked["url_key"] == by_key["key"], "left").select(
        F.col("page_id").cast("bigint").alias("page_id"), "url_key", F.coalesce("n", zero).alias("n_captures"), F.coalesce("versions", zero).alias("n_versions"), F.coalesce("bytes", zero).alias("n_bytes"), F.col("first").alias("first_page_id"),
    )
