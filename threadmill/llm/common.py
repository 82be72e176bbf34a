"""Vectorised text kernels over Arrow buffers, and the shared-folder helper.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the
lower-cased text. All kernels work on slices of a batch of a few MB of text, so that memory does
not depend on the batch size; a document longer than a slice is a slice of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
U64 = np.uint64
np.seterr(over="ignore")  # hashes wrap around
GOLD = U64(0x9E3779B97F4A7C15)
_P = 0x5851F42D4C957F2D | 1
_tables: dict[str, np.ndarray] = {}

WORD_BYTE = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    WORD_BYTE[_c] = True
WORD_BYTE[128:] = True


def fmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain), on arrays."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x = x * U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


BYTE_CODE = fmix(np.arange(1, 257, dtype=U64) * GOLD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    have = _tables.get("pow")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 65536)
        inv = pow(_P, -1, 1 << 64)
        for name, base in (("pow", _P), ("inv", inv)):
            t = np.full(size, U64(base), dtype=U64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["pow"], _tables["inv"]


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch with about `limit` bytes of text each."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = (np.cumsum(lengths) - lengths) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offsets (nulls are empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of the documents' words among them."""
    m = WORD_BYTE[data]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    before[off[:-1][off[:-1] < len(m)]] = False
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    starts = np.flatnonzero(m & ~before)
    return starts, np.flatnonzero(m & ~after) + 1, np.searchsorted(starts, off)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every lower-cased word, and the documents' offsets in that array."""
    data, off = buffer_of(pc.utf8_lower(texts))
    st, en, woff = word_spans(data, off)
    if not len(st):
        return np.zeros(0, U64), woff
    pw, inv = _powers(len(data) + 1)
    h = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_CODE[data] * pw[: len(data)], out=h[1:])
    return fmix((h[en] - h[st]) * inv[st] + (en - st).astype(U64)), woff


def owners(off: np.ndarray) -> np.ndarray:
    """The document of each element."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def shingles(words: np.ndarray, woff: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of k words of a document, in order, and its document. With `short`, a
    document of 1 to k-1 words has one shingle, of all its words."""
    n, doc = len(words), owners(woff)
    if not n:
        return np.zeros(0, U64), doc
    room = woff[1:][doc] - np.arange(n)
    ok = room >= k
    h = words * U64(0x9E3779B97F4A7C15 | 1)
    for j in range(1, k):
        nxt = np.zeros(n, dtype=U64)
        nxt[: n - j] = words[j:]
        h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9) + nxt
    h = fmix(h)
    if short and k > 1:
        size = np.diff(woff)
        few = np.flatnonzero((size > 0) & (size < k))
        if len(few):
            at = woff[:-1][few]
            for d, s, c in zip(few, at, size[few], strict=True):
                x = U64(0x51ED270B)
                for w in words[s : s + c]:
                    x = fmix(np.array([x * GOLD + w], dtype=U64))[0] if c else x
                h[s] = x
            ok = ok.copy()
            ok[at] = True
    return h[ok], doc[ok]


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, type=kind))


IDS = ("doc_id", "item_id", "page_id", "conv_id")


def need_columns(df: DataFrame, *names: str) -> DataFrame:
    """`df`, if it has each of the columns once and ids among them are whole numbers."""
    for n in names:
        if df.columns.count(n) != 1:
            raise ValueError(f"column {n} is {'missing' if n not in df.columns else 'there more than once'}; there are {df.columns}")
        if n in IDS and not isinstance(df.schema.fields[df.columns.index(n)].dataType, (T.IntegralType, T.NullType)):
            raise ValueError(f"{n} must be a whole number")
    return df


def numbered(df: DataFrame, *keep: str) -> DataFrame:
    """`df` with its columns named c0, c1, ... by position, but those in `keep`: names with dots, names
    that differ in case only and names that are used here can then do no harm. `toDF(*df.columns)`
    gives the names back."""
    need_columns(df, *keep)
    return df.toDF(*[c if c in keep else f"c{i}" for i, c in enumerate(df.columns)])


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever the others are called."""
    return numbered(df, *names).select(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or, only where that is
    unset (as in tests), a temporary one that is then set."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have is None:
        found = sc._jsc.sc().getCheckpointDir()
        have = found.get() if found.isDefined() else None
    if have is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="threadmill-")
        sc.setCheckpointDir(have)
    at = sc._jvm.org.apache.hadoop.fs.Path(have)  # a path without scheme is on the session's own file system
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString().rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes the rows as a Parquet table in the shared folder and reads them again: cuts the lineage
    and survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadmill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_leftover: dict[str, list[Scratch]] = {}


class Scratch:
    """Tables of one job in a folder of their own below the shared one, which clear() removes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/threadmill-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def later(self) -> Scratch:
        """To be cleared by clear_leftovers(), as a lazy result still reads it."""
        _leftover.setdefault(self.spark.sparkContext.applicationId, []).append(self)
        return self


def clear_leftovers(spark: SparkSession) -> None:
    """Removes the lists that lazy results read; for a caller that has written those results."""
    for scratch in _leftover.pop(spark.sparkContext.applicationId, []):
        scratch.clear()


def file_system(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    return pfs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


FILE, ROW, BUCKET = "__threadmill_file", "__threadmill_row", "__threadmill_bucket"
PLACE_BUCKETS = 256


def located(docs: DataFrame) -> DataFrame:
    """`docs` with the place of each row: a hash of its file's path, and its number in the file. Rows
    that don't come straight from Parquet files are written to the shared folder first."""

    def places(df: DataFrame) -> DataFrame:
        return df.select(*[df[c] for c in df.columns], F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))

    try:
        return places(docs)
    except AnalysisException:
        return places(materialize(docs, "docs"))


def _bucket(file: Column) -> Column:
    return F.pmod(file, F.lit(PLACE_BUCKETS))


def write_places(rows: DataFrame, path: str) -> str:
    """Writes rows (FILE, ROW) as sorted lists in PLACE_BUCKETS folders by file, and returns the folder."""
    bucketed = rows.select(FILE, ROW, _bucket(F.col(FILE)).alias(BUCKET))
    bucketed.repartition(BUCKET).sortWithinPartitions(BUCKET, FILE, ROW).write.partitionBy(BUCKET).parquet(path)
    return path


class Places:
    """The lists that write_places() wrote, read by a task as it comes to a file."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = file_system(path)
        self.file, self.rows = None, np.zeros(0, np.int64)

    def _load(self, file: int) -> np.ndarray:
        if file != self.file:
            found = self.fs.get_file_info(pfs.FileSelector(f"{self.root}/{BUCKET}={file % PLACE_BUCKETS}", allow_not_found=True))
            own = [x.path for x in found if x.path.endswith(".parquet")]  # sorted by file: other files' row groups are skipped
            parts = [np.asarray(pq.read_table(x, filesystem=self.fs, partitioning=None, columns=[ROW], filters=[(FILE, "=", file)]).column(ROW)) for x in own]
            self.file, self.rows = file, np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        return self.rows

    def hold(self, files: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether each place is listed."""
        out = np.zeros(len(rows), bool)
        for file in np.unique(files):
            mine, listed = files == file, self._load(int(file))
            if len(listed):
                at = np.searchsorted(listed, rows[mine])
                out[mine] = listed[np.minimum(at, len(listed) - 1)] == rows[mine]
        return out


def at_places(docs: DataFrame, path: str, columns: list[str], keep: bool) -> DataFrame:
    """The columns of those rows of located() `docs` that are listed at `path` (or aren't, unless
    `keep`). A map over the files: rows aren't shuffled, whatever their number."""
    wanted = docs.select(*columns, FILE, ROW)
    schema = docs.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(path)
        for batch in batches:
            n = batch.num_columns
            listed = places.hold(np.asarray(batch.column(n - 2)), np.asarray(batch.column(n - 1)))
            yield batch.select(list(range(n - 2))).filter(pa.array(listed == keep))

    return wanted.mapInArrow(run, schema)
