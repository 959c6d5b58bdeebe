"""Shared helpers: scratch tables in the cluster's shared folder, words and fingerprints as vectors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Word separators: space and tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
#: The same rule as a pattern for Spark and DuckDB.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees (spark.checkpoint.dir); one of our own only where that is unset and the
    executors are threads of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="gridspark-"))
    return _own_dir[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is deleted at exit."""
    path = f"{shared_dir(spark)}/gridspark-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path  # type: ignore[attr-defined]
    return back


def discard(*dfs: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in dfs:
        path = getattr(df, "_scratch", None)
        if path:
            _remove(df.sparkSession, path)


def settled(make, label: str) -> DataFrame:
    """What make() returns, written and read back; the scratch tables that it used are deleted."""
    before = {path for _, path in _made}
    out = materialize(make(), label)
    for spark, path in list(_made):
        if path not in before and path != out._scratch:  # type: ignore[attr-defined]
            _remove(spark, path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _cleanup() -> None:
    import contextlib
    import shutil

    for spark, path in list(_made):
        with contextlib.suppress(Exception):  # the session may have ended before the interpreter
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
    for d in _own_dir:
        shutil.rmtree(d, ignore_errors=True)


def as_struct(df: DataFrame, **more) -> DataFrame:
    """df's columns as the fields of one column, doc, beside more: so their names never clash with an operator's own."""
    return df.select(F.struct("*").alias("doc"), *(c.alias(name) for name, c in more.items()))


def with_field(doc: pa.StructArray, name: str, values: pa.Array) -> pa.StructArray:
    """doc with other values of one field."""
    return pa.StructArray.from_arrays([values if f.name == name else doc.field(f.name) for f in doc.type], fields=list(doc.type))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(sums: DataFrame, by: list[str], at: str, value: str, name: str, block: int = 1024) -> DataFrame:
    """(by, at, name): the sum of value over the rows of the same `by` and smaller `at` (a whole number, once each).

    Sums run inside blocks of `at` and over the blocks, so a task orders a block's or all blocks' rows only."""
    cells = sums.select(*by, at, value, F.expr(f"{at} div {block}").alias("_block"))
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = cells.withColumn("_in", before(Window.partitionBy(*by, "_block").orderBy(at)))
    blocks = cells.groupBy(*by, "_block").agg(F.sum(value).alias(value))
    outer = blocks.select(*by, "_block", before(Window.partitionBy(*by).orderBy("_block")).alias("_out"))
    return inner.join(outer, [*by, "_block"]).select(*by, at, (F.col("_in") + F.col("_out")).cast("long").alias(name))


def parts_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ---- vectors over UTF-8 bytes -------------------------------------------------------------------

RADIX = np.uint64(0x9E3779B97F4A7C15)
RADIX_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:  # doubling: powers of the first half times base**done
            step = np.uint64(pow(int(base), done, 2**64))
            out[done : 2 * done] = out[:done] * step
            done *= 2
        _powers[name] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix(NamedTuple):
    """sums[i]: of the mixed 8-byte strings that begin before i, each times RADIX**its place; eight[i]: the 8 bytes from i, big-endian
    (zeros behind the end)."""

    sums: np.ndarray
    eight: np.ndarray


def prefix_hash(data: np.ndarray) -> Prefix:
    """What span_hash needs of bytes."""
    n = len(data)
    eight = np.zeros(n + 8, np.uint64)
    eight[:n] = data
    for width in (1, 2, 4):  # of 2, 4 and 8 bytes
        eight[: n + 8 - width] = (eight[: n + 8 - width] << np.uint64(8 * width)) | eight[width:]
    eight = eight[: n + 1]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(eight[:n]) * _power_table("r", RADIX, n), out=sums[1:])
    return Prefix(sums, eight)


def span_hash(prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the spans start..end, equal for equal bytes wherever they stand.

    A polynomial over a span's 8-byte strings, each mixed first, so strings built to cancel byte by byte (Thue-Morse) don't;
    spans of up to 8 bytes have no two of the same length with one fingerprint."""
    size = end - start
    long_ = size > 8
    last = np.where(long_, end - 7, start)
    raw = (prefix.sums[last] - prefix.sums[start]) * _power_table("i", RADIX_INV, len(prefix.sums))[start]
    unused = (64 - 8 * np.clip(size, 1, 8)).astype(np.uint64)
    short = (prefix.eight[start] >> unused) * (size > 0).astype(np.uint64)
    return mix(np.where(long_, raw, short) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def first_bytes(prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the spans (all of a shorter one) as numbers."""
    return prefix.eight[start] >> (64 - 8 * np.clip(end - start, 1, 8)).astype(np.uint64)


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte vector, and offsets (nulls as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most `most` bytes each (one row at least), so that work vectors stay small."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out


def word_count(text) -> F.Column:
    """Number of words of a text column, in the JVM: word starts are word characters after none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
