"""Shared helpers: lineage cuts, shipping the package, vectorised words and hashes.

Words everywhere are maximal runs of characters other than space and \\t..\\r
(``[^\\x20\\x09-\\x0D]+``); "lower-case" folds A-Z only. Both act on single
bytes, so texts are handled as UTF-8 without decoding.
"""

from __future__ import annotations

import ctypes
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.deploy import delete, shared_dir, ship

#: Splits a word from the next; the same set as in the contracts.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- lineage cuts ---------------------------------------------------------------

_SCOPES = threading.local()
#: Settings while an operator writes a table of its own. Spark deletes the shuffle files of each action when it ends,
#: as a written table needs them no more; and hands Python some MB at a time.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def _set_for_writing(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, what: str = "cut", group_bytes: int | None = None) -> DataFrame:
    """Write to the shared folder and read again: the lineage ends there, so a lost executor costs no recomputation.

    `group_bytes`: size of the files' row groups, for wide rows, which a reader takes by the group.
    """
    spark = df.sparkSession
    path = _named(spark, what)
    schema = df.schema
    with _set_for_writing(spark):
        _writer(df, group_bytes).parquet(path)
    _between_tables(spark)
    return spark.read.schema(schema).parquet(path)


def cut_buckets(df: DataFrame, by: str, buckets: int, what: str = "buckets", group_bytes: int | None = None) -> DataFrame:
    """As `cut`, but as a table bucketed by a column, so that later joins and groups by that column don't move its rows.

    Rows are written where they are, without a shuffle. The table's entry in the catalog goes at once; its files stay as those of `cut`.
    """
    spark = df.sparkSession
    path = _named(spark, what)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with _set_for_writing(spark):
        _writer(df, group_bytes).bucketBy(min(buckets, 100_000), by).option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved while the entry is there
    spark.sql(f"DROP TABLE {name}")
    _between_tables(spark)
    return table


def _named(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/sheaf-{what}-{uuid.uuid4().hex}"
    if getattr(_SCOPES, "open", None):
        _SCOPES.open[-1].append(path)
    return path


def _writer(df: DataFrame, group_bytes: int | None):
    w = df.write
    return w if group_bytes is None else w.option("parquet.block.size", str(group_bytes)).option("parquet.block.size.row.check.min", "4")


def discard(df: DataFrame) -> None:
    """Delete a cut's table, once all that was made of it is itself cut or collected."""
    for folder in _folders(df):
        delete(df.sparkSession, folder)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def own_tables(df: DataFrame) -> set[str]:
    """Folders of tables that `cut` wrote and this DataFrame reads."""
    return {f for f in _folders(df) if f.rsplit("/", 1)[1].startswith("sheaf-")}


def tidy(operator: Callable) -> Callable:
    """When the operator ends, its tables in the shared folder go, but for those that the DataFrame it returns reads.

    Those pass to the operator that called it, if that is tidy too; else they stay, as the result is computed when its owner asks.
    """

    @wraps(operator)
    def run(*args, **kwargs):
        scopes = _SCOPES.open = getattr(_SCOPES, "open", None) or []
        scopes.append([])
        kept: set[str] = set()
        try:
            out = operator(*args, **kwargs)
            kept = {f.rsplit("/", 1)[1] for f in own_tables(out)} if isinstance(out, DataFrame) else kept
        finally:
            spark = SparkSession.getActiveSession()
            for path in scopes.pop():
                if path.rsplit("/", 1)[1] not in kept:
                    delete(spark, path)
                elif scopes:
                    scopes[-1].append(path)
        return out

    return run


def key_name(key: str, *taken: str) -> str:
    """The name under which a result carries the key: its own, or with `_key` behind it where a column of the result is called so."""
    while key.lower() in taken:
        key += "_key"
    return key


def fold(col: str, modulus: int):
    """crc32 of the id's decimal text, modulo; null ids fall in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def smallest_hashes(rows: DataFrame, group: str, key: str, most: int, seed: int, salts: int = 256) -> DataFrame:
    """group, key of the `most` rows of each group with the smallest hashes of their key; ties go by key.

    First within salted parts of a group, then among their winners: no task reads
    more than salts x most rows of a group in the end.
    """
    hashed = rows.select(group, key, F.xxhash64(F.lit(seed), F.col(key)).alias("__hash")).withColumn("__part", F.pmod("__hash", F.lit(salts)))
    for by in ((group, "__part"), (group,)):
        order = Window.partitionBy(*by).orderBy("__hash", key)
        hashed = hashed.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
    return hashed.select(group, key)


# --- workers -------------------------------------------------------------------


@lru_cache(maxsize=None)
def _libc():
    """glibc, told to give back every freed array of a MB and more; None elsewhere."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        return libc if hasattr(libc, "malloc_trim") else None
    except (OSError, AttributeError):
        return None


def settle() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and stand beside the executor's heap. Long tables of powers go, too."""
    if len(_POWERS[0]) > 1 << 20:
        _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.set_memory_pool(pa.system_memory_pool())
    if libc := _libc():
        libc.malloc_trim(0)


def empty_heaps(spark: SparkSession) -> None:
    """Collect garbage in the JVM of every executor, one task a core: a heap that an earlier job filled goes back to the system, and so do buffers and classes that only garbage held."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


#: Seconds between two times that a driver in `sparing` gives memory back.
EVERY = 15.0


@contextmanager
def sparing(spark: SparkSession):
    """For long runs of many jobs: the driver gives memory back now, and after tables written meanwhile, every EVERY seconds at most."""
    before = getattr(_SCOPES, "emptied", None)
    empty_driver(spark)
    _SCOPES.emptied = time.monotonic()
    try:
        yield
    finally:
        _SCOPES.emptied = before


def _between_tables(spark: SparkSession) -> None:
    at = getattr(_SCOPES, "emptied", None)
    if at is not None and time.monotonic() - at >= EVERY:
        empty_driver(spark)
        _SCOPES.emptied = time.monotonic()


def empty_driver(spark: SparkSession) -> None:
    """Collect garbage in the driver's JVM, and give what its heap and its compilers have freed back to the system; in its Python, too.

    Its heap grows with garbage of plans and of tasks' ends, and glibc keeps what compilers and codecs freed, some 150 MB after a hundred jobs.
    """
    spark._jvm.System.gc()
    try:
        _trim_jvm(spark)
    except Py4JError:  # a JVM without that command
        pass
    if libc := _libc():
        libc.malloc_trim(0)


def _trim_jvm(spark: SparkSession) -> None:
    """`jcmd System.trim_native_heap`, by way of the JVM's own beans. Their class is not open, so the method is that of the interface."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    types, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(kinds):
        types[i] = jvm.java.lang.Class.forName(kind)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
    invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def lean(function: Callable) -> Callable:
    """A function of batches that settles before and behind its task."""

    def run(batches):
        settle()
        try:
            yield from function(batches)
        finally:
            settle()

    return run


def lean_group(function: Callable) -> Callable:
    """A function of a group's table that settles behind it."""

    def run(table: pa.Table) -> pa.Table:
        settle()
        try:
            return function(table)
        finally:
            settle()

    return run


def lean_groups(function: Callable) -> Callable:
    """The same for two tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        settle()
        try:
            return function(left, right)
        finally:
            settle()

    return run


# --- batches -----------------------------------------------------------------


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches, text: str, most: int = 4 << 20):
    """Record batches cut into runs of rows with about `most` bytes of text each (one longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def pulled(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# --- hashes ------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; x is a uint64 array and stays as it is."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of every word."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    before = np.empty(len(raw), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes, the same wherever the word stands."""
    n = len(raw)
    p, q = _powers(n + 1)
    x = (_LOWER[raw] if lower else raw).astype(np.uint64)
    x += np.uint64(1)
    x *= p[:n]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(x, out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def runs(raw: np.ndarray, off: np.ndarray, most: int = 1 << 20):
    """Start and end of runs of about `most` bytes that split no word: long texts are worked on piece by piece. A longer word stands whole."""
    at, n = 0, len(raw)
    while at < n:
        to = min(at + most, n)
        if to < n:
            text_end = int(off[np.searchsorted(off, to)])
            while to < text_end:
                space = np.flatnonzero(_IS_SPACE[raw[to : min(to + (1 << 16), text_end)]])
                if len(space):
                    to += int(space[0])
                    break
                to = min(to + (1 << 16), text_end)
        yield at, to
        at = to


def hashed_words(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, by runs: temporaries don't grow with a text."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for at, to in runs(raw, off):
        first = int(np.searchsorted(off, at, "right")) - 1
        part = np.clip(off[first : int(np.searchsorted(off, to, "left")) + 1], at, to) - at
        s, e, row = words(raw[at:to], part)
        out.append((word_hashes(raw[at:to], s, e, lower), row + first))
    return np.concatenate([h for h, _ in out]), np.concatenate([r for _, r in out])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
