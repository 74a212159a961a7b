"""Shared plumbing: vectorised text primitives and shared-storage tables.

Null texts are empty texts everywhere.  Every helper works on slices of Arrow
batches bounded by bytes, so that memory doesn't follow the batch row count.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks over which the rows of one key are dealt in a salted join.
SALTS = 8
U64 = np.uint64
#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 2 << 20
#: Bytes of one Arrow batch while a scratch table is written.
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared tables


class Scratch:
    """Tables in the folder that ``spark.checkpoint.dir`` names (shared storage).

    Used to cut lineage and to reuse a result without computing it twice.  Where
    the setting is absent, a master in this process gets a local folder (tests) and
    a cluster an error.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = f"{tempfile.gettempdir()}/checkpoints"
        self.spark = spark
        self.tables: list[str] = []
        self.base = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, bucket_by: str | None = None) -> DataFrame:
        """Write and read again; a table bucketed by a column joins on it without a shuffle."""
        path = f"{self.base}/{name}"
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, ARROW_BYTES)
        try:
            if bucket_by is None:
                df.write.mode("overwrite").parquet(path)
                return self.spark.read.schema(df.schema).parquet(path)
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            table = f"scratch_{uuid.uuid4().hex}"
            df.repartition(n, bucket_by).write.bucketBy(n, bucket_by).sortBy(bucket_by).option("path", path).format("parquet").saveAsTable(table)
            self.tables.append(table)
            return self.spark.table(table)
        finally:
            self.spark.conf.set(key, before)

    def drop(self, *names: str) -> None:
        """Delete tables that no later read needs."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_tables(self) -> None:
        """Forget the bucketed tables; ``drop`` deletes their files."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of finished jobs."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (a row a key), the rows of a key dealt over SALTS tasks by ``spread``."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS).cast("long"))
    parts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    return many.withColumn("__salt", salt).join(one.withColumn("__salt", F.explode(parts)), [*keys, "__salt"], how).drop("__salt")


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


# ---------------------------------------------------------------- Arrow slices


def give_back() -> None:
    """Hand freed memory back to the system: workers wait between tasks, and several may wait at once."""
    POWERS.__init__()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (rows, bytes, offsets) with about ``limit`` bytes of ``column`` each.

    A single longer text forms a slice of its own: texts are never cut.
    """
    batch = data = offsets = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            lo = offsets[begin]
            yield batch.slice(begin, end - begin), data[lo : offsets[end]], offsets[begin : end + 1] - lo
            begin = end
    del batch, data, offsets
    give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_rows(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def long_values(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BASE = U64(0xD1342543DE82EF95)


def byte_values(fold_case: bool = False, seed: int = 11) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z count as a-z if ``fold_case``."""
    values = random_words(256, seed)
    if fold_case:
        values[65:91] = values[97:123]
    return values


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = U64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[U64(1), np.full(size - 1, _BASE)], dtype=U64)
                self.down = np.cumprod(np.r_[U64(1), np.full(size - 1, inverse)], dtype=U64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


#: Bytes over which span hashes take one run of prefix sums.
PIECE_BYTES = 64 << 10


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]`` for each span, from prefix sums.

    Spans whose starts lie in one piece of the bytes are hashed together: a hash doesn't
    depend on where its sums begin, and a piece's sums stay in the processor's cache.
    """
    out = np.empty(len(starts), U64)
    cuts = np.flatnonzero(np.diff(starts // PIECE_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True):
        if a == b:
            continue
        start, end = starts[a:b], ends[a:b]
        lo, hi = int(start.min()), int(end.max())
        up, down = POWERS.to(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(values[lo:hi] * up[:-1], dtype=U64, out=sums[1:])
        start, end = start - lo, end - lo
        out[a:b] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
    return out


# ---------------------------------------------------------------- words


def blank_words() -> np.ndarray:
    """Byte classes of ``[^\\x20\\x09-\\x0D]+``."""
    inside = np.ones(256, bool)
    inside[[32, 9, 10, 11, 12, 13]] = False
    return inside


def alnum_words() -> np.ndarray:
    """Byte classes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return inside


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (n + 1 long)."""
    flag = inside[data]
    left = np.empty(len(data) + 1, bool)
    left[0] = left[-1] = False
    left[1:] = flag
    starts_here = flag & ~left[:-1]
    ends_here = np.zeros(len(data), bool)
    ends_here[:-1] = flag[:-1] & ~flag[1:]
    if len(data):
        ends_here[-1] = flag[-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts_here[edges] |= flag[edges]
    ends_here[edges - 1] |= flag[edges - 1]
    starts = np.flatnonzero(starts_here)
    return starts, np.flatnonzero(ends_here) + 1, np.searchsorted(starts, offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def gram_hashes(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that stay in one row, and where they start."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    scale = random_words(k, 77) | U64(1)
    total = word[:n] * scale[0]
    for j in range(1, k):
        total += word[j : j + n] * scale[j]
    row = owners(first)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(total[at]), at


# ---------------------------------------------------------------- row identity

#: What a row is known by: its doc_id (LAST where it has none) and a hash of its text.
ROW = ["doc_id", "row"]
LAST = (1 << 63) - 1


def keyed() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row")]


def own_id() -> Column:
    """The doc_id of a keyed row, null again where it has none."""
    return F.nullif(F.col("doc_id"), F.lit(LAST)).alias("doc_id")
