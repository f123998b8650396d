"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import shared_folder

#: Bytes of text that a Python worker works on at a time, and of an Arrow batch; longer texts are one slice and one batch each.
SLICE_BYTES, BATCH_BYTES = 2 << 20, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=None)
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class files:  # noqa: N801
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = self.path(root)
        self.system = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self) -> list[str]:
        if not self.system.exists(self.root):
            return []
        return [s.getPath().getName() for s in self.system.listStatus(self.root) if s.isDirectory()]

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(self.root, name))

    def delete(self, name: str | None = None) -> None:
        self.system.delete(self.path(self.root, name) if name else self.root, True)


class Scratch:
    """Tables written under the shared folder for one run of an operator; they cut lineage and outlive executors.

    An operator drops what its result doesn't read. What the result does read stays until release(), since only the caller knows
    when it has been consumed.
    """

    #: Folders of each application that weren't released yet.
    folders: dict[str, list[str]] = {}

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
        self.made: set[str] = set()
        self.folders.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        self.made.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that nothing will read again."""
        files(self.spark, self.root).delete(name)
        self.made.discard(name)

    def drop_but(self, *starts: str) -> None:
        """Delete the tables whose names don't begin so."""
        for name in [n for n in self.made if not n.startswith(starts)]:
            self.drop(name)


def release(spark: SparkSession, but: tuple[str, ...] = ()) -> None:
    """Delete the scratch tables of this application except those under `but`; results that read them have to be consumed before."""
    own = Scratch.folders.get(spark.sparkContext.applicationId, [])
    for root in [r for r in own if r not in but]:
        files(spark, root).delete()
        own.remove(root)


def text_of(column: str) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two never-null columns that tell rows apart even if ids are null or repeated."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"),
        F.xxhash64(text_of(text_col)).alias("k2"),
    ]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches cut so that a slice holds about `limit` bytes of `column`, or one row; with that column's values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        lengths = [0 if v is None else v for v in pa.compute.binary_length(array).to_pylist()]
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start), array.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += n
        yield batch.slice(start), array.slice(start).to_pylist()


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _trim(run: Callable) -> Callable:
    """`run`, after which a worker gives freed memory back, since it may serve other stages."""

    @wraps(run)
    def trimmed(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return trimmed


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most in this session, unless smaller ones are set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(name)).rstrip("b") == str(64 << 20):  # Spark's default
        spark.conf.set(name, f"{BATCH_BYTES}b")


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in small batches, from workers that keep little memory."""
    small_batches(df.sparkSession)
    return df.mapInArrow(_trim(run), schema)


def column_of(spark: SparkSession, run: Callable[[Iterator], Iterator[pa.Array]], kind: str) -> Callable[..., Column]:
    """A column that Python computes from others, batch by batch; all other columns of a row stay in the JVM."""
    small_batches(spark)
    trimmed = _trim(run)

    @F.arrow_udf(kind)
    def computed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return trimmed(batches)

    return computed


class Memory:
    """What a worker remembers of strings, up to about so many bytes; emptied when full."""

    #: Bytes of an entry besides the string's characters.
    ENTRY = 220

    def __init__(self, limit: int) -> None:
        self.known: dict = {}
        self.limit, self.held = limit, 0

    def missing(self, wanted: set) -> list:
        """Those that aren't known, for which there is room now; what was known may be gone, and then all are missing."""
        fresh = wanted.difference(self.known)
        size = sum(map(len, fresh)) + self.ENTRY * len(fresh)
        if self.held + size > self.limit and self.known:
            self.known.clear()
            self.held, fresh = 0, wanted
            size = sum(map(len, fresh)) + self.ENTRY * len(fresh)
        self.held += size
        return list(fresh)


def partitions_for(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


