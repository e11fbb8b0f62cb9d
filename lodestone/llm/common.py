"""What the training-data operators share: the shared folder, materialised tables, tables by name."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The ASCII white space that separates words in every operator: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lodestone-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset (local tests) a temporary folder of the driver serves.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or _own_folder()


#: Folders this driver has made in the shared store.
_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made() -> int:
    """How many intermediate tables there are now; release() takes it as a mark."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> int:
    """Deletes the intermediate tables made since a mark but `keep`, once the results that read them are written; returns how many."""
    gone = [p for p in _made[since:] if p != keep]
    for path in gone:
        drop_path(spark, path)
    return len(gone)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through Hadoop's file system API."""
    if path in _made:
        _made.remove(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, the shuffle files of a query go as soon as it ends; otherwise they stay until the driver happens to collect its garbage.

    For queries that are run once. The session's own setting holds again afterwards.
    """
    before = spark.conf.get(_CLEANUP_KEY)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_KEY, before)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, survives lost executors, drops its shuffle files."""
    path = path or new_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of a step, in the shared folder until clear()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(new_path(self.spark, label))
        return materialise(df, label, self.paths[-1])

    def drop(self, path: str) -> None:
        self.paths.remove(path)
        drop_path(self.spark, path)

    def clear(self) -> None:
        while self.paths:
            drop_path(self.spark, self.paths.pop())


#: Most bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES; a smaller one stays.

    A task holds a batch several times, in the JVM's off-heap memory and in its Python
    worker, which both keep what they have once taken. Batches of up to 64 MB, Spark's
    default, are most of an executor's memory beyond its heap. No result depends on where
    batches are cut. A text longer than the bound is a batch of its own.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def keeps_columns(*needed: str):
    """For functions from documents to some of their rows: whatever the other columns' names are, they come back as they were.

    Inside, every column but the needed ones has a name of its own, extra_0, extra_1, ...,
    so names that a function uses itself, and names with dots, cannot clash. Arrow batches
    are bounded.
    """

    def wrap(function):
        @wraps(function)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            bounded_batches(docs.sparkSession)
            plain = docs.toDF(*(c if c in needed else f"extra_{i}" for i, c in enumerate(docs.columns)))
            return function(plain, *args, **kwargs).toDF(*docs.columns)

        return run

    return wrap


def each(column: pa.Array):
    """The values of a column one by one, so that a batch's texts are not all held twice."""
    return (x.as_py() for x in column)


def whole_groups(batches, keys: int):
    """Tables cut between groups: rows in order of the first `keys` columns, no group in two tables."""
    kept: list[pa.RecordBatch] = []
    for b in batches:  # a batch is closed up to the start of its last group, which the next one may continue
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([*kept, b])
        cols = [table.column(c).to_numpy() for c in range(keys)]
        other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in cols]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield table.slice(0, cut)
        kept = table.slice(cut).to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def group_slices(table: pa.Table, keys: int) -> list[tuple[int, int]]:
    """Start and end of each group of the first `keys` columns."""
    cols = [table.column(c).to_numpy() for c in range(keys)]
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in cols])
    starts = np.append(np.flatnonzero(new), table.num_rows).tolist()
    return list(zip(starts[:-1], starts[1:], strict=True))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
