"""Tables written to the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lodestone-tables-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


#: Folders this driver has made in the shared store.
_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; only where that is unset and the work is local in a folder of the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _made.append(f"{(root or _own_folder()).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many intermediate tables there are now; release() takes it as a mark."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes the intermediate tables made since a mark, once the results that read them are written; returns how many."""
    gone = _made[since:]
    del _made[since:]
    for path in gone:
        delete(spark, path)
    return len(gone)


def kept(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df written as Parquet and read again."""
    path = path or new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task that sorts or groups, on average.
TASK_ROWS = 1 << 18


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as its number of rows asks for, so that what a task holds does not grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def changed(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a path was last modified, and its length; a folder's own."""
    p, fs = _fs(spark, path)
    status = fs.getFileStatus(p)
    return status.getModificationTime(), status.getLen()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put(spark: SparkSession, path: str, data: str | bytes, overwrite: bool = True) -> None:
    """Writes a small file, such as a manifest or a report, to any store Hadoop reaches; without overwrite it fails where one is."""
    p, fs = _fs(spark, path)
    out = fs.create(p, overwrite)
    out.write(bytearray(data.encode() if isinstance(data, str) else data))
    out.close()


def get(spark: SparkSession, path: str) -> str:
    """The text of a small file, hidden ones too, which Spark's readers pass over."""
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)
