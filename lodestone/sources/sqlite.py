"""SQLite tables as DataFrames: files are read as bytes by Spark and opened in memory on the executors."""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KINDS = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}


def read_table(spark: SparkSession, path: str, table: str, schema: str, rows_a_batch: int = 5000) -> DataFrame:
    """Rows of a table in every database file under path; schema: columns of type long, double or string.

    Works on any store Spark reads; a file is one task's work and must fit its memory.
    Files without the table give no rows.
    """
    fields = T._parse_datatype_string(schema).fields
    names, kinds = [f.name for f in fields], [_KINDS[f.dataType] for f in fields]
    quoted = ", ".join(f'"{n}"' for n in names)

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                con = sqlite3.connect(":memory:")
                con.deserialize(data)
                if con.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (table,)).fetchone()[0]:
                    found = con.execute(f'SELECT {quoted} FROM "{table}"')
                    while rows := found.fetchmany(rows_a_batch):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                con.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The session, message and part tables of a session database."""
    return (
        read_table(spark, path, "session", "id string, title string, directory string, time_created long, time_updated long, time_compacting long"),
        read_table(spark, path, "message", "id string, session_id string, data string"),
        read_table(spark, path, "part", "id string, session_id string, type string, data string"),
    )
