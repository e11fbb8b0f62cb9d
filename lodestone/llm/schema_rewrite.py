"""Drifted schema rewrite: files whose columns were renamed, reordered, lost or retyped get one evolved schema.

Columns are matched by Parquet field id. Footers are read by tasks, one row a file; files
are grouped by the fingerprint of their schema; each distinct schema is compiled once into
a native projection, and the union of these projections is shuffled by file, sorted by row
index and written by Spark's partitioned writer, which replaces exactly the folders of the
rewritten files (dynamic overwrite). Files that have the evolved schema already are neither
read nor written. Running it again after a lost driver continues: what was replaced is
then of the evolved schema.

A table here is a folder with one data file in each ``file_no=...`` folder. The driver holds
its file listing with fingerprints, as Spark's own file index does (at most 500 files in
op12), and a projection a distinct schema; never rows. A file is sorted and written by one
task, streaming.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, new_path, shared_dir

KEY = "file_no"
ID = "parquet.field.id"
#: The columns of clients in order of their field ids from 1, and what stands for a missing column.
COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
MISSING = {"source": "none", "nation_id": -1}
VERSIONS, DRIFTED, FILES, SEED = 24, 15, 500, 42


def evolved_schema(clients: DataFrame) -> T.StructType:
    """The schema of clients, nullable, nation_id long, with field ids from 1."""
    kind = lambda c: T.LongType() if c == "nation_id" else clients.schema[c].dataType
    return T.StructType([T.StructField(c, kind(c), True, {ID: i}) for i, c in enumerate(COLUMNS, 1)])


def _with_ids(fields, values: list[Column]) -> list[Column]:
    return [v.alias(f.name, metadata={ID: f.metadata[ID]}) for f, v in zip(fields, values, strict=True)]


# Reading footers


def footers(spark: SparkSession, folder: str) -> DataFrame:
    """file_no, path, columns (names, comma-joined), fingerprint: JSON of (name, field id, type, nullable) of each data file's columns.

    Tasks read footers only, through Arrow's file systems, which know local paths, s3, gs, abfs and
    hdfs; for other stores Spark's reader hands the task the file's bytes.
    """
    direct = folder.split(":", 1)[0] in ("file", "s3", "gs", "abfs", "hdfs") or folder.startswith("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    no = F.regexp_extract("path", rf"/{KEY}=(\d+)/", 1).cast("long")

    def run(batches):
        from pyarrow import fs
        from pyarrow import parquet as pq

        for b in batches:
            rows = {"columns": [], "fingerprint": []}
            for path, content in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if direct:
                    store, inside = fs.FileSystem.from_uri(path if not path.startswith("file:/") else "file:///" + path[5:].lstrip("/"))
                    with store.open_input_file(inside) as f:
                        schema = pq.read_schema(f)
                else:
                    schema = pq.read_schema(pa.BufferReader(content.as_buffer()))
                rows["columns"].append(",".join(schema.names))
                rows["fingerprint"].append(json.dumps([[f.name, _field_id(f), str(f.type), f.nullable] for f in schema]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, rows.values())], [KEY, "path", *rows])

    asked = files.select(no.alias(KEY), "path", (F.lit(None).cast("binary") if direct else F.col("content")).alias("content"))
    found = asked.repartition(F.col("path")).mapInArrow(run, f"{KEY} long, path string, columns string, fingerprint string")
    return found.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))


def _field_id(field: pa.Field) -> int | None:
    found = (field.metadata or {}).get(b"PARQUET:field_id")
    return int(found) if found is not None else None


# Rewriting


def projection(rows: DataFrame, ids: list[int | None], target: T.StructType, missing: dict) -> DataFrame:
    """file_no, __path, __row and the target's columns of rows read with their files' own schema.

    ids: the field id of each column, None for a column without one, which matches nothing.
    """
    at = {i: c for i, c in zip(ids, rows.columns, strict=True) if i is not None}
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    values = []
    for f in target.fields:
        if f.metadata[ID] in at:
            values.append(F.col(f"`{at[f.metadata[ID]]}`").cast(f.dataType))
        else:  # `when` keeps the column nullable, a bare literal would be written as required
            values.append(F.when(row >= 0, F.lit(missing.get(f.name)).cast(f.dataType)))
    return rows.select(F.regexp_extract(path, rf"/{KEY}=(\d+)/", 1).cast("long").alias(KEY), path.alias("__path"), row.alias("__row"), *_with_ids(target.fields, values))


def is_evolved(own: T.StructType, fingerprint: list, target: T.StructType) -> bool:
    """Same names, types and ids in the same order, all nullable."""
    wanted = [(f.name, f.metadata[ID], f.dataType, True) for f in target.fields]
    return [(f.name, i, f.dataType, null) for f, (_, i, _, null) in zip(own.fields, fingerprint, strict=True)] == wanted


def write_files(rows: DataFrame, order: list[str], folder: str, mode: str) -> None:
    """One file for each file_no, its rows in the given order: shuffled by file, sorted, written by one task a file."""
    hidden = [c for c in rows.columns if c not in order]
    dealt = rows.repartition(F.col(KEY)).sortWithinPartitions(KEY, *order).select(*hidden)
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy(KEY).parquet(folder)


def rewrite(spark: SparkSession, folder: str, target: T.StructType, missing: dict | None = None) -> DataFrame:
    """Rewrites in place what drifted; returns file_no, start_columns, rewritten of each file, as found before.

    Nulls stay null; a column that a file does not have gets its value of `missing`, or null.
    Columns without a field id, or with one the target does not have, are dropped. Rows and
    their order stay. A folder with several data files is rewritten into one, by path, then
    row index. An empty table is left as it is.
    """
    if KEY in target.names:
        raise ValueError(f"{KEY} names the files and cannot be a column of the table")
    before = materialise(footers(spark, folder), "footers")
    grouped = before.groupBy("fingerprint").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("fingerprint").collect()  # the file listing
    schemas = {g["fingerprint"]: spark.read.parquet(g["paths"][0]).schema for g in grouped}
    drifted = [f for f, own in schemas.items() if not is_evolved(own, json.loads(f), target)]
    odd = F.max(F.col("fingerprint").isin(drifted)) | (F.count("*") > 1)
    facts = before.groupBy(KEY).agg(odd.alias("rewritten"), F.min_by("columns", "path").alias("start_columns"))
    facts = materialise(facts.select(KEY, "start_columns", "rewritten"), "files")
    redo = {r[KEY] for r in facts.where("rewritten").select(KEY).collect()}  # file numbers
    parts = []
    for g in grouped:
        paths = [p for p in g["paths"] if int(p.rsplit(f"/{KEY}=", 1)[1].split("/", 1)[0]) in redo]
        if paths:
            own = spark.read.schema(schemas[g["fingerprint"]]).parquet(*paths)
            parts.append(projection(own, [i for _, i, _, _ in json.loads(g["fingerprint"])], target, missing or {}))
    if parts:
        union = reduce(DataFrame.union, parts)
        write_files(union, ["__path", "__row"], folder, "overwrite")
    return facts


# Starting files


def version_of(file_no: Column) -> Column:
    v = F.crc32(F.concat(F.lit(f"{SEED}:"), file_no.cast("string"))) % VERSIONS
    return F.when(v > DRIFTED, 0).otherwise(v).cast("int")


def numbered(clients: DataFrame, files: int = FILES) -> DataFrame:
    """The ten columns with r (place in the order by crc32 of the decimal client_id, then client_id), file_no and version.

    Rows of equal client_id are ordered by their other columns; null ids come first. The
    order comes from range partitions, whose bounds take all columns and a row number, so
    that no id, however often it stands there, lies in one task. Counts of partitions, as
    many as there are partitions, give each partition's first place.
    """
    spark = clients.sparkSession
    rows = clients.select(*COLUMNS).withColumn("__crc", F.crc32(F.col("client_id").cast("string"))).withColumn("__id", F.monotonically_increasing_id())
    order = ["__crc", *COLUMNS, "__id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = materialise(dealt.select(*COLUMNS, F.spark_partition_id().alias("__part"), place.alias("__at")), "ordered")
    counts = sorted((r["__part"], r["count"]) for r in kept.groupBy("__part").count().collect())  # a row a partition
    starts, n = [], 0
    for part, count in counts:
        starts.append((part, n))
        n += count
    offsets = spark.createDataFrame(starts, "__part int, __first long")
    r = F.col("__first") + F.col("__at")
    placed = kept.join(F.broadcast(offsets), "__part").withColumn("r", r).withColumn(KEY, F.floor(F.col("r") / F.lit(1 + n // files)).cast("long"))
    return placed.select(*COLUMNS, "r", KEY, version_of(F.col(KEY)).alias("version"))


def drifted_columns(target: T.StructType, version: int) -> list[Column]:
    """The columns of a starting file of a version, with their field ids: bit 1 swaps two names, 2 the order, 4 loses columns, 8 narrows types."""
    names = {"name": "email", "email": "name"} if version & 1 else {}
    fields = [f for f in target.fields if not (version & 4 and f.name in MISSING)]
    if version & 2:
        fields = [fields[0], *reversed(fields[1:])]
    kinds = {"balance": "float", "nation_id": "int"} if version & 8 else {}
    return [F.col(f.name).cast(kinds.get(f.name, f.dataType)).alias(names.get(f.name, f.name), metadata={ID: f.metadata[ID]}) for f in fields]


def lay_out(clients: DataFrame, folder: str, files: int = FILES) -> T.StructType:
    """Writes the starting files into folder/file_no=.../ and returns the evolved schema; no rows, no files."""
    spark, target = clients.sparkSession, evolved_schema(clients)
    by_version = new_path(spark, "versions")
    numbered(clients, files).withColumn("__v", F.col("version")).write.partitionBy("__v").parquet(by_version)
    schema = T.StructType([*target.fields, T.StructField("r", T.LongType()), T.StructField(KEY, T.LongType()), T.StructField("version", T.IntegerType())])
    rows = spark.read.schema(T.StructType([*(clients.schema[c] for c in COLUMNS), *schema.fields[-3:], T.StructField("__v", T.IntegerType())])).parquet(by_version)
    found = [v for (v,) in rows.select("__v").distinct().collect()]  # at most 16
    for v in sorted(found):
        write_files(rows.where(F.col("__v") == v).select(*drifted_columns(target, v), KEY, "r"), ["r"], folder, "append")
    if not found:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return target


# Digests of the final files


def _texts(column: pa.Array) -> pa.Array:
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
    elif pa.types.is_floating(column.type):
        v = column.to_numpy(zero_copy_only=False).astype(np.float64) * 1048576
        if not np.isfinite(v[~np.asarray(column.is_null())]).all() or (len(v) and np.nanmax(np.abs(v), initial=0) >= 2.0**62):
            scaled = [x if x is None else x * 1048576 for x in column.to_pylist()]
            column = pa.array([x if x is None else str(math.floor(x) if math.isfinite(x) else x) for x in scaled], pa.string())
        else:
            column = pa.array(np.floor(np.nan_to_num(v)).astype(np.int64), pa.int64(), mask=np.asarray(column.is_null()))
    return column.cast(pa.string()).fill_null("?")


def digests(spark: SparkSession, folder: str, target: T.StructType) -> DataFrame:
    """file_no, n_rows, n_nulls, ids_sha256, rows_sha256 of the table's files, read back in row order; one streaming task a file.

    Floating columns go in as floor(1048576 * x), or their text where not finite; times as microseconds.
    """
    path = F.regexp_extract(F.col("_metadata.file_path"), rf"/{KEY}=(\d+)/", 1).cast("long")
    rows = spark.read.schema(target).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    dealt = rows.select(path.alias(KEY), F.col("_metadata.row_index").alias("__row"), *target.names).repartition(F.col(KEY)).sortWithinPartitions(KEY, "__row").drop("__row")

    def run(batches):
        now, n, nulls, ids, lines = None, 0, 0, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (now, n, nulls, ids.hexdigest(), lines.hexdigest())], [KEY, "n_rows", "n_nulls", "ids_sha256", "rows_sha256"])

        for b in batches:
            if not b.num_rows:
                continue
            files = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            texts = [_texts(b.column(c)) for c in range(1, b.num_columns)]
            joined = pc.binary_join_element_wise(*texts, "|").to_pylist()
            first = texts[0].to_pylist()
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if files[start] != now:
                    if n:
                        yield done()
                    now, n, nulls, ids, lines = int(files[start]), 0, 0, hashlib.sha256(), hashlib.sha256()
                ids.update(((b"," if n else b"") + ",".join(first[start:end]).encode()))
                lines.update(((b"\n" if n else b"") + "\n".join(joined[start:end]).encode()))
                n += end - start
                nulls += sum(b.column(c).slice(start, end - start).null_count for c in range(1, b.num_columns))
        if n:
            yield done()

    return dealt.mapInArrow(run, f"{KEY} long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: starting files of clients in a new folder, rewritten there, with the digests of the final files."""
    folder = f"{shared_dir(spark).rstrip('/')}/clients-table-{uuid.uuid4().hex}"  # stays
    target = lay_out(spark.read.parquet(f"{sf_dir}/clients.parquet"), folder)
    before = rewrite(spark, folder, target, MISSING)
    after = footers(spark, folder).select(KEY, "path", "columns")
    rows = digests(spark, folder, target).join(after, KEY).join(before, KEY)
    return rows.select(KEY, version_of(F.col(KEY)).cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")
