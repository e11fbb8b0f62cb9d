"""Drifted files and their rewrite against a plain computation."""

import datetime as dt
import glob
import hashlib
import math
import os
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("lodestone.llm")

import numpy as np  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402

from lodestone.llm import schema_rewrite as S  # noqa: E402

NAMES = S.COLUMNS
START = dt.datetime(2024, 1, 1)


def clients(n):
    """n rows with nulls in every column, equal client_ids, repeated rows and values beyond a float."""
    rows = []
    for i in range(n):
        row = [i * 7 % n, i, f"s{i % 3}", START + dt.timedelta(microseconds=i * 999_999), f"n{i}é", f"e{i}|x", f"c{i}", i % 25, "retail", i * 1234.5678 - 3000]
        row[i % 10] = None if i % 4 == 3 else row[i % 10]
        rows.append(row)
    rows[5][0] = rows[6][0] = rows[7][0] = 40
    rows.append(list(rows[8]))
    rows[9][9], rows[10][9] = float("inf"), 1e300
    return rows


def version(no):
    v = zlib.crc32(f"42:{no}".encode()) % 24
    return v if v <= 15 else 0


def expected(rows, files):
    key = lambda r: (zlib.crc32(str(r[0]).encode()), r[0]) if r[0] is not None else (-1, -1)
    own = lambda r: [(x is not None, x) if x is not None else (False,) for x in r]
    ordered = sorted(rows, key=lambda r: (key(r), own(r)))
    per, by = 1 + len(rows) // files, defaultdict(list)
    for i, r in enumerate(ordered):
        by[i // per].append(list(r))
    found = {}
    for no, part in by.items():
        v = version(no)
        names = list(NAMES)
        if v & 1:
            names[4], names[5] = names[5], names[4]
        if v & 4:
            names = [x for x in names if x not in ("source", "nation_id")]
        if v & 2:
            names = [names[0], *reversed(names[1:])]
        for r in part:
            if v & 4:
                r[2], r[7] = "none", -1
            if v & 8 and r[9] is not None:
                with np.errstate(over="ignore"):
                    r[9] = float(np.float32(r[9]))
        text = lambda i, x: "?" if x is None else str((x - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)) if i == 3 else (str(math.floor(1048576 * x)) if math.isfinite(1048576 * x) else str(1048576 * x)) if i == 9 else str(x)
        lines = [[text(i, x) for i, x in enumerate(r)] for r in part]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found[no] = (v, len(part), sum(x is None for r in part for x in r), digest(",".join(x[0] for x in lines)), digest("\n".join("|".join(x) for x in lines)), ",".join(names), ",".join(NAMES), v > 0)
    return found


def data_files(folder):
    return sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True))


@pytest.mark.parametrize("files", [500, 30])
def test_rewrite_equals_plain_computation(spark, tmp_path, files):
    rows = clients(60 if files == 500 else 700)
    schema = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, file_no string, r int, version int"
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    folder = f"file://{tmp_path}/table"
    target = S.lay_out(table, folder, files)
    want = expected(rows, files)
    before = {p: os.stat(p).st_mtime_ns for p in data_files(f"{tmp_path}/table")}
    drifted = {no for no, w in want.items() if w[-1]}
    assert len(before) == len(want) and 0 < len(drifted) < len(want)
    for path in before:  # starting files: names in order, field ids, types
        no = int(path.split("file_no=")[1].split("/")[0])
        kept = pq.read_schema(path)
        assert ",".join(kept.names) == want[no][5]
        swap = {"name": "email", "email": "name"} if want[no][0] & 1 else {}
        assert all(S._field_id(f) == NAMES.index(swap.get(f.name, f.name)) + 1 and f.nullable for f in kept)
        assert str(kept.field("balance").type) == ("float" if want[no][0] & 8 else "double")
        if not want[no][0] & 4:
            assert str(kept.field("nation_id").type) == ("int32" if want[no][0] & 8 else "int64")
    facts = {r["file_no"]: r for r in S.rewrite(spark, folder, target, S.MISSING).collect()}
    after = data_files(f"{tmp_path}/table")
    assert len(after) == len(want)
    assert {p for p in after if p in before and os.stat(p).st_mtime_ns == before[p]} == {p for p in before if int(p.split("file_no=")[1].split("/")[0]) not in drifted}
    for path in after:
        final = pq.read_schema(path)
        assert final.names == NAMES and [S._field_id(f) for f in final] == list(range(1, 11)) and all(f.nullable for f in final)
        assert str(final.field("nation_id").type) == "int64" and str(final.field("balance").type) == "double"
    got = {r["file_no"]: r for r in S.digests(spark, folder, target).collect()}
    assert {no: (version(no), g["n_rows"], g["n_nulls"], g["ids_sha256"], g["rows_sha256"], facts[no]["start_columns"], ",".join(NAMES), facts[no]["rewritten"]) for no, g in got.items()} == want
    again = S.rewrite(spark, folder, target, S.MISSING)  # nothing is left to do
    assert not again.where("rewritten").count() and data_files(f"{tmp_path}/table") == after


def test_query_counts_files_and_rows(spark, sf):
    rows = S.query(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/clients.parquet").count()
    want = expected([list(r) for r in spark.read.parquet(f"{sf}/clients.parquet").select(*NAMES).collect()], 500)
    assert sum(r["n_rows"] for r in rows) == n and len({r["path"] for r in rows}) == len(rows) == len(want)
    got = {r["file_no"]: (r["version"], r["n_rows"], r["n_nulls"], r["ids_sha256"], r["rows_sha256"], r["start_columns"], r["columns"], r["rewritten"]) for r in rows}
    assert got == want


def test_empty_table_and_odd_files(spark, tmp_path):
    empty = spark.createDataFrame([], "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double")
    folder = f"file://{tmp_path}/none"
    target = S.lay_out(empty, folder)
    assert S.rewrite(spark, folder, target).count() == 0 and S.digests(spark, folder, target).count() == 0
    # two files in a folder, one without field ids: one file after, unmatched columns dropped, missing ones null or as given
    table = f"{tmp_path}/odd"
    spark.range(3).selectExpr("cast(id as int) as client_id", "'x' as other").coalesce(1).write.parquet(f"{table}/file_no=7")
    one = spark.range(5, 7).select(S.F.col("id").cast("int").alias("old", metadata={S.ID: 1}))
    one.coalesce(1).write.mode("append").parquet(f"{table}/file_no=7")
    facts = S.rewrite(spark, f"file://{table}", target, S.MISSING).collect()
    rows = spark.read.schema(target).parquet(f"{table}/file_no=7").collect()
    assert len(facts) == 1 and len(data_files(table)) == 1
    assert sorted((r["client_id"] is None, r["client_id"], r["source"], r["nation_id"], r["city"]) for r in rows if r["client_id"] is not None) == [(False, 5, "none", -1, None), (False, 6, "none", -1, None)]
    assert len(rows) == 5
    with pytest.raises(ValueError):
        S.rewrite(spark, f"file://{table}", S.T.StructType([S.T.StructField("file_no", S.T.LongType(), True, {S.ID: 1})]))
