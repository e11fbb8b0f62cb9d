"""A deterministic hashing embedder: words and word pairs hashed into signed dimensions, unit length.

It stands in for a sentence model, which is not available offline; any column of
unit vectors works with the search operators.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 256
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|\d+")


def embed_text(text: str | None, size: int = SIZE) -> list[float]:
    """The unit vector of a text; the zero vector of a text without words."""
    words = [w.lower() for w in _WORD.findall(text or "")]
    v = np.zeros(size)
    for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
        h = zlib.crc32(w.encode())
        v[h % size] += 1.0 if h & 0x80000000 else -1.0
    length = float(np.linalg.norm(v))
    return (v / length if length else v).tolist()


def embed(rows: DataFrame, text: str = "document", size: int = SIZE) -> DataFrame:
    """Adds embedding; batches of rows go through Arrow."""
    at = rows.columns.index(text)

    def run(batches):
        for b in batches:
            vectors = [embed_text(t, size) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], [*b.schema.names, "embedding"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])).withColumn("vec_id", F.xxhash64("chunk_id"))
