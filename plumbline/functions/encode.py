"""Token matrices of texts. The encoder is pluggable: anything that gives `matrix` (vectors one after another) and `rows`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T

#: Dimensions of the hashing encoder: the hexadecimal digits of an MD5.
WIDTH = 32

Encoder = Callable[[Column], tuple[Column, Column]]


def hashing_encoder(text: Column) -> tuple[Column, Column]:
    """Matrix and rows of a text: a unit vector of signs for each distinct word, from its digest.

    It needs no model and is the same everywhere. Equal words have similarity 1, others lie around 0, so MaxSim counts
    the query's words that a text has. A text without words has one row of zeros.
    """
    words = F.array_distinct(F.filter(T.words(text), lambda w: w != ""))
    unit = 1.0 / WIDTH**0.5
    vectors = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.lit(WIDTH)), lambda j: F.when(F.substr(F.md5(w), j, F.lit(1)) >= "8", -unit).otherwise(unit)))
    zeros = F.array_repeat(F.lit(0.0), WIDTH)
    return F.when(F.size(words) > 0, F.flatten(vectors)).otherwise(zeros), F.greatest(F.size(words), F.lit(1)).cast("long")


def encoded(rows: DataFrame, column: str, encoder: Encoder = hashing_encoder) -> DataFrame:
    """Rows with the token matrix of a text."""
    matrix, n = encoder(F.coalesce(column, F.lit("")))
    return rows.withColumn("matrix", matrix).withColumn("rows", n)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for flat, rows in zip(batch.column("matrix").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            out.append(np.array([rows, len(flat) // max(1, rows)], "<u4").tobytes() + np.array(flat, "<f2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], names=["key", "blob"])


def to_blobs(found: DataFrame) -> DataFrame:
    """Token matrices (key, matrix, rows) as bytes: rows and columns as little-endian u32, then half-precision floats."""
    return found.select(F.col("key").cast("string").alias("key"), F.col("matrix").cast("array<double>").alias("matrix"), F.col("rows").cast("long").alias("rows")).mapInArrow(_blobs, "key string, blob binary")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flats, rows = [], []
        for blob in batch.column("blob").to_pylist():
            n, width = np.frombuffer(blob[:8], "<u4").tolist() if blob is not None and len(blob) >= 8 else (0, 0)
            good = blob is not None and len(blob) == 8 + 2 * n * width and len(blob) >= 8
            flats.append(np.frombuffer(blob[8:], "<f2").astype(float).tolist() if good else None)
            rows.append(n if good else None)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(flats, pa.list_(pa.float64())), pa.array(rows, pa.int64())], names=["key", "matrix", "rows"])


def from_blobs(blobs: DataFrame) -> DataFrame:
    """The matrices again; a blob that doesn't have the size that it says has null, like one that isn't there."""
    return blobs.select("key", "blob").mapInArrow(_matrices, "key string, matrix array<double>, rows long")
