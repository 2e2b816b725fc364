"""Matrix files as DataFrames of (id, vec): each task reads its own rows of the file, by byte range.

A path is one that all executors see, or a URI of a file system that pyarrow opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 65_536


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): lines with their number, files in order of their paths; one pass counts the lines of each split of a file, a second
    numbers them."""
    t = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_m"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    start, rows = 0, []
    for r in sorted(t.groupBy("_f", "_b").agg(F.min("_m").alias("m"), F.count("*").alias("n")).collect()):
        rows.append((r["_f"], r["_b"], start - r["m"]))
        start += r["n"]
    at = spark.createDataFrame(rows, "_g string, _c bigint, _shift bigint")
    return t.join(F.broadcast(at), (F.col("_f") == F.col("_g")) & (F.col("_b") == F.col("_c"))).select((F.col("_m") + F.col("_shift")).alias("row"), "value")


def _file_rows(spark: SparkSession, n: int, load, kind: str) -> DataFrame:
    """(id, vec) from load(first, last) -> (rows, dim) array."""
    starts = spark.range(0, max(n, 0), ROWS, max(1, -(-n // ROWS)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("id").to_pylist():
                x = np.ascontiguousarray(load(s, min(n, s + ROWS)))
                flat = pa.array(x.ravel().astype(np.float32 if kind == "float" else np.int64))
                off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(x))), pa.ListArray.from_arrays(off, flat)], names=["id", "vec"])

    return starts.mapInArrow(read, f"id bigint, vec array<{'float' if kind == 'float' else 'bigint'}>")


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _part(path: str, dtype: np.dtype, offset: int, rows: int) -> np.ndarray:
    with _open(path) as f:
        return np.frombuffer(f.read_at(rows * dtype.itemsize, offset), dtype)


def npy(spark: SparkSession, path: str, n: int | None = None, dim: int | None = None, kind: str = "float") -> DataFrame:
    """The first n rows of a two-dimensional .npy file of any number type; fewer rows than n, or another dim, are an error."""
    with _open(path) as f:
        head = io.BytesIO(f.read_at(min(f.size(), 65_536), 0))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    offset = head.tell()
    if len(shape) != 2 or fortran or n is not None and shape[0] < n or dim is not None and shape[1] != dim:
        raise ValueError(f"{path} has shape {shape}{' by columns' if fortran else ''}, not at least {n} rows of {dim}")
    row = np.dtype((dtype, (shape[1],)))
    return _file_rows(spark, shape[0] if n is None else n, lambda a, b: _part(path, row, offset + a * row.itemsize, b - a), kind)


def vecs(spark: SparkSession, path: str, n: int | None = None, dim: int | None = None) -> DataFrame:
    """.fvecs, .bvecs or .ivecs: an int32 dimension before each row. A short .ivecs file is an error, the others give what there is."""
    end = os.path.splitext(path)[1]
    dtype = {".fvecs": "<f4", ".bvecs": "u1", ".ivecs": "<i4"}[end]
    with _open(path) as f:
        size = f.size()
        head = f.read_at(min(4, size), 0)
    d = int(np.frombuffer(head, "<i4")[0]) if head else (dim or 0)
    if dim is not None and d != dim:
        raise ValueError(f"{path} has dimension {d}, not {dim}")
    row = np.dtype([("d", "<i4"), ("x", dtype, (d,))])
    there = size // row.itemsize
    if end == ".ivecs" and n is not None and there < n:
        raise ValueError(f"{path} has {there} rows, not {n}")
    n = there if n is None else min(n, there)
    return _file_rows(spark, n, lambda a, b: _part(path, row, a * row.itemsize, b - a)["x"], "int" if end == ".ivecs" else "float")


def text_matrix(spark: SparkSession, path: str, n: int | None = None, dim: int | None = None, kind: str = "float") -> DataFrame:
    """White-space separated numbers, a row on each line; a row of another length than dim is an error."""
    cast = "array<float>" if kind == "float" else "array<bigint>"
    v = numbered_lines(spark, path).select(F.col("row").alias("id"), F.split(F.trim("value"), r"\s+").alias("_f"))
    v = v if n is None else v.where(F.col("id") < n)
    out = F.col("_f").cast(cast)
    if dim is not None:
        out = F.when(F.size("_f") == dim, out).otherwise(F.raise_error(F.lit(f"a row hasn't {dim} numbers")).cast(cast))
    return v.select("id", out.alias("vec"))


def floats(spark: SparkSession, path: str, n: int | None = None, dim: int | None = None) -> DataFrame:
    return _by_extension(path, {".bvecs": vecs, ".fvecs": vecs, ".txt": text_matrix, ".npy": npy})(spark, path, n, dim)


def integers(spark: SparkSession, path: str, n: int | None = None, m: int | None = None) -> DataFrame:
    kinds = {".npy": lambda *a: npy(*a, kind="int"), ".txt": lambda *a: text_matrix(*a, kind="int"), ".ivecs": vecs}
    return _by_extension(path, kinds)(spark, path, n, m)


def graph(spark: SparkSession, path: str, n: int | None = None, m: int | None = None) -> DataFrame:
    """(src, nbrs)."""
    return integers(spark, path, n, m).select(F.col("id").alias("src"), F.col("vec").alias("nbrs"))


def _by_extension(path: str, kinds: dict):
    end = os.path.splitext(path)[1]
    if end not in kinds:
        raise ValueError(f"{path}: expected one of {', '.join(kinds)}")
    return kinds[end]


def random_matrix(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, vec) of uniform numbers in [0, 1), the same for the same seed."""
    u = lambda i: (F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(2**24)) / F.lit(float(2**24))).cast("float")
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), u).alias("vec"))


def zip_ids(matrix: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, vec): matrix rows (id = row number) under the ids (row, id) of a sidecar."""
    i = ids.select(F.col("row").alias("_row"), F.col("id").alias("_id"))
    return matrix.join(i, F.col("id") == F.col("_row")).select(F.col("_id").alias("id"), "vec")
