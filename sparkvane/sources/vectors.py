"""Files of vectors: records of a little-endian dimension and that many 4-byte values."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_DIM = 1 << 20


class VectorFileError(ValueError):
    pass


def parse(raw: bytes, kind: str = "<f4", first: int | None = None) -> np.ndarray:
    """All records (or the first ones) of a file's bytes, as a matrix."""
    if not raw:
        return np.zeros((0, 0), kind)
    if len(raw) < 4:
        raise VectorFileError("the file ends within a record")
    dim = struct.unpack("<I", raw[:4])[0]
    if not 0 < dim <= MAX_DIM:
        raise VectorFileError(f"no such dimension: {dim}")
    size = 4 + 4 * dim
    n = len(raw) // size if first is None else min(first, len(raw) // size)
    if (first is None or n < first) and len(raw) % size:
        raise VectorFileError("the file ends within a record, or records differ in dimension")
    rows = np.frombuffer(raw[: n * size], "<u4").reshape(n, dim + 1)
    if (rows[:, 0] != dim).any():
        raise VectorFileError("records differ in dimension")
    return rows[:, 1:].view(kind)


def to_bytes(rows: np.ndarray, kind: str = "<f4") -> bytes:
    rows = np.ascontiguousarray(rows, kind)
    head = np.full((len(rows), 1), rows.shape[1], "<u4")
    return np.hstack([head, rows.view("<u4")]).tobytes()


class _Records(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], kind: str):
        self.path, self.kind = options["path"].removeprefix("file://"), kind
        self.rows = int(options.get("rowsPerPartition", 65536))
        self.limit = int(options["limit"]) if "limit" in options else None

    def _shape(self) -> tuple[int, int]:
        import os

        length = os.path.getsize(self.path)
        if not length:
            return 0, 0
        with open(self.path, "rb") as f:
            head = f.read(4)
        if len(head) < 4:
            raise VectorFileError("the file ends within a record")
        dim = struct.unpack("<I", head)[0]
        if not 0 < dim <= MAX_DIM:
            raise VectorFileError(f"no such dimension: {dim}")
        n, rest = divmod(length, 4 + 4 * dim)
        if rest and (self.limit is None or n < self.limit):
            raise VectorFileError("the file ends within a record, or records differ in dimension")
        return dim, n if self.limit is None else min(n, self.limit)

    def partitions(self):
        _, n = self._shape()
        return [_Records(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [_Records(0, 0)]

    def read(self, partition: _Records):
        dim, _ = self._shape()
        n = partition.last - partition.first
        if not n:
            return
        with open(self.path, "rb") as f:
            f.seek(partition.first * (4 + 4 * dim))
            rows = parse(f.read(n * (4 + 4 * dim)), "<f4" if self.kind == "float" else "<i4")
        if rows.shape != (n, dim):
            raise VectorFileError("records differ in dimension")
        values = pa.array(np.ascontiguousarray(rows).ravel())
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), values)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.last)), vectors], ["id", "vector"])


class FvecsSource(DataSource):
    """``spark.read.format("fvecs")``; options ``limit`` (first records) and ``rowsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return "id long, vector array<float>"

    def reader(self, schema):
        return _Reader(self.options, "float")


class IvecsSource(FvecsSource):
    @classmethod
    def name(cls) -> str:
        return "ivecs"

    def schema(self) -> str:
        return "id long, vector array<int>"

    def reader(self, schema):
        return _Reader(self.options, "int")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)


def read_shared(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """The same from a store that only Spark reads: one task a file of at most 2 GB. Ids run on
    from file to file, in the order of their paths."""
    files = spark.read.format("binaryFile").load(path)
    little = F.concat(*[F.substring("content", i, 1) for i in (4, 3, 2, 1)])  # the first record's dimension
    size = 4 + 4 * F.conv(F.hex(little), 16, 10).cast("long")
    heads = files.select("path", F.coalesce(F.expr("length").cast("long") / size, F.lit(0)).cast("long").alias("n"))  # a row a file
    first = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.select("path", "content").join(heads.select("path", first.alias("first")), "path").select("first", "content")

    def run(batches):
        for b in batches:
            for start, raw in zip(b.column("first").to_pylist(), b.column("content").to_pylist()):
                rows = parse(raw, "<f4" if kind == "float" else "<i4")
                yield pa.RecordBatch.from_arrays([pa.array(start + np.arange(len(rows))), pa.array(list(rows), pa.list_(pa.float32() if kind == "float" else pa.int32()))], ["id", "vector"])

    return rows.mapInArrow(run, f"id long, vector array<{kind}>")


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """``n`` vectors uniform in [-1, 1), the same for a seed however they are partitioned."""
    return spark.range(n).select("id", F.expr(f"sequence(1, {dim})").alias("s")).select("id", F.transform("s", lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 24)) / F.lit(float(1 << 23)) - 1.0).cast("float")).alias("vector"))
