"""Helpers shared by the operators: scratch tables, batching, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 2 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables in the folder that the cluster names in spark.checkpoint.dir.

    A written table cuts lineage and survives lost executors. Only where the setting is absent on a local master (tests) is
    a folder of this machine taken. What is left of the tables goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"file://{tempfile.gettempdir()}/pagemill-scratch"
        self.spark, self.root = spark, f"{root.rstrip('/')}/pagemill-{uuid.uuid4().hex}"
        fs, path = self._path(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that no later plan reads, and lets Spark clear shuffle files of finished plans."""
        import gc

        for name in names:
            fs, path = self._path(f"{self.root}/{name}")
            fs.delete(path, True)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def named(column: str):
    """A column by its whole name, whatever it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


class Carried:
    """Rows whose caller's columns travel as one struct ``row``, so that none of their names can meet one of ours.

    ``own`` gives the columns that an operator reads, under its own names; ``replaced`` names those that it will replace.
    """

    def __init__(self, df: DataFrame, *replaced: str, **own: str):
        self.own = {c: n for n, c in own.items()}
        self.names = [c for c in df.columns if c not in replaced]
        rest = [named(c) for c in self.names if c not in self.own]
        self.frame = df.select(F.struct(*(rest or [F.lit(None).cast("int").alias("none")])).alias("row"), *(named(c).alias(n) for n, c in own.items()))

    def columns(self) -> list:
        """The caller's columns, in order and by name, from a frame that still has ``row`` and the own columns."""
        return [F.col(self.own[c]).alias(c) if c in self.own else F.col("row.`" + c.replace("`", "``") + "`").alias(c) for c in self.names]


def row_key(df: DataFrame) -> list:
    """128 bits of a row's content, as two longs: equal rows share them, and so their results.

    They come from the SHA-256 of all columns, each with its length or a mark for null, so unlike rows differ. Columns that
    hold others (maps too) go as JSON.
    """
    parts = []
    for f in df.schema.fields:
        nested = f.dataType.typeName() in ("struct", "array", "map", "variant")
        x = F.to_json(named(f.name), {"ignoreNullFields": "false"}) if nested else named(f.name).cast("string")
        parts += [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("n"))]
    digest = F.sha2(F.concat(*parts).cast("binary"), 256)
    return [F.xxhash64(digest).alias(ROW[0]), F.xxhash64(F.lit(7), digest).alias(ROW[1])]


#: Columns of a row's key.
ROW = ("row_key1", "row_key2")


@lru_cache(1)
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Gives freed memory back to the system; a reused worker would else keep the peak of every stage."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text).cast(pa.large_binary())
        size = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: batch.num_rows + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        trim()


def with_fields(df: DataFrame, fields: str) -> T.StructType:
    """The schema of df and more fields, whatever the names."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with one key, from a partition sorted by it."""
    held, now = [], None
    for b in batches:
        for row in b.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def shrink(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    import zstandard

    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def grow(blob: bytes, kind) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.array(flat.reshape(size, -1).T, order="C").view(kind).ravel()
