"""Files as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_kind


def files(spark: SparkSession, path: str | list[str], streaming: bool = False) -> DataFrame:
    """path, content, kind of files, directories or globs. Filters on path reach the scan before any content is read."""
    if streaming:
        schema = "path string, modificationTime timestamp, length long, content binary"
        rows = spark.readStream.format("binaryFile").schema(schema).load(path)
    else:
        rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "content", file_kind(F.col("path")).alias("kind"))
