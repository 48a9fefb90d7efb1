"""Files as they arrive: the batch plan on a stream. It keeps no state."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.pipeline import regions
from ..sources.files import files


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False, **how):
    """Writes region rows of files that appear in a folder as Parquet; once: those there now, then stops."""
    rows = regions(files(spark, folder, streaming=True), **how)
    write = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (write.trigger(availableNow=True) if once else write).start(out)
