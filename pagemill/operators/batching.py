"""Width buckets, default filling and positional joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT


def width_buckets(df: DataFrame, page: list[str], width: str = "w", order: str = "region_ord", size: int = DEFAULT.bucket_size) -> DataFrame:
    """Adds bucket: each page's rows by width (ties by order), ``size`` to a bucket."""
    by = Window.partitionBy(*page).orderBy(width, order)
    return df.withColumn("bucket", F.floor((F.row_number().over(by) - 1) / size).cast("int"))


def bucket_padding(df: DataFrame, page: list[str], width: str = "w") -> DataFrame:
    """Adds padding: what each row lacks to the widest of its bucket."""
    return df.withColumn("padding", F.max(width).over(Window.partitionBy(*page, "bucket")) - F.col(width))


def fill_defaults(regions: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Every region, with an empty text and confidence 0 where nothing was recognised."""
    out = regions.join(found.select(*key, "text", "confidence"), key, "left")
    return out.withColumns({"text": F.coalesce("text", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def zip_shorter(left, right):
    """Pairs (a, b) of two arrays up to the shorter one's length."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def score_filter(cells: DataFrame, key: list[str], value: str, threshold: float, least: float, score: float) -> DataFrame:
    """Regions of cells above threshold that are large enough and score enough; n and score a region."""
    from ..functions.geometry import mask

    kept = cells.where(mask(F.col(value), threshold)).groupBy(*key).agg(F.count("*").alias("n"), (F.sum(value) / (F.count("*") + 1e-6)).alias("score"))
    return kept.where(~(F.col("n") < least) & ~(F.col("score") < score))
