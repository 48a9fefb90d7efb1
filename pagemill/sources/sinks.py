"""Results as rows, JSON or plain text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_pages(regions: DataFrame) -> DataFrame:
    """path, page, method, results (in reading order) from region rows."""
    one = F.struct(F.element_at(F.element_at("quad", 1), 2).alias("y"), "region_ord", F.struct("quad", "text", "confidence").alias("r"))
    held = regions.groupBy("path", "page").agg(F.max("method").alias("method"), F.array_sort(F.collect_list(F.when(F.col("region_ord") >= 0, one))).alias("all"))
    return held.select("path", "page", "method", F.transform("all", lambda x: x["r"]).alias("results"))


def to_text(pages: DataFrame) -> DataFrame:
    return pages.select("path", "page", F.array_join(F.transform("results", lambda r: r["text"]), "\n").alias("text"))


def to_json(pages: DataFrame) -> DataFrame:
    return pages.select("path", "page", F.to_json(F.struct("page", "method", "results")).alias("json"))


def write_json(result: list, path: str) -> None:
    """One readable file, for results of a single document."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(result, f, ensure_ascii=False, indent=2)


#: Line colours of marked regions, taken in turn (fixed values).
PALETTE = ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 165, 0), (128, 0, 128))


def marked(image, quads, width: int = 2):
    """A copy of an RGB raster with each quad's outline in the palette's colours."""
    import numpy as np

    out = np.array(image, copy=True)
    for i, quad in enumerate(quads):
        for (x0, y0), (x1, y1) in zip(quad, [*quad[1:], quad[0]]):
            n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
            for x, y in zip(np.linspace(x0, x1, n).astype(int), np.linspace(y0, y1, n).astype(int)):
                out[max(0, y - width // 2) : max(0, y + (width + 1) // 2), max(0, x - width // 2) : max(0, x + (width + 1) // 2)] = PALETTE[i % len(PALETTE)]
    return out
