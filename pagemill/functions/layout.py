"""Pages from text layers and regions: routing, reading order, plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import bbox_quad
from .text import strip


def layer_regions(blocks: Column) -> Column:
    """Regions of a text layer: text blocks' lines, spans joined, blank lines left out, confidence 1."""
    lines = F.flatten(F.transform(F.filter(F.coalesce(blocks, F.expr("cast(array() as " + _blocks() + ")")), lambda b: b["type"] == 0), lambda b: b["lines"]))
    told = F.transform(lines, lambda n: F.struct(bbox_quad(n["bbox"]).alias("quad"), strip(F.array_join(F.transform(n["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), "")).alias("text"), F.lit(1.0).alias("confidence")))
    return F.filter(told, lambda r: r["text"] != "")


def _blocks() -> str:
    from ..schema import BLOCKS

    return BLOCKS


def method(regions: Column, force_ocr: bool = False) -> Column:
    """text if the page's layer has a line that is not blank, unless recognition is forced."""
    return F.lit("ocr") if force_ocr else F.when(F.size(regions) > 0, "text").otherwise("ocr")


def reading_order(regions: Column) -> Column:
    """By the first corner's y; equal ones keep their order."""
    keyed = F.transform(regions, lambda r, i: F.struct(r["quad"][0][1].alias("y"), i.alias("i"), r.alias("r")))
    by = lambda a, b: F.when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).otherwise(a["i"] - b["i"])
    return F.transform(F.array_sort(keyed, by), lambda k: k["r"])


def page_text(regions: Column) -> Column:
    return F.array_join(F.transform(reading_order(regions), lambda r: r["text"]), "\n")


def page(page_no: Column, how: Column, regions: Column) -> Column:
    return F.struct(page_no.cast("int").alias("page"), how.alias("method"), reading_order(regions).alias("results"))
