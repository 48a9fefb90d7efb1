"""Files to region rows, and the classic entry points on top.

One Arrow-fed pass decodes, detects and recognises, so that rasters are never shuffled; text layers leave it as blocks and are
turned into regions by expressions. Ordering, routing and assembly are expressions too.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..backends import REGISTRY
from ..functions import layout
from ..schema import BLOCKS, REGION_ROWS
from ..sources.files import files
from ..sources.images import decode, pdf_pages
from ..sources.sinks import to_pages, to_text

RAW = f"path string, page int, unit string, forced boolean, blocks {BLOCKS}, found array<struct<quad: array<array<double>>, text: string, confidence: double>>"


def _read(detector: tuple[str, dict], recognizer: tuple[str, dict], dpi: int, force_ocr: bool, parts: int, shape):
    def look(image):
        d, r = REGISTRY.get("detector", detector[0], **detector[1]), REGISTRY.get("recognizer", recognizer[0], **recognizer[1])
        quads = d.detect(image)
        return [{"quad": [[float(v) for v in p] for p in q], "text": t, "confidence": float(c)} for q, (t, c) in zip(quads, r.recognize(image, quads))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, kind, part in zip(*(b.column(c) for c in ("path", "content", "kind", "part"))):
                data = content.as_py()
                pages = pdf_pages(data, dpi, force_ocr, part.as_py(), parts) if kind.as_py() == "pdf" else [(1, [], decode(data))]
                for page, blocks, image in pages:  # one page in memory at a time
                    found = look(image) if image is not None else []
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "page": page, "unit": "pt" if image is None else "px", "forced": force_ocr or kind.as_py() != "pdf", "blocks": blocks, "found": found}], shape)

    return run


def regions(found: DataFrame, detector: tuple[str, dict] = ("dark", {}), recognizer: tuple[str, dict] = ("blank", {}), dpi: int = 200, force_ocr: bool = False, parts: int = 1) -> DataFrame:
    """Region rows of files; a page without regions has one row with region_ord -1.

    The pages of a PDF file are read in ``parts`` ranges, each by a task of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(RAW))
    ranges = F.when(F.col("kind") == "pdf", F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    found = found.withColumn("part", F.explode(ranges))
    if parts > 1:
        found = found.repartition(parts, "path", "part")
    raw = found.mapInArrow(_read(detector, recognizer, dpi, force_ocr, parts, shape), RAW)
    layer = F.when(F.col("forced"), F.array().cast("array<struct<quad: array<array<double>>, text: string, confidence: double>>")).otherwise(layout.layer_regions(F.col("blocks")))
    told = raw.withColumn("layer", layer).withColumn("method", layout.method(F.col("layer")))
    told = told.withColumn("all", F.when(F.col("method") == "text", F.col("layer")).otherwise(F.col("found")))
    flat = told.select("path", "page", "method", "unit", F.posexplode_outer("all").alias("region_ord", "r"))
    names = [f.split()[0] for f in REGION_ROWS.split(", ")]
    return flat.select("path", "page", F.coalesce("region_ord", F.lit(-1)).alias("region_ord"), "r.quad", "r.text", "r.confidence", "method", "unit").select(*names)


def get_optimal_workers(max_workers: int = 4) -> int:
    return min(os.cpu_count() or 1, max_workers)


class OCRPipeline:
    """One document at a time on a session; the same plan runs over whole folders through ``regions``.

    Without names of components those of the model files are taken, which need ``model``, ``recognizer_model`` and
    ``vocabulary`` (or these in the settings); what is missing is said at once.
    """

    def __init__(
        self,
        *,
        onnx: bool = True,
        gpu: bool = False,
        detector: str | None = None,
        recognizer: str | None = None,
        model: str | None = None,
        recognizer_model: str | None = None,
        vocabulary: str | None = None,
        detector_settings: dict | None = None,
        recognizer_settings: dict | None = None,
        spark: SparkSession | None = None,
    ):
        tail = "-onnx" if onnx else ""
        detector, recognizer = detector or f"dbnet{tail}", recognizer or f"crnn{tail}"
        self.detector = detector, REGISTRY.settings("detector", detector, **{"model": model, "gpu": gpu, **(detector_settings or {})})
        self.recognizer = recognizer, REGISTRY.settings("recognizer", recognizer, **{"model": recognizer_model, "vocabulary": vocabulary, "gpu": gpu, **(recognizer_settings or {})})
        self.spark = spark or SparkSession.builder.getOrCreate()

    def pages(self, path: str, *, dpi: int = 200, force_ocr: bool = False, workers: int | None = None) -> DataFrame:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        parts = max(1, workers if workers is not None else get_optimal_workers()) if is_pdf(path) else 1
        return to_pages(regions(files(self.spark, os.path.abspath(path)), self.detector, self.recognizer, dpi, force_ocr, parts)).orderBy("page")

    def process_image(self, path: str) -> list[dict]:
        return [r for p in self.pages(path).collect() for r in p.asDict(True)["results"]]

    def process_pdf(self, path: str, *, dpi: int = 200, force_ocr: bool = False, workers: int | None = None) -> list[dict]:
        return [{k: p[k] for k in ("page", "method", "results")} for p in (r.asDict(True) for r in self.pages(path, dpi=dpi, force_ocr=force_ocr, workers=workers).collect())]

    def process(self, path: str, dpi: int = 200) -> list[dict]:
        return self.process_pdf(path, dpi=dpi) if is_pdf(path) else self.process_image(path)

    def get_text(self, path: str, **how) -> str | list[str]:
        texts = [r["text"] for r in to_text(self.pages(path, **(how if is_pdf(path) else {}))).orderBy("page").collect()]
        return texts if is_pdf(path) else "\n".join(texts)


def is_pdf(path: str) -> bool:
    from pathlib import Path

    return Path(path).suffix.lower() == ".pdf"


def ocr(path: str, *, onnx: bool = True, **settings) -> str | list[str]:
    return OCRPipeline(onnx=onnx, **settings).get_text(path)


def ocr_detailed(path: str, *, onnx: bool = True, **settings) -> list[dict]:
    return OCRPipeline(onnx=onnx, **settings).process(path)
