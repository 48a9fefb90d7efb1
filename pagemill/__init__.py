"""Spark-native document text engine."""

from .backends import REGISTRY, Registry
from .plans.pipeline import OCRPipeline, get_optimal_workers, ocr, ocr_detailed

__all__ = ["REGISTRY", "OCRPipeline", "Registry", "get_optimal_workers", "ocr", "ocr_detailed"]
