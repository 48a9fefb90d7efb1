"""Row types."""

from __future__ import annotations

QUAD = "array<array<double>>"
REGION = f"struct<quad: {QUAD}, text: string, confidence: double>"
PAGE = f"struct<page: int, method: string, results: array<{REGION}>>"
BLOCKS = "array<struct<type: int, lines: array<struct<bbox: array<double>, spans: array<struct<text: string>>>>>>"
RASTER = "struct<height: int, width: int, channels: int, data: binary>"
REGION_ROWS = f"path string, page int, region_ord int, quad {QUAD}, text string, confidence double, method string, unit string"
