"""Settings of detection, recognition and page handling."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Fixed values that results must agree with."""

    threshold: float = 0.252
    unclip_ratio: float = 2.44
    box_threshold: float = 0.52
    min_area: float = 38.0
    input_height: int = 32
    min_width: int = 8
    bucket_size: int = 4
    dpi: int = 200
    mean: tuple[float, float, float] = (0.485, 0.456, 0.406)
    std: tuple[float, float, float] = (0.229, 0.224, 0.225)


DEFAULT = Params()
