"""Detectors and recognizers: protocols, registry, and the built-in ones.

A detector has detect(image) -> list of quads (4 x 2); a recognizer has recognize(image, quads) -> list of (text, confidence) in
the same order. Instances live once a Python worker, by their full settings.
"""

from __future__ import annotations

import inspect
import json
import os
from typing import Any

import numpy as np

from .operators.kernels import boxes, resize, resize_smooth
from .params import DEFAULT, Params


class Registry:
    """Names of component classes, and instances by class and settings."""

    def __init__(self):
        self._kinds: dict[str, dict[str, type]] = {"detector": {}, "recognizer": {}}
        self._made: dict[tuple, Any] = {}

    def register(self, kind: str, name: str, cls: type) -> None:
        """A name registered again gets new instances."""
        self._kinds[kind][name] = cls
        self._made = {k: v for k, v in self._made.items() if k[:2] != (kind, name)}

    def get(self, kind: str, name: str, **settings: Any):
        if name not in self._kinds[kind]:
            raise ValueError(f"no {kind} named {name!r}; there are: {', '.join(self.names(kind))}")
        key = (kind, name, json.dumps(settings, sort_keys=True, default=str))
        if key not in self._made:
            self._made[key] = self._kinds[kind][name](**settings)
        return self._made[key]

    def settings(self, kind: str, name: str, **settings: Any) -> dict[str, Any]:
        """Those of the settings that a class takes; raises where it needs one more, so that no task has to fail first."""
        if name not in self._kinds[kind]:
            raise ValueError(f"no {kind} named {name!r}; there are: {', '.join(self.names(kind))}")
        takes = inspect.signature(self._kinds[kind][name]).parameters
        if lack := [k for k, v in takes.items() if v.default is v.empty and v.kind == v.POSITIONAL_OR_KEYWORD and settings.get(k) is None]:
            raise ValueError(f"{kind} {name!r} needs: {', '.join(lack)}")
        return {k: v for k, v in settings.items() if k in takes and v is not None}

    def names(self, kind: str) -> list[str]:
        return sorted(self._kinds[kind])

    def register_detector(self, name: str, cls: type) -> None:
        self.register("detector", name, cls)

    def register_recognizer(self, name: str, cls: type) -> None:
        self.register("recognizer", name, cls)

    def list_detectors(self) -> list[str]:
        return self.names("detector")

    def list_recognizers(self) -> list[str]:
        return self.names("recognizer")


class DarkDetector:
    """Takes darkness for the probability of text: a stand-in without weights."""

    def __init__(self, params: Params = DEFAULT):
        self.params = params

    def detect(self, image: np.ndarray) -> list[np.ndarray]:
        h, w = image.shape[:2]
        if not h or not w:
            return []
        return boxes(1 - image.astype(np.float32).mean(2) / 255, 1.0, 1.0, w, h, self.params)


class BlankRecognizer:
    """Gives every region an empty text."""

    def recognize(self, image: np.ndarray, quads: list) -> list[tuple[str, float]]:
        return [("", 0.0) for _ in quads]


def _session(path: str, gpu: bool):
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = 1  # a task has one core
    options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
    return ort.InferenceSession(path, options, providers=["CUDAExecutionProvider", "CPUExecutionProvider"] if gpu else ["CPUExecutionProvider"])


class _Onnx:
    def __init__(self, model: str, gpu: bool):
        self.session = _session(model, gpu)
        self.input = self.session.get_inputs()[0].name

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.session.run(None, {self.input: x})[0])


class _Torch:
    """A TorchScript file; the library is loaded only here."""

    def __init__(self, model: str, gpu: bool):
        try:
            import torch
        except ImportError as e:
            raise ImportError("running a TorchScript model needs torch") from e
        self.torch, self.device = torch, "cuda" if gpu and torch.cuda.is_available() else "cpu"
        self.model = torch.jit.load(model, map_location=self.device).eval()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with self.torch.no_grad():
            return np.asarray(self.model(self.torch.from_numpy(x).to(self.device)).cpu().numpy())


class OnnxDetector:
    """A segmentation model file that maps (1, 3, H, W) to a probability map; sides go up to multiples of 32."""

    runner: type = _Onnx

    def __init__(self, model: str, gpu: bool = False, params: Params = DEFAULT):
        self.run, self.params = self.runner(model, gpu), params

    def detect(self, image: np.ndarray) -> list[np.ndarray]:
        h, w = image.shape[:2]
        if not h or not w:
            return []
        H, W = (h + 31) // 32 * 32, (w + 31) // 32 * 32
        x = (resize(image, H, W).astype(np.float32) / 255 - np.array(self.params.mean, np.float32)) / np.array(self.params.std, np.float32)
        prob = self.run(np.ascontiguousarray(x.astype(np.float32).transpose(2, 0, 1)[None])).reshape(H, W)
        return boxes(prob, w / W, h / H, w, h, self.params)


class TorchDetector(OnnxDetector):
    runner = _Torch


class OnnxRecognizer:
    """A line model file that maps (N, 3, 32, W) to logits (N, T, classes), with a vocabulary; the last class is blank.

    The vocabulary is the letters themselves, or the path of a text file that holds them.
    """

    runner: type = _Onnx

    def __init__(self, model: str, vocabulary: str, gpu: bool = False, params: Params = DEFAULT):
        if os.path.isfile(vocabulary):
            with open(vocabulary, encoding="utf-8") as f:
                vocabulary = f.read().rstrip("\n")
        self.run, self.vocabulary, self.params = self.runner(model, gpu), vocabulary, params

    def recognize(self, image: np.ndarray, quads: list) -> list[tuple[str, float]]:
        out, lines = [("", 0.0)] * len(quads), []
        for i, q in enumerate(quads):
            x0, y0 = np.maximum(np.trunc(np.min(q, 0)), 0).astype(int)
            x1, y1 = np.minimum(np.trunc(np.max(q, 0)).astype(int), [image.shape[1], image.shape[0]])
            if x1 > x0 and y1 > y0:
                width = max(self.params.min_width, int((x1 - x0) * (self.params.input_height / (y1 - y0))))
                lines.append((width, i, resize_smooth(image[y0:y1, x0:x1], self.params.input_height, width).transpose(2, 0, 1).astype(np.float32) / 255))
        lines.sort(key=lambda n: n[:2])
        for at in range(0, len(lines), self.params.bucket_size):
            part = lines[at : at + self.params.bucket_size]
            batch = np.zeros((len(part), 3, self.params.input_height, part[-1][0]), np.float32)
            for k, (width, _, line) in enumerate(part):
                batch[k, :, :, :width] = line
            for (_, i, _), logits in zip(part, self.run(batch)):
                out[i] = ctc(np.asarray(logits, float), self.vocabulary)
        return out


class TorchRecognizer(OnnxRecognizer):
    runner = _Torch


def ctc(logits: np.ndarray, vocabulary: str) -> tuple[str, float]:
    """functions.ctc for one array."""
    best = logits.argmax(1)
    sure = 1 / np.exp(logits - logits.max(1, keepdims=True)).sum(1)
    kept = [c for i, c in enumerate(best.tolist()) if (not i or c != best[i - 1]) and c < len(vocabulary)]
    return "".join(vocabulary[c] for c in kept), float(sure.min())


REGISTRY = Registry()
# The names of the public interface.
for name, cls in (("dark", DarkDetector), ("dbnet", TorchDetector), ("dbnet-onnx", OnnxDetector), ("onnx", OnnxDetector)):
    REGISTRY.register_detector(name, cls)
for name, cls in (("blank", BlankRecognizer), ("crnn", TorchRecognizer), ("crnn-onnx", OnnxRecognizer), ("onnx", OnnxRecognizer)):
    REGISTRY.register_recognizer(name, cls)
