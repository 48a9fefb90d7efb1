"""Command line: text or JSON of an image or PDF file."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagemill")
    p.add_argument("file", nargs="?", help="an image or a PDF file")
    p.add_argument("--model", help="model file of the detector")
    p.add_argument("--recognizer-model", help="model file of the recognizer")
    p.add_argument("--vocabulary", help="the recognizer's letters, or a text file with them")
    p.add_argument("--no-onnx", action="store_true", help="the model files are TorchScript")
    p.add_argument("--gpu", action="store_true", help="run the models on a GPU")
    p.add_argument("--dpi", type=int, default=200, help="resolution of rendered PDF pages")
    p.add_argument("--force-ocr", action="store_true", help="recognise PDF pages that have a text layer, too")
    p.add_argument("--workers", type=int, help="ranges of PDF pages that are read at once")
    p.add_argument("--out", "-o", help="write JSON to this file")
    p.add_argument("--json", action="store_true", help="print JSON with quads")
    for hidden in ("--image", "--pdf", "--detector", "--recognizer"):
        p.add_argument(hidden, help=argparse.SUPPRESS)
    p.add_argument("--onnx", action="store_true", help=argparse.SUPPRESS)
    return p


def script() -> None:
    sys.exit(main())


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    path = a.file or a.image or a.pdf
    if not path:
        print("no input file", file=sys.stderr)
        return 1
    from .plans.pipeline import OCRPipeline, is_pdf
    from .sources.sinks import write_json

    try:
        run = OCRPipeline(onnx=a.onnx or not a.no_onnx, gpu=a.gpu, detector=a.detector, recognizer=a.recognizer, model=a.model, recognizer_model=a.recognizer_model, vocabulary=a.vocabulary)
        result = run.process_pdf(path, dpi=a.dpi, force_ocr=a.force_ocr, workers=a.workers) if is_pdf(path) else run.process_image(path)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.out:
        write_json(result, a.out)
    elif a.json:
        print(json.dumps(result, ensure_ascii=False, indent=2))
    else:
        for page in result if is_pdf(path) else [{"results": result}]:
            if "page" in page:
                print(f"--- Страница {page['page']} ---")
            print("\n".join(r["text"] for r in page["results"]))
    return 0
