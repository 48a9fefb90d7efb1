import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill import REGISTRY, OCRPipeline, Registry, cli
from pagemill.backends import BlankRecognizer, DarkDetector, ctc
from pagemill.functions import ctc as ctc_sql
from pagemill.functions import geometry, layout, text
from pagemill.operators import batching, kernels
from pagemill.schema import BLOCKS
from pagemill.sources.files import files
from pagemill.sources.images import decode_png, encode_png
from pagemill.streaming.ingest import ingest


def box_image():
    image = np.full((200, 400, 3), 255, np.uint8)
    image[50:150, 50:350] = 0
    return image


def one(spark, expr, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).select(expr).first()[0]


@pytest.mark.parametrize("name,kind", [("a.pdf", "pdf"), ("B.PDF", "pdf"), (".pdf", "image"), ("a.pdf.png", "image"), ("a", "image"), ("d.pdf/x", "image")])
def test_suffix(spark, name, kind):
    assert one(spark, text.file_kind(F.col("p")), p=F.lit(f"/in/{name}")) == kind


def test_strip(spark):
    assert one(spark, text.strip(F.col("t")), t=F.lit(" \t\x1c a b　\n")) == "a b"


@pytest.mark.parametrize("classes,want", [([0, 0, 3, 0, 1], "aab"), ([3], ""), ([0, 0, 0], "a"), ([2, 1, 1, 2], "cbc")])
def test_ctc_repeats_and_blanks(spark, classes, want):
    logits = [[4.0 if c == k else 0.0 for c in range(4)] for k in classes]
    df = spark.createDataFrame([(logits,)], "x array<array<double>>")
    got = df.select(ctc_sql.text(F.col("x"), "abc"), ctc_sql.confidence(F.col("x"))).first()
    assert got[0] == want == ctc(np.array(logits), "abc")[0]
    assert got[1] == pytest.approx(ctc(np.array(logits), "abc")[1])


def test_ctc_tie_takes_the_first(spark):
    df = spark.createDataFrame([([[1.0, 1.0, 0.0]],)], "x array<array<double>>")
    assert df.select(ctc_sql.text(F.col("x"), "ab")).first()[0] == "a"


def test_order_points(spark):
    flat = F.array(*(F.lit(float(v)) for v in (5, 9, 1, 1, 6, 2, 0, 8)))
    got = [(p["x"], p["y"]) for p in one(spark, geometry.order_points(geometry.points(F.col("f"))), f=flat)]
    assert got == [(1, 1), (6, 2), (5, 9), (0, 8)]
    assert kernels.order_points(np.array([(5, 9), (1, 1), (6, 2), (0, 8)])).tolist() == [[1, 1], [6, 2], [5, 9], [0, 8]]


def test_crop_edges(spark):
    flat = F.array(*(F.lit(v) for v in (-0.9, 7.99, 700.0, 3.0, 9.0, 4.0, 2.0, 2.0)))
    b = one(spark, geometry.crop_bounds(geometry.points(F.col("f")), 640, 480), f=flat)
    assert (b["x0"], b["y0"], b["x1"], b["y1"], b["empty"]) == (0, 2, 640, 7, False)


def test_text_layer(spark):
    line = lambda y, *t: {"bbox": [0.0, y, 5.0, y + 1], "spans": [{"text": s} for s in t]}
    pages = [
        (1, [{"type": 0, "lines": [line(5.0, "b"), line(1.0, "a", "x"), line(5.0, "c"), line(9.0, "  ")]}]),
        (2, [{"type": 0, "lines": [line(1.0, " ")]}, {"type": 1, "lines": [line(1.0, "picture")]}]),
        (3, None),
    ]
    r = spark.createDataFrame(pages, f"page int, blocks {BLOCKS}").select("page", layout.layer_regions(F.col("blocks")).alias("r"))
    got = r.select(layout.method(F.col("r")), layout.page_text(F.col("r"))).collect()
    assert [tuple(x) for x in got] == [("text", "ax\nb\nc"), ("ocr", ""), ("ocr", "")]


def test_width_buckets_and_zip(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate([9, 8, 8, 30, 9, 9, 12, 8, 40])], "page int, region_ord int, w int")
    got = {r["region_ord"]: r["bucket"] for r in batching.width_buckets(df, ["page"]).collect()}
    assert [got[i] for i in range(9)] == [0, 0, 0, 1, 1, 1, 1, 0, 2]
    assert len(one(spark, batching.zip_shorter(F.col("a"), F.col("b")), a=F.array(*map(F.lit, (1, 2, 3))), b=F.array(*map(F.lit, "xy")))) == 2


def test_not_a_number_is_no_text(spark):
    assert one(spark, geometry.mask(F.col("p")), p=F.lit(float("nan"))) is False


def test_components_touch_at_corners_and_holes_fill():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool)
    assert kernels.components(m)[1] == 3
    ring = np.ones((9, 9), bool)
    ring[2:7, 2:7] = False
    assert kernels.filled(ring).all() and not kernels.filled(np.zeros((3, 3), bool)).any()


def test_only_outer_regions_have_boxes():
    """A ring with a blob in its hole is one region; the blob beside it is another."""
    m = np.zeros((60, 90), bool)
    m[5:45, 5:45], m[12:38, 12:38], m[20:30, 20:30], m[10:40, 60:80] = True, False, True, True
    label, n = kernels.components(m)
    assert n == 3 and kernels.external(label, n).tolist() == [1, 2]
    assert len(kernels.boxes(m.astype(float), 1, 1, 90, 60)) == 2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32), st.booleans())
def test_components_by_definition(h, w, seed, corners):
    m = np.random.default_rng(seed).random((h, w)) < 0.5
    want, n = np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m)):
        if not want[y, x]:
            n, todo = n + 1, [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < h and 0 <= b < w and m[a, b] and not want[a, b]:
                    want[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not (i and j)]
    got, k = kernels.components(m, corners)
    assert k == n and (got == want).all()


def test_a_large_page_is_quick():
    import time

    page = np.zeros((2200, 1600))
    for y in range(10, 2190, 40):
        for x in range(10, 1560, 45):
            page[y : y + 24, x : x + 36] = 0.9
    began = time.process_time()
    found = kernels.boxes(page, 1, 1, 1600, 2200)
    assert len(found) == 55 * 35 and time.process_time() - began < 6
    frame = np.pad(np.zeros((1480, 1480), bool), 10, constant_values=True)
    began = time.process_time()
    assert kernels.filled(frame).all() and time.process_time() - began < 1


def test_missing_models_are_said_at_once(spark, capsys, tmp_path):
    with pytest.raises(ValueError, match="'dbnet-onnx' needs: model"):
        OCRPipeline(spark=spark)
    with pytest.raises(ValueError, match="'crnn' needs: model, vocabulary"):
        OCRPipeline(spark=spark, onnx=False, model="m.pt")
    with pytest.raises(ValueError, match="there are: blank, crnn, crnn-onnx, onnx"):
        OCRPipeline(spark=spark, detector="dark", recognizer="none")
    (tmp_path / "a.png").write_bytes(encode_png(box_image()))
    assert cli.main([str(tmp_path / "a.png")]) == 1 and "needs: model" in capsys.readouterr().err
    assert {"dbnet", "dbnet-onnx"} <= set(REGISTRY.list_detectors()) and {"crnn", "crnn-onnx"} <= set(REGISTRY.list_recognizers())


class Stand:
    """Stands for a model run: darkness as probability, and logits that spell ab."""

    def __init__(self, model, gpu):
        self.model = model

    def __call__(self, x):
        if self.model == "detector":
            grey = x[0].transpose(1, 2, 0) * np.array([0.229, 0.224, 0.225]) + [0.485, 0.456, 0.406]
            return (1 - grey.mean(2))[None, None].astype(np.float32)
        return np.tile(np.eye(3, dtype=np.float32)[[0, 2, 1]] * 9, (len(x), 1, 1))


def test_model_classes_prepare_and_decode(monkeypatch, tmp_path):
    from pagemill.backends import OnnxDetector, OnnxRecognizer, TorchDetector

    monkeypatch.setattr(OnnxDetector, "runner", Stand)
    monkeypatch.setattr(OnnxRecognizer, "runner", Stand)
    quads = OnnxDetector("detector").detect(box_image())
    assert len(quads) == 1 and quads[0][0][0] < 50 and quads[0][2][0] > 350
    (tmp_path / "letters.txt").write_text("ab\n")
    for letters in ("ab", str(tmp_path / "letters.txt")):
        got = OnnxRecognizer("recognizer", letters).recognize(box_image(), [*quads, np.zeros((4, 2)), *quads * 5])
        assert [t for t, _ in got] == ["ab", "", *["ab"] * 5] and got[0][1] > 0.9 and got[1][1] == 0
    with pytest.raises(ImportError, match="torch"):
        TorchDetector("m.pt")


class Paper:
    """Stands for an open PDF: odd pages with a text layer, even ones blank."""

    page_count = 7

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def __getitem__(self, i):
        return Sheet(i)


class Sheet:
    def __init__(self, i):
        self.i = i

    def get_text(self, _):
        lines = [{"bbox": (0, y, 9, y + 1), "spans": [{"text": f"p{self.i + 1} l{y}"}]} for y in (2, 1)] if self.i % 2 == 0 else []
        return {"blocks": [{"type": 0, "lines": lines}, {"type": 1}]}

    def get_pixmap(self, matrix):
        import types

        image = box_image()
        return types.SimpleNamespace(samples=image.tobytes(), height=200, width=400, n=3)


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_pdf_by_ranges(monkeypatch, parts):
    import sys
    import types

    import pyarrow as pa

    from pagemill.plans import pipeline
    from pagemill.sources import images
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    monkeypatch.setattr(images, "open_pdf", lambda data: Paper())
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(Matrix=lambda *a: a))
    shape = to_arrow_schema(_parse_datatype_string(pipeline.RAW))
    for forced in (False, True):
        run = pipeline._read(("dark", {}), ("blank", {}), 200, forced, parts, shape)
        rows = pa.record_batch({"path": ["a.pdf"] * parts, "content": [b""] * parts, "kind": ["pdf"] * parts, "part": list(range(parts))})
        got = [r for b in run(iter([rows])) for r in b.to_pylist()]
        assert [r["page"] for r in got] == list(range(1, 8))
        assert [r["unit"] for r in got] == (["px"] * 7 if forced else ["pt", "px"] * 3 + ["pt"])
        assert [len(r["found"]) for r in got] == ([1] * 7 if forced else [0, 1] * 3 + [0])


def test_images_of_a_folder_in_parts(spark, tmp_path):
    from pagemill.plans.pipeline import regions

    for n in "ab":
        (tmp_path / f"{n}.png").write_bytes(encode_png(box_image()))
    assert sorted(r["region_ord"] for r in regions(files(spark, str(tmp_path)), parts=4).collect()) == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5), st.lists(st.integers(0, 2), max_size=3), st.integers(0, 1000))
def test_ctc_loss_by_all_paths(steps, target, seed):
    import itertools

    x = np.random.default_rng(seed).normal(size=(steps, 4))
    p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    total = 0.0
    for path in itertools.product(range(4), repeat=steps):
        spelled = [c for i, c in enumerate(path) if c != 3 and (not i or c != path[i - 1])]
        total += np.prod([p[i, c] for i, c in enumerate(path)]) * (spelled == target)
    assert np.exp(-kernels.ctc_loss(x, target, 3)) == pytest.approx(total, abs=1e-12)


def test_ctc_loss_expression(spark):
    """Equal to the kernel, with zero for targets that the steps cannot spell; long inputs do not underflow."""
    rng = np.random.default_rng(3)
    cases = [(rng.normal(size=(int(rng.integers(0, 9)), 4)), rng.integers(0, 3, int(rng.integers(0, 5))).tolist()) for _ in range(60)]
    cases += [(rng.normal(size=(3, 4)), [1, 1]), (rng.normal(size=(2, 4)), [1, 1]), (rng.normal(size=(2000, 4)) * 9, [0, 1, 2, 2] * 50), (np.zeros((0, 4)), [])]
    table = [(i, x.tolist(), t) for i, (x, t) in enumerate(cases)] + [(-1, None, [1]), (-2, [[1.0, 0.0, 0.0, 0.0]], None)]
    df = spark.createDataFrame(table, "i long, x array<array<double>>, t array<int>").repartition(4)
    df = df.select("i", "t", ctc_sql.loss(F.col("x"), F.col("t"), 3).alias("loss"))
    got = {r["i"]: r["loss"] for r in df.collect()}
    want = [kernels.ctc_loss(x, t, 3) for x, t in cases]
    want = [0.0 if np.isinf(w) else w for w in want]
    assert [got[i] for i in range(len(cases))] == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert got[-1] is None and got[-2] is None
    mean = np.mean([w / max(1, len(t)) for w, (_, t) in zip(want, cases)])
    assert df.select(ctc_sql.mean_loss(F.col("loss"), F.col("t"))).first()[0] == pytest.approx(mean)


def test_thumbnail():
    from pagemill.sources.images import thumbnail

    assert thumbnail(box_image()).shape == (66, 133, 3) and thumbnail(np.zeros((1, 1, 3), np.uint8)).shape == (1, 1, 3)


def test_thin_line_has_no_area():
    line = kernels.outline(np.ones((1, 100), bool))
    assert kernels.polygon_area(line) == 0
    assert kernels.boxes(np.pad(np.ones((1, 100)), 5), 1, 1, 110, 11) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=3, max_size=12), st.floats(0, 5))
def test_least_rectangle(points, grow):
    p = np.array(points)
    rect = kernels.min_area_rect(p, grow)
    size = kernels.polygon_area(rect)
    turns = [np.deg2rad(a) for a in range(0, 90, 3)]
    spans = [(np.ptp(p @ [np.cos(t), np.sin(t)]) + 2 * grow) * (np.ptp(p @ [-np.sin(t), np.cos(t)]) + 2 * grow) for t in turns]
    assert size <= min(spans) + 1e-6


def test_detector_contract():
    quads = DarkDetector().detect(box_image())
    assert len(quads) == 1
    q = quads[0]
    assert q.shape == (4, 2) and q[:, 0].min() >= 0 and q[:, 0].max() <= 400 and q[:, 1].max() <= 200
    assert q[0][0] < 50 and q[2][0] > 350
    assert DarkDetector().detect(np.full((200, 400, 3), 255, np.uint8)) == []


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 14), st.integers(1, 14), st.integers(1, 14), st.integers(1, 14), st.integers(0, 9))
def test_smooth_resize_by_definition(h, w, height, width, seed):
    """In fractions, so that halves are halves."""
    from fractions import Fraction
    from math import floor

    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)
    half = Fraction(1, 2)

    def axis(row, size):
        n, out = len(row), []
        reach = max(Fraction(n, size), 1)
        for i in range(size):
            weights = [max(0, 1 - abs(x + half - (i + half) * n / size) / reach) for x in range(n)]
            out.append(floor(sum(a * int(v) for a, v in zip(weights, row)) / sum(weights) + half))
        return out

    wide = np.array([[axis(image[y, :, c], width) for c in range(3)] for y in range(h)]).transpose(0, 2, 1)
    want = np.array([[axis(wide[:, x, c], height) for c in range(3)] for x in range(width)]).transpose(2, 0, 1)
    got = kernels.resize_smooth(image, height, width)
    assert got.dtype == np.uint8 and (got == want).all()


def test_resizes_differ_where_a_pattern_shrinks():
    """Antialiasing sees all pixels of a fine pattern; two pixels an axis do not."""
    fine = np.zeros((64, 64, 3), np.uint8)
    fine[:, ::4] = 255
    assert (kernels.resize_smooth(fine, 8, 8)[:, 1:-1] == 64).all()
    coarse = kernels.resize(fine, 8, 8)
    assert coarse.dtype == np.uint8 and (coarse == 128).all()  # halfway between pixels 3 (0) and 4 (255) of each eight
    assert (kernels.resize(fine, 64, 64) == fine).all() and (kernels.resize_smooth(fine, 64, 64) == fine).all()


def test_resize_keeps_a_flat_image():
    assert (kernels.resize_smooth(np.full((7, 5, 3), 9, np.uint8), 32, 64) == 9).all()
    assert np.allclose(kernels.resize(np.full((7, 5, 3), 9, np.uint8), 32, 64), 9)


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 9))
def test_png_round_trip(h, w, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)
    assert (decode_png(encode_png(image)) == image).all()


def test_registry():
    r = Registry()
    r.register_detector("d", DarkDetector)
    r.register_recognizer("r", BlankRecognizer)
    assert r.get("detector", "d") is r.get("detector", "d")
    before = r.get("detector", "d")
    r.register_detector("d", DarkDetector)
    assert r.get("detector", "d") is not before
    with pytest.raises(ValueError, match="there are: r"):
        r.get("recognizer", "x")


def test_files_to_json(spark, tmp_path, capsys):
    path = tmp_path / "page.png"
    path.write_bytes(encode_png(box_image()))
    stubs = {"detector": "dark", "recognizer": "blank"}
    run = OCRPipeline(spark=spark, **stubs)
    regions = run.process_image(str(path))
    assert [set(r) for r in regions] == [{"quad", "text", "confidence"}]
    assert regions[0]["text"] == "" and regions[0]["confidence"] == 0.0
    assert run.get_text(str(path)) == ""
    out = tmp_path / "r.json"
    assert cli.main([str(path), "--out", str(out), "--detector", "dark", "--recognizer", "blank"]) == 0
    assert json.loads(out.read_text()) == regions
    assert cli.main([]) == 1 and cli.main([str(tmp_path / "none.png")]) == 1
    assert [r["kind"] for r in files(spark, str(tmp_path / "*.png")).collect()] == ["image"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(encode_png(box_image()))
    q = ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
