"""Image and PDF bytes to rasters and text layers. Runs in Arrow-fed Python workers; libraries are imported there."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode_png(image: np.ndarray) -> bytes:
    """RGB uint8 as PNG, no filter."""
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image, np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """8-bit PNG without interlacing to RGB; alpha is dropped."""
    at, idat, palette, head = 8, [], None, None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG without interlacing is read without Pillow")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    for y in range(h):
        out[y] = _unfilter(raw[y, 0], raw[y, 1:], out[y - 1] if y else np.zeros(w * channels, np.uint8), channels)
    out = out.reshape(h, w, channels)
    if palette is not None:
        return palette[out[..., 0]]
    return out[..., :3] if channels >= 3 else np.repeat(out[..., :1], 3, 2)


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + up
    out = line.astype(np.int32)
    above = up.astype(np.int32)
    for i in range(len(out)):
        a = int(out[i - n]) if i >= n else 0
        c = int(above[i - n]) if i >= n else 0
        b = int(above[i])
        if kind == 1:
            guess = a
        elif kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """RGB uint8 of an image file. PNG needs no library; other formats need Pillow."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        try:
            return decode_png(data)
        except ValueError:
            pass
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise ImportError("reading this image format needs Pillow") from e
    return np.array(Image.open(io.BytesIO(data)).convert("RGB"))


def open_pdf(data: bytes):
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF files needs PyMuPDF") from e
    return fitz.open(stream=data, filetype="pdf")


def pdf_pages(data: bytes, dpi: int, force_ocr: bool, part: int = 0, parts: int = 1):
    """(page from 1, blocks, raster or None) of each page in one of ``parts`` even ranges; a raster only where the layer has no
    text or ocr is forced."""
    with open_pdf(data) as doc:
        n = doc.page_count
        for i in range(part * n // parts, (part + 1) * n // parts):
            page = doc[i]
            blocks = [{"type": b["type"], "lines": [{"bbox": [float(v) for v in n["bbox"]], "spans": [{"text": s.get("text", "")} for s in n["spans"]]} for n in b.get("lines", [])]} for b in page.get_text("dict")["blocks"]]
            blank = not any("".join(s["text"] for s in n["spans"]).strip() for b in blocks if b["type"] == 0 for n in b["lines"])
            image = None
            if blank or force_ocr:
                import fitz

                pix = page.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72))
                image = np.frombuffer(pix.samples, np.uint8).reshape(pix.height, pix.width, pix.n)[:, :, :3]
            yield i + 1, blocks, image


def thumbnail(image: np.ndarray, by: int = 3) -> np.ndarray:
    """The image with its sides divided, for a look at marked regions."""
    from ..operators.kernels import resize

    h, w = image.shape[:2]
    return np.clip(np.rint(resize(image, max(1, h // by), max(1, w // by))), 0, 255).astype(np.uint8)
