"""Array kernels for which Spark has no expression: regions of a mask, rectangles, resizing. NumPy only."""

from __future__ import annotations

import numpy as np

from ..params import DEFAULT, Params


def components(mask: np.ndarray, corners: bool = True) -> tuple[np.ndarray, int]:
    """Labels (0: none) of connected regions, numbered by their first pixel; by runs of rows and union-find.

    Regions are joined over edges and, with ``corners``, over corners too.
    """
    mask = np.asarray(mask, bool)
    out = np.zeros(mask.shape, np.int32)
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    y, x0 = np.nonzero(step == 1)
    x1 = np.nonzero(step == -1)[1]
    if not len(y):
        return out, 0
    # runs of the row above that a run touches are neighbours in the list of all runs
    line, reach = mask.shape[1] + 3, int(corners)
    lo = np.searchsorted(y * line + x1, (y - 1) * line + x0 + 1 - reach, "left")
    hi = np.searchsorted(y * line + x0, (y - 1) * line + x1 - 1 + reach, "right")
    many = np.where(y > 0, np.maximum(hi - lo, 0), 0)
    parent = list(range(len(y)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for k in np.flatnonzero(many).tolist():
        for j in range(int(lo[k]), int(lo[k] + many[k])):
            r, s = sorted((find(j), find(k)))
            parent[s] = r
    roots, name = np.unique([find(k) for k in range(len(y))], return_inverse=True)
    size = x1 - x0
    first = y * mask.shape[1] + x0
    out.ravel()[np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = np.repeat(name + 1, size)
    return out, len(roots)


def outside(mask: np.ndarray) -> np.ndarray:
    """Pixels off the mask that the frame reaches over edges."""
    label = components(np.pad(~np.asarray(mask, bool), 1, constant_values=True), corners=False)[0]
    return label[1:-1, 1:-1] == label[0, 0]


def filled(region: np.ndarray) -> np.ndarray:
    """The region with its holes: all that the outside does not reach."""
    return ~outside(region)


def external(label: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the regions that border on the outside; those in a hole of another do not."""
    free = np.pad(outside(label > 0), 1, constant_values=True)
    seen = free[:-2, 1:-1] | free[2:, 1:-1] | free[1:-1, :-2] | free[1:-1, 2:]
    return np.setdiff1d(np.unique(label[seen]), [0])


STEPS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def outline(region: np.ndarray) -> np.ndarray:
    """Pixel centres round a filled region, clockwise on screen, as (x, y)."""
    ys, xs = np.nonzero(region)
    start = (int(xs[0]), int(ys[0]))
    inside = lambda x, y: 0 <= y < region.shape[0] and 0 <= x < region.shape[1] and region[y, x]
    path, at, face = [start], start, 0
    first = None
    while True:
        for turn in range(8):
            d = (face + 6 + turn) % 8
            x, y = at[0] + STEPS[d][0], at[1] + STEPS[d][1]
            if inside(x, y):
                break
        else:
            return np.array(path)
        if (at, d) == first:
            return np.array(path[:-1] if len(path) > 1 else path)
        first = first or (at, d)
        at, face = (x, y), d
        path.append(at)


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0].astype(float), p[:, 1].astype(float)
    return abs(float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))) / 2


def polygon_length(p: np.ndarray) -> float:
    return float(np.hypot(*(p - np.roll(p, -1, 0)).T.astype(float)).sum())


def hull(p: np.ndarray) -> np.ndarray:
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def min_area_rect(p: np.ndarray, grow: float = 0.0) -> np.ndarray:
    """Corners of the least rectangle round the points after growing them by ``grow`` with round joins.

    Growing adds the same to every direction's support, so the least one still lies along an edge of the hull.
    """
    h = hull(p)
    if len(h) == 1:
        h = np.repeat(h, 2, 0)
    edges = np.roll(h, -1, 0) - h
    best = None
    for e in edges:
        n = np.hypot(*e)
        u = e / n if n else np.array([1.0, 0.0])
        v = np.array([-u[1], u[0]])
        a, b = h @ u, h @ v
        box = a.min() - grow, a.max() + grow, b.min() - grow, b.max() + grow
        size = (box[1] - box[0]) * (box[3] - box[2])
        if best is None or size < best[0] - 1e-9:
            best = size, u, v, box
    _, u, v, (a0, a1, b0, b1) = best
    return np.array([u * a + v * b for a, b in ((a0, b0), (a1, b0), (a1, b1), (a0, b1))])


def order_points(q: np.ndarray) -> np.ndarray:
    by_y = q[np.argsort(q[:, 1], kind="stable")]
    top, low = (h[np.argsort(h[:, 0], kind="stable")] for h in (by_y[:2], by_y[2:]))
    return np.concatenate([top, low[::-1]])


def boxes(prob: np.ndarray, sx: float, sy: float, width: int, height: int, params: Params = DEFAULT) -> list[np.ndarray]:
    """Quads (4 x 2 float32, from top left clockwise) of a probability map, in pixels of the original image."""
    with np.errstate(invalid="ignore"):
        label, n = components(prob > params.threshold)
    out = []
    ys, xs = np.nonzero(label)
    order = np.argsort(label[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    cuts = np.searchsorted(label[ys, xs], np.arange(1, n + 1))
    tops, lows, lefts, rights = (f.reduceat(v, cuts) if n else v for f, v in ((np.minimum, ys), (np.maximum, ys), (np.minimum, xs), (np.maximum, xs)))
    for k in external(label, n).tolist():
        y0, x0 = tops[k - 1], lefts[k - 1]
        region = filled(label[y0 : lows[k - 1] + 1, x0 : rights[k - 1] + 1] == k)
        line = outline(region) + [x0, y0]
        size = polygon_area(line)
        if size < params.min_area:
            continue
        part = prob[y0 : y0 + region.shape[0], x0 : x0 + region.shape[1]]
        if float(part[region].sum() / (region.sum() + 1e-6)) < params.box_threshold:
            continue
        length = polygon_length(line)
        grow = size * params.unclip_ratio / length if size >= 1 and length >= 1 else 0.0
        quad = min_area_rect(line, grow) * [sx, sy]
        quad[:, 0], quad[:, 1] = np.clip(quad[:, 0], 0, width), np.clip(quad[:, 1], 0, height)
        out.append(order_points(quad.astype(np.float32)))
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, by pixel centres, edges repeated, two pixels an axis whatever the size; bytes are rounded to bytes."""
    whole = image.dtype == np.uint8
    image = image.astype(np.float32)
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    image = image.reshape(h, w, -1)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    out = top * (1 - fy) + low * fy
    return np.floor(out + 0.5).astype(np.uint8) if whole else out


def _smooth(image: np.ndarray, size: int) -> np.ndarray:
    """The second axis of bytes (rows, n, channels) brought to a size by a triangle that widens as the axis shrinks."""
    n = image.shape[1]
    reach = max(n / size, 1.0)
    middle = (np.arange(size) + 0.5) * n / size
    first = np.floor(middle - reach + 0.5).astype(int)
    total, weights = np.zeros((image.shape[0], size, image.shape[2])), np.zeros(size)
    for k in range(int(np.ceil(2 * reach)) + 1):  # tap by tap, so that no more than one image is held besides
        at = first + k
        weight = np.maximum(0, 1 - np.abs(at + 0.5 - middle) / reach) * ((at >= 0) & (at < n))
        total += image[:, np.clip(at, 0, n - 1)] * weight[:, None]
        weights += weight
    return np.floor(total / weights[:, None] + 0.5 + 1e-9).astype(np.uint8)  # halves go up, whatever the sum's last bits


def resize_smooth(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Antialiased bilinear resizing of bytes (h, w, channels): the width first, then the height, each rounded to bytes."""
    return _smooth(_smooth(image, width).transpose(1, 0, 2), height).transpose(1, 0, 2)


def ctc_loss(logits: np.ndarray, target: list[int], blank: int) -> float:
    """Negative log probability that the steps spell the target, over all alignments; infinite where none fits."""
    x = logits.astype(float)
    logp = x - x.max(1, keepdims=True)
    logp -= np.log(np.exp(logp).sum(1, keepdims=True))
    marks = [blank, *(c for t in target for c in (t, blank))]
    skip = np.array([i > 1 and c != blank and c != marks[i - 2] for i, c in enumerate(marks)])
    now = np.full(len(marks), -np.inf)
    now[0] = 0.0
    for t, step in enumerate(logp[:, marks]):
        if t:
            one, two = np.append(-np.inf, now[:-1]), np.where(skip, np.append([-np.inf] * 2, now[:-2])[: len(now)], -np.inf)
            now = np.logaddexp(np.logaddexp(now, one), two) + step
        else:
            now[:2] = step[:2]
    return float(-np.logaddexp.reduce(now[-2:])) if len(x) else (0.0 if not target else float("inf"))
