"""Where the subject of a picture is, by classical means: what departs from a smooth background.

Pictures are looked at in at most ``SIDE`` pixels; boxes come out in the picture's own pixels.
"""

from __future__ import annotations

from collections import deque

import numpy as np

from weftline.functions.pixels import grey, resized

SIDE = 192


def opponent(a: np.ndarray) -> np.ndarray:
    """Lightness and two opponent colours (CIE Lab from sRGB, D65)."""
    x = (np.repeat(a[..., None], 3, axis=2) if a.ndim == 2 else a).astype(np.float64) / 255
    x = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    xyz = x @ np.array([[0.4124, 0.2126, 0.0193], [0.3576, 0.7152, 0.1192], [0.1805, 0.0722, 0.9505]]) / np.array([0.9505, 1.0, 1.089])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def ring(shape: tuple[int, int], share: float = 0.06) -> np.ndarray:
    """The border as a mask."""
    h, w = shape
    k, m = max(1, int(h * share)), max(1, int(w * share))
    out = np.ones(shape, bool)
    out[k : h - k, m : w - m] = False
    return out


def residual(x: np.ndarray) -> np.ndarray:
    """Distance of each pixel from the plane that fits the border best, in robust spreads of the border."""
    h, w = x.shape[:2]
    yy, xx = np.mgrid[0:h, 0:w]
    base = np.stack([np.ones(h * w), yy.ravel() / h, xx.ravel() / w], axis=1)
    edge = ring((h, w)).ravel()
    flat = x.reshape(h * w, -1)
    coef = np.linalg.lstsq(base[edge], flat[edge], rcond=None)[0]
    away = np.sqrt(((flat - base @ coef) ** 2).sum(axis=1))
    mid = np.median(away[edge])
    spread = max(1.0, 1.4826 * np.median(np.abs(away[edge] - mid)) + mid)
    return (away / spread).reshape(h, w)


def box_mean(x: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square window, the edges repeated."""
    n = 2 * radius + 1
    p = np.pad(x, radius, mode="edge").cumsum(axis=0).cumsum(axis=1)
    p = np.pad(p, ((1, 0), (1, 0)))
    return (p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]) / (n * n)


def texture(g: np.ndarray, radius: int = 3) -> np.ndarray:
    """Local deviation of brightness."""
    m = box_mean(g, radius)
    return np.sqrt(np.maximum(box_mean(g * g, radius) - m * m, 0))


def closed(mask: np.ndarray, radius: int = 2) -> np.ndarray:
    """Small holes filled, then small specks removed."""
    grown = box_mean(mask.astype(float), radius) > 1e-9
    closed_ = box_mean(grown.astype(float), radius) > 1 - 1e-9
    opened = box_mean((closed_ | mask).astype(float), 1) > 0.5
    return opened


def components(mask: np.ndarray) -> list[np.ndarray]:
    """Connected regions (four neighbours), the largest first, as arrays of (row, column)."""
    seen, out = ~mask, []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        own, queue = [], deque([(y, x)])
        seen[y, x] = True
        while queue:
            i, j = queue.popleft()
            own.append((i, j))
            for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and not seen[a, b]:
                    seen[a, b] = True
                    queue.append((a, b))
        out.append(np.array(own))
    return sorted(out, key=len, reverse=True)


def _small(a: np.ndarray) -> tuple[np.ndarray, float]:
    h, w = a.shape[:2]
    s = max(1.0, max(h, w) / SIDE)
    return (a if s == 1 else np.clip(resized(a, max(2, round(h / s)), max(2, round(w / s))), 0, 255).astype(np.uint8)), s


def _box(points: np.ndarray, scale: float, shape: tuple[int, ...]) -> tuple[int, int, int, int]:
    (t, l), (b, r) = points.min(axis=0), points.max(axis=0) + 1
    y, x = int(t * scale), int(l * scale)
    return x, y, min(shape[1], int(np.ceil(r * scale))) - x, min(shape[0], int(np.ceil(b * scale))) - y


def detect(a: np.ndarray, colour: tuple[int, int, int] | None = None, background: str | None = None) -> dict:
    """Box and confidence of the subject; the whole picture with confidence 0 if nothing departs.

    The threshold falls in steps until enough of the picture departs in colour or texture. A hint of the
    subject's colour adds pixels near it; a flat background lets the search start lower.
    """
    small, scale = _small(a)
    lab = opponent(small)
    away, rough = residual(lab), texture(grey(small))
    near = None if colour is None else np.sqrt(((lab - opponent(np.array([[colour]], np.uint8))[0, 0]) ** 2).sum(axis=2)) < 18
    start = 4.0 if background == "SOLIDCOLOR" else 6.0
    for step, threshold in enumerate((start, start / 1.5, start / 2.25)):
        mask = (away > threshold) | ((rough > 0.08) & (away > threshold / 2))
        if near is not None:
            mask |= near & (away > 1.5)
        parts = components(closed(mask))
        parts = [p for p in parts if len(p) >= 0.002 * mask.size and len(p) >= 0.1 * len(parts[0])]
        area = sum(map(len, parts))
        if area >= 0.01 * mask.size:
            box = _box(np.concatenate(parts), scale, a.shape)
            filled = area / max(1, box[2] * box[3] / scale**2)
            return {"box": box, "confidence": round(float(min(1.0, 0.4 + 0.6 * filled) / (1 + 0.25 * step)), 4)}
    return {"box": (0, 0, a.shape[1], a.shape[0]), "confidence": 0.0}


def salient_box(a: np.ndarray, share: float = 0.5) -> tuple[int, int, int, int]:
    """Box of what stands out in local contrast near edges."""
    small, scale = _small(a)
    g = grey(small)
    contrast = np.abs(g - box_mean(g, max(2, min(g.shape) // 8)))
    dy, dx = np.gradient(g)
    edges = box_mean((np.hypot(dx, dy) > 0.08).astype(float), 2) > 0
    z = contrast * edges
    if z.max() <= 1e-9:
        return 0, 0, a.shape[1], a.shape[0]
    score = 1 / (1 + np.exp(-(z / z.max() - 0.25) * 12))
    points = np.argwhere((score > share) & edges)
    return _box(points, scale, a.shape) if len(points) else (0, 0, a.shape[1], a.shape[0])


def interior(a: np.ndarray, least: float = 2.0) -> tuple[int, int, int, int] | None:
    """The patch, among squares of several sizes, that is more varied than the ring around it; None if none is
    ``least`` times as varied."""
    small, scale = _small(a)
    g, best, found = grey(small), least, None
    h, w = g.shape
    for part in (0.25, 0.4, 0.6):
        n = max(2, int(min(h, w) * part))
        for y in range(0, h - n + 1, max(1, n // 4)):
            for x in range(0, w - n + 1, max(1, n // 4)):
                inner = g[y : y + n, x : x + n]
                m = max(1, n // 4)
                outer = g[max(0, y - m) : y + n + m, max(0, x - m) : x + n + m]
                around = max(1e-4, (outer.var() * outer.size - inner.var() * inner.size) / max(1, outer.size - inner.size))
                ratio = inner.var() / around
                if outer.size > inner.size and inner.var() > 1e-3 and ratio > best:
                    best, found = ratio, (y, x, n)
    if not found:
        return None
    y, x, n = found
    return int(x * scale), int(y * scale), int(n * scale), int(n * scale)


def promoted(legacy: tuple[int, int, int, int], found: dict, shape: tuple[int, int], least: float = 0.35) -> tuple[int, int, int, int]:
    """The detected box in place of an earlier one, if it is sure enough and no mere whole picture."""
    whole = found["box"] == (0, 0, shape[1], shape[0])
    return found["box"] if not whole and found["confidence"] >= least else legacy
